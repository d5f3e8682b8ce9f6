import random
import zlib

import numpy as np
import pytest

from versio.llm import toxicity as tox


def corpus(n=1600, seed=1):
    r = random.Random(seed)
    words = [f"wort{i}" for i in range(400)]
    bad = [f"schimpf{i}" for i in range(6)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 8 == 0
        w = [r.choice(words) for _ in range(r.randrange(20, 120))]
        if toxic:
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def scored(spark):
    rows, labels = corpus()
    rows = rows + [(5000, None), (5001, ""), (5002, "!!"), (None, "schimpf1 schimpf2 schimpf3 schimpf0"), (5003, "wort1 " * 60_000), (7, rows[7][1])]
    known = [(d, t) for d, t in labels if d % 3] + [(1, None), (None, 1), (8, 0), (8, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS toxic", "'y' AS toxicity")
    out = tox.toxicity(docs, spark.createDataFrame(known, "doc_id long, toxic int"))
    return [r.asDict() for r in out.select("doc_id", "toxicity", tox.held_out(out["doc_id"]).alias("held")).collect()], labels


def test_held_out_accuracy(scored):
    got, labels = scored
    truth = dict(labels)
    own = [(r["toxicity"], truth[r["doc_id"]]) for r in got if r["doc_id"] in truth and r["held"]]
    bad, fine = np.array([s for s, t in own if t]), np.array([s for s, t in own if not t])
    assert (bad[:, None] > fine).mean() > 0.97
    assert (bad >= tox.THRESHOLD).mean() > 0.9 and (fine < tox.THRESHOLD).mean() > 0.97


def test_every_row_has_one_score_in_range(scored):
    got, _ = scored
    assert len(got) == 1606 and all(0 <= r["toxicity"] <= 1 for r in got)
    by = {r["doc_id"]: r["toxicity"] for r in got}
    assert by[5000] == by[5001] == by[5002] < tox.THRESHOLD and by[None] >= tox.THRESHOLD
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)


def test_held_out_labels_do_not_matter(spark):
    rows, labels = corpus(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    other = [(d, 1 - t if zlib.crc32(str(d).encode()) % 4 == 2 else t) for d, t in labels]
    a, b = (tox.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, other))
    assert all((x == y).all() for x, y in zip(a, b, strict=True))


def test_no_positives_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["toxicity"] for r in tox.toxicity(docs, none).collect()] == [0.0, 0.0]
    assert tox.toxicity(docs.limit(0), none).count() == 0


def test_negative_part_of_the_risk_does_not_run_away():
    r = np.random.default_rng(0)
    n, f = 400, 2000  # more features than texts: an unconstrained PU risk would fall without end
    positive = np.arange(n) < 60
    doc = np.repeat(np.arange(n), 30)
    feature = r.integers(0, f, len(doc))
    w, b = tox.nnpu(positive, doc, feature, f, 0.1)
    z = np.bincount(doc, w[feature], n) + b
    clean = np.log1p(np.exp(z[~positive])).mean() - 0.1 * np.log1p(np.exp(z[positive])).mean()
    assert clean > -0.05
