import random

import pytest

import __spark_entry__
import corpus_pipeline as cp
from versio.llm import queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    r = random.Random(1)
    words = [f"wort{i}" for i in range(500)]
    bad = [f"schimpf{i}" for i in range(6)]
    rows, labels = [], []
    for i in range(700):
        w = [r.choice(words) for _ in range(r.randrange(60, 120))]
        if i % 7 == 0:
            for _ in range(5):
                w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append([i, " ".join(w[:30]) + "\n" + " ".join(w[30:])])
        labels.append((i, int(i % 7 == 0)))
    copy, near = rows[1][1], rows[2][1].split(" ")
    near[40] = "anders"
    item = " ".join(r.choice(words) for _ in range(15))
    rows += [[2000, copy], [2001, copy], [2002, " ".join(near)], [2003, rows[3][1] + "\n" + item], [2004, None], [2005, ""], [None, "eigener text ohne nummer"], [3, rows[3][1]]]
    full = [(i, t, "de", "s", None if t is None else len(t), "extra", 0.5) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, sp_ids string, toxicity double").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, item, rows


def test_stages_and_their_decisions(spark, tables):
    d, item, rows = tables
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), []
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, d)
        if k < len(cp.STAGES) - 1:
            assert out.columns == list(cp.COLUMNS)
        out.write.parquet(f"{d}/stage{k}")
        docs = spark.read.parquet(f"{d}/stage{k}")
        kept.append([r["doc_id"] for r in docs.select("doc_id").collect()])
    toxic = {i for i, _ in rows if i is not None and i < 700 and i % 7 == 0}
    assert len(toxic - set(kept[0])) > 0.9 * len(toxic) and len([i for i in kept[0] if i not in toxic]) > 0.97 * (len(rows) - len(toxic))
    lines = set(kept[0]) - set(kept[1])
    assert {2000, 2001} <= lines and lines <= {2000, 2001, 2002, 3}
    clean = {i for i, _ in rows if i is not None and i < 700} & set(kept[0])
    assert clean <= set(kept[1]) | lines and clean - lines <= set(kept[2]) | {2002}
    assert set(kept[2]) - set(kept[3]) == {2003} and sorted(map(repr, kept[4])) == sorted(map(repr, kept[3]))
    assert len(kept[3]) == len(set(kept[3])) and None in kept[3]
    assert all(r["lossless"] for r in docs.collect())
    chars = {r["doc_id"]: (r["text"], r["n_chars"]) for r in spark.read.parquet(f"{d}/stage2").collect()}
    assert all(t is None or len(t) == n for t, n in chars.values())


def test_run_gives_the_last_stage(spark, tables):
    d, _, _ = tables
    assert {r["doc_id"] for r in cp.run(spark, d).collect()} == {r["doc_id"] for r in spark.read.parquet(f"{d}/stage4").collect()}


def test_stages_take_empty_tables(spark, tables, tmp_path):
    d, _, _ = tables
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in cp.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_all_ten_and_the_pipeline_are_registered():
    names = list(queries.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(names) <= set(__spark_entry__.queries()) and set(queries.oracle_sql()) <= set(names)
