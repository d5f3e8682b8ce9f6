"""Keyed tables: dense positions (P9), scoring without exchange (J3), the ledger (E1, S7), requests in normal form
(F5), tasks of equal cost (X1), files that our own readers accept (S2, S7), one-pass quarantine (S6)."""
import json
import os
import re
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from conftest import SF001, write_lines
from versio import session
from versio.functions import prompts as P
from versio.functions.chrf import batch_stats, segment_stats
from versio.operators import chrf, infer
from versio.operators.directions import expand_directions, shot_sweep
from versio.plans import jobs
from versio.sources import keyed, readers, sinks
from versio.sources.corpus import first_documents, fixture_corpus, ingest_jsonl, keyed_fixture_corpus, scan_parallel, write_keyed_corpus
from versio.sources.ordinals import rank_integers

cloudpickle.register_pickle_by_value(sys.modules[__name__])

USER = P.DEFAULT_CHAT_MARKUP["open"].replace("{role}", "user")
COPY = infer.CopyBetween(USER, P.DEFAULT_CHAT_MARKUP["close"])


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(plan):
    """The lines of a plan's first tree that send rows over the network, each with the node right below."""
    lines = plan.split("\n")
    return [lines[i] + lines[i + 1] for i, x in enumerate(lines[:-1]) if "Exchange" in x]


def test_positions_are_dense_and_pushed(spark, tmp):
    rows = [("dev" if i % 3 else "test", "eng_hin" if i % 2 else "eng_tam", i * 7, f"s{i}", f"t{i}") for i in range(200)]
    corpus = spark.createDataFrame(rows, "subset string, pair string, ordinal long, src_txt string, tgt_txt string")
    write_keyed_corpus(corpus, tmp + "/c", buckets=4)
    back = keyed.read_keyed(spark, tmp + "/c")
    for r in back.groupBy("subset", "pair").agg(F.sort_array(F.collect_list(F.struct("ordinal", "position"))).alias("x")).collect():
        assert [p for _, p in r.x] == list(range(len(r.x)))
    first = first_documents(back, 5)
    plan = plan_of(first)
    assert "LessThan(position,5)" in plan and "Window" not in plan and "Exchange" not in plan
    assert sorted(map(tuple, first.select("subset", "pair", "ordinal").collect())) == sorted(
        t for s in ("dev", "test") for p in ("eng_hin", "eng_tam") for t in sorted((s, p, r[2]) for r in rows if r[:2] == (s, p))[:5])
    assert scan_parallel(spark, tmp + "/c", "dev", "eng_hin").count() == sum(r[:2] == ("dev", "eng_hin") for r in rows)


def test_ranks_refuse_repeated_keys(spark):
    df = spark.createDataFrame([("a", 3), ("a", 3), ("a", 4)], "g string, k long")
    with pytest.raises(Exception, match="repeated k 3"):
        rank_integers(df, "g", "k").collect()


def test_fixture_positions_equal_those_ranked_on_rows(spark, tmp):
    from versio.sources.corpus import pair_documents_with_positions, table
    from versio.sources.ordinals import dense_positions
    want = dense_positions(fixture_corpus(spark, SF001), ["subset", "pair"], "ordinal")
    got = pair_documents_with_positions(table(spark, SF001, "documents")).select(*want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_scoring_exchanges_no_text(spark, tmp):
    corpus = keyed_fixture_corpus(spark, SF001, tmp + "/corpus")
    preds = expand_directions(corpus.where("subset = 'test'")).withColumn("k", F.lit(1)).withColumn("pred", F.concat("src", F.lit(" x")))
    sinks.write_predictions(sinks.run_layout(preds, "m"), tmp + "/preds")
    cfg = jobs.JobConfig(ks=[1], model="m")
    stored = jobs.read_predictions(spark, tmp + "/preds", cfg)
    scores = chrf.score_runs(stored, corpus, [(1,)], ["k"])
    scores.collect()
    moved = exchanges(plan_of(scores))
    assert moved and not [x for x in moved if re.search(r"\b(pred|src_txt|tgt_txt|_ref|_h|_r)#", x)]
    assert "SortMergeJoin" in plan_of(scores) and "Bucketed: true" in plan_of(scores)
    refs = jobs.references(corpus, [1])
    cols = ["pair", "direction", "k", "n_ref", "n_hyp", "n_segments", "status", "chrf"]
    assert sorted(map(tuple, scores.select(*cols).collect())) == sorted(map(tuple, jobs.score(stored, refs).select(*cols).collect()))


def test_a_table_keeps_its_buckets_in_any_session(spark, tmp):
    a = spark.range(100).select(F.lit("eng_x").alias("pair"), F.col("id").alias("ordinal")).withColumn("doc_key", keyed.doc_key())
    keyed.write_keyed(a, tmp + "/t", ["pair"], ["ordinal"], buckets=5)
    for t in spark.catalog.listTables():
        if t.name.startswith("versio_"):
            spark.sql(f"DROP TABLE {t.name}")
    keyed.write_keyed(a.where("ordinal < 9"), tmp + "/t", ["pair"])
    back = keyed.read_keyed(spark, tmp + "/t")
    assert back.count() == 109 and "SelectedBucketsCount: 5 out of 5" in plan_of(back.groupBy("doc_key").count())
    assert back.join(back.select("doc_key").distinct(), "doc_key").count() == 109
    with pytest.raises(ValueError, match="another layout"):
        keyed.write_keyed(a, tmp + "/t", ["pair"], buckets=7)


def test_texts_that_runs_share_are_counted_once(spark, tmp):
    corpus = spark.createDataFrame([("test", "eng_x", i, f"source {i}", f"quelle {i}") for i in range(30)],
                                   "subset string, pair string, ordinal long, src_txt string, tgt_txt string").withColumn("doc_key", keyed.doc_key())
    runs = [("a", 0), ("a", 1), ("b", 0)]
    preds = expand_directions(corpus).select("doc_key", "direction", F.col("src").alias("pred"))
    preds = preds.withColumn("r", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(k).alias("k")) for m, k in runs]))).select("*", "r.*")
    scores = chrf.score_runs(preds, corpus, runs, ["model", "k"])
    seen = spark.sparkContext.accumulator(0)
    original = chrf.batch_stats

    def counting(hyps, refs):
        seen.add(len(hyps))
        return original(hyps, refs)

    chrf.batch_stats = counting
    try:
        rows = chrf.score_runs(preds, corpus, runs, ["model", "k"]).collect()
    finally:
        chrf.batch_stats = original
    assert seen.value == 60 and len(rows) == 6 == scores.count()
    assert len({r.chrf for r in rows if r.direction == "eng_2_x"}) == 1 and all(r.status == "ok" and r.n_hyp == 30 for r in rows)


# --- X1: tasks of equal cost ---------------------------------------------------------


def test_skewed_prompts_in_one_split_become_tasks_of_equal_cost(spark):
    n = 6000
    rng = np.random.default_rng(5)
    sizes = np.minimum(4000, rng.pareto(1.1, n) * 40 + 1).astype(int).tolist()
    df = spark.createDataFrame([("eng_2_x", i, "p" * s) for i, s in enumerate(sizes)], "direction string, ordinal long, prompt string").coalesce(1)
    dealt = infer.balanced(df.withColumn("cost", F.length("prompt").cast("long")), "cost", ["direction", "ordinal"], 16)
    per = [r.c for r in dealt.groupBy(F.spark_partition_id().alias("t")).agg(F.sum("cost").alias("c")).collect()]
    assert len(per) == 16 and max(per) < 2 * np.median(per)
    lengths = dealt.select(F.spark_partition_id().alias("t"), F.monotonically_increasing_id().alias("i"), "cost").collect()
    for t in range(16):
        mine = [r.cost for r in sorted((r for r in lengths if r.t == t), key=lambda r: r.i)]
        assert mine == sorted(mine, reverse=True)
    same = lambda d: sorted((r.ordinal, r.output) for r in infer.generate(d, "prompt", COPY, ["direction", "ordinal"]).collect())
    assert same(dealt) == same(df) and dealt.count() == n
    assert infer.balanced(df.limit(0).withColumn("cost", F.lit(1)), "cost", ["ordinal"], 4).count() == 0


# --- F5: requests in normal form; E1, S7: units and the ledger ------------------------


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs)


def parallel(spark, n, words=20):
    rows = [("test" if i % 5 else "dev", "eng_fr", i, " ".join(f"{i}w{j}" for j in range(words)), f"cible {i}") for i in range(n)]
    return spark.createDataFrame(rows, "subset string, pair string, ordinal long, src_txt string, tgt_txt string")


def test_stored_requests_do_not_grow_with_k(spark, tmp):
    corpus = parallel(spark, 300, 150)  # every dev text is in the word band
    made = {k: jobs.store_requests(corpus, jobs.JobConfig(ks=ks)) for k, ks in ((1, [1]), (8, [0, 1, 3, 8]))}
    stored = {k: sum(size(f.split(":", 1)[1].rsplit("/unit=", 1)[0]) for f in {x.rsplit("/", 1)[0] for x in m.documents.inputFiles()}) for k, m in made.items()}
    assert abs(stored[8] - stored[1]) < 0.02 * stored[1]
    assert made[8].sets.count() == 2 * 3 and made[8].sets.agg(F.max(F.size("blocks"))).first()[0] == 8
    from versio.operators import fewshot
    want = fewshot.build_prompts(corpus, [0, 1, 3, 8]).select(*jobs.KEYS, "prompt")
    got = fewshot.render_prompts(shot_sweep(made[8].documents, [0, 1, 3, 8]), made[8].sets).select(*jobs.KEYS, "prompt")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_units_are_bounded_key_ranges(spark):
    made = jobs.store_requests(parallel(spark, 200), jobs.JobConfig(ks=[0], dialect="bare", unit_rows=30))
    assert [u.unit for u in made.units] == list(range(11)) and all(u.n <= 30 for u in made.units) and sum(u.n for u in made.units) == 320
    ends = [(tuple(u.first), tuple(u.last)) for u in made.units]
    assert all(a <= b for a, b in ends) and all(x[1] < y[0] for x, y in zip(ends, ends[1:]))


class Scans:
    """Counts the rows that a frame's scan gives."""

    def __init__(self, spark, corpus):
        self.seen = seen = spark.sparkContext.accumulator(0)

        def count(batches):
            for pdf in batches:
                seen.add(len(pdf))
                yield pdf

        self.corpus = corpus.mapInPandas(count, corpus.schema)


def test_one_corpus_scan_for_any_number_of_units(spark, tmp):
    plain = parallel(spark, 100).withColumn("position", F.when(F.col("subset") == "dev", F.floor(F.col("ordinal") / 5)).otherwise(F.col("ordinal") - F.floor(F.col("ordinal") / 5) - 1))
    seen = {}
    for units in (2, 8):
        s = Scans(spark, plain)
        cfg = jobs.JobConfig(ks=[0], dialect="bare", resume=True, commit_units=units)
        made = jobs.store_requests(s.corpus, cfg)
        jobs.commit_units(spark, made, COPY, cfg, f"{tmp}/{units}/predictions", f"{tmp}/{units}/ledger")
        seen[units] = s.seen.value
        assert spark.read.parquet(f"{tmp}/{units}/ledger").count() == units
    assert seen[2] == seen[8]


def test_predictions_outside_the_ledger_do_not_count(spark, tmp):
    corpus = parallel(spark, 60)
    cfg = jobs.JobConfig(ks=[0, 1], dialect="bare", model="org/m", resume=True, commit_units=4)
    out = jobs.run_translation_job(spark, corpus, COPY, cfg, out_root=tmp + "/run")
    ledger = spark.read.parquet(tmp + "/run/ledger").orderBy("unit").collect()
    assert [r.unit for r in ledger] == [0, 1, 2, 3] and {r.ks for r in ledger} == {"0,1"} and sum(r.n_rows for r in ledger) == 96
    assert out["predictions"].count() == 192
    # A crash after the data and before the ledger row: the rows are there, but no unit names them.
    lost = jobs.read_predictions(spark, tmp + "/run/predictions", cfg, tmp + "/run/ledger").limit(7).withColumn("unit_id", F.lit("crashed")).withColumn("pred", F.lit("x"))
    sinks.write_predictions(sinks.run_layout(lost, "org/m"), tmp + "/run/predictions")
    again = jobs.run_translation_job(spark, corpus, COPY, cfg, out_root=tmp + "/run")
    assert again["predictions"].count() == 192 and again["predictions"].where("pred = 'x'").count() == 0
    assert spark.read.parquet(tmp + "/run/ledger").count() == 4  # nothing was pending
    more = jobs.run_translation_job(spark, corpus, COPY, jobs.JobConfig(**{**cfg.__dict__, "ks": [0, 1, 3]}), out_root=tmp + "/run")
    assert more["predictions"].count() == 288 and all(r.status == "ok" for r in more["scores"].collect())


# --- files -----------------------------------------------------------------------------


def test_corpus_and_prediction_files_come_back(spark, tmp):
    corpus = fixture_corpus(spark, SF001).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_corpus_jsonl(corpus, tmp + "/data")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(len(fs) for _, _, fs in os.walk(tmp + "/data")) > 4  # several parts and their checksums
    parallel, rejects, check = ingest_jsonl(spark, tmp + "/data", strict=False)
    # Ordinals of a split are places in its files.
    from versio.sources.ordinals import dense_positions
    want = dense_positions(corpus, ["subset", "pair"], "ordinal").select("subset", "pair", F.col("position").alias("ordinal"), "src_txt", "tgt_txt")
    assert rejects.count() == 0 and all(r.status == "ok" for r in check.collect())
    assert parallel.exceptAll(want).count() == 0 and parallel.count() == want.count()


def test_prediction_files_keep_key_order(spark, tmp):
    df = spark.range(5000).selectExpr("'eng_x' AS pair", "if(id % 2 = 0, 'eng_2_x', 'x_2_eng') AS direction", "id AS ordinal", "1 AS k", "concat('t', id) AS pred").repartition(7)
    sinks.write_predictions_jsonl(sinks.run_layout(df, "org/m"), tmp + "/p")
    lines = readers.numbered_lines(spark, tmp + "/p", matching="direction=x_2_eng$").orderBy("ordinal").collect()
    assert [json.loads(r.value)[0] for r in lines] == [f"t{i}" for i in range(1, 5000, 2)]


def test_line_numbers_take_one_scan_of_the_text(spark, tmp):
    write_lines(tmp + "/x.jsonl", [json.dumps([str(i)]) for i in range(50)])
    df = readers.numbered_lines(spark, tmp + "/x.jsonl")
    assert "FileScan text" not in plan_of(df) and [r.ordinal for r in df.orderBy("ordinal").collect()] == list(range(50))


def test_parts_follow_each_other_by_number(spark, tmp):
    d = tmp + "/doc.eng.jsonl"
    os.makedirs(d)
    for part in (2, 10, 100000):
        write_lines(f"{d}/part-{part:05d}-abc.c000.txt", [f"{part} {i}" for i in range(3)])
    got = [r.value for r in readers.numbered_lines(spark, d).orderBy("ordinal").collect()]
    assert got == [f"{p} {i}" for p in (2, 10, 100000) for i in range(3)]


def test_quarantine_is_one_write_read_by_both_sides(spark, tmp):
    os.makedirs(tmp + "/eng_hin")
    write_lines(tmp + "/eng_hin/doc.eng.cleaned.jsonl", ['{"text": "a"}', "{bad", '{"text": "c"}', '{"text": "d"}'])
    write_lines(tmp + "/eng_hin/doc.hin.cleaned.jsonl", ['{"text": "A"}', '{"text": "B"}', '{"text": 3}'])
    good, rejects = readers.read_text_pair_tree(spark, tmp)
    assert [tuple(r) for r in good.collect()] == [("eng_hin", 0, "a", "A")]
    assert sorted(map(tuple, rejects.collect())) == [("eng_hin", 2, "source not a {text} object"), ("eng_hin", 3, "target not a {text} object")]
    for df in (good, rejects):
        plan = plan_of(df)
        assert "Join" not in plan and plan.count("FileScan") == 1 and "PartitionFilters: [isnotnull(taken" in plan


def test_stored_tables_can_be_discarded(spark):
    kept, session._STORED[:] = list(session._STORED), []
    try:
        path = session.materialize(spark.range(3)).inputFiles()[0].split(":", 1)[1].rsplit("/", 1)[0]
        assert os.path.isdir(path) and session.discard(spark) == 1 and not os.path.exists(path) and session.discard(spark) == 0
    finally:
        session._STORED[:] = kept


# --- A1 in batches -----------------------------------------------------------------------


def random_pairs(rng, n, alphabet, longest):
    side = lambda: "".join(rng.choice(alphabet, rng.integers(0, longest)))
    out = [(side(), side()) for _ in range(n)]
    return out + [(a, a[: len(a) // 2]) for a, _ in out[: n // 4]] + [("", "abc"), ("abc", ""), ("", ""), ("\0", "\0\0a")]


@pytest.mark.parametrize("alphabet,longest", [("ab", 30), ("abcdefghé字\0", 60), ([chr(0x900 + i) for i in range(500)], 200), ([chr(0x4E00 + i) for i in range(20000)], 3000)])
def test_batches_equal_single_segments(alphabet, longest):
    rng = np.random.default_rng(longest)
    pairs = random_pairs(rng, 60 if longest < 3000 else 4, list(alphabet), longest)
    got = batch_stats([h for h, _ in pairs], [r for _, r in pairs])
    assert got.tolist() == [segment_stats(h, r) for h, r in pairs]


def test_sentences_are_counted_in_batches_much_faster():
    import time
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(500)]
    texts = ["".join(words[i] for i in rng.integers(0, 500, 12)) for _ in range(100_001)]
    hyps, refs = texts[:-1], texts[1:]
    t0 = time.process_time()
    batched = np.concatenate([batch_stats(hyps[i : i + 10_000], refs[i : i + 10_000]) for i in range(0, 100_000, 10_000)])
    t1 = time.process_time()
    single = np.array([segment_stats(h, r) for h, r in zip(hyps[:20_000], refs[:20_000])])
    t2 = time.process_time()
    assert (batched[:20_000] == single).all() and 3 * (t1 - t0) < 5 * (t2 - t1)


def test_writes_of_a_run_do_not_multiply_with_its_units(spark, tmp, monkeypatch):
    """Units are committed in waves, each no larger than what is committed before it; every unit has its own ledger
    row, and names exactly its own predictions."""
    assert [len(w) for w in jobs.waves(list(range(200)))] == [1, 1, 2, 4, 8, 16, 32, 32, 32, 32, 32, 8]
    assert [x for w in jobs.waves(list(range(77))) for x in w] == list(range(77)) and jobs.waves([]) == []
    writes, write = [], sinks.write_predictions
    monkeypatch.setattr(jobs.sinks, "write_predictions", lambda *a, **b: writes.append(1) or write(*a, **b))
    cfg = jobs.JobConfig(ks=[0, 1], dialect="bare", model="org/m", resume=True, commit_units=10)
    made = jobs.store_requests(parallel(spark, 100), cfg)
    jobs.commit_units(spark, made, COPY, cfg, tmp + "/predictions", tmp + "/ledger")
    assert len(made.units) == 10 and len(writes) == 5
    rows = {r.unit_id: r for r in spark.read.parquet(tmp + "/ledger").collect()}
    assert sorted(r.unit for r in rows.values()) == list(range(10))
    held = jobs.committed(spark, tmp + "/predictions", tmp + "/ledger").select("unit_id", "pair", "direction", "ordinal").collect()
    assert len(held) == 2 * sum(r.n_rows for r in rows.values()) and {r.unit_id for r in held} == set(rows)
    units = {(d.pair, d.direction, d.ordinal): d.unit for d in made.documents.select("pair", "direction", "ordinal", "unit").collect()}
    assert all(units[r.pair, r.direction, r.ordinal] == rows[r.unit_id].unit for r in held)
