"""chrF: hand cases, brute force, Arrow vs native Spark plans, partition invariance."""
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from plain_chrf import native_segment_stats, py_chrf
from versio.functions.chrf import corpus_score, segment_stats
from versio.operators import chrf as C


def test_hand_cases():
    assert py_chrf(["abc def"], ["abc def"]) == 100.0
    assert corpus_score(segment_stats("abcdef", "abcdef")) == 100.0
    assert py_chrf(["aaa"], ["bbb"]) == 0.0
    assert py_chrf([""], ["abc"]) == 0.0
    st = segment_stats("abcdef", "ab")
    assert st[6:] == [0] * 12  # orders 3-6: reference has none, hypothesis count zeroed


def test_whitespace_does_not_matter():
    assert py_chrf(["a b  c"], ["abc"]) == 100.0


def test_numpy_stats_equal_brute_force_large_alphabet():
    from collections import Counter
    random.seed(7)
    alpha = [chr(0x4E00 + i) for i in range(3000)]  # forces the byte-compare path
    h = "".join(random.choice(alpha[:40]) for _ in range(500))
    r = "".join(random.choice(alpha[:40] + alpha[-2000:]) for _ in range(800))
    r += "".join(alpha[:1500])
    got = segment_stats(h, r)
    for n in range(1, 7):
        hc = Counter(h[i:i + n] for i in range(len(h) - n + 1))
        rc = Counter(r[i:i + n] for i in range(len(r) - n + 1))
        assert got[3 * (n - 1):3 * n] == [sum(hc.values()), sum(rc.values()), sum((hc & rc).values())]


def _docs(spark):
    d = spark.read.parquet(f"{SF001}/documents.parquet")
    return d.select("doc_id", "lang", F.col("text").alias("ref"),
                    F.reverse(F.col("text")).alias("hyp"))


def test_spark_matches_python_and_native(spark):
    d = _docs(spark).where(F.length("ref") < 4000)
    arrow = C.corpus_chrf(C.segment_statistics(d, "hyp", "ref", ["lang", "doc_id"]), ["lang"], digits=None)
    native = C.corpus_chrf(native_segment_stats(d, "hyp", "ref", ["lang", "doc_id"]), ["lang"], digits=None)
    a = {r.lang: r.chrf for r in arrow.collect()}
    n = {r.lang: r.chrf for r in native.collect()}
    rows = d.collect()
    for lang in a:
        hyps = [r.hyp for r in rows if r.lang == lang]
        refs = [r.ref for r in rows if r.lang == lang]
        assert a[lang] == pytest.approx(py_chrf(hyps, refs), abs=1e-9)
        assert a[lang] == pytest.approx(n[lang], abs=1e-9)


def test_same_result_at_1_and_8_partitions(spark):
    d = _docs(spark)
    one = C.chrf_by(d.coalesce(1), "hyp", "ref", ["lang"], ["doc_id"]).orderBy("lang").collect()
    many = C.chrf_by(d.repartition(8), "hyp", "ref", ["lang"], ["doc_id"]).orderBy("lang").collect()
    assert [(r.lang, r.chrf) for r in one] == [(r.lang, r.chrf) for r in many]


def test_alignment_check(spark):
    h = spark.createDataFrame([("d", 0, "a"), ("d", 1, "b")], "direction string, ordinal long, pred string")
    r = spark.createDataFrame([("d", 0, "a"), ("d", 1, "b"), ("d", 2, "c")], "direction string, ordinal long, ref string")
    aligned, counts = C.align(h, r, ["direction", "ordinal"], ["direction"])
    assert aligned.count() == 2
    c = C.score_aligned(h, r, ["direction", "ordinal"], ["direction"]).first()
    assert (c.n_ref, c.n_hyp, c.n_segments, c.status, c.chrf) == (3, 2, 2, "length mismatch", None)


def test_partial_aggregate_in_plan(spark):
    d = _docs(spark)
    plan = C.chrf_by(d, "hyp", "ref", ["lang"], ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "partial_sum" in plan


def test_hot_direction_moves_only_partial_sums(spark):
    """One direction holds ~99% of the segments; its aggregate exchange moves one row per task."""
    from test_fewshot import _nodes
    rows = [("eng_2_hin" if i % 100 else "hin_2_eng", i, f"text number {i}", f"text {i} number") for i in range(3000)]
    d = spark.createDataFrame(rows, "direction string, ordinal long, hyp string, ref string").repartition(8)
    df = C.chrf_by(d, "hyp", "ref", ["direction"], ["ordinal"])
    qe = df._jdf.queryExecution()
    assert qe.toRdd().count() == 2
    def first_real(n):
        while n.nodeName().startswith("WholeStageCodegen") or n.nodeName() == "InputAdapter":
            n = n.children().apply(0)
        return n
    ex = [n for n in _nodes(qe.executedPlan())
          if n.nodeName() == "Exchange" and first_real(n.children().apply(0)).nodeName() == "HashAggregate"]
    written = ex[0].metrics().apply("shuffleRecordsWritten").value()
    assert 0 < written <= 8 * 2      # tasks x directions, not 3000 segments


def test_statistics_leave_a_task_in_the_batches_they_came_in(spark):
    """One frame for each sort of two or three documents cost more than the counting."""
    from pyspark.sql import functions as F
    from versio.functions.chrf import segment_stats
    from versio.operators import chrf as op
    rows = [(i, "abcdefgh " * (900 + i), "abxdefgh " * 1200) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, h string, r string").coalesce(1)
    frames = []

    class Seen:
        """Stands for the prepared rows: runs the task's function here and keeps the frames it yields."""

        def __init__(self, prepared):
            self.prepared, self.schema = prepared, prepared.schema

        def mapInPandas(self, fn, schema):  # noqa: N802
            frames.extend(fn(iter([self.prepared.toPandas()])))
            return spark.createDataFrame(frames[0], schema)

    class Rows:
        select = staticmethod(lambda *c: Seen(df.select(*c)))

    want = {i: segment_stats(h.replace(" ", ""), r.replace(" ", "")) for i, h, r in rows}
    for out in (op.segment_statistics(Rows, "h", "r", ["id"]), op.segment_statistics(df, "h", "r", ["id"])):
        assert {r.id: list(r)[1:] for r in out.collect()} == want
    assert [len(x) for x in frames] == [40]
    assert op.segment_statistics(df.where(F.lit(False)), "h", "r", ["id"]).count() == 0


def test_batches_drop_whitespace_and_grams_end_with_their_side():
    """Whitespace went in an expression of its own before; sides that continue each other share no gram over their ends."""
    from versio.functions.chrf import batch_stats
    pairs = [("a b　c", "a\x1cbc \n"), ("ab", "abcd"), ("cdab", "ab"), ("", " "), ("  ", "ab"), ("ab", ""), ("\0a\0", "\0 a"),
             ("😀a😀b", "😀 a😀"), ("aaaaaaaa", "aaaaaaaaaaaa")]
    want = [segment_stats("".join(h.split()), "".join(r.split())) for h, r in pairs]
    assert batch_stats([h for h, _ in pairs], [r for _, r in pairs]).tolist() == want
    big = "".join(chr(0x4E00 + i) for i in range(3000))  # too many letters to pack
    assert batch_stats([big + " x"], ["x " + big]).tolist() == [segment_stats(big + "x", "x" + big)]
