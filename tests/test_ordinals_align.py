"""Distributed ranks equal row_number; alignment checks J1/J2/J6."""
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF01
from versio.operators import align
from versio.sources.ordinals import rank_within


@pytest.mark.parametrize("parts", [1, 8, 64])
def test_rank_within_equals_row_number(spark, parts):
    d = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang")
    got = rank_within(d, ["lang"], ["doc_id"], num_partitions=parts)
    want = d.withColumn("ordinal", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")) - 1)
    assert sorted(map(tuple, got.select("doc_id", "lang", "ordinal").collect())) == \
        sorted(map(tuple, want.select("doc_id", "lang", "ordinal").collect()))


def sides(spark, n_src, n_tgt):
    s = spark.createDataFrame([("eng_hin", i, f"s{i}") for i in range(n_src)], "pair string, ordinal long, s string")
    t = spark.createDataFrame([("eng_hin", i, f"t{i}") for i in range(n_tgt)], "pair string, ordinal long, t string")
    return s, t


def test_strict_zip_names_the_pair(spark):
    s, t = sides(spark, 3, 2)
    with pytest.raises(ValueError, match="eng_hin"):
        align.strict_zip(s, t, ["pair"])
    s, t = sides(spark, 2, 2)
    assert align.strict_zip(s, t, ["pair"]).count() == 2


def test_truncating_counts(spark):
    s, t = sides(spark, 3, 2)
    counts = align.side_counts(s, t, ["pair"])
    pairs = s.join(t, ["pair", "ordinal"]).groupBy("pair").agg(F.count(F.lit(1)).alias("n_pairs"))
    r = align.truncating_counts(counts, pairs, ["pair"]).first()
    assert (r.n_pairs, r.unmatched_src, r.unmatched_tgt) == (2, 1, 0)


def test_coverage_statuses(spark):
    exp = spark.createDataFrame([("eng", "hin"), ("hin", "eng"), ("eng", "tam"), ("tam", "eng")],
                                "src_lang string, tgt_lang string")
    refs = spark.createDataFrame([("eng_2_hin",), ("hin_2_eng",), ("tam_2_eng",)], "direction string")
    hyps = spark.createDataFrame([("eng_2_hin",), ("eng_2_tam",)], "direction string")
    got = {r.direction: r.status for r in align.coverage(exp, refs, hyps).collect()}
    assert got == {"eng_2_hin": "ok", "hin_2_eng": "missing_hyp", "eng_2_tam": "missing_ref", "tam_2_eng": "missing_hyp"}


def test_rank_integers_equals_row_number(spark, monkeypatch):
    from versio.sources import ordinals
    monkeypatch.setattr(ordinals, "BUCKET", 64)
    d = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang")
    got = ordinals.rank_integers(d, "lang", "doc_id")
    want = d.withColumn("ordinal", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")) - 1)
    assert got.select("doc_id", "lang", "ordinal").exceptAll(want.select("doc_id", "lang", "ordinal")).count() == 0


def test_rank_default_partitioning_under_aqe(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        d = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang")
        got = rank_within(d, ["lang"], ["doc_id"])
        want = d.withColumn("ordinal", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")) - 1)
        assert got.select("doc_id", "lang", "ordinal").exceptAll(want.select("doc_id", "lang", "ordinal")).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
