"""Positional alignment checks.

Alignment itself is an equi-join on the explicit document key. The checks
work on per-group counts, so they never move text: each side is counted
with a partial aggregate and the small count tables are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .directions import pair_of


def side_counts(src: DataFrame, tgt: DataFrame, on: list[str]) -> DataFrame:
    """``on + n_src, n_tgt`` from two keyed side tables (full outer on the groups)."""
    a = src.groupBy(*on).agg(F.count(F.lit(1)).alias("n_src"))
    b = tgt.groupBy(*on).agg(F.count(F.lit(1)).alias("n_tgt"))
    return (a.join(b, on, "full_outer")
             .select(*on, F.coalesce("n_src", F.lit(0)).alias("n_src"), F.coalesce("n_tgt", F.lit(0)).alias("n_tgt")))


def strict_check(counts: DataFrame) -> DataFrame:
    """``status`` is ``ok`` only when both sides have the same number of rows."""
    return counts.withColumn("status", F.when(F.col("n_src") == F.col("n_tgt"), F.lit("ok"))
                                        .otherwise(F.lit("length mismatch")))


def strict_zip(src: DataFrame, tgt: DataFrame, on: list[str], key: str = "ordinal") -> DataFrame:
    """Zip two sides on ``on + [key]``; raise naming the groups whose sizes differ."""
    bad = strict_check(side_counts(src, tgt, on)).where(F.col("status") != "ok")
    names = bad.select(F.concat_ws("/", *[F.col(c).cast("string") for c in on]).alias("g")).limit(20).collect()
    if names:
        raise ValueError("example source / target length mismatch: " + ", ".join(r.g for r in names))
    return src.join(tgt, on + [key])


def truncating_counts(counts: DataFrame, n_pairs: DataFrame, on: list[str]) -> DataFrame:
    """Pairs kept and rows left unmatched on each side."""
    return (counts.join(n_pairs, on, "left")
                  .select(*on, "n_src", "n_tgt", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"))
                  .withColumn("unmatched_src", F.col("n_src") - F.col("n_pairs"))
                  .withColumn("unmatched_tgt", F.col("n_tgt") - F.col("n_pairs")))


def coverage(expected: DataFrame, refs: DataFrame, hyps: DataFrame) -> DataFrame:
    """Status per expected direction (``src_lang, tgt_lang``), and per ``k`` where ``expected`` has one.

    ``refs``/``hyps`` hold one row per present (direction[, k], document); they
    are reduced to present keys before the join.
    """
    keys = ["direction", *(["k"] if "k" in expected.columns else [])]
    r = refs.select(*[c for c in keys if c in refs.columns]).distinct().withColumn("_r", F.lit(True))
    h = hyps.select(*keys).distinct().withColumn("_h", F.lit(True))
    e = expected.withColumn("direction", F.concat("src_lang", F.lit("_2_"), "tgt_lang"))
    j = e.join(r, [c for c in keys if c in refs.columns], "left").join(h, keys, "left")
    has_r = F.coalesce("_r", F.lit(False))
    has_h = F.coalesce("_h", F.lit(False))
    status = (F.when(has_r & has_h, F.lit("ok")).when(has_r, F.lit("missing_hyp"))
               .when(has_h, F.lit("missing_ref")).otherwise(F.lit("missing_ref_and_hyp")))
    return j.select(*keys, "src_lang", "tgt_lang",
                    pair_of(F.col("src_lang"), F.col("tgt_lang")).alias("pair"), status.alias("status"))
