"""chrF by two other ways: plain Python, and n-grams exploded in Spark."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versio.functions.chrf import *  # noqa: F403
from versio.functions.chrf import CHAR_ORDER, corpus_score, segment_stats, stat_names  # noqa: F401
from versio.functions.text import remove_ws


def native_segment_stats(df: DataFrame, hyp_col: str, ref_col: str, key_cols: list[str]) -> DataFrame:
    """All-Spark statistics (test oracle): explode n-grams, count, match."""
    base = df.select(*key_cols, remove_ws(F.col(hyp_col)).alias("_h"), remove_ws(F.col(ref_col)).alias("_r"))
    sides = base.select(*key_cols, F.explode(F.array(
        F.struct(F.lit("h").alias("side"), F.col("_h").alias("s")),
        F.struct(F.lit("r").alias("side"), F.col("_r").alias("s")))).alias("x")).select(*key_cols, "x.side", "x.s")
    chars = sides.select(*key_cols, "side", F.when(F.length("s") > 0, F.split("s", "")).otherwise(
        F.array().cast("array<string>")).alias("c"))
    grams = chars.select(*key_cols, "side", F.explode(F.sequence(F.lit(1), F.lit(CHAR_ORDER))).alias("n"), "c")
    grams = grams.select(*key_cols, "side", "n", F.explode(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("c") - F.col("n") + 1, F.lit(0))),
        lambda i: F.array_join(F.slice("c", i, F.col("n")), ""))).alias("g"))
    counts = grams.groupBy(*key_cols, "n", "g").agg(
        F.count(F.when(F.col("side") == "h", 1)).alias("ch"), F.count(F.when(F.col("side") == "r", 1)).alias("cr"))
    per = counts.groupBy(*key_cols, "n").agg(F.sum("ch").alias("nh"), F.sum("cr").alias("nr"),
                                             F.sum(F.least("ch", "cr")).alias("nm"))
    per = per.withColumn("nh", F.when(F.col("nr") > 0, F.col("nh")).otherwise(F.lit(0)))
    wide = per.groupBy(*key_cols).pivot("n", list(range(1, CHAR_ORDER + 1))).agg(
        F.first("nh").alias("h"), F.first("nr").alias("r"), F.first("nm").alias("m"))
    cols = []
    for n in range(1, CHAR_ORDER + 1):
        cols += [F.coalesce(F.col(f"{n}_h"), F.lit(0)).cast("bigint").alias(f"hyp{n}"),
                 F.coalesce(F.col(f"{n}_r"), F.lit(0)).cast("bigint").alias(f"ref{n}"),
                 F.coalesce(F.col(f"{n}_m"), F.lit(0)).cast("bigint").alias(f"match{n}")]
    return wide.select(*key_cols, *cols)


def py_chrf(hyps: list[str], refs: list[str]) -> float:
    """Brute-force corpus chrF with Counters (test oracle only)."""
    from collections import Counter
    tot = [0] * (3 * CHAR_ORDER)
    for hyp, ref in zip(hyps, refs):
        h = "".join(hyp.split())
        r = "".join(ref.split())
        for n in range(1, CHAR_ORDER + 1):
            hc = Counter(h[i:i + n] for i in range(len(h) - n + 1))
            rc = Counter(r[i:i + n] for i in range(len(r) - n + 1))
            nh, nr = sum(hc.values()), sum(rc.values())
            m = sum((hc & rc).values())
            tot[3 * (n - 1)] += nh if nr > 0 else 0
            tot[3 * (n - 1) + 1] += nr
            tot[3 * (n - 1) + 2] += m
    return corpus_score(tot)
