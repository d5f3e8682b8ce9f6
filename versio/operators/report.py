"""Counts, tallies and score ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prompts import prompt_file_name


def evaluated(coverage: DataFrame, scores: DataFrame) -> DataFrame:
    """The coverage table with ``status`` taken from the alignment where both files are present: a
    direction (and shot count) whose lines do not align failed."""
    keys = [c for c in ("direction", "k") if c in coverage.columns and c in scores.columns]
    aligned = scores.select(*keys, F.col("status").alias("_aligned"))
    status = F.when(F.col("status") == "ok", F.coalesce("_aligned", F.lit("not scored"))).otherwise(F.col("status"))
    return coverage.join(aligned, keys, "left").withColumn("status", status).drop("_aligned")


def tally(coverage: DataFrame) -> DataFrame:
    """A3: successful and failed evaluations over the (evaluated) coverage table."""
    return coverage.agg(F.count_if(F.col("status") == "ok").alias("n_ok"),
                        F.count_if(F.col("status") != "ok").alias("n_failed"),
                        F.count(F.lit(1)).alias("n_expected"))


def rank_scores(scores: DataFrame, top: int | None = None) -> DataFrame:
    """T3 (and T4 with ``top``): rank by chrF descending, ties by direction; within a model and shot
    count where the scores have them. Directions without a score (not aligned) have no rank.

    With ``top`` the rows are first cut by ``orderBy(...).limit(top)``, which
    plans as a per-task top-k merged once (``TakeOrderedAndProject``); the rank
    window then sees at most ``top`` rows. Score tables have one row per
    direction, so the full ranking window is tiny as well.
    """
    order = [F.desc("chrf"), F.asc("direction")]
    if "status" in scores.columns:
        scores = scores.where(F.col("status") == "ok")
    runs = [c for c in ("model", "k") if c in scores.columns]
    if top is not None and not runs:
        scores = scores.orderBy(*order).limit(top)
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy(*runs).orderBy(*order)))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def score_lines(scores: DataFrame, k: int | None = None) -> DataFrame:
    """The TSV row text ``<hyp file>\\t<score .4f>``; without ``k`` each row's own shot count names its file."""
    name = prompt_file_name(F.col("src_lang"), F.col("tgt_lang"), F.col("k") if k is None else F.lit(k), pred=True)
    return scores.withColumn("hyp_file", name).withColumn(
        "line", F.concat(name, F.lit("\t"), F.format_string("%.4f", F.col("chrf"))))
