"""Corpus chrF per group (A1) with hypothesis/reference alignment.

Plan: ``mapInPandas`` turns each segment, less whitespace, into 18 integers
(exact n-gram counting in numpy, no n-gram ever leaves the task);
``groupBy(direction)`` sums them with a partial (map-side) aggregate, so only
18 longs per group and task cross the shuffle -- a direction holding a third
of the corpus costs the same shuffle as any other. The score is a closed-form
Column expression over the sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.chrf import BETA, CHAR_ORDER, batch_stats, stat_names
from ..sources.keyed import KEY, co_partitioned
from .directions import pair_langs

STATS = stat_names()


#: Characters of both sides that are counted together, so that their keys stay in a core's cache (a longer segment is
#: counted alone).
SORT_CHARS = 1 << 15


def _runs(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring segments that together have about ``limit`` characters, one segment at least."""
    ends = np.cumsum(sizes)
    a = 0
    while a < len(ends):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, "right")))
        yield a, z
        a = z


def segment_statistics(df: DataFrame, hyp_col: str, ref_col: str, key_cols: list[str]) -> DataFrame:
    """Per row: ``key_cols`` + 18 bigint statistics (``hyp1, ref1, match1, ...``).

    A batch goes back as one batch: the few documents of one sort would not pay for a frame of their own.
    """
    prepared = df.select(*key_cols, F.coalesce(F.col(hyp_col), F.lit("")).alias("_h"), F.coalesce(F.col(ref_col), F.lit("")).alias("_r"))
    schema = T.StructType([*(prepared.schema[c] for c in key_cols), *(T.StructField(s, T.LongType()) for s in STATS)])

    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hyps, refs = pdf["_h"].tolist(), pdf["_r"].tolist()
            sizes = np.array([len(h) + len(r) for h, r in zip(hyps, refs, strict=True)], np.int64)
            counts = np.concatenate([np.zeros((0, len(STATS)), np.int64), *(batch_stats(hyps[a:z], refs[a:z]) for a, z in _runs(sizes, SORT_CHARS))])
            yield pd.concat([pdf[key_cols], pd.DataFrame(counts, columns=STATS, index=pdf.index)], axis=1)

    return prepared.mapInPandas(per_batch, schema)


def score_column(order: int = CHAR_ORDER, beta: float = BETA) -> Column:
    """chrF from summed statistics columns; orders added in a fixed sequence."""
    sp = sr = eff = None
    for n in range(1, order + 1):
        h, r, m = F.col(f"hyp{n}"), F.col(f"ref{n}"), F.col(f"match{n}")
        ok = (h > 0) & (r > 0)
        p = F.when(ok, m.cast("double") / h).otherwise(F.lit(0.0))
        rc = F.when(ok, m.cast("double") / r).otherwise(F.lit(0.0))
        e = F.when(ok, F.lit(1)).otherwise(F.lit(0))
        sp = p if sp is None else sp + p
        sr = rc if sr is None else sr + rc
        eff = e if eff is None else eff + e
    P = sp / eff
    R = sr / eff
    f = beta * beta
    score = F.lit(100.0) * F.lit(1 + f) * P * R / (F.lit(f) * P + R)
    return F.when((eff == 0) | ((P + R) == 0), F.lit(0.0)).otherwise(score)


def corpus_chrf(stats: DataFrame, group_cols: list[str], digits: int | None = 4) -> DataFrame:
    """Sum segment statistics per group -> ``group_cols, n_segments, <18 sums>, chrf``."""
    agg = stats.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_segments"), *[F.sum(s).alias(s) for s in STATS])
    score = score_column()
    if digits is not None:
        score = F.round(score, digits)
    return agg.withColumn("chrf", score)


def align(hyps: DataFrame, refs: DataFrame, keys: list[str], group_cols: list[str],
          hyp_col: str = "pred", ref_col: str = "ref") -> tuple[DataFrame, DataFrame]:
    """Join hypotheses and references on keys.

    Returns (aligned rows, side counts ``group_cols, n_ref, n_hyp``). Side
    counts are partial aggregates over keys only (no text moves); the aligned
    rows come from one inner equi-join. Pair with ``with_status`` once the
    aligned rows have been counted (``n_segments`` of the score table).
    """
    h = hyps.select(*keys, F.col(hyp_col).alias(hyp_col))
    r = refs.select(*keys, F.col(ref_col).alias(ref_col))
    aligned = h.join(r, keys)
    n_h = hyps.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n_hyp"))
    n_r = refs.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n_ref"))
    counts = (n_r.join(n_h, group_cols, "full_outer")
              .select(*group_cols, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_ref", "n_hyp")]))
    return aligned, counts


def with_status(counts: DataFrame, scores: DataFrame, group_cols: list[str]) -> DataFrame:
    """Join side counts with scores; ``status`` is ``ok`` when every row on both sides aligned. A group
    that did not align has no score."""
    j = counts.join(scores, group_cols, "left").withColumn("n_segments", F.coalesce("n_segments", F.lit(0)))
    ok = (F.col("n_ref") == F.col("n_hyp")) & (F.col("n_ref") == F.col("n_segments"))
    return j.withColumn("status", F.when(ok, F.lit("ok")).otherwise(F.lit("length mismatch"))).withColumn("chrf", F.when(ok, F.col("chrf")))


def score_aligned(hyps: DataFrame, refs: DataFrame, keys: list[str], group_cols: list[str],
                  hyp_col: str = "pred", ref_col: str = "ref") -> DataFrame:
    """J3 + A1: ``group_cols, n_ref, n_hyp, n_segments, chrf, status``."""
    aligned, counts = align(hyps, refs, keys, group_cols, hyp_col, ref_col)
    scores = chrf_by(aligned, hyp_col, ref_col, group_cols, keys)
    return with_status(counts, scores.select(*group_cols, "n_segments", "chrf"), group_cols)


def chrf_by(df: DataFrame, hyp_col: str, ref_col: str, group_cols: list[str],
            key_cols: list[str] | None = None) -> DataFrame:
    """Segment statistics + corpus score per group in one plan."""
    keys = list(dict.fromkeys(group_cols + (key_cols or [])))
    return corpus_chrf(segment_statistics(df, hyp_col, ref_col, keys), group_cols)


def score_runs(preds: DataFrame, corpus: DataFrame, runs: list[tuple], run_cols: list[str], subset: str = "test") -> DataFrame:
    """J3 + A1 for many runs over one keyed corpus: ``pair, src_lang, tgt_lang, direction, <run_cols>, n_ref, n_hyp,
    n_segments, chrf, status`` for every direction of the corpus and every run, predicted or not.

    ``preds``: ``doc_key, direction, <run_cols>, pred``; ``runs`` names the runs (values of ``run_cols``).
    References are the corpus rows themselves, one for both directions and all runs. Predictions meet them on
    ``doc_key``: where both are clustered tables (or projections of them) neither side is exchanged. Runs that
    give a document the same text are counted once and the statistics joined to each.
    """
    refs = corpus.where(F.col("subset") == subset)
    number = F.lit(None).cast("int")
    for i, run in enumerate(runs):
        same = F.lit(True)
        for c, v in zip(run_cols, run, strict=True):
            same = same & (F.col(c) == F.lit(v))
        number = F.when(same, F.lit(i)).otherwise(number)
    mine = preds.select(KEY, "direction", number.alias("_run"), F.col("pred")).where(F.col("_run").isNotNull())
    distinct = mine.groupBy(KEY, "direction", "pred").agg(F.collect_list("_run").alias("_runs"))
    met = co_partitioned(distinct, refs.select(KEY, "pair", "src_txt", "tgt_txt"))
    a, b = pair_langs("pair")
    forward = F.col("direction") == F.concat(a, F.lit("_2_"), b)
    met = met.where(forward | (F.col("direction") == F.concat(b, F.lit("_2_"), a)))
    met = met.withColumn("_ref", F.when(forward, F.col("tgt_txt")).otherwise(F.col("src_txt")))
    stats = segment_statistics(met, "pred", "_ref", ["pair", "direction", "_runs"])
    stats = stats.withColumn("_run", F.explode("_runs")).drop("_runs")
    scores = corpus_chrf(stats, ["pair", "direction", "_run"]).select("pair", "direction", "_run", "n_segments", "chrf")
    n_hyp = mine.groupBy(F.split_part(KEY, F.lit("/"), F.lit(1)).alias("pair"), "direction", "_run").agg(F.count(F.lit(1)).alias("n_hyp"))
    per_pair = refs.groupBy("pair").agg(F.count(F.lit(1)).alias("n_ref"))
    sides = F.array(F.struct(a.alias("src_lang"), b.alias("tgt_lang")), F.struct(b.alias("src_lang"), a.alias("tgt_lang")))
    listed = F.array(*[F.struct(F.lit(i).alias("_run"), *[F.lit(v).alias(c) for c, v in zip(run_cols, run, strict=True)]) for i, run in enumerate(runs)])
    every = per_pair.select("pair", "n_ref", F.explode(sides).alias("d")).select("pair", "n_ref", "d.*", F.explode(listed).alias("r")).select("pair", "n_ref", "src_lang", "tgt_lang", "r.*")
    every = every.withColumn("direction", F.concat("src_lang", F.lit("_2_"), "tgt_lang"))
    groups = ["pair", "direction", "_run"]
    counts = every.join(n_hyp, groups, "left").withColumn("n_hyp", F.coalesce("n_hyp", F.lit(0)))
    return with_status(counts, scores, groups).drop("_run")
