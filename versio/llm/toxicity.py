"""Toxicity by non-negative positive-unlabelled (nnPU) learning.

Confirmed toxic documents are the positives, a sample of all other text is unlabelled; no document
counts as clean. With the class prior ``pi``, the risk of a classifier g under the logistic loss l is

    pi * E_P[l(g)] + max(0, E_U[l(-g)] - pi * E_P[l(-g)])

The clean class's part is what the unlabelled text shows less the positives' share; where it would
turn negative (overfitting), a step goes back along that part instead. A linear classifier over
hashed words and word beginnings is trained in numpy on a bounded sample (``positives`` and
``unlabelled`` documents, chosen by a hash of doc_id, at most about so many at any input size);
every document is then scored where it lies, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versio.llm.common import WORD_BYTES, chunks, mix64, stored

THRESHOLD = 0.3
#: Bounds of the training sample, in documents; of the features, in number.
POSITIVES, UNLABELLED, FEATURES = 8_000, 24_000, 20_000
HASH_BITS = 22
#: A feature must be as much more frequent in positives than in unlabelled text: Poisson log-likelihood
#: ratio of its count in positives against the count that its unlabelled rate lets expect.
LEAST_EVIDENCE = 8.0
PREFIXES = (4, 6, 8)
SALT = 2718281

LOW = np.frombuffer(WORD_BYTES, np.uint8)

#: Features, their weights, and the calibration's margins and probabilities.
Model = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
NOTHING: Model = (np.zeros(0, np.int64), np.zeros(0), np.zeros(1), np.zeros(1))


def features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of every word and of its beginnings of 4, 6 and 8 bytes, repeats included."""
    n = len(raw)
    low = np.zeros(n + 8, np.uint8)
    np.take(LOW, raw, out=low[:n])
    inside = low[:n] != 32
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    begins = np.flatnonzero(inside & (~before | edge[:n]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    size = ends - begins
    word = np.ndarray(n + 1, "<u8", low.data, strides=(1,))
    head = word[begins]
    masks = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
    doc = np.searchsorted(at, begins, "right") - 1
    first = head & masks[np.minimum(size, 8)]
    tail = word[np.maximum(ends - 8, begins)] & masks[np.minimum(size, 8)]
    keys = [mix64(first ^ mix64(tail + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))]
    docs = [doc]
    for k in PREFIXES:
        long = size > k
        keys.append(mix64((head[long] & masks[k]) + np.uint64(k * 0x51ED2701)))
        docs.append(doc[long])
    return np.concatenate(docs), (np.concatenate(keys) >> np.uint64(64 - HASH_BITS)).astype(np.int32)


def held_out(doc: Column) -> Column:
    return F.coalesce(F.crc32(doc.cast("string")) % 4 == 2, F.lit(False))


def _features_of(docs: DataFrame) -> DataFrame:
    """(positive, feature list without repeats) of each row of (positive, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, at in chunks(batch, "text"):
                doc, feat = features(raw, at)
                both = np.unique((doc.astype(np.int64) << HASH_BITS) | feat)
                cuts = np.searchsorted(both, np.arange(rows.num_rows + 1, dtype=np.int64) << HASH_BITS)
                values = pa.array((both & ((1 << HASH_BITS) - 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([rows.column("positive"), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)], ["positive", "features"])

    return docs.select("positive", "text").mapInArrow(run, "positive boolean, features array<int>")


def nnpu(positive: np.ndarray, doc: np.ndarray, feature: np.ndarray, n_features: int, prior: float,
         steps: int = 300, rate: float = 0.05, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk; ``doc`` and ``feature`` are the ones of
    the sparse binary matrix, ``positive`` has a flag for each document. Full-batch Adam."""
    n = len(positive)
    in_p = positive.astype(np.float64) / max(1, positive.sum())
    in_u = (~positive).astype(np.float64) / max(1, (~positive).sum())
    w = np.zeros(n_features + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.clip(np.bincount(doc, w[feature], n) + w[-1], -30, 30)
        up, down = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(z))  # slopes of l(-z) and of -l(z)
        clean = in_u - prior * in_p
        slope = clean * up
        if (clean * np.log1p(np.exp(z))).sum() >= 0:
            slope = slope - prior * in_p * down
        else:
            slope = -slope
        g = np.append(np.bincount(feature, slope[doc], n_features), slope.sum())
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def calibration(positive: np.ndarray, margin: np.ndarray, prior: float, bins: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Points (margin, probability) of a rising curve: the prior times the density of the positives'
    margins over that of the unlabelled ones, pooled until it rises (PAV). No label says clean."""
    cuts = np.unique(np.quantile(np.concatenate([margin[positive], margin[~positive]]), np.linspace(0, 1, bins + 1)))
    at = np.clip(np.searchsorted(cuts, margin, "right") - 1, 0, max(0, len(cuts) - 2))
    size = max(1, len(cuts) - 1)
    p = np.bincount(at[positive], minlength=size) / positive.sum()
    u = np.bincount(at[~positive], minlength=size) / (~positive).sum()
    mid = np.bincount(at, margin, size) / np.maximum(1, np.bincount(at, minlength=size))
    pools: list[list[float]] = []  # positives, unlabelled, sum of u * mid
    least = 0.5 / (~positive).sum()
    for a, b, x in zip(p, u, mid, strict=True):
        if a or b:
            pools.append([a, b + least, (b + least) * x])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [i + j for i, j in zip(pools[-1], last, strict=True)]
    return np.array([c / b for _, b, c in pools]), np.clip([prior * a / b for a, b, _ in pools], 0.001, 0.999)


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Features, weights and calibration points, learned from labels and texts of rows that are not held out.

    ``labels``: (doc_id, toxic); a null toxic or doc_id is no label; a doc_id is positive if any of its
    rows says 1. Without positives, or without other text, everything scores 0.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    total = docs.count()
    if not toxic or not total:
        return NOTHING
    prior = min(max(toxic / n, 1e-4), 0.9)

    def share(most: int, of: int) -> Column:
        return F.pmod(F.xxhash64("doc_id", F.lit(SALT)), F.lit(1 << 30)) < int(min(1.0, most / of) * (1 << 30))

    # At most ``positives`` ids, so they go to every task and no text is shuffled.
    chosen = known.where("toxic = 1").orderBy(F.xxhash64("doc_id", F.lit(SALT)), "doc_id").limit(positives).select("doc_id", F.lit(True).alias("positive"))
    text = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = (
        text.join(F.broadcast(chosen), "doc_id", "left").where(F.col("positive") | share(unlabelled, total))
        .select(F.coalesce("positive", F.lit(False)).alias("positive"), "text")
    )
    rows = stored(_features_of(sample), "toxicity-sample")
    sizes = {r[0]: r[1] for r in rows.groupBy("positive").count().collect()}
    if True not in sizes or False not in sizes:
        return NOTHING
    p, u = sizes[True], sizes[False]
    each = rows.select("positive", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u"))
    expected = (F.col("u") + 1) * (p / (u + 1))
    evidence = F.col("p") * F.log(F.col("p") / expected) - (F.col("p") - expected)
    kept = each.where((F.col("p") > expected) & (evidence >= LEAST_EVIDENCE)).orderBy(F.desc(evidence), "feature").limit(FEATURES)
    ids = np.sort(np.array([r[0] for r in kept.select("feature").collect()], np.int64))
    if not len(ids):
        return ids, np.zeros(0), np.zeros(1), np.array([prior])
    wanted = F.lit([int(x) for x in ids])
    found = rows.select("positive", F.array_intersect("features", wanted).alias("f")).toArrow()
    flags = np.asarray(found.column("positive").to_numpy(zero_copy_only=False), bool)
    lists = found.column("f").combine_chunks()
    cuts = np.asarray(lists.offsets)
    feature = np.searchsorted(ids, lists.values.to_numpy()[cuts[0] : cuts[-1]])
    doc = np.repeat(np.arange(len(flags)), np.diff(cuts))
    order = np.lexsort((feature, doc))
    weights, _ = nnpu(flags, doc[order], feature[order], len(ids), prior)
    return ids, weights, *calibration(flags, np.bincount(doc, weights[feature], len(flags)), prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1). Null and empty texts score as texts without words; a column
    of that name is replaced; all rows and all other columns stay."""
    ids, weights, margins, chances = model
    dense = np.zeros(1 << HASH_BITS, np.float32)
    dense[ids] = weights
    shared = docs.sparkSession.sparkContext.broadcast(dense)
    docs = docs.drop("toxicity")
    schema = T.StructType([*docs.schema.fields, T.StructField("toxicity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        for batch in batches:
            for rows, raw, at in chunks(batch, "text"):
                doc, feat = features(raw, at)
                told = weight[feat] != 0
                both = np.unique((doc[told].astype(np.int64) << HASH_BITS) | feat[told])
                z = np.bincount(both >> HASH_BITS, weight[both & ((1 << HASH_BITS) - 1)], rows.num_rows)
                s = np.round(np.interp(z, margins, chances), 6)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(s, pa.float64())], schema=rows.schema.append(pa.field("toxicity", pa.float64())))

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> DataFrame:
    """Fits on ``labels`` and ``docs`` and adds ``toxicity`` to every row of ``docs``."""
    return score(docs, fit(docs, labels, positives, unlabelled))
