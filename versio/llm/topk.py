"""Exact top-k search by distributed histogram selection.

Every query is scored against every row; nothing is indexed or sampled. A round counts, for each
query, how many scores fall in each of ``BINS`` equal ranges; the counts of all tasks are added up, and
the range that holds the kth best score becomes the next round's whole. It ends when that range is one
value, or when no more than ``ENOUGH`` times k rows reach its lower end. A last pass keeps the rows
that do, k a task and query at most (ties go to the smaller id, so a task's own k best suffice), and ranks them.

Queries are taken in blocks of ``BLOCK``, whose vectors go to every task: the block's size bounds what
is broadcast and the histograms, whatever the number of queries. Scores are 64-bit integers; sums of
products beyond 64 bits wrap around, as in Spark's own long arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versio.llm.common import share, stored, taken

K, EVERY, SCALE = 10, 100, 1024
BLOCK, BINS, ENOUGH = 1024, 256, 4
#: Scores held at once in a task.
AT_ONCE = 1 << 21


def integers(vectors: DataFrame, vec: str, embedding: str, scale: int) -> DataFrame:
    """(id, v): rows whose vector takes part, as integer components."""
    whole = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return (
        vectors.where(F.col(vec).isNotNull() & F.col(embedding).isNotNull()).where(whole)
        .select(F.col(vec).cast("long").alias("id"), F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
    )


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of integers, cut or filled with zeros to ``width``."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    size = np.diff(np.asarray(lists.offsets))
    values = np.asarray(lists.flatten(), np.int64)
    if (size == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(size), width), np.int64)
    at = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
    row = np.repeat(np.arange(len(size)), size)
    out[row[at < width], at[at < width]] = values[at < width]
    return out


class Scorer:
    """A block of queries; scores candidates and forgets those with a query's own id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.top = float(np.abs(vectors.astype(np.float64)).max(initial=0))

    def batches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(candidate ids, scores by candidate and query, whether the pair counts)."""
        width = self.vectors.shape[1]
        size = max(1, AT_ONCE // max(1, len(self.ids)))
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                part = batch.slice(i, size)
                ids, x = part.column("id").to_numpy(), matrix(part.column("v"), width)
                if float(np.abs(x.astype(np.float64)).max(initial=0)) * self.top * max(1, width) < 2**53:
                    s = (x.astype(np.float64) @ self.vectors.T.astype(np.float64)).astype(np.int64)  # exact below 2**53
                else:
                    s = x @ self.vectors.T
                yield ids, s, ids[:, None] != self.ids[None, :]


def _histogram(rows: DataFrame, scorer, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts by query and bin of the scores from low to high, and each query's bin width."""
    spark = rows.sparkSession
    width = np.array([max(1, -(-(int(h) - int(a) + 1) // BINS)) for a, h in zip(low, high, strict=True)], np.uint64)
    state = spark.sparkContext.broadcast((low, high, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, (lo, hi, w) = taken(scorer), state.value
        n = len(q.ids)
        total = np.zeros(n * BINS, np.int64)
        for _, s, counts in q.batches(batches):
            counts &= (s >= lo) & (s <= hi)
            cand, query = np.nonzero(counts)
            bins = (s[cand, query].view(np.uint64) - lo.view(np.uint64)[query]) // w[query]
            total += np.bincount(query * BINS + bins.astype(np.int64), minlength=n * BINS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])

    cells = rows.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # BLOCK x BINS at most
    out = np.zeros(len(low) * BINS, np.int64)
    out[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    state.unpersist()
    return out.reshape(-1, BINS), width


def thresholds(rows: DataFrame, scorer, n: int, k: int) -> np.ndarray:
    """For each query a score that its k best rows reach and few others do."""
    low, high = np.full(n, -(2**63), np.int64), np.full(n, 2**63 - 1, np.int64)
    above = np.zeros(n, np.int64)
    least = scorer_range(rows, scorer)
    low, high = np.maximum(low, -least), np.minimum(high, least)
    open_ = np.ones(n, bool)
    out = low.copy()
    while open_.any():
        lo, hi = np.where(open_, low, 1), np.where(open_, high, 0)  # nothing falls into a settled query's range
        counts, width = _histogram(rows, scorer, lo, hi)
        for q in np.flatnonzero(open_).tolist():
            down = above[q] + np.cumsum(counts[q][::-1])
            if down[-1] <= k:  # all there are
                out[q], open_[q] = low[q], False
                continue
            b = BINS - 1 - int(np.argmax(down >= k))
            a, w = int(low[q]) + b * int(width[q]), int(width[q])
            reach = int(down[BINS - 1 - b])
            out[q] = a
            if w == 1 or reach <= ENOUGH * k:
                open_[q] = False
            above[q] = reach - int(counts[q][b])
            low[q], high[q] = a, min(int(high[q]), a + w - 1)
    return out


def scorer_range(rows: DataFrame, scorer) -> np.ndarray:
    """For each query a bound on the size of its scores, from the largest component of any row."""
    q = taken(scorer)
    top = rows.select(F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))).alias("top")).first()[0] or 0.0
    bound = np.abs(q.vectors.astype(np.float64)).sum(axis=1) * top * (1 + 1e-9) + 1
    return np.array([int(b) if b < 2**62 else 2**63 - 1 for b in bound], np.int64)


def _best(ids: np.ndarray, query: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of each query's k highest scores, ties to the smaller id."""
    order = np.lexsort((ids, ~score, query))
    q = query[order]
    head = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(head, np.arange(len(q)), 0)) if len(q) else np.zeros(0, np.int64)
    return order[np.arange(len(q)) - begin < k]


def _candidates(rows: DataFrame, scorer, least: np.ndarray, k: int) -> DataFrame:
    floor_ = rows.sparkSession.sparkContext.broadcast(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, low = taken(scorer), floor_.value
        own = [np.zeros(0, np.int64)] * 3
        for ids, s, counts in q.batches(batches):
            cand, query = np.nonzero(counts & (s >= low))
            own = [np.concatenate(x) for x in zip(own, (ids[cand], query, s[cand, query]), strict=True)]
            kept = _best(*own, k)
            own = [x[kept] for x in own]
        ids, query, score = own
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(q.ids[query] if len(query) else query), pa.array(ids), pa.array(score)], ["q", "query", "vec_id", "score"])

    return rows.mapInArrow(run, "q long, query long, vec_id long, score long")


def top_k(vectors: DataFrame, vec: str = "vec_id", embedding: str = "embedding", k: int = K, every: int = EVERY, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """(query, rank, vec_id, score): for each row whose id is divisible by ``every`` its k best other rows.

    Rows with a null id, a null vector or a null or non-finite component take no part. A row's own id
    is no candidate. Repeated rows are candidates each, and one query; rows of one id with different
    vectors are a query each. Of vectors of different lengths the common components count.
    """
    rows = integers(vectors, vec, embedding, scale)
    queries = stored(rows.where(F.col("id") % every == 0).distinct(), "queries")
    total = queries.count()
    blocks = max(1, -(-total // block))
    out = None
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == b).toArrow()
        if not part.num_rows and b < blocks - 1:
            continue
        lists = part.column("v").combine_chunks()
        width = int(max((len(x) for x in lists.to_pylist()), default=0))
        scorer = share(rows.sparkSession, Scorer(part.column("id").to_numpy(), matrix(lists, max(1, width))))
        least = thresholds(rows, scorer, part.num_rows, k) if part.num_rows else np.zeros(0, np.int64)
        found = _candidates(rows, scorer, least, k).withColumn("q", F.col("q") + b * (1 << 32))
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
        found = found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "vec_id", "score")
        if b < blocks - 1:
            found = stored(found, "top")
        out = found if out is None else out.unionByName(found)
    return out
