"""Benchmark decontamination by Wu-Manber multi-pattern search.

Benchmark items become windows of ``window`` consecutive words (a shorter item is one window). The
distinct windows are the patterns. They are collected in blocks of bounded size; each block is
broadcast as Wu-Manber tables, and the documents stream past it, without a shuffle. Bound: a block
holds about ``block_bytes`` of patterns whatever the benchmark's size; a larger benchmark is read in
more passes.

Search, per pattern class (patterns of similar length), over the text as `` w1 w2 ... ``:

* the *shift table* has, for each hashed block of ``B`` bytes, how far the search may skip on;
* where the shift is 0, the block ending the pattern's first ``m`` bytes selects a *bucket*, narrowed
  by the patterns' first ``B`` bytes;
* each pattern of the bucket is *compared directly*; only that confirms an occurrence.

The search keeps many cursors at once (numpy), one for each stretch of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versio.llm.common import WORD_BYTES, bytes_of, chunks, share, stored, taken

WINDOW = 10
BLOCK_BYTES = 16 << 20
#: Bytes of a shift-table block, at most; length classes begin at these pattern lengths.
BLOCK = 8
CLASSES = (0, 16, 32, 64)
SHIFT_BITS = 18
LANES = 4096


class WuManber:
    """Tables for one class of byte patterns, each of ``BLOCK`` bytes or fewer only if it must be."""

    def __init__(self, patterns: list[bytes], ids: list[int]):
        self.patterns, self.ids = patterns, ids
        self.m = min(map(len, patterns))
        self.b = min(BLOCK, self.m)
        self.mask = np.uint64((1 << (8 * self.b)) - 1)
        heads = np.frombuffer(b"".join(p[: self.m] for p in patterns), np.uint8).reshape(-1, self.m)
        self.shift = np.full(1 << SHIFT_BITS, self.m - self.b + 1, np.int32)
        for end in range(self.b, self.m + 1):
            block = np.zeros(len(patterns), np.uint64)
            for k in range(self.b):
                block |= heads[:, end - self.b + k].astype(np.uint64) << np.uint64(8 * k)
            np.minimum.at(self.shift, self._slot(block), self.m - end)
            suffix = block if end == self.m else None
            if end == self.b:
                prefix = block
        keys = self._key(suffix, prefix)
        order = np.argsort(keys, kind="stable")
        self.order, self.keys = order, keys[order]

    @staticmethod
    def _slot(block: np.ndarray) -> np.ndarray:
        return ((block * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SHIFT_BITS)).astype(np.int64)

    @staticmethod
    def _key(suffix: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        return (suffix * np.uint64(0x9E3779B97F4A7C15)) ^ (prefix * np.uint64(0xC2B2AE3D27D4EB4F))

    def search(self, data: bytes) -> list[tuple[int, int]]:
        """(start, pattern id) of every occurrence in ``data``, which has 8 spare bytes at its end."""
        n = len(data) - 8
        if n < self.m:
            return []
        word = np.ndarray(n + 1, "<u8", data, strides=(1,))
        step = max(1, -(-(n - self.m + 1) // LANES))
        cur = np.arange(self.m, n + 1, step, dtype=np.int64)  # end of the pattern's first m bytes
        stop = np.minimum(cur + step, n + 1)
        found: list[np.ndarray] = []
        while len(cur):
            s = self.shift[self._slot(word[cur - self.b] & self.mask)]
            hit = s == 0
            if hit.any():
                found.append(cur[hit])
            cur = cur + np.maximum(s, 1)
            on = cur < stop
            if not on.all():
                cur, stop = cur[on], stop[on]
        if not found:
            return []
        at = np.concatenate(found)
        keys = self._key(word[at - self.b] & self.mask, word[at - self.m] & self.mask)
        lo = np.searchsorted(self.keys, keys, "left")
        some = lo < len(self.keys)
        some[some] = self.keys[lo[some]] == keys[some]
        at, keys, lo = at[some] - self.m, keys[some], lo[some]
        hi = np.searchsorted(self.keys, keys, "right")
        out = []
        for p, a, z in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True):
            for k in self.order[a:z].tolist():
                if data.startswith(self.patterns[k], p):
                    out.append((p, self.ids[k]))
        return out


class Patterns:
    """The pattern classes of one block of windows, and the items each window belongs to."""

    def __init__(self, rows: list[tuple[bytes, str]]):
        by: dict[bytes, set[str]] = {}
        for window, item in rows:
            by.setdefault(window, set()).add(item)
        texts = sorted(by)
        self.items = [sorted(by[t]) for t in texts]
        self.words = [t.count(b" ") - 1 for t in texts]
        self.classes = []
        for lo, hi in zip(CLASSES, (*CLASSES[1:], 1 << 62), strict=True):
            own = [i for i, t in enumerate(texts) if lo <= len(t) < hi]
            if own:
                self.classes.append(WuManber([texts[i] for i in own], own))

    def search(self, data: bytes) -> list[tuple[int, int]]:
        return [x for c in self.classes for x in c.search(data)]


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(WORD_BYTES).split()


def benchmark_windows(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """Distinct (window, item): window as bytes `` w1 w2 ... ``, item as string (null: empty)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = bytes_of(batch.column("t"))
            data, items, out, own = raw.tobytes(), batch.column("i").to_pylist(), [], []
            for k, name in enumerate(items):
                w = words_of(data[at[k] : at[k + 1]])
                for a in range(max(1, len(w) - window + 1) if w else 0):
                    out.append(b" " + b" ".join(w[a : a + window]) + b" ")
                    own.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(own, pa.string())], ["window", "item"])

    source = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.col(text).cast("string").alias("t"))
    return source.mapInArrow(cut, "window binary, item string").distinct()


def scan(docs: DataFrame, patterns: Patterns, text: str) -> DataFrame:
    """Adds what one block of patterns finds to the columns ``_words``, ``_spans`` (from, to pairs of
    word positions, flattened and merged) and ``_items``."""
    tables = share(docs.sparkSession, patterns)
    kept = [c for c in docs.columns if not c.startswith("_wm_")]
    again = "_wm_spans" in docs.columns
    fields = [f for f in docs.schema.fields if f.name in kept]
    schema = T.StructType([*fields, T.StructField("_wm_words", T.LongType()), T.StructField("_wm_spans", T.ArrayType(T.LongType())), T.StructField("_wm_items", T.ArrayType(T.StringType()))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = taken(tables)
        for batch in batches:
            for rows, raw, at in chunks(batch, text):
                data, n, lines = raw.tobytes(), [], []
                for k in range(rows.num_rows):
                    w = words_of(data[at[k] : at[k + 1]])
                    n.append(len(w))
                    lines.append(b" ".join(w))
                starts = np.cumsum([0] + [len(x) + 3 for x in lines])  # b" " + line + b" \0" each
                joined = b"".join(x for line in lines for x in (b" ", line, b" \0")) + bytes(8)
                spans: list[list[tuple[int, int]]] = [[] for _ in lines]
                items: list[set[str]] = [set() for _ in lines]
                hits = p.search(joined)
                by_doc: dict[int, list[tuple[int, int]]] = {}
                for (pos, k), d in zip(hits, (np.searchsorted(starts, [h[0] for h in hits], "right") - 1).tolist(), strict=True):
                    by_doc.setdefault(d, []).append((pos, k))
                for d, own in by_doc.items():
                    blank = np.flatnonzero(np.frombuffer(joined, np.uint8, starts[d + 1] - starts[d], starts[d]) == 32)
                    first = np.searchsorted(blank, np.array([x[0] for x in own]) - starts[d]).tolist()
                    for a, (_, k) in zip(first, own, strict=True):
                        spans[d].append((a, a + p.words[k]))
                        items[d].update(p.items[k])
                if again:
                    for d, (s, i) in enumerate(zip(rows.column("_wm_spans").to_pylist(), rows.column("_wm_items").to_pylist(), strict=True)):
                        spans[d] += zip(s[::2], s[1::2], strict=True)
                        items[d].update(i)
                merged = [merge(s) for s in spans]
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in kept), pa.array(n, pa.int64()), pa.array(merged, pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    schema=pa.schema([*(rows.schema.field(c) for c in kept), ("_wm_words", pa.int64()), ("_wm_spans", pa.list_(pa.int64())), ("_wm_items", pa.list_(pa.string()))]),
                )

    return docs.mapInArrow(find, schema)


def merge(spans: list[tuple[int, int]]) -> list[int]:
    """Unites overlapping or touching (from, to) pairs, flattened."""
    out: list[int] = []
    for a, z in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], z)
        else:
            out += [a, z]
    return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with ``dc_words`` (words in the text), ``dc_hit`` (words inside a benchmark window),
    ``dc_spans`` (array of from, to word positions, end exclusive), ``dc_items`` (ids, as sorted strings).

    Null and empty texts have no words and no hits; a null item id counts as one item with the empty
    id; repeated rows each get their own result; rows of one item id are one item. An empty benchmark
    finds nothing. Columns of ``docs`` named ``dc_*`` or ``_wm_*`` are replaced; all others stay.
    """
    docs = docs.drop(*[c for c in docs.columns if c.startswith(("_wm_", "dc_"))])
    windows = stored(benchmark_windows(benchmark, item, item_text, window), "windows")
    total = windows.agg(F.sum(F.octet_length("window") + F.octet_length("item"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    out = docs
    for b in range(blocks):
        part = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b) if blocks > 1 else windows
        rows = [(bytes(r[0]), r[1]) for r in part.toLocalIterator()]
        out = scan(out, Patterns(rows), text)
        if b < blocks - 1:
            out = stored(out, "decontaminated")
    spans = F.col("_wm_spans")
    hit = F.aggregate(F.sequence(F.lit(0), F.size(spans) - 1), F.lit(0).cast("long"), lambda s, i: s + F.when(i % 2 == 0, -spans[i]).otherwise(spans[i]))
    return out.select(
        *docs.columns, F.col("_wm_words").alias("dc_words"),
        F.when(F.size(spans) == 0, F.lit(0).cast("long")).otherwise(hit).alias("dc_hit"), spans.alias("dc_spans"), F.col("_wm_items").alias("dc_items"),
    )


def digest(found: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One row per document: counts, digest of the item ids and the verdict."""
    return found.select(
        F.col(doc).alias("doc_id"), F.col("dc_words").alias("n_words"), F.col("dc_hit").alias("n_hit"),
        F.size("dc_items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "dc_items"), 256).alias("items_sha256"),
        (F.col("dc_hit") > 0).alias("contaminated"),
    )


__all__ = ["Patterns", "WuManber", "decontaminate", "digest"]
