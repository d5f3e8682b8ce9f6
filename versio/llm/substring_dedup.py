"""Removal of repeated byte strings by prefix doubling over the positions that a sampled gram step leaves.

Every byte covered by a string of ``LENGTH`` bytes that also starts earlier goes. Doubling over all
positions would shuffle a row for each byte of the corpus in each round, so positions that are settled
without it go first; the rest are ranked by doubling, exactly:

1. ``GRAM`` bytes. Each window of ``LENGTH`` bytes has an anchor, the leftmost of its GRAM-byte strings with
   the least name, a 64-bit hash (about one byte in 30 is an anchor). Equal windows have equal anchors
   at equal places, so a window whose anchor's name is unique is unique: most positions end here.
2. An anchor and all that its windows cover, about twice ``LENGTH``. Pairs (gram, cover) that occurred
   before make all windows of the anchor repeats. The first anchor of a cover repeats at most in part.
3. Up to ``UNIT`` neighbouring windows of a cover whose gram has several covers, on a grid from the anchor.
   Units that occurred before are repeats; of the first ones those are unique, with all their windows,
   whose common bytes are in no other first unit. What is left goes the same way in units of FINER
   windows; what is left then lies at the edges of differences.
4. Prefix doubling over the positions that are left. Spark sorts their strings of LENGTH / 4 bytes and ranks
   them; then it sorts the pairs (rank at p, rank at p + h) for h of LENGTH / 4 and LENGTH / 2. Each round
   drops the positions whose key is unique: no window that needs a unique string repeats. A position
   is one row a round. Windows with the same last pair are equal, all but the first of a class repeat.

A class's first place is a partial minimum, and only distinct keys are sorted, so hot strings send one row
a task; joins on keys give every member its class's rank or first place, and hot classes are split by
adaptive execution. Every round is stored, and its shuffle files go at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versio.functions.worker import resource
from versio.llm.common import bytes_of, chunks, discard, mix64, stored, stored_path

LENGTH, GRAM = 100, 36
#: Windows that are settled at once before the doubling, and then of what is left; any numbers under LENGTH give
#: the same result.
UNIT, FINER = 16, (2,)
#: Bytes that are named at once, so that their names stay in a core's cache; places within them take the low
#: bits of a sort key.
SEGMENT = 1 << 18
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))
LETTERS = tuple(mix64(np.arange(256, dtype=np.uint64) * np.uint64(k) + np.uint64(k)) for k in (0x632BE5AB, 0x85157AF5))


def _powers(which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse; made once in a Python worker."""
    return resource(lambda: _make_powers(which), f"powers-{which}-{SEGMENT}")


def _make_powers(which: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (BASES[which], np.uint64(pow(int(BASES[which]), -1, 1 << 64))):
        p = np.full(SEGMENT + 1, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


class Names:
    """Names of all substrings of a segment: equal strings have equal names (64 bits)."""

    def __init__(self, raw: np.ndarray, which: int):
        power, self.inverse = _powers(which)
        self.sum = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(LETTERS[which][raw] * power[: len(raw)], out=self.sum[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sum[end] - self.sum[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64) * BASES[0])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sum) - size
        return mix64((self.sum[size:] - self.sum[:n]) * self.inverse[:n])


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbouring values."""
    n = len(x)
    y = np.full(n + -n % w, np.iinfo(np.uint64).max, np.uint64)
    y[:n] = x
    y = y.reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).reshape(-1)
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def _segment(raw: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors of texts end to end with offsets ``at``, in one segment: (text number, anchor, first window,
    last window, gram's name, cover's name); places count from the segment's begin."""
    n = len(raw)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    g = Names(raw, 0).grams(gram)
    key = (g & ~np.uint64(SEGMENT - 1)) | np.arange(len(g), dtype=np.uint64)  # of equal names the leftmost is least
    lead = (_least(key, length - gram + 1) & np.uint64(SEGMENT - 1)).astype(np.int64)
    # A text's windows begin before its last length - 1 bytes.
    change = np.zeros(len(lead) + 1, np.int32)
    many = np.diff(at) >= length
    np.add.at(change, at[:-1][many], 1)
    np.add.at(change, at[1:][many] - length + 1, -1)
    inside = np.cumsum(change[:-1]) > 0
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | (lead[1:] != lead[:-1])
    begin[at[:-1][many]] = True
    end = inside.copy()
    end[:-1] &= ~inside[1:] | begin[1:]
    first, last = np.flatnonzero(begin), np.flatnonzero(end)
    place = lead[first]
    return np.searchsorted(at, first, "right") - 1, place, first, last, g[place], Names(raw, 1).of(first, last + length)


def anchors(raw: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """As ``_segment``, with places counted from each text's begin, for any number of bytes."""
    out = []
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + SEGMENT, "right")) - 1)
        a, z = int(at[i]), int(at[j])
        for s in range(a, max(a + 1, z - length + 1), SEGMENT - length + 1) if j == i + 1 else (a,):
            # Each window of a long text lies in exactly one of its segments.
            e = min(z, s + SEGMENT) if j == i + 1 else z
            text, *places, g, cover = _segment(raw[s:e], at[i : j + 1] - a if j > i + 1 else np.array([0, e - s]), length, gram)
            base = at[i : j + 1][text] - a if j > i + 1 else np.full(len(text), a - s)
            out.append((text + i, *(p - base for p in places), g, cover))
        i = j
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else _segment(raw, at, length, gram)


def _chunk_anchors(rows: pa.RecordBatch, raw: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple:
    """The anchors of a chunk of rows, and which of them repeat the gram and cover of an earlier one of the
    chunk; a repeated input row's anchors repeat nothing but drop out (None of both). An anchor that a
    segment's end cuts in two is two anchors of the same place, told apart by their first windows."""
    text, place, first, last, g, e = anchors(raw, at, length, gram)
    rank = pc.rank(rows.column("doc"), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()[text]
    by = np.argsort(g)
    same = g[by[1:]] == g[by[:-1]]
    some = np.union1d(by[1:][same], by[:-1][same])  # most grams occur once: only the others are put in order
    order = some[np.lexsort((first[some], place[some], rank[some], e[some], g[some]))]
    a, b = order[1:], order[:-1]
    again, twice = np.zeros(len(g), bool), np.zeros(len(g), bool)
    again[a] = (g[a] == g[b]) & (e[a] == e[b])
    twice[a] = again[a] & (rank[a] == rank[b]) & (place[a] == place[b]) & (first[a] == first[b])
    return text, place, first, last, g, e, ~again, again & ~twice


def _anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(g, e, doc, place, ahead, more): the anchors; windows begin at place - ahead, and ``more`` follow. Of
    equal ones in a chunk of rows only the first is an anchor; what the others cover comes as rows without
    names, so a group of copies sends one row a chunk to the shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, at in chunks(batch, "text"):
                *arrays, new, old = _chunk_anchors(rows, raw, at, length, gram)
                text, place, first, last, g, e = (x[new] for x in arrays)
                apart = at + np.arange(len(at))  # a place between texts, so that theirs never touch
                a, z = _union(apart[arrays[0][old]] + arrays[2][old], apart[arrays[0][old]] + arrays[3][old] + length)
                own = np.searchsorted(apart, a, "right") - 1
                nameless = pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(pa.concat_arrays([pa.array(x.view(np.int64)), nameless]) for x in (g, e)), rows.column("doc").take(pa.array(np.concatenate([text, own]))),
                     *(pa.array(np.concatenate(x).astype(np.int32)) for x in ((place, a - apart[own]), (place - first, np.zeros(len(a), np.int64)), (last - first, z - a - length)))],
                    ["g", "e", "doc", "place", "ahead", "more"])

    kind = docs.schema["doc"].dataType
    return docs.mapInArrow(run, T.StructType([T.StructField("g", T.LongType()), T.StructField("e", T.LongType()), T.StructField("doc", kind), *(T.StructField(c, T.IntegerType()) for c in ("place", "ahead", "more"))]))


def _contexts(docs: DataFrame) -> DataFrame:
    """(g, doc, place, begin, bytes): what the windows of the anchors listed in ``parts`` cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = bytes_of(batch.column("text"))
            parts = batch.column("parts")
            own = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(parts.offsets)))
            flat = parts.flatten()
            first, end = np.asarray(flat.field("first")) + at[own], np.minimum(np.asarray(flat.field("end")) + at[own], at[own + 1])
            data = raw.tobytes()
            yield pa.RecordBatch.from_arrays(
                [flat.field("g"), batch.column("doc").take(pa.array(own)), flat.field("place"), flat.field("first"), pa.array([data[a:z] for a, z in zip(first.tolist(), end.tolist(), strict=True)], pa.binary())],
                ["g", "doc", "place", "begin", "bytes"])

    kind = docs.schema["doc"].dataType
    return docs.mapInArrow(run, T.StructType([T.StructField("g", T.LongType()), T.StructField("doc", kind), *(T.StructField(c, T.IntegerType()) for c in ("place", "begin")), T.StructField("bytes", T.BinaryType())]))


def _units(contexts: DataFrame, length: int, unit: int) -> DataFrame:
    """(g, e, c, number, at, many, doc, start): the windows of each context in units of up to ``unit``
    neighbours, on a grid that the anchor's place fixes. ``e`` names all bytes of a unit and where it lies from
    its anchor; ``c`` names the bytes that all windows of the grid's cell share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, at in chunks(batch, "bytes", SEGMENT):
                many = np.maximum(np.diff(at) - length + 1, 0)
                row = np.repeat(np.arange(len(many)), many)
                number = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                begin = rows.column("begin").to_numpy()
                behind = rows.column("place").to_numpy()[row] - begin[row] - number  # from window to anchor
                cell = behind // unit
                head = np.concatenate([[True], (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])])[: len(row)]
                head = np.flatnonzero(head)
                count = np.diff(np.append(head, len(row)))
                row, first, cell, behind = row[head], number[head], cell[head], behind[head]
                low = at[row] + first
                e = mix64(Names(raw, 1).of(low, low + count - 1 + length) + behind.astype(np.uint64) * BASES[1])
                core = low + behind - cell * unit  # the cell's last window begins here, its first one unit - 1 before
                c = mix64(Names(raw, 0).of(core, core + length - unit + 1) + cell.astype(np.uint64) * BASES[1])
                of = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("g").take(of), pa.array(e.view(np.int64)), pa.array(c.view(np.int64)), rows.column("number").take(of), *(pa.array(x.astype(np.int32)) for x in (first, count)), rows.column("doc").take(of), pa.array((begin[row] + first).astype(np.int32))],
                    ["g", "e", "c", "number", "at", "many", "doc", "start"])

    kind = contexts.schema["doc"].dataType
    names = [*((c, T.LongType()) for c in ("g", "e", "c", "number")), *((c, T.IntegerType()) for c in ("at", "many")), ("doc", kind), ("start", T.IntegerType())]
    return contexts.mapInArrow(run, T.StructType([T.StructField(c, t) for c, t in names]))


def _settled(contexts: DataFrame, length: int, unit: int) -> tuple[DataFrame, DataFrame]:
    """The windows of contexts in units: (doc, a, z), what units cover that occurred before, and the first units
    that share bytes with others, again as contexts."""
    units = stored(_units(contexts, length, unit), "units")
    start = F.struct("doc", "start")
    firsts = stored(
        units.groupBy("g", "e").agg(F.min(F.struct("doc", "start", "number", "at", "many", "c")).alias("first"), F.count("*").alias("n")).select("g", "e", "n", "first.*"), "first-units")
    early = firsts.where("n > 1").select("g", "e", start.alias("first"))
    spans = units.join(_built(early), ["g", "e"]).where(start > F.col("first")).select("doc", F.col("start").alias("a"), (F.col("start") + F.col("many") - 1 + length).alias("z"))
    cores = firsts.groupBy("g", "c").agg(F.count("*").alias("n")).where("n > 1").select("g", "c")
    left = firsts.join(_built(cores), ["g", "c"], "left_semi").select("g", "doc", "start", "number", "at", "many").join(contexts.select("number", "place", "bytes"), "number")
    return spans, stored(
        left.select("g", "doc", "place", F.col("start").alias("begin"), F.substring("bytes", F.col("at") + 1, F.col("many") - 1 + length).alias("bytes"), F.monotonically_increasing_id().alias("number")), "stretches")


def _offsets(length: int) -> list[tuple[int, int, list[int]]]:
    """The rounds: (size of the strings that have ranks, offset of the pairs, where in a window pairs are
    needed); the last round's pairs, at 0 only, are of ``length`` bytes."""
    sizes, rounds = [-(-length // 4)], []
    while sizes[-1] < length:
        sizes.append(min(2 * sizes[-1], length))
    needed = [0]
    for size, whole in reversed(list(zip(sizes, sizes[1:], strict=False))):
        rounds.append((size, whole - size, needed))
        needed = sorted({x + y for x in needed for y in (0, whole - size)})
    return rounds[::-1]


def _strings(stretches: DataFrame, length: int, size: int, needed: list[int]) -> DataFrame:
    """(number, at, x): strings of ``size`` bytes at the needed places of every window of every stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, at in chunks(batch, "bytes", SEGMENT):
                windows = np.maximum(np.diff(at) - length + 1, 0)
                many = np.maximum(np.diff(at) - size + 1, 0)
                row = np.repeat(np.arange(len(many)), many)
                place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                used = np.zeros(len(row), bool)
                for x in needed:
                    used |= (place >= x) & (place < x + windows[row])
                row, place = row[used], place[used]
                if not len(row):
                    continue
                data = np.lib.stride_tricks.sliding_window_view(raw, size)[at[row] + place].tobytes()
                ends = np.arange(0, len(data) + 1, size, dtype=np.int32)
                strings = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([rows.column("number").take(pa.array(row)), pa.array(place.astype(np.int32)), strings], ["number", "at", "x"])

    return stretches.select("number", "bytes").mapInArrow(run, T.StructType([T.StructField("number", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("x", T.BinaryType())]))


def _built(keyed: DataFrame) -> DataFrame:
    """``keyed``, of distinct keys, as the side of a join that a task holds as a hash table: its partition is
    as small as the shuffle makes it whatever keys are hot, and neither side is sorted."""
    return keyed.hint("shuffle_hash")


def _ranked(positions: DataFrame, keys: list[str]) -> DataFrame:
    """(number, at, rank): positions whose keys occur more than once, ranked by the keys' order. Only distinct
    keys are sorted, after partial counts, and stored before, as Spark reads what it sorts twice; a frequent
    key's positions meet its rank in a join, which adaptive execution splits."""
    path = stored_path(positions.sparkSession, "shared-keys")
    shared = stored(positions.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "shared-keys", path)
    ranks = stored(shared.orderBy(*keys).select(*keys, F.monotonically_increasing_id().alias("rank")), "ranks")
    discard(positions.sparkSession, path)
    return positions.join(_built(ranks), keys).select("number", "at", "rank")


def _pairs(ranked: DataFrame, offset: int, needed: list[int], unit: int) -> DataFrame:
    """(number, at, x, y): the ranks at a needed position and ``offset`` bytes behind it, where both are left. The
    positions of a stretch, four a window at most, follow each other in a partition."""

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        number, at, rank = (rows.column(c).to_numpy() for c in ("number", "at", "rank"))
        row = np.cumsum(np.append(0, number[1:] != number[:-1]))[: len(number)]
        key = row << 32 | at
        order = np.argsort(key)
        key, rank, at, number = key[order], rank[order], at[order], number[order]
        ahead = np.minimum(np.searchsorted(key, key + offset), max(len(key) - 1, 0))
        used = np.zeros(len(key), bool)
        for x in needed:
            used |= (at >= x) & (at < x + unit)
        both = np.flatnonzero(used & (key[ahead] == key + offset))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (number[both], at[both].astype(np.int32), rank[both], rank[ahead[both]])], ["number", "at", "x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last stretch of a batch goes on in the next one
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            if not len(rows):
                continue
            cut = int(np.searchsorted(rows.column("number").to_numpy(), rows.column("number")[-1].as_py()))
            yield pairs(rows.slice(0, cut))
            held = rows.slice(cut)
        if held is not None:
            yield pairs(held)

    together = ranked.repartition("number").sortWithinPartitions("number")
    return together.mapInArrow(run, T.StructType([T.StructField("number", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("x", T.LongType()), T.StructField("y", T.LongType())]))


def doubled(stretches: DataFrame, length: int, unit: int) -> DataFrame:
    """(number, at, x, y): windows of ``length`` bytes of (number, bytes), ``unit`` a stretch at most, named by a
    pair of ranks: equal windows, and no others, have equal pairs. Windows that a round finds unique are
    left out."""
    rounds = _offsets(length)
    size, offset, needed = rounds[0]
    positions, keys = _strings(stretches, length, size, sorted({x + y for x in needed for y in (0, offset)})), ["x"]
    for _, offset, needed in rounds:
        positions, keys = stored(_pairs(_ranked(positions, keys), offset, needed, unit), "rank-pairs"), ["x", "y"]
    return positions


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, unit: int = UNIT) -> DataFrame:
    """(doc, a, z): stretches of (doc, text), in bytes, that strings of ``length`` bytes with an earlier
    start cover; they may overlap."""
    spark = docs.sparkSession
    place, start, begin = F.struct("doc", "place"), F.struct("doc", "start"), F.col("place") - F.col("ahead")
    covered = ["doc", begin.alias("a"), (begin + F.col("more") + length).alias("z")]
    # The texts are named in one pass; its rows, most of them unique, stay only until those left are known.
    path = stored_path(spark, "all-anchors")
    every = stored(_anchors(docs, length, gram), "all-anchors", path)
    at_once = stored(every.where("g is null").select(*covered), "repeated-at-once")
    every = every.where("g is not null")
    shared = stored(every.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "shared-grams")
    kept = stored(every.join(_built(shared), "g", "left_semi"), "anchors")
    discard(spark, path)
    classes = stored(
        kept.groupBy("g", "e").agg(F.min(F.struct("doc", "place", "ahead", "more")).alias("first"), F.count("*").alias("n")).select("g", "e", "n", "first.*"), "covers")
    first = classes.where("n > 1").select("g", "e", F.struct("doc", "place").alias("first"))
    whole = kept.join(_built(first), ["g", "e"]).where(place > F.col("first")).select(*covered)
    several = stored(classes.drop("n").groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "several")  # so that adaptive execution can split the join
    parts = classes.join(_built(several), "g", "left_semi").groupBy("doc").agg(
        F.collect_list(F.struct("g", "place", begin.alias("first"), (begin + F.col("more") + length).alias("end"))).alias("parts"))
    asked = docs.join(parts.withColumnRenamed("doc", "d"), F.col("doc").eqNullSafe(F.col("d"))).select("doc", "text", "parts")
    left = stored(_contexts(asked).withColumn("number", F.monotonically_increasing_id()), "contexts")
    sizes, settled = [unit, *(u for u in FINER if u < unit)], []
    for u in sizes:
        spans, left = _settled(left, length, u)
        settled.append(spans)
    stretches = left.select("doc", F.col("begin").alias("start"), "bytes", "number")
    windows = doubled(stretches, length, sizes[-1]).join(stretches.select("number", "doc", F.col("start").alias("begin")), "number").select("x", "y", "doc", (F.col("begin") + F.col("at")).alias("start"))
    early = windows.groupBy("x", "y").agg(F.min(start).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    single = windows.join(_built(early), ["x", "y"]).where(start > F.col("first")).select("doc", F.col("start").alias("a"), (F.col("start") + length).alias("z"))
    return stored(reduce(DataFrame.unionByName, [whole, *settled, single, at_once]), "repeats")


def _union(a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching stretches as one, in order."""
    if not len(a):
        return a, z
    order = np.argsort(a, kind="stable")
    a, z = a[order], np.maximum.accumulate(z[order])
    head = np.concatenate([[True], a[1:] > z[:-1]])
    return a[head], z[np.append(np.flatnonzero(head)[1:], len(a)) - 1]


def dedup_substrings(docs: DataFrame, doc: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with ``sd_bytes`` (length of the UTF-8 text), ``sd_kept`` (the bytes left, as binary) and
    ``sd_removed`` (array of (a, z): the maximal stretches taken out).

    Null and empty texts, and those under ``length`` bytes, lose nothing; null counts as empty. A null
    doc_id comes before all others. A doc_id names one document: repeated rows get equal results, none
    of them earlier than another, and a stretch found at a place of one row holds for all its rows.
    Columns named ``sd_*`` are replaced, all others stay.
    """
    docs = docs.drop("sd_bytes", "sd_kept", "sd_removed", "sd_found", "sd_doc")
    source = docs.select(F.col(doc).alias("doc"), F.col(text).cast("string").alias("text"))
    found = repeats(source, length, gram).groupBy("doc").agg(F.collect_list(F.struct("a", "z")).alias("sd_found")).withColumnRenamed("doc", "sd_doc")
    both = docs.join(found, F.col(doc).eqNullSafe(F.col("sd_doc")), "left").drop("sd_doc")
    names = docs.columns
    pair = pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = bytes_of(batch.column(text))
            lists, kept, gone = batch.column("sd_found"), [], []
            for k in range(batch.num_rows):
                own = raw[at[k] : at[k + 1]]
                if lists[k].is_valid:
                    x = lists[k].values
                    a, z = _union(np.asarray(x.field("a")), np.minimum(np.asarray(x.field("z")), len(own)))
                    a, z = a[a < z], z[a < z]
                    keep = np.ones(len(own), bool)
                    for s, e in zip(a.tolist(), z.tolist(), strict=True):
                        keep[s:e] = False
                    kept.append(own[keep].tobytes())
                    gone.append([{"a": s, "z": e} for s, e in zip(a.tolist(), z.tolist(), strict=True)])
                else:
                    kept.append(own.tobytes())
                    gone.append([])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(np.diff(at)), pa.array(kept, pa.binary()), pa.array(gone, pair)], [*names, "sd_bytes", "sd_kept", "sd_removed"])

    stretch = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("z", T.IntegerType())]))
    return both.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("sd_bytes", T.LongType()), T.StructField("sd_kept", T.BinaryType()), T.StructField("sd_removed", stretch)]))


def digest(done: DataFrame, doc: str = "doc_id") -> DataFrame:
    return done.select(
        F.col(doc).alias("doc_id"), F.col("sd_bytes").alias("n_bytes"), (F.col("sd_bytes") - F.octet_length("sd_kept")).cast("long").alias("n_removed"),
        F.size("sd_removed").cast("long").alias("n_spans"), F.sha2("sd_kept", 256).alias("kept_sha256"))
