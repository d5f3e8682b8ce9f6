"""SimHash near-dedup with the generalised pigeonhole principle (GPH).

A document's fingerprint has 64 bits: lower-case A-Z, take words between ASCII white space, hash
every run of ``SHINGLE`` words (XXH64), and set a bit that more than half of the hashes have. Two
fingerprints link at a Hamming distance of ``DISTANCE`` or less; documents that links join are one
component.

Search: the 64 bits are cut into m partitions, and partition i gets a threshold t_i, with
sum(t_i) = DISTANCE - m + 1. Two linked fingerprints then differ in at most t_i bits of some partition
i (t_i = -1: the partition is not searched). Correlated bits share a partition, so that the others
tell fingerprints apart; a dynamic programme gives each partition the threshold that costs least, in rows
to shuffle and candidates to compare, for each m, and the cheapest m is taken. The counts behind that cover
all fingerprints. Both sides of a pair flip half of t_i bits, rounded up: within t_i they meet at a value
between them, so a row is sent for each value near by, not for all within t_i.

Equal fingerprints are one row from the start. A bucket (partition, value) of more than ``BLOCK``
fingerprints is cut into blocks, and each pair of blocks is a group of its own, so no task gets a
whole hot bucket. Groups are verified in numpy and give the links that join their members, one for each
member at most, not all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versio.llm.common import bytes_of, stored

SHINGLE, DISTANCE, SEED = 3, 3, 42
BLOCK = 4096
#: What comparing two fingerprints of a bucket costs against sending and sorting a row: nanoseconds in numpy
#: against microseconds.
PAIR = 1 / 500
#: Hashes whose bits are counted at once.
AT_ONCE = 1 << 17


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    if n <= 1:
        return digest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    hashes = np.fromiter((digest(line[a:z], SEED) for a, z in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), "<u8", n)
    count = np.zeros(64, np.int64)
    for i in range(0, n, AT_ONCE):
        part = hashes[i : i + AT_ONCE]
        count += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc, fp) of each row of (doc, text); fp is the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = bytes_of(batch.column("text"))
            data = raw.tobytes()
            fp = np.array([fingerprint(data[at[k] : at[k + 1]], shingle) for k in range(batch.num_rows)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(fp.view(np.int64))], ["doc", "fp"])

    return docs.select("doc", "text").mapInArrow(run, T.StructType([T.StructField("doc", docs.schema["doc"].dataType), T.StructField("fp", T.LongType())]))


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both set (64 x 64)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64), np.int64), 0
        for batch in batches:
            x = batch.column("fp").to_numpy()
            bits = np.unpackbits(x.view(np.uint8), bitorder="little").reshape(-1, 64).astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
            n += len(x)
        cells = np.append(total.reshape(-1), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097, dtype=np.int32)), pa.array(cells)], ["cell", "n"])

    rows = fps.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 4097 rows
    cells = np.zeros(4097, np.int64)
    for r in rows:
        cells[r[0]] = r[1]
    return int(cells[-1]), cells[:-1].reshape(64, 64)


def partitions(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The 64 bits in m groups of nearly equal size, each grown from the most correlated bits left."""
    p = np.diag(both) / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(1, n) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    left, out = list(range(64)), []
    for k in range(m):
        size = len(left) // (m - k)
        group = [max(left, key=lambda b: (corr[b, left].max(), -b))]
        while len(group) < size:
            rest = [b for b in left if b not in group]
            group.append(max(rest, key=lambda b: (corr[b, group].sum(), -b)))
        left = [b for b in left if b not in group]
        out.append(sorted(group))
    return out


def projected(bits: list[int]) -> Column:
    """The given bits of ``fp``; the others 0."""
    mask = sum(1 << b for b in bits)
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def near(bits: list[int], t: int) -> Column:
    """The values where ``fp`` meets all fingerprints within ``t`` flips on the bits: those within half as many."""
    flips = [sum(1 << b for b in c) for k in range(half(t) + 1) for c in combinations(bits, k)]
    flips = [x - (1 << 64) if x >> 63 else x for x in flips]
    value = projected(bits)
    return F.transform(F.lit(flips).cast("array<bigint>"), lambda x: value.bitwiseXOR(x))


def half(t: int) -> int:
    return (t + 1) // 2


def allocate(cost: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds, -1 or more for each partition, with the given sum and the least cost;
    cost[i][t + 1] is that of partition i at threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, x in enumerate(row, -1):
                if s + t not in step or c + x < step[s + t][0]:
                    step[s + t] = (c + x, [*ts, t])
        best = step
    return best[total]


def plan(fps: DataFrame, distance: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions to search, by the estimated cost of rows and candidates.

    At threshold 0 a partition's candidates are counted exactly, over all fingerprints; at t they are
    taken to grow as the chance that two fingerprints meet, their flips taken together, does.
    """
    n, both = bit_counts(fps)
    cuts = {m: partitions(n, both, m) for m in range(2, distance + 2)} if distance else {1: [list(range(64))]}
    parts = [(m, i, bits) for m, groups in cuts.items() for i, bits in enumerate(groups)]
    values = fps.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), projected(bits).alias("value")) for k, (_, _, bits) in enumerate(parts)])).alias("x")).select("x.*")
    sums = values.groupBy("k", "value").agg(F.count("*").alias("c")).groupBy("k").agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2).alias("pairs"))
    pairs = {r[0]: r[1] for r in sums.collect()}  # a row for each partition
    p = np.diag(both) / max(1, n)
    costs: dict[int, list[list[float]]] = {}
    for k, (m, _, bits) in enumerate(parts):
        differ = np.array([1.0])
        for b in bits:
            q = 2 * p[b] * (1 - p[b])
            differ = np.convolve(differ, [1 - q, q])
        row = [0.0]
        for t in range(distance + 1):
            rows = n * sum(math.comb(len(bits), j) for j in range(half(t) + 1))
            row.append(rows + PAIR * pairs.get(k, 0) * differ[: 2 * half(t) + 1].sum() / max(differ[0], 1e-12))
        costs.setdefault(m, []).append(row)
    _, m, ts = min((*allocate(c, distance - m + 1)[:1], m, allocate(c, distance - m + 1)[1]) for m, c in costs.items())
    return [(bits, t) for bits, t in zip(cuts[m], ts, strict=True) if t >= 0]


def joined(fp: np.ndarray, group: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by group: (fingerprint, one it is linked with, over others if need be), for all
    rows but one of each set that verified links join."""
    label = np.arange(len(fp))
    at, step = label[:-1], 1
    while len(at):
        at = at[at < len(fp) - step]
        at = at[group[at] == group[at + step]]
        a, b = at, at + step
        new = label[a] != label[b]
        a, b = a[new], b[new]
        near = np.bitwise_count((fp[a] ^ fp[b]).view(np.uint64)) <= distance
        a, b = a[near], b[near]
        while len(a):
            x, y = label[a], label[b]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
            a, b = (z[label[a] != label[b]] for z in (a, b))
        step += 1
    linked = label != np.arange(len(fp))
    return fp[linked], fp[label[linked]]


def links(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(u, v) pairs of distinct fingerprints of ``fps`` (fp, without repeats) that are in one component;
    they join all that links at the distance join."""
    chosen = plan(fps, distance)
    rows = None
    for k, (bits, t) in enumerate(chosen):
        part = fps.select(F.lit(k).alias("k"), F.explode(near(bits, t)).alias("value"), "fp")
        rows = part if rows is None else rows.unionByName(part)
    keys = ["k", "value"]
    big = rows.groupBy(keys).agg(F.count("*").alias("n")).where(F.col("n") > block)
    rows = rows.join(big, keys, "left").withColumn("m", F.ceil(F.coalesce("n", F.lit(1)) / block).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("m")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("m") - 1))
    rows = rows.select(*keys, "fp", own.alias("own"), other.alias("other")).select(*keys, "fp", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    names = [*keys, "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def out(columns: list[np.ndarray]) -> pa.RecordBatch:
            change = np.zeros(len(columns[0]), bool)
            for c in columns[:-1]:
                change[1:] |= c[1:] != c[:-1]
            u, v = joined(columns[-1], np.cumsum(change), distance)
            differ = u != v
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)[differ]), pa.array(np.minimum(u, v)[differ])], ["u", "v"])

        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in (*names, "fp")]
            if not len(columns[0]):
                continue
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            same = np.ones(len(columns[0]), bool)
            for c in columns[:-1]:
                same &= c == c[-1]
            last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0  # the last group may go on
            held = [c[last:] for c in columns]
            if last:
                yield out([c[:last] for c in columns])
        if held is not None:
            yield out(held)

    return rows.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each node of the edges (u, v), u > v, that is not the smallest of its component, with that
    one. Alternating large-star and small-star rounds, each stored; they end when nothing changes."""
    edges = stored(edges, "links")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "stars")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc, fp, component, root): fingerprint and component of each row; root is the smallest fingerprint
    of the component.

    The component is the smallest doc_id that links reach. Null and empty texts have fingerprint zero
    and link like any other; a null doc_id is never a component's name unless it has no other.
    Repeated rows are rows of the same component.
    """
    rows = stored(fingerprints(docs.select(F.col(doc).alias("doc"), F.col(text).cast("string").alias("text")), shingle), "fingerprints")
    first = stored(rows.groupBy("fp").agg(F.min("doc").alias("doc")), "distinct-fingerprints")
    root = components(links(first.select("fp"), distance))
    named = first.join(root.withColumnsRenamed({"u": "fp", "v": "root"}), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("doc").alias("component"))
    return rows.join(named.join(least, "root").select("fp", "component", "root"), "fp").select("doc", "fp", "component", "root")


def one_each(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one document of each component left: the one with the smallest doc_id. Of rows that
    share that doc_id one stays; of a component whose rows all have a null doc_id one stays, too."""
    found = near_duplicates(docs, doc, text, shingle, distance)
    kept = found.where(F.col("doc") == F.col("component")).groupBy("doc").agg(F.count("*").alias("__sh_rows"))
    both = docs.join(kept.withColumnRenamed("doc", "__sh_doc"), F.col(doc) == F.col("__sh_doc"))
    alone = both.where("__sh_rows = 1").select(*docs.columns)
    shared = both.where("__sh_rows > 1").dropDuplicates([doc]).select(*docs.columns)
    # Rows without an id are told apart by their fingerprints.
    unnamed = found.where("component is null").groupBy("root").agg(F.min("fp").alias("__sh_fp")).select("__sh_fp")
    other = _fingerprinted(docs.where(F.col(doc).isNull()), text, shingle).join(unnamed, "__sh_fp").dropDuplicates(["__sh_fp"]).select(*docs.columns)
    return alone.unionByName(shared).unionByName(other)


def _fingerprinted(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """``docs`` with ``__sh_fp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = bytes_of(batch.column(text))
            fp = np.array([fingerprint(raw[at[k] : at[k + 1]].tobytes(), shingle) for k in range(batch.num_rows)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp.view(np.int64))], [*batch.schema.names, "__sh_fp"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__sh_fp", T.LongType())]))


def digest(found: DataFrame) -> DataFrame:
    return found.select(F.col("doc").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
