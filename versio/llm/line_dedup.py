"""Line dedup by a deletion-neighbourhood join.

A line is its words (runs of bytes other than ASCII white space); two lines match if they have the
same words, or, where both have ``LEAST_WORDS`` or more, if one word is inserted, deleted or changed
between them (edit distance 1 over words). A line goes if a matching line comes earlier, by doc_id
and line number; lines are judged on the input, not on what is left. Lines without words stay.

1. Lines become 128-bit names; equal names are grouped to a distinct line with its first place
   (partial sums, so a line that fills a third of the corpus sends one row a task).
2. An edit leaves the first or the last half of the words alone, so only lines that share either with
   another distinct line can match one; the others are left out here (nothing else is).
3. Each of these lines emits all variants within the edit bound, itself and the line without each
   one of its words, as hashed keys. Equal variants are grouped with the earliest line for each
   deleted word, never as pairs: a change shows as the same deletion in both lines, an insertion as
   one line's variant equal to the other line.
4. Each line's earliest partner is fetched, and the edit distance between the two is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versio.llm.common import bytes_of, mix64, stored

LEAST_WORDS = 11
MASK = (1 << 64) - 1
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _name(words: list[bytes]) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(b" ".join(words))
    return _signed(d >> 64), _signed(d & MASK)


def halves(words: list[bytes]) -> list[int]:
    """Keys of the first and last h words, for h of n // 2 and (n - 1) // 2: lines of n and of n or n + 1
    words that one edit parts have the first or the last n // 2 words in common."""
    n, out = len(words), []
    for h in {n // 2, (n - 1) // 2}:
        out.append(_signed(xxhash.xxh3_64_intdigest(b" ".join(words[:h]), 1)))
        out.append(_signed(xxhash.xxh3_64_intdigest(b" ".join(words[n - h :]), 2)))
    return out


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, line, a, b, halves): every line that has words, with its name and the keys of its halves, null
    where it may match equal lines only."""
    kind = docs.schema["doc"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = bytes_of(batch.column("text"))
            data, own, line, a, b, half = raw.tobytes(), [], [], [], [], []
            for k in range(batch.num_rows):
                for i, x in enumerate(data[at[k] : at[k + 1]].split(b"\n")):
                    w = x.split()
                    if w:
                        own.append(k)
                        line.append(i)
                        p, q = _name(w)
                        a.append(p)
                        b.append(q)
                        half.append(halves(w) if len(w) >= LEAST_WORDS else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(pa.array(own, pa.int64())), pa.array(line, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(half, pa.list_(pa.int64()))],
                ["doc", "line", "a", "b", "halves"])

    schema = T.StructType([T.StructField("doc", kind), T.StructField("line", T.IntegerType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("halves", T.ArrayType(T.LongType()))])
    return docs.select("doc", "text").mapInArrow(run, schema)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, line, words): the lines that ``wanted`` names by (doc, line, a, b), as space-joined words."""
    per_doc = wanted.groupBy("doc").agg(F.collect_list(F.struct("line", "a", "b")).alias("w"))
    both = docs.select("doc", "text").join(per_doc.withColumnRenamed("doc", "d"), F.col("doc").eqNullSafe(F.col("d"))).select("doc", "text", "w")
    kind = docs.schema["doc"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = bytes_of(batch.column("text"))
            data, own, line, words = raw.tobytes(), [], [], []
            for k, named in enumerate(batch.column("w").to_pylist()):
                lines = data[at[k] : at[k + 1]].split(b"\n")
                for x in named:
                    w = lines[x["line"]].split() if x["line"] < len(lines) else []
                    if w and _name(w) == (x["a"], x["b"]):  # rows that share a doc_id hold other lines
                        own.append(k)
                        line.append(x["line"])
                        words.append(b" ".join(w))
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(own, pa.int64())), pa.array(line, pa.int32()), pa.array(words, pa.binary())], ["doc", "line", "words"])

    schema = T.StructType([T.StructField("doc", kind), T.StructField("line", T.IntegerType()), T.StructField("words", T.BinaryType())])
    return both.mapInArrow(run, schema).distinct()


def variants(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two hash words for the line itself (first) and for the line without each one of its words."""
    n, out = len(words), []
    names = [xxhash.xxh3_128_intdigest(w) for w in words]
    for part, base in zip((64, 0), BASES, strict=True):
        x = np.array([(d >> part) & MASK for d in names], np.uint64)
        power = np.ones(n + 1, np.uint64)
        np.cumprod(np.full(n, base, np.uint64), out=power[1:])
        ahead = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * power[1:])])
        moved = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * power[:-1])])
        out.append(mix64(np.concatenate([ahead[-1:], ahead[:-1] + (moved[-1] - moved[1:])])).view(np.int64))
    return out[0], out[1]


def _variants(lines: DataFrame) -> DataFrame:
    """(u, v, cut, doc, line): all variants as keys; cut is the deleted word's number, -1 for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, cut, own = [], [], [], []
            for k, words in enumerate(batch.column("words").to_pylist()):
                a, b = variants(words.split(b" "))
                u.append(a)
                v.append(b)
                cut.append(np.arange(-1, len(a) - 1, dtype=np.int32))
                own.append(np.full(len(a), k, np.int64))
            if own:
                rows = pa.array(np.concatenate(own))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(u)), pa.array(np.concatenate(v)), pa.array(np.concatenate(cut)), batch.column("doc").take(rows), batch.column("line").take(rows)],
                    ["u", "v", "cut", "doc", "line"])

    kind = lines.schema["doc"].dataType
    schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType()), T.StructField("cut", T.IntegerType()), T.StructField("doc", kind), T.StructField("line", T.IntegerType())])
    return lines.mapInArrow(run, schema)


def one_edit(x: list[bytes], y: list[bytes]) -> bool:
    """Whether the edit distance between two word lists is at most 1."""
    if abs(len(x) - len(y)) > 1:
        return False
    i, short = 0, min(len(x), len(y))
    while i < short and x[i] == y[i]:
        i += 1
    return x[i + (len(x) >= len(y)) :] == y[i + (len(y) >= len(x)) :]


def _verified(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [one_edit(x.split(b" "), y.split(b" ")) for x, y in zip(batch.column("words").to_pylist(), batch.column("other").to_pylist(), strict=True)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(run, pairs.schema)


def near_lines(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(doc, line): first places of distinct lines that match an earlier, different line."""
    half = distinct.select("doc", "line", "a", "b", F.explode("halves").alias("half"))
    shared = half.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    chosen = half.join(shared, "half", "left_semi").select("doc", "line", "a", "b").distinct()
    lines = stored(_texts(docs, chosen), "lines")
    every = _variants(lines)
    shared = every.groupBy("u", "v").agg(F.count("*").alias("n")).where("n > 1").select("u", "v")
    keys = stored(every.join(shared, ["u", "v"], "left_semi"), "variants")
    place = F.struct("doc", "line")
    # For each key: the earliest line for each deleted word, as many as a line has words at most.
    groups = keys.groupBy("u", "v", "cut").agg(F.min(place).alias("place")).groupBy("u", "v").agg(F.collect_list(F.struct("cut", "place")).alias("by"))
    same = F.filter("by", lambda x: F.when(F.col("cut") < 0, x["cut"] >= 0).otherwise((x["cut"] < 0) | (x["cut"] == F.col("cut"))))
    partner = F.array_min(F.transform(same, lambda x: x["place"]))
    pairs = keys.join(groups, ["u", "v"]).select("doc", "line", partner.alias("p")).where(F.col("p") < place).groupBy("doc", "line").agg(F.min("p").alias("p"))
    x = pairs.join(lines.withColumnsRenamed({"doc": "d", "line": "l"}), F.col("doc").eqNullSafe(F.col("d")) & (F.col("line") == F.col("l"))).select("doc", "line", "p", "words")
    y = lines.select(F.col("doc").alias("d"), F.col("line").alias("l"), F.col("words").alias("other"))
    x = x.join(y, F.col("p.doc").eqNullSafe(F.col("d")) & (F.col("p.line") == F.col("l"))).select("doc", "line", "words", "other")
    return _verified(x).select("doc", "line").distinct()


def line_verdicts(docs: DataFrame) -> DataFrame:
    """(doc, line, gone): every line of (doc, text) that has words."""
    lines = stored(_lines(docs), "line-names")
    grouped = lines.groupBy("a", "b").agg(F.min(F.struct("doc", "line")).alias("first"), F.any_value("halves").alias("halves"), F.count("*").alias("n"))
    distinct = stored(grouped.select("first.*", "a", "b", "halves", "n"), "distinct-lines")
    near = near_lines(docs, distinct).withColumnsRenamed({"doc": "d", "line": "l"}).withColumn("near", F.lit(True))
    verdict = distinct.join(near, F.col("doc").eqNullSafe(F.col("d")) & (F.col("line") == F.col("l")), "left")
    verdict = verdict.where((F.col("n") > 1) | F.col("near")).select("a", "b", F.struct("doc", "line").alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    later = F.struct("doc", "line") > F.col("first")
    return lines.join(verdict, ["a", "b"], "left").select("doc", "line", F.coalesce(F.col("near") | later, F.lit(False)).alias("gone"))


def _kept(docs: DataFrame, text: str) -> DataFrame:
    """Takes the lines numbered in ``_gone`` out of the text."""
    names = [c for c in docs.columns if c != "_gone"]
    fields = [*(f for f in docs.schema.fields if f.name != "_gone"), T.StructField("ld_lines", T.LongType()), T.StructField("ld_removed", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text)
            raw, at = bytes_of(column)
            data, texts, n, cut = raw.tobytes(), [], [], []
            for k, gone in enumerate(batch.column("_gone").to_pylist()):
                t = data[at[k] : at[k + 1]]
                lines = t.split(b"\n")
                n.append(sum(1 for x in lines if x.strip()))
                drop = set(gone or ())
                cut.append(len(drop))
                texts.append((b"\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else t).decode("utf-8", "replace") if column[k].is_valid else None)
            arrays = [pa.array(texts, pa.string()) if c == text else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n, pa.int64()), pa.array(cut, pa.int64())], [*names, "ld_lines", "ld_removed"])

    return docs.mapInArrow(run, T.StructType(fields))


def dedup_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the text that is left, ``ld_lines`` (lines with words before) and ``ld_removed``.

    All rows stay; a null text stays null and an empty one empty, with no lines. A null doc_id comes
    before all others. Rows that share a doc_id share line numbers: of two equal lines at the same
    place neither is earlier, so repeated rows all keep what the first of them keeps. Columns of the
    names ``ld_*`` and ``_gone`` are replaced; all others stay.
    """
    docs = docs.drop("ld_lines", "ld_removed", "_gone")
    gone = line_verdicts(docs.select(F.col(doc).alias("doc"), F.col(text).cast("string").alias("text"))).where("gone")
    per_doc = gone.groupBy("doc").agg(F.collect_set("line").alias("_gone")).withColumnRenamed("doc", "_doc")
    on: Column = F.col(doc).eqNullSafe(F.col("_doc"))
    return _kept(docs.join(per_doc, on, "left").drop("_doc"), text)


def decisions(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_removed, removed): the numbers, from 0, of the lines that ``dedup_lines`` takes
    out, ascending and comma-joined; rows that share a doc_id are one row. Texts need not move for this."""
    source = docs.select(F.col(doc).alias("doc"), F.col(text).cast("string").alias("text"))
    per = line_verdicts(source).distinct().groupBy("doc").agg(
        F.count("*").alias("n_lines"), F.count_if("gone").alias("n_removed"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("gone"), F.col("line")))), ",").alias("removed"))
    named = source.select("doc").distinct().withColumnRenamed("doc", "doc_id")
    return named.join(per, F.col("doc_id").eqNullSafe(F.col("doc")), "left").select(
        "doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("removed", F.lit("")).alias("removed"))
