"""Token counts of a BPE vocabulary, from each distinct pre-token's piece count and per-document frequencies.

Merges only ever build vocabulary pieces. So where no piece holds two neighbouring characters side by side,
no merge crosses between them, and what lies on both sides is split independently: the text is cut there.
What is between two cuts is a pre-token (about a word with its space). The count of a text is the sum of
its pre-tokens' counts, exactly.

1. All texts give the table of distinct pre-tokens with their occurrences (counted within each chunk of
   rows first, then by Spark).
2. The library encodes each distinct pre-token once; only the number of its pieces is kept.
3. Each document's pre-token frequencies meet that table. The ``FREQUENT`` most frequent short pre-tokens
   (at most ``FREQUENT * SHORT`` bytes) are joined by broadcast and summed where the text is read; the
   frequencies of all others go through an equi-join and a sum by row. No ids of a document are ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versio.llm.common import chunks, share, stored, taken

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stands before a pre-token while it is encoded, for the library puts a space before what it is given.
BREAK = "\n"
LIMIT = 4096
FREQUENT, SHORT = 1 << 16, 32


class Cuts:
    """Which neighbouring characters some piece holds side by side; its size is that of the vocabulary."""

    def __init__(self, model: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        if sp.normalize("Á ﬁ  b\n") != f"{SPACE}Á{SPACE}ﬁ{SPACE}{SPACE}b\n":
            raise ValueError("the vocabulary's normalisation changes more than spaces")
        self.proto = sp.serialized_model_proto()
        spelled = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        pairs = np.array(sorted({ord(a) << 21 | ord(b) for p in (x.replace(SPACE, " ") for x in spelled) for a, b in zip(p, p[1:], strict=False)}), np.int64)
        if any(ord(BREAK) in (x >> 21, x & 0x1FFFFF) for x in pairs.tolist()):
            raise ValueError("a piece spans a line break")
        self.ascii = np.zeros((128, 128), bool)
        low = pairs[((pairs >> 21) < 128) & ((pairs & 0x1FFFFF) < 128)]
        self.ascii[low >> 21, low & 0x1FFFFF] = True
        self.pairs = pairs

    def between(self, points: np.ndarray) -> np.ndarray:
        """For each character but the first, whether a cut lies before it."""
        x, y = points[:-1], points[1:]
        small = (x | y) < 128
        joined = self.ascii[x & 127, y & 127] & small
        at = np.flatnonzero(~small)
        if len(at) and len(self.pairs):
            key = x[at].astype(np.int64) << 21 | y[at]
            k = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            joined[at] = self.pairs[k] == key
        return ~joined

    def units(self, raw: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Of texts end to end: the distinct pre-tokens, and of each occurrence which it is and its row."""
        led = at[1:] > at[:-1]  # the library puts a space before every text but an empty one
        raw = np.insert(raw, at[:-1][led], 0x20)
        at = at + np.concatenate([[0], np.cumsum(led)])
        if not len(raw):
            return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
        points = raw if raw.max() < 0x80 else np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        cut = np.concatenate([[True], self.between(points)])
        ends = np.cumsum(1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000), dtype=np.int64)
        begins = np.concatenate([[0], ends[:-1]])
        cut[np.searchsorted(begins, at[:-1][led])] = True
        starts = begins[cut]
        offsets = np.append(starts, len(raw)).astype(np.int32)
        words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        return words.dictionary, words.indices.to_numpy().astype(np.int64), np.searchsorted(at, starts, "right") - 1


def _texts(docs: DataFrame, doc: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc).alias("tc_doc"), F.octet_length(whole).cast("long").alias("tc_bytes"), F.replace(F.make_valid_utf8(whole), F.lit(SPACE), F.lit(" ")).alias("tc_text"))


def pre_tokens(docs: DataFrame, doc: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """``unit, n, pieces``: every distinct pre-token, its occurrences in all texts, and its number of pieces."""
    shared = share(docs.sparkSession, Cuts(model))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = taken(shared)
        for batch in batches:
            for _, raw, at in chunks(batch, "tc_text"):
                units, which, _ = cuts.units(raw, at)
                yield pa.RecordBatch.from_arrays([units, pa.array(np.bincount(which, minlength=len(units)).astype(np.int64))], ["unit", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = sentencepiece.SentencePieceProcessor(model_proto=taken(shared).proto)
        extra = len(sp.encode(BREAK))
        for batch in batches:
            sizes = [len(x) - extra for x in sp.encode([BREAK + u for u in batch.column("unit").to_pylist()], num_threads=1)]
            yield pa.RecordBatch.from_arrays([batch.column("unit"), batch.column("n"), pa.array(sizes, pa.int64())], ["unit", "n", "pieces"])

    every = _texts(docs, doc, text).select("tc_text").mapInArrow(found, "unit string, n long")
    return every.groupBy("unit").agg(F.sum("n").alias("n")).mapInArrow(counted, "unit string, n long, pieces long")


def token_counts(docs: DataFrame, doc: str = "doc_id", text: str = "text", model: str = MODEL, limit: int = LIMIT, frequent: int = FREQUENT) -> DataFrame:
    """One row for each row of ``docs``: its key, ``tc_bytes`` (UTF-8), ``tc_tokens`` and ``tc_over`` (more than
    ``limit`` tokens), as the library counts without begin, end or added special tokens.

    A null text counts as empty: no bytes, no tokens. A null key and repeated rows are rows like others. Bytes
    that are no UTF-8 are read as U+FFFD. Other columns are not carried along.
    """
    spark = docs.sparkSession
    cuts = Cuts(model)
    vocabulary = stored(pre_tokens(docs, doc, text, model), "pre-tokens")
    top = vocabulary.where(F.octet_length("unit") <= SHORT).orderBy(F.desc("n"), "unit").limit(frequent).select("unit", "pieces").toArrow()
    shared, known = share(spark, cuts), share(spark, (top.column("unit").combine_chunks(), top.column("pieces").to_numpy()))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, (often, pieces) = taken(shared), taken(known)
        pieces = np.append(pieces, 0)
        for batch in batches:
            for rows, raw, at in chunks(batch, "tc_text"):
                units, which, row = cuts.units(raw, at)
                place = pc.fill_null(pc.index_in(units, often), len(often)).to_numpy()
                here = np.bincount(row, pieces[place][which], rows.num_rows).astype(np.int64)
                rare = place[which] == len(often)
                pair, times = np.unique(row[rare] * max(1, len(units)) + which[rare], return_counts=True)
                owner, unit = np.divmod(pair, max(1, len(units)))
                ends = pa.array(np.searchsorted(owner, np.arange(rows.num_rows + 1)).astype(np.int32), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, x) for x in (units.take(pa.array(unit)), pa.array(times.astype(np.int64)))]
                yield pa.RecordBatch.from_arrays([rows.column("tc_doc"), rows.column("tc_bytes"), pa.array(here), *lists], ["tc_doc", "tc_bytes", "here", "units", "times"])

    texts = _texts(docs, doc, text)
    kind = texts.schema["tc_doc"].dataType.simpleString()
    per = texts.mapInArrow(summed, f"tc_doc {kind}, tc_bytes long, here long, units array<string>, times array<long>")
    per = stored(per.withColumn("tc_row", F.monotonically_increasing_id()), "frequencies")
    rare = per.where(F.size("units") > 0).select("tc_row", F.explode(F.arrays_zip("units", "times")).alias("x")).select("tc_row", F.col("x.units").alias("unit"), F.col("x.times").alias("times"))
    rest = rare.join(vocabulary.select("unit", "pieces"), "unit").groupBy("tc_row").agg(F.sum(F.col("times") * F.col("pieces")).alias("rest"))
    tokens = F.col("here") + F.coalesce("rest", F.lit(0))
    return per.select("tc_row", "tc_doc", "tc_bytes", "here").join(rest, "tc_row", "left").select(
        F.col("tc_doc").alias(doc), "tc_bytes", tokens.alias("tc_tokens"), (tokens > limit).alias("tc_over"))


def digest(done: DataFrame, doc: str = "doc_id") -> DataFrame:
    return done.select(F.col(doc).alias("doc_id"), F.col("tc_bytes").alias("n_bytes"), F.col("tc_tokens").alias("n_tokens"), F.col("tc_over").alias("over_limit"))
