"""Fill-in-the-middle: texts cut at two token borders and rearranged so that a model learns to fill gaps.

A text is cut into tokens (white space goes with the word after it); two borders, drawn from the row's
key, part it into prefix, middle and suffix. The drawn form says how the parts are laid out:

    plain   the text as it is (also for empty texts and texts that hold a mark)
    psm     <P>prefix<S>suffix<M>middle
    spm     <S>suffix<P>prefix<M>middle

All drawing is a hash of the seed and the row's key, so a row's result is the same in any batch, task or
rerun. A batch is one pipeline of ``pyarrow.compute`` kernels: the tokens of all its texts are split into
list arrays, flattened with their parent rows, numbered, filtered by role, rebuilt into lists and joined.
Nothing is shuffled, and a row's work is linear in its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versio.llm.common import chunks

TOKEN = rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARK = "<[PSM]>"
SEED = 42
#: Of 100 rows, how many are rearranged, and of 100 of those, how many put the suffix first.
RATE, SUFFIX_FIRST = 50, 80
#: Ends each token while a batch is split: a byte that no UTF-8 text holds.
END = b"\xff"

OUT = [
    T.StructField("fim_n", T.LongType()),
    T.StructField("fim_prefix_chars", T.LongType()),
    T.StructField("fim_middle_chars", T.LongType()),
    T.StructField("fim_output", T.StringType()),
]


def _join(flat: pa.Array, role: pa.Array, count: pa.Array) -> pa.Array:
    """Per row the tokens of one role end to end; ``count`` is how many of them each row has."""
    ends = np.concatenate([[0], np.cumsum(count.to_numpy(zero_copy_only=False))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.filter(role))
    return pc.binary_join(lists, b"").cast(pa.string())


def _parts(text: pa.Array, first: pa.Array, second: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """(number of tokens, prefix, middle, suffix) of each text; the two draws are taken modulo n + 1."""
    ended = pc.replace_substring_regex(text.cast(pa.binary()), pattern=b"(?:" + TOKEN + b")", replacement=rb"\0" + END)
    lists = pc.split_pattern(ended, END)
    n = pc.cast(pc.subtract(pc.list_value_length(lists), 1), pa.int64())  # what follows the last end is empty
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.greater(pc.binary_length(flat), 0)
    flat, parent = flat.filter(real), parent.filter(real)
    before = pc.subtract(pc.cumulative_sum(n), n)
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(before, parent))
    places = pc.add(n, 1)
    one, two = (pc.subtract(h, pc.multiply(pc.divide(h, places), places)) for h in (first, second))
    a, b = pc.min_element_wise(one, two), pc.max_element_wise(one, two)
    in_prefix = pc.less(ordinal, pc.take(a, parent))
    in_suffix = pc.greater_equal(ordinal, pc.take(b, parent))
    in_middle = pc.invert(pc.or_(in_prefix, in_suffix))
    return n, _join(flat, in_prefix, a), _join(flat, in_middle, pc.subtract(b, a)), _join(flat, in_suffix, pc.subtract(n, b))


def fill_in_middle(docs: DataFrame, doc: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``docs`` with ``fim_form``, ``fim_n`` (tokens), ``fim_prefix_chars`` and ``fim_middle_chars`` (null where
    plain) and ``fim_output``.

    A null text counts as empty, a null key as an empty one. Rows with equal key and text, repeated rows among
    them, get equal results. Bytes that are no UTF-8 are read as U+FFFD. Columns ``fim_*`` of the input are
    replaced, all others stay.
    """
    docs = docs.drop(*(c for c in docs.columns if c.lower().startswith("fim_")))
    names = docs.columns
    sha = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc).cast("string"), F.lit(""))), 256)
    draw = [F.conv(F.substring(sha, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    whole = F.make_valid_utf8(F.coalesce(F.col(text).cast("string"), F.lit("")))
    plain = (whole == "") | whole.rlike(MARK) | (draw[2] % 100 >= rate)
    form = F.when(plain, "plain").when(draw[3] % 100 < suffix_first, "spm").otherwise("psm")
    drawn = docs.withColumns({"fim_form": form, "fim_text": whole, "fim_first": draw[0], "fim_second": draw[1]})
    given = [*names, "fim_form"]
    schema = T.StructType([*docs.schema.fields, T.StructField("fim_form", T.StringType()), *OUT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, _ in chunks(batch, "fim_text"):
                whole, form = rows.column("fim_text"), rows.column("fim_form")
                n, prefix, middle, suffix = _parts(whole, rows.column("fim_first"), rows.column("fim_second"))
                plain = pc.equal(form, "plain")
                laid = pc.if_else(
                    pc.equal(form, "psm"),
                    pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, ""),
                    pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, ""),
                )
                none = pa.scalar(None, pa.int64())
                sizes = [pc.if_else(plain, none, pc.cast(pc.utf8_length(part), pa.int64())) for part in (prefix, middle)]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in given), n, *sizes, pc.if_else(plain, whole, laid)], schema.names)

    return drawn.mapInArrow(run, schema)


def restore(made: DataFrame, output: str = "fim_output", form: str = "fim_form", out: str = "fim_restored") -> DataFrame:
    """``made`` with the text that an output and its form stand for; null where either is null, where the form
    is none of the three, or where an output lacks the marks of its form."""
    made = made.drop(out)
    schema = T.StructType([*made.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, _ in chunks(batch, output):
                text, kind = rows.column(output), rows.column(form)
                psm, plain = pc.equal(kind, "psm"), pc.equal(kind, "plain")
                led = pc.if_else(psm, pc.starts_with(text, PREFIX), pc.starts_with(text, SUFFIX))
                parts = pc.split_pattern_regex(text, MARK)
                framed = pc.and_(pc.and_(pc.equal(pc.list_value_length(parts), 4), led), pc.is_in(kind, pa.array(["psm", "spm"])))
                framed = pc.fill_null(framed, False)
                parts = pc.split_pattern_regex(pc.if_else(framed, text, PREFIX + SUFFIX + MIDDLE), MARK)
                one, two, three = (pc.list_element(parts, k) for k in (1, 2, 3))
                whole = pc.binary_join_element_wise(pc.if_else(psm, one, two), three, pc.if_else(psm, two, one), "")
                none = pa.scalar(None, pa.string())
                yield pa.RecordBatch.from_arrays([*rows.columns, pc.if_else(plain, text, pc.if_else(framed, whole, none))], schema.names)

    return made.mapInArrow(run, schema)


def digest(restored: DataFrame, doc: str = "doc_id") -> DataFrame:
    return restored.select(
        F.col(doc).alias("doc_id"), F.col("fim_n").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"),
        F.col("fim_middle_chars").alias("middle_chars"), F.sha2("fim_output", 256).alias("output_sha256"), F.sha2("fim_restored", 256).alias("restored_sha256"),
    )
