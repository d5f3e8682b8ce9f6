"""JSON-lines readers: the three "line -> text" dialects and the paired reader.

All parsing is JVM-side: ``try_parse_json`` + ``schema_of_variant`` dispatch
for the strict reader, ``get_json_object`` / ``try_variant_get`` for the
lenient ones. Each parser takes the raw line column (``value`` from
``spark.read.text``) so it works on files and on derived columns alike.

* S3 strict: skip blank lines; a JSON string, or an array whose first element
  is a string; anything else is quarantined (``error`` set) or raised.
* S4 prompt: strip the line; ``{`` -> field ``prompt``; ``[`` -> first
  element; else the stripped line itself. No further strip.
* S5 score: ``[``/``{``/``"`` -> JSON: first element / field ``translation``
  (default ``""``) / the string; else the raw line; then strip.
* S6 paired ``{"text": ...}``: a pair is dropped when either side fails, and
  reported with its 1-based line number.

Readers of files store what they read once: the numbered lines, and the
parsed rows in two partitions, taken and rejected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import drop_lone_surrogate_escapes, is_blank, scrub, strip_ws
from ..session import stored_path
from .ordinals import line_ordinals, line_positions


#: A part file of a directory that Spark wrote; the directory is the logical file, the number the part's place.
PART_RE = r"/part-(\d+)[^/]*$"


def read_lines(spark: SparkSession, path: str, make_valid: bool = False, matching: str | None = None) -> DataFrame:
    """Lines of text files with the logical file, the place of the part in it and the split offset (for ordinals).

    A directory of ``part-*`` files, as Spark's writers leave it, is one
    logical file; its parts follow each other by number. With ``matching`` all
    files below ``path`` are read whose logical file matches that pattern.
    ``make_valid`` applies F13 (undecodable bytes -> U+FFFD).
    """
    reader = spark.read.option("recursiveFileLookup", True) if matching else spark.read
    at = F.col("_metadata.file_path")
    df = reader.text(path).select(
        "value",
        F.regexp_replace(at, PART_RE, "").alias("_file"),
        F.concat(F.lpad(F.regexp_extract(at, PART_RE, 1), 10, "0"), F.element_at(F.split(at, "/"), -1)).alias("_part"),
        F.col("_metadata.file_block_start").alias("_block"),
    )
    if matching:
        df = df.where(F.col("_file").rlike(matching))
    if make_valid:
        df = df.withColumn("value", scrub("value"))
    return df


def numbered_lines(spark: SparkSession, path: str, make_valid: bool = False, matching: str | None = None) -> DataFrame:
    """``_file, ordinal, value``: every raw line with its 0-based position in its (logical) file. The text is read
    once, and stored for the numbering."""
    return line_ordinals(read_lines(spark, path, make_valid, matching)).select("_file", "ordinal", "value")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used (a plain expression would be copied to
    every place, and a line parsed as often)."""
    return F.transform(F.array(value), use)[0]


def whole_json(line: Column) -> Column:
    """The line's JSON value as a variant, null unless the value is all there is.

    ``try_parse_json`` stops after the first value, so the line is parsed once
    inside an array and once inside an object: text after the value breaks at
    least one of them (it would have to close both).
    """
    listed = F.try_parse_json(F.concat(F.lit("["), line, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"v":'), line, F.lit("}")))
    return F.when(named.isNotNull(), F.try_variant_get(listed, "$[0]", "variant"))


def _is_string(v: Column) -> Column:
    return F.schema_of_variant(v) == F.lit("STRING")


def parse_strict(value: Column) -> Column:
    """S3 on one line: struct(text, error). ``error`` is null when the line is good."""
    v = whole_json(value)
    kind = F.schema_of_variant(v)
    first = F.try_variant_get(v, "$[0]", "variant")
    text = (F.when(kind.startswith("ARRAY") & first.isNotNull() & _is_string(first),
                   F.try_variant_get(v, "$[0]", "string"))
             .when(kind == F.lit("STRING"), F.try_variant_get(v, "$", "string")))
    error = (F.when(v.isNull(), F.lit("not json"))
              .when(kind.startswith("ARRAY") & first.isNull(), F.lit("empty array"))
              .when(kind.startswith("ARRAY") & ~_is_string(first), F.lit("first element not a string"))
              .when(text.isNull(), F.lit("line must be a string or a single-element list")))
    return F.struct(strip_ws(text).alias("text"), error.alias("error"))


def _read(line: Column, v: Column, json_text: Column, is_json: Column, plain: Column) -> Column:
    """struct(text, error) of a line that is JSON where ``is_json`` says so, else plain text."""
    def checked(text: Column) -> Column:
        error = F.when(is_json & v.isNull(), F.lit("not json")).when(text.isNull(), F.lit("no text in the json value"))
        return F.struct(text.alias("text"), error.alias("error"))

    return _once(F.when(is_json, json_text).otherwise(plain), checked)


def parse_prompt(value: Column) -> Column:
    """S4 on one line: struct(text, error); an unreadable line is an error, never an empty prompt."""
    line = strip_ws(value)
    v = whole_json(line)
    text = (F.when(line.startswith("{"), F.try_variant_get(v, "$.prompt", "string"))
             .otherwise(F.try_variant_get(v, "$[0]", "string")))
    return _read(line, v, text, line.startswith("{") | line.startswith("["), line)


def parse_score(value: Column) -> Column:
    """S5 on one line: struct(text, error), the text stripped; an object without ``translation`` reads as ``""``."""
    def read(line: Column) -> Column:
        is_json = line.startswith("[") | line.startswith("{") | line.startswith('"')

        def taken(v: Column) -> Column:
            text = (F.when(line.startswith("["), F.try_variant_get(v, "$[0]", "string"))
                     .when(line.startswith("{"), F.when(v.isNotNull(), F.coalesce(F.try_variant_get(v, "$.translation", "string"), F.lit(""))))
                     .otherwise(F.try_variant_get(v, "$", "string")))
            return _read(line, v, strip_ws(text), is_json, line)

        return _once(F.when(is_json, whole_json(line)), taken)

    return _once(strip_ws(value), read)


def parse_text_object(value: Column) -> Column:
    """S6 side: ``$.text`` when the line is an object whose ``text`` is a string."""
    v = whole_json(value)
    t = F.try_variant_get(v, "$.text", "variant")
    return F.when(F.schema_of_variant(v).startswith("OBJECT") & t.isNotNull() & _is_string(t),
                  F.try_variant_get(v, "$.text", "string"))


def drop_blank(df: DataFrame, col: str = "value") -> DataFrame:
    """Drop blank raw lines (a line ``[""]`` is not blank)."""
    return df.where(~is_blank(col))


def quarantined(parsed: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows) of a parsed frame, both with ``error``: one write, partitioned by whether a row
    was taken, so that nothing is read or parsed twice."""
    path = stored_path(parsed.sparkSession, "quarantine")
    marked = parsed.withColumn("error", error).withColumn("taken", F.col("error").isNull())
    marked.write.partitionBy("taken").parquet(path)
    back = parsed.sparkSession.read.schema(marked.schema).parquet(path)
    return back.where(F.col("taken")).drop("taken"), back.where(~F.col("taken")).drop("taken")


def _split(spark: SparkSession, path: str, parse, name: str, strict: bool, what: str, matching: str | None = None, positions: bool = False) -> tuple[DataFrame, DataFrame]:
    """Good rows ``_file, ordinal, <name>`` and rejects ``_file, ordinal, value, error`` of a reader; with ``positions``
    the good rows have ``pos``, the position among the file's non-blank lines."""
    if positions:
        lines = line_positions(read_lines(spark, path, matching=matching), is_blank("value")).select("_file", "ordinal", "pos", "value")
    else:
        lines = drop_blank(numbered_lines(spark, path, matching=matching))
    keys = ["_file", "ordinal", *(["pos"] if positions else [])]
    parsed = lines.withColumn("_p", parse(F.col("value")))
    error = F.col("_p.error")
    if strict:  # nothing to quarantine: the first bad line ends the job
        stop = F.raise_error(F.concat(F.lit(f"bad {what} line "), F.col("_file"), F.lit(":"),
                                      (F.col("ordinal") + 1).cast("string"), F.lit(": "), error))
        text = F.when(error.isNull(), F.col("_p.text")).otherwise(stop.cast("string"))
        return parsed.select(*keys, text.alias(name)), parsed.where(F.lit(False)).select("_file", "ordinal", "value", error.alias("error"))
    row = parsed.select(*keys, F.when(error.isNotNull(), F.col("value")).alias("value"), F.col("_p.text").alias(name), error.alias("_error"))
    good, bad = quarantined(row, F.col("_error"))
    return good.select(*keys, name), bad.select("_file", "ordinal", "value", "error")


def read_documents(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """S3 over files: (good rows ``_file, ordinal, text``, quarantine ``_file, ordinal, value, error``).

    With ``strict`` a bad line raises instead of being quarantined.
    """
    return _split(spark, path, parse_strict, "text", strict, "document")


def read_prompts(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """S4 over files: (``_file, ordinal, prompt``, rejects); ``strict`` raises on a bad line."""
    return _split(spark, path, parse_prompt, "prompt", strict, "prompt")


def read_scored(spark: SparkSession, path: str, strict: bool = False, matching: str | None = None, positions: bool = False) -> tuple[DataFrame, DataFrame]:
    """S5 over files: (``_file, ordinal, text``, rejects); ``strict`` raises on a bad line. ``matching``: all logical
    files below ``path`` that match this pattern. ``positions``: with ``pos`` among the non-blank lines of a file."""
    return _split(spark, path, parse_score, "text", strict, "scored", matching, positions)


def _both_sides(src: DataFrame, tgt: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    """Keyed lines that meet on ``keys``, parsed to ``src, tgt``, and why a pair is rejected (null: it is not).
    Lone surrogate escapes are dropped before parsing (F13)."""
    s = src.select(*keys, parse_text_object(drop_lone_surrogate_escapes("value")).alias("src"))
    t = tgt.select(*keys, parse_text_object(drop_lone_surrogate_escapes("value")).alias("tgt"))
    reason = F.when(F.col("src").isNull(), F.lit("source not a {text} object")).when(F.col("tgt").isNull(), F.lit("target not a {text} object"))
    return s.join(t, keys), reason


def zip_text_objects(src: DataFrame, tgt: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """S6 + J2 on keyed lines: both sides ``keys + [value]`` of ``{"text": ...}`` lines.

    Lines meet on ``keys`` (truncating: a key on one side only is not a pair);
    a key where either side fails to parse is rejected, as the reference skips
    the whole pair. Returns ``(pairs: keys + src, tgt; rejects: keys + reason)``,
    both computed when read; ``read_text_pairs`` stores them in one pass.
    """
    z, reason = _both_sides(src, tgt, keys)
    return z.where(reason.isNull()), z.where(reason.isNotNull()).select(*keys, reason.alias("reason"))


def read_text_pairs(spark: SparkSession, src_path: str, tgt_path: str,
                    src_lang: str, tgt_lang: str) -> tuple[DataFrame, DataFrame]:
    """S6 + J2 + F13 over two ``{"text"}`` files: ``(pairs, rejects)``, parsed and stored in one pass.

    pairs: ``ordinal, src, tgt, src_lang, tgt_lang``; rejects: ``line`` (1-based), ``reason``.
    Undecodable bytes become U+FFFD on read.
    """
    s = numbered_lines(spark, src_path, make_valid=True).select("ordinal", "value")
    t = numbered_lines(spark, tgt_path, make_valid=True).select("ordinal", "value")
    good, bad = quarantined(*_both_sides(s, t, ["ordinal"]))
    return (good.select("ordinal", "src", "tgt", F.lit(src_lang).alias("src_lang"), F.lit(tgt_lang).alias("tgt_lang")),
            bad.select((F.col("ordinal") + 1).alias("line"), F.col("error").alias("reason")))


#: ``<root>/<pair>/doc.<lang>[.cleaned].jsonl``, or partition directories of parts.
PAIR_FILES_RE = r"/(?:pair=)?([^/]+)/(?:doc\.([^/.]+)(?:\.cleaned)?\.jsonl|lang=([^/]+))$"


def read_text_pair_tree(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """S6 over the training files of all pairs at once: ``(pairs, rejects)``, parsed and stored in one pass.

    pairs: ``pair, ordinal, src, tgt``; rejects: ``pair, line`` (1-based, in both files of the pair), ``reason``.
    """
    f = F.col("_file")
    lines = numbered_lines(spark, root, make_valid=True, matching=PAIR_FILES_RE)
    lines = lines.select(F.regexp_extract(f, PAIR_FILES_RE, 1).alias("pair"), "ordinal", "value",
                         F.concat(F.regexp_extract(f, PAIR_FILES_RE, 2), F.regexp_extract(f, PAIR_FILES_RE, 3)).alias("lang"))
    side = lambda k: lines.where(F.col("lang") == F.split_part("pair", F.lit("_"), F.lit(k))).select("pair", "ordinal", "value")
    good, bad = quarantined(*_both_sides(side(1), side(2), ["pair", "ordinal"]))
    return good.select("pair", "ordinal", "src", "tgt"), bad.select("pair", (F.col("ordinal") + 1).alias("line"), F.col("error").alias("reason"))
