"""Parallel corpus: table shape, partition-selective scan (S1), fixture pairing.

The corpus table is ``parallel(subset, pair, ordinal, src_txt, tgt_txt)``,
stored partitioned by ``subset, pair`` so S1 is partition pruning. ``pair`` is
``eng_<x>``; ``src_txt`` is the English side. ``write_keyed_corpus`` also
stores ``position``, the dense rank of a document in its split and pair, and
clusters rows by ``doc_key`` (see ``keyed``): the first N documents are a pushed
filter, and scoring joins need no exchange.

The driver's ``documents`` table holds no parallel text, so the fixture pairs
documents by rank (they are not translations): inside each language,
``ordinal`` is the document's rank by ``doc_id``; English plays ``eng``; every
other language ``x`` gives pair ``eng_x`` by equal ordinal (truncating zip);
``subset`` is ``dev`` for every fifth ordinal, else ``test``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_ws
from ..session import stored_path
from . import keyed
from .ordinals import dense_positions, join_ranks, rank_integers

PARALLEL_SCHEMA = "subset string, pair string, ordinal bigint, src_txt string, tgt_txt string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, read as it is stored."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scan_parallel(spark: SparkSession, root: str, subset: str | None = None,
                  pair: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Read one split and/or one pair of a partitioned corpus table."""
    df = spark.read.parquet(root)
    if subset is not None:
        df = df.where(F.col("subset") == subset)
    if pair is not None:
        df = df.where(F.col("pair") == pair)
    if columns:
        df = df.select(*columns)
    return df


def write_parallel(df: DataFrame, root: str, mode: str = "overwrite") -> None:
    """Store a corpus partitioned by split and pair (one directory per S1 unit)."""
    (df.select("subset", "pair", "ordinal", "src_txt", "tgt_txt")
       .hint("rebalance", "subset", "pair")
       .write.mode(mode).partitionBy("subset", "pair").parquet(root))


KEYED_COLUMNS = ["doc_key", "ordinal", "position", "src_txt", "tgt_txt", "subset", "pair"]


def write_keyed_corpus(corpus: DataFrame, path: str, buckets: int | None = None) -> None:
    """Ingest, called explicitly: store a corpus clustered by ``doc_key`` and sorted by ``position``."""
    if "position" not in corpus.columns:
        corpus = dense_positions(corpus, ["subset", "pair"], "ordinal")
    keyed.write_keyed(corpus.withColumn("doc_key", keyed.doc_key()).select(*KEYED_COLUMNS), path, ["subset", "pair"], ["position"], buckets, overwrite=True)


def first_documents(corpus: DataFrame, n: int) -> DataFrame:
    """The first ``n`` documents of every split and pair of a keyed corpus, by a filter on ``position``."""
    return corpus.where(F.col("position") < n)


def document_keys(documents: DataFrame, english: str = "en", eng_code: str = "eng", dev_every: int = 5) -> DataFrame:
    """Keys of the fixture: ``lang, doc_id, ordinal`` and, where a document has a partner (English itself aside),
    ``subset, pair, position``."""
    ranks = rank_integers(documents.select("lang", "doc_id"), "lang", "doc_id")
    subset = F.when(F.pmod(F.col("ordinal"), F.lit(dev_every)) == 0, F.lit("dev")).otherwise(F.lit("test"))
    other = ranks.where(F.col("lang") != english).join(ranks.where(F.col("lang") == english).select("ordinal"), "ordinal", "left_semi")
    other = other.select("doc_id", "ordinal", subset.alias("subset"), F.concat(F.lit(eng_code + "_"), F.col("lang")).alias("pair"))
    return rank_integers(other, ["subset", "pair"], "ordinal", "position")


def ranked_documents(documents: DataFrame) -> DataFrame:
    """``lang, doc_id, text`` + ``ordinal`` = rank by ``doc_id`` inside ``lang`` (0-based). Only keys are ranked."""
    docs = documents.select("lang", "doc_id", "text")
    return join_ranks(docs, rank_integers(docs.select("lang", "doc_id"), "lang", "doc_id"), ["lang", "doc_id"])


def fixture_ranked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_documents(table(spark, sf_dir, "documents"))


def pair_documents(documents: DataFrame, english: str = "en", eng_code: str = "eng",
                   dev_every: int = 5) -> DataFrame:
    """Fixture pairing -> ``parallel`` rows. Texts are stripped as the JSONL readers do."""
    ranked = ranked_documents(documents).select(
        "lang", "ordinal", strip_ws("text").alias("text"))
    en = ranked.where(F.col("lang") == english).select("ordinal", F.col("text").alias("src_txt"))
    other = ranked.where(F.col("lang") != english).select(
        "ordinal", "lang", F.col("text").alias("tgt_txt"))
    # Equi-join on ordinal: each English row meets at most one row per language.
    return en.join(other, "ordinal").select(
        F.when(F.pmod(F.col("ordinal"), F.lit(dev_every)) == 0, F.lit("dev"))
         .otherwise(F.lit("test")).alias("subset"),
        F.concat(F.lit(eng_code + "_"), F.col("lang")).alias("pair"),
        "ordinal", "src_txt", "tgt_txt",
    )


def pair_documents_with_positions(documents: DataFrame, english: str = "en", eng_code: str = "eng", dev_every: int = 5) -> DataFrame:
    """As ``pair_documents``, with ``position``: ranked on keys before any text is attached."""
    docs = documents.select("lang", "doc_id", strip_ws("text").alias("text"))
    keys = document_keys(documents, english, eng_code, dev_every)
    other = docs.where(F.col("lang") != english).join(keys, "doc_id").select("subset", "pair", "ordinal", "position", F.col("text").alias("tgt_txt"))
    en = docs.where(F.col("lang") == english)
    ranks = rank_integers(en.select("lang", "doc_id"), "lang", "doc_id")
    en = join_ranks(en, ranks, ["lang", "doc_id"]).select("ordinal", F.col("text").alias("src_txt"))
    return en.join(other, "ordinal")


def fixture_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture ``parallel`` rows, derived from ``documents`` whenever they are read."""
    return pair_documents(table(spark, sf_dir, "documents"))


def keyed_fixture_corpus(spark: SparkSession, sf_dir: str, path: str | None = None, buckets: int | None = None) -> DataFrame:
    """The fixture corpus ingested as a keyed table (in the shared folder unless a path is named) and read back."""
    path = path or stored_path(spark, "corpus")
    write_keyed_corpus(pair_documents_with_positions(table(spark, sf_dir, "documents")), path, buckets)
    return keyed.read_keyed(spark, path)


def ingest_fixture_corpus(spark: SparkSession, sf_dir: str, path: str) -> str:
    """Ingest, called explicitly: store the fixture corpus under ``path`` as a deployment stores its own
    (S1: partition and column pruning), and return the path for ``scan_parallel``."""
    write_parallel(fixture_corpus(spark, sf_dir), path)
    return path


# --- JSONL corpus ingest (the per-language document-file layout) -------------------

#: ``<root>/<subset>/<pair>/doc.<lang>.jsonl``, or the partition directories that ``sinks.write_corpus_jsonl`` writes.
LAYOUT_RE = r"/(?:subset=)?([^/]+)/(?:pair=)?([^/]+)/(?:doc\.([^/.]+)\.jsonl|lang=([^/]+))$"


def jsonl_lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines of ``<root>/<subset>/<pair>/doc.<lang>.jsonl`` with keys from the path; a file may be a directory of
    parts, as this library's own sinks write it.

    Output: ``subset, pair, lang, ordinal, value`` (ordinal = 0-based line
    position in its file, blank lines included so positions never shift).
    """
    from .readers import numbered_lines
    f = F.col("_file")
    lines = numbered_lines(spark, root, matching=LAYOUT_RE)
    lang = F.concat(F.regexp_extract(f, LAYOUT_RE, 3), F.regexp_extract(f, LAYOUT_RE, 4))
    return lines.select(F.regexp_extract(f, LAYOUT_RE, 1).alias("subset"),
                        F.regexp_extract(f, LAYOUT_RE, 2).alias("pair"),
                        lang.alias("lang"), "ordinal", "value")


def zip_sides(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S3 + J1 + D9 over keyed document lines.

    ``lines``: ``subset, pair, lang, ordinal, value``; the pair ``a_b`` has
    source language ``a`` and target ``b``. Returns ``(parallel, rejects,
    check)``: aligned rows where both lines parse; rejected keys with a
    reason (blank or unreadable line on a side, or no line on a side); and the
    per-(subset, pair) line counts with the strict status.
    """
    from ..operators.align import strict_check
    from ..operators.directions import pair_langs
    from ..functions.text import is_blank
    from .readers import parse_strict
    a, b = pair_langs("pair")
    p = lines.withColumn("_p", parse_strict(F.col("value"))).withColumn("_blank", is_blank("value"))
    err = F.when(F.col("_blank"), F.lit("blank line")).otherwise(F.col("_p.error"))

    def side(lang_col, name):
        return p.where(F.col("lang") == lang_col).select(
            "subset", "pair", "ordinal", F.col("_p.text").alias(name), err.alias(name + "_err"),
            F.lit(True).alias(name + "_seen"))

    z = side(a, "src_txt").join(side(b, "tgt_txt"), ["subset", "pair", "ordinal"], "full_outer")
    good = F.col("src_txt_err").isNull() & F.col("tgt_txt_err").isNull() & \
        F.col("src_txt_seen").isNotNull() & F.col("tgt_txt_seen").isNotNull()
    parallel = z.where(good).select("subset", "pair", "ordinal", "src_txt", "tgt_txt")
    reason = (F.when(F.col("src_txt_seen").isNull(), F.lit("no source line"))
               .when(F.col("tgt_txt_seen").isNull(), F.lit("no target line"))
               .when(F.col("src_txt_err").isNotNull(), F.concat(F.lit("source: "), F.col("src_txt_err")))
               .otherwise(F.concat(F.lit("target: "), F.col("tgt_txt_err"))))
    rejects = z.where(~good).select("subset", "pair", "ordinal", reason.alias("reason"))
    counts = (p.groupBy("subset", "pair")
               .agg(F.count_if(F.col("lang") == a).alias("n_src"), F.count_if(F.col("lang") == b).alias("n_tgt")))
    return parallel, rejects, strict_check(counts)


def ingest_jsonl(spark: SparkSession, root: str, strict: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Read a JSONL corpus tree into ``(parallel, rejects, check)``.

    With ``strict`` a (subset, pair) whose two files differ in line count
    raises, naming the groups (J1).
    """
    parallel, rejects, check = zip_sides(jsonl_lines(spark, root))
    if strict:
        bad = [f"{r.subset}/{r.pair}" for r in check.where(F.col("status") != "ok").limit(20).collect()]
        if bad:
            raise ValueError("source / target length mismatch: " + ", ".join(bad))
    return parallel, rejects, check
