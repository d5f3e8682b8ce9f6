"""The training-data pipeline: documents in, sampled token ids out.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it left, and returns
the columns of ``documents``, the last one the tokens. Further columns of the input are dropped.

1. toxicity: documents scored ``THRESHOLD`` or more go.
2. line dedup: lines that match an earlier line go; documents that lose all their lines go.
3. SimHash near-dedup: of each group the document with the smallest doc_id stays.
4. benchmark decontamination: documents that hold a window of a benchmark item go.
5. SentencePiece: the text of what is left becomes ids.

Documents without words are neither toxic nor contaminated; they form one near-duplicate group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versio.llm import decontaminate as dc
from versio.llm import line_dedup as ld
from versio.llm import pieces as sp
from versio.llm import simhash as sh
from versio.llm import toxicity as tox
from versio.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*[c for c in COLUMNS if c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _documents(docs)
    scored = tox.toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.where(F.col("toxicity") < tox.THRESHOLD).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _documents(docs)
    done = ld.dedup_lines(docs).where((F.col("ld_removed") == 0) | (F.col("ld_removed") < F.col("ld_lines")))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("ld_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sh.one_each(_documents(docs))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _documents(docs)
    return dc.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("dc_hit = 0").select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sp.digest(sp.encode(_documents(docs).select("doc_id", "text")))


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: Trained scores, fingerprint components and sampled segmentations are beyond SQL; tests/llm compares
#: the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, "pipeline")
    return docs
