"""Sinks: JSONL documents (S2), predictions (S7), scores (S8), CSV (S9), run layout.

Partitioned writers use the ``REBALANCE`` hint on their partition columns:
rows of one directory are gathered together, and AQE splits any partition
above the advisory size, so a direction holding a third of the data is
written by many tasks (many files) instead of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prompts import model_dir_name
from .keyed import doc_key, write_keyed


def jsonl_line(text: Column) -> Column:
    """S2 encoding: a one-element JSON array, non-ASCII kept raw."""
    return F.to_json(F.array(text))


def write_lines(df: DataFrame, path: str, partition_cols: list[str], value_col: str = "value",
                order_col: str = "ordinal", mode: str = "overwrite") -> None:
    """Text lines in partitioned directories. Rows are dealt by ranges of the key, so within a directory part
    number order is key order, however many files there are."""
    # A directory name that is the same on all rows (a model's, say) would be folded to a constant and dropped from the
    # sort; the writer would then sort again, by directory alone, and lose the order of the lines. Tied to the order
    # column by an empty string, it stays a column.
    none = F.substring(F.coalesce(F.col(order_col).cast("string"), F.lit("")), 1, 0)
    named = df.select(*[F.concat(F.col(c).cast("string"), none).alias(c) for c in partition_cols], order_col, F.col(value_col).alias("value"))
    (named.repartitionByRange(*partition_cols, order_col)
       .sortWithinPartitions(*partition_cols, order_col)
       .select(*partition_cols, "value")
       .write.mode(mode).partitionBy(*partition_cols).text(path))


def write_documents(df: DataFrame, path: str, partition_cols: list[str], text_col: str = "text",
                    order_col: str = "ordinal", mode: str = "overwrite") -> None:
    """One JSONL line per document, in key order."""
    write_lines(df.select(*partition_cols, order_col, jsonl_line(F.col(text_col)).alias("value")), path, partition_cols, "value", order_col, mode)


def write_corpus_jsonl(corpus: DataFrame, root: str, mode: str = "overwrite") -> None:
    """S2 for a whole corpus: both sides of every split and pair as JSONL lines, a directory of parts per language
    file. ``corpus.ingest_jsonl(spark, root)`` reads it back."""
    a, b = F.split_part("pair", F.lit("_"), F.lit(1)), F.split_part("pair", F.lit("_"), F.lit(2))
    sides = F.explode(F.array(F.struct(a.alias("lang"), F.col("src_txt").alias("text")), F.struct(b.alias("lang"), F.col("tgt_txt").alias("text"))))
    write_documents(corpus.select("subset", "pair", "ordinal", sides.alias("s")).select("subset", "pair", "s.lang", "ordinal", "s.text"),
                    root, ["subset", "pair", "lang"], mode=mode)


def run_layout(df: DataFrame, model: str, k_col: str = "k") -> DataFrame:
    """Add the run-layout partition columns ``model, shot``."""
    return (df.withColumn("model", model_dir_name(F.lit(model)))
              .withColumn("shot", F.concat(F.lit("shot"), F.col(k_col).cast("string"))))


#: Directories of the run layout, for predictions in either form.
RUN_COLS = ["pair", "model", "shot", "direction"]


def write_predictions(df: DataFrame, path: str, mode: str = "append", buckets: int | None = None) -> None:
    """Predictions keyed by ``(pair, model, shot, direction, ordinal)``, clustered by document key as the corpus
    is, so that scoring exchanges no text. ``unit_id`` names the unit of a resumable run ("" for none).

    ``overwrite`` replaces only the (pair, model, shot, direction) directories
    being written (dynamic partition overwrite); other runs stay.
    """
    df = df.withColumn("doc_key", doc_key())
    if "unit_id" not in df.columns:
        df = df.withColumn("unit_id", F.lit(""))
    write_keyed(df.select("doc_key", "ordinal", "pred", "unit_id", *RUN_COLS), path, RUN_COLS, buckets=buckets, overwrite=mode == "overwrite")


def write_predictions_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S7 as files: one JSONL line per prediction in key order, a directory of parts per (pair, model, shot,
    direction). ``jobs.score_run_files`` reads it back."""
    write_documents(df.select(*RUN_COLS, "ordinal", "pred"), path, RUN_COLS, text_col="pred", mode=mode)


def predictions_jsonl_view(df: DataFrame, pred_col: str = "pred") -> DataFrame:
    """S7 export view: keys plus the prediction as a one-element JSON array line."""
    keys = [c for c in df.columns if c != pred_col]
    return df.select(*keys, jsonl_line(F.col(pred_col)).alias("value"))


def write_scores(scores: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The score table as TSV with a header, a directory per model and shot count (a handful of rows
    each); only the directories being written are replaced, so other models and sweeps stay."""
    (scores.repartition("model", "shot").sortWithinPartitions("pair", "direction")
       .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("model", "shot")
       .option("sep", "\t").option("header", True).csv(path))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header; embedded newlines and quotes are quoted."""
    (df.write.mode(mode).option("header", True).option("escape", '"').option("quoteAll", False)
       .option("multiLine", True).csv(path))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S9 back: what ``write_csv`` wrote, with embedded newlines and quotes."""
    return (spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path))
