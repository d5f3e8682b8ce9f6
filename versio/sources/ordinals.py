"""Stable row keys without a global sort in one task.

``rank_within`` gives ``row_number() over (partition by g order by o) - 1`` but
never funnels a group into one task: a language holding most of the corpus is
spread over many range partitions. Plan:

1. range-partition only the key columns on ``(g, o)`` and sort inside each
   partition; tag each row with its partition id and a per-partition sequence;
2. store that key table once, so the range bounds are computed a single time;
3. aggregate ``count``/``min(seq)`` per (partition, group) -- at most
   partitions x groups rows -- and prefix-sum counts in partition order;
4. join that small table back; ``ordinal = offset + seq - first``.

``rank_integers`` ranks unique integer keys without storing anything: ranks
inside buckets of neighbouring integers plus the counts of the buckets before.
``dense_positions`` attaches such ranks to rows with texts, which are never sorted.

Joins carry no hints: adaptive execution broadcasts what is small.

``line_ordinals`` numbers the lines of text files (ingest): the order is file
order, parts of one file by their number, blocks by their start offset.
``line_positions`` also numbers the lines that are left when some are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Neighbouring integers that one window ranks.
BUCKET = 1 << 14
#: Neighbouring lines whose dropped ones are listed together.
CHUNK = 1 << 10


def rank_table(df: DataFrame, group_cols: list[str], order_cols: list[str],
               out_col: str = "ordinal", num_partitions: int | None = None) -> DataFrame:
    """Key columns + ``out_col`` = 0-based rank of the key inside its group.

    Order keys must be unique inside a group for the result to be deterministic
    (as with ``row_number``). The result is materialized (keys only).
    """
    keys = group_cols + order_cols
    order = [F.col(k).asc_nulls_first() for k in keys]
    # Without an explicit count the range shuffle is coalescible by AQE, which
    # only merges adjacent ranges: order (and so the offsets) is preserved.
    spread = (df.select(*keys).repartitionByRange(num_partitions, *order) if num_partitions
              else df.select(*keys).repartitionByRange(*order))
    ranged = (
        spread
        .sortWithinPartitions(*keys)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id())
    )
    ranged = materialize(ranged)
    # Bounded: one row per (range partition, group).
    stats = ranged.groupBy("_pid", *group_cols).agg(
        F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    stats = stats.select("_pid", *group_cols, "_first", "_offset")
    return (ranged.join(stats, ["_pid"] + group_cols)
            .select(*keys, (F.col("_offset") + F.col("_seq") - F.col("_first")).alias(out_col)))


def join_ranks(df: DataFrame, ranks: DataFrame, keys: list[str]) -> DataFrame:
    """Attach a rank table (one row per input row, keys only) to its rows."""
    return df.join(ranks, keys)


def rank_within(df: DataFrame, group_cols: list[str], order_cols: list[str],
                out_col: str = "ordinal", num_partitions: int | None = None) -> DataFrame:
    """``df`` with ``out_col`` = ``row_number() over (partition by g order by o) - 1``."""
    ranks = rank_table(df, group_cols, order_cols, out_col, num_partitions)
    return join_ranks(df, ranks, group_cols + order_cols)


def rank_integers(df: DataFrame, group: str | list[str], key: str, out_col: str = "ordinal") -> DataFrame:
    """``df`` with ``out_col`` = ``row_number() over (partition by group order by key) - 1``.

    For unique integer keys; a repeated key raises. A bucket holds ``BUCKET``
    neighbouring integers at most, so no window grows with the group; the
    counts of all buckets before are a running sum over one row per bucket.
    Nothing is stored or collected. Give it keys only and attach the ranks to
    the texts afterwards (``join_ranks``): then no text is sorted.
    """
    groups = [group] if isinstance(group, str) else group
    bucket = F.floor(F.col(key) / BUCKET).cast("long")
    rows = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*groups, "_bucket").orderBy(key)
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(*groups, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    again = F.lag(key).over(inside) == F.col(key)
    row = F.when(again, F.raise_error(F.concat(F.lit(f"repeated {key} "), F.col(key).cast("string"))).cast("int")).otherwise(F.row_number().over(inside))
    ranked = rows.withColumn("_inside", row - 1).join(counts, [*groups, "_bucket"])
    return ranked.withColumn(out_col, F.col("_before") + F.col("_inside")).drop("_bucket", "_inside", "_before")


def dense_positions(df: DataFrame, group_cols: list[str], key: str, out_col: str = "position") -> DataFrame:
    """``df`` with ``out_col`` = the dense 0-based rank of the integer ``key`` in its group (P9). Only keys are ranked."""
    ranks = rank_integers(df.select(*group_cols, key), group_cols, key, out_col)
    return join_ranks(df, ranks, [*group_cols, key])


def line_ordinals(lines: DataFrame, out_col: str = "ordinal") -> DataFrame:
    """Number lines of each file 0.. in file order (lines from ``spark.read.text``).

    Expects ``value``, ``_file`` (the logical file), ``_part`` (place of a
    physical file in it) and ``_block`` (split start offset) -- see
    ``readers.read_lines``. Each split is read by one task in order, so
    ``monotonically_increasing_id`` is contiguous inside a split. The text is
    read once: tagged lines are stored, the line counts of the splits come from
    the key columns of that table, and their running sums per file (one row per
    split) are joined back.
    """
    block = ["_file", "_part", "_block"]
    tagged = materialize(lines.withColumn("_seq", F.monotonically_increasing_id()))
    stats = tagged.groupBy(*block).agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_file").orderBy("_part", "_block").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.select(*block, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return tagged.join(stats, block).withColumn(out_col, F.col("_offset") + F.col("_seq") - F.col("_first")).drop("_seq", "_first", "_offset")


def line_positions(lines: DataFrame, dropped: Column) -> DataFrame:
    """The lines that are not ``dropped``, with ``ordinal`` among all lines of their file (as ``line_ordinals``) and
    ``pos`` among those left.

    No text is sorted for it: a line's ``pos`` is its ordinal less the dropped lines of the chunks before, a running sum
    over one row per ``CHUNK`` lines of a split, and less those before it in its own chunk, which are listed. These rows
    are stored, so that the join knows how few they are before it deals out any text.
    """
    chunk = ["_file", "_part", "_block", "_chunk"]
    numbered = lines.withColumn("_seq", F.monotonically_increasing_id()).withColumn("_dropped", dropped)
    tagged = materialize(numbered.withColumn("_chunk", F.floor(F.col("_seq") / CHUNK).cast("long")))
    gone = tagged.where(F.col("_dropped")).groupBy(*chunk).agg(F.collect_list("_seq").alias("_gone"))
    stats = tagged.groupBy(*chunk).agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_dropped")).alias("_lost"))
    before = Window.partitionBy("_file").orderBy("_part", "_block", "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.select(*chunk, "_first", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c + "_before") for c in ("_n", "_lost")])
    kept = tagged.where(~F.col("_dropped")).join(materialize(stats.join(gone, chunk, "left")), chunk)
    kept = kept.withColumn("ordinal", F.col("_n_before") + F.col("_seq") - F.col("_first"))
    inside = F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.size(F.filter("_gone", lambda x: x < F.col("_seq"))))
    kept = kept.withColumn("pos", F.col("ordinal") - F.col("_lost_before") - inside)
    return kept.drop("_chunk", "_seq", "_dropped", "_first", "_n_before", "_lost_before", "_gone")
