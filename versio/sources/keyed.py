"""Tables clustered by document key, so that what belongs to one document meets without an exchange.

The corpus and the predictions over it are bucketed by ``doc_key`` (pair and
ordinal in one string) into the same number of buckets. A join on ``doc_key``
between two such tables reads bucket ``i`` of both sides in one task: no text
crosses the network when predictions are scored (J3). Inside a bucket rows are
sorted by the given columns; for the corpus that is ``position``, the dense
0-based rank of a document in its split and pair, so ``position < n`` is a
Parquet min/max filter (P9).

Files are plain Parquet in partition directories, readable by path like any
other table. The bucket layout itself lives in a catalog entry that is named
after the path; it is an external table, so dropping the entry keeps the files.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = "doc_key"


def doc_key(pair: Column | str = "pair", ordinal: Column | str = "ordinal") -> Column:
    """The document's key as one column: ``<pair>/<ordinal>``."""
    pair, ordinal = (F.col(c) if isinstance(c, str) else c for c in (pair, ordinal))
    return F.concat(pair, F.lit("/"), ordinal.cast("string"))


LAYOUT = "_layout.json"


def default_buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _file(spark: SparkSession, path: str):
    """(file system, path) of a table's layout file; readers of the table do not see names with an underscore."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, LAYOUT)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def layout(spark: SparkSession, path: str) -> dict | None:
    """What the table at ``path`` was written with: ``buckets, partition_cols, sort_cols, schema``; None without a table."""
    fs, at = _file(spark, path)
    if not fs.exists(at):
        return None
    lines = spark.sparkContext._jvm.org.apache.commons.io.IOUtils
    stream = fs.open(at)
    try:
        return json.loads(lines.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _entry(spark: SparkSession, path: str, how: dict) -> str:
    """The catalog entry over ``path``, made if it is not there; returns its name."""
    schema = T.StructType.fromJson(how["schema"])
    name = "versio_" + hashlib.sha1(f"{path} {json.dumps(how, sort_keys=True)}".encode()).hexdigest()[:20]
    if not spark.catalog.tableExists(name):
        cols = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
        by = f" PARTITIONED BY ({', '.join(map(_quoted, how['partition_cols']))})" if how["partition_cols"] else ""
        order = f" SORTED BY ({', '.join(map(_quoted, how['sort_cols']))})" if how["sort_cols"] else ""
        location = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({cols}) USING parquet OPTIONS (partitionOverwriteMode 'dynamic'){by} "
                  f"CLUSTERED BY ({_quoted(KEY)}){order} INTO {how['buckets']} BUCKETS LOCATION '{location}'")
    return name


def write_keyed(df: DataFrame, path: str, partition_cols: list[str], sort_cols: list[str] | None = None,
                buckets: int | None = None, overwrite: bool = False) -> None:
    """Add rows (with a ``doc_key``) to the clustered table at ``path``.

    One exchange deals the rows by the hash that the buckets use, so a task
    writes one bucket: a file per partition directory and bucket. With
    ``overwrite`` the partition directories being written are replaced, others
    stay. A table keeps the layout of its first write.
    """
    spark = df.sparkSession
    df = df.select(*[c for c in df.columns if c not in partition_cols], *partition_cols)
    how = layout(spark, path)
    if how is None:
        how = {"buckets": buckets or default_buckets(spark), "partition_cols": partition_cols, "sort_cols": sort_cols or [], "schema": df.schema.jsonValue()}
        fs, at = _file(spark, path)
        out = fs.create(at, True)
        try:
            out.write(bytearray(json.dumps(how).encode()))
        finally:
            out.close()
    elif how["partition_cols"] != partition_cols or buckets not in (None, how["buckets"]):
        raise ValueError(f"{path} was written with another layout: {how}")
    df = df.select(*T.StructType.fromJson(how["schema"]).names)
    df.repartition(how["buckets"], KEY).write.insertInto(_entry(spark, path, how), overwrite=overwrite)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """The clustered table at ``path``; joins on ``doc_key`` with a table of as many buckets need no exchange."""
    how = layout(spark, path)
    if how is None:
        raise ValueError(f"no clustered table at {path}")
    name = _entry(spark, path, how)
    if how["partition_cols"]:
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    spark.catalog.refreshTable(name)
    return spark.table(name)


def co_partitioned(left: DataFrame, right: DataFrame, key: str = KEY) -> DataFrame:
    """Inner join on the document key as a merge of equal buckets: neither side is exchanged or broadcast where
    both are clustered tables of as many buckets (or projections of them)."""
    return left.hint("merge").join(right, key)
