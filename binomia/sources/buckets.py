"""Key indexes laid out for lookups: bucketed by kind and key, so that a lookup shuffles the names alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows of a bucket, about, where the number of buckets isn't given.
BUCKET_ROWS = 500_000


def save_index(index: DataFrame, name: str, buckets: int | None = None, path: str | None = None) -> DataFrame:
    """Write a key index (kind, key, ..) as a table of the session catalog, bucketed and sorted by kind and key.

    Joins on (kind, key) read its buckets as they are: no exchange and, with one file a
    bucket, no sort on this side. ``path`` places the files; otherwise they lie in the
    warehouse. An existing table is replaced. The number of buckets follows the rows, at
    least the session's shuffle partitions, so that the names aren't dealt to fewer tasks.
    """
    spark = index.sparkSession
    if buckets is None:
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-index.count() // BUCKET_ROWS))
    spark.sql(f"drop table if exists `{name}`")
    # one task a bucket: a bucket is one file
    out = index.repartition(buckets, "kind", "key").write.bucketBy(buckets, "kind", "key").sortBy("kind", "key").format("parquet")
    (out.option("path", path) if path else out).saveAsTable(f"`{name}`")
    return load_index(spark, name)


def load_index(spark: SparkSession, name: str) -> DataFrame:
    """A table that :func:`save_index` has written."""
    return spark.table(f"`{name}`")
