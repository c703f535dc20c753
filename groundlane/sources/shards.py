"""Training shards: an epoch's rows as Parquet files in the order of their rank, with a manifest, read from any step on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import exists, moved

MANIFEST = "file string, first long, last long, n_rows long"


def write_shards(ranked: DataFrame, path: str, rows_per_shard: int = 100_000) -> DataFrame:
    """Writes rows with `rank` as range-partitioned files of about `rows_per_shard` rows under `path`/rows, sorted within, and a
    manifest of each file's ranks beside them; returns the manifest. Both get their names in one step, when they are whole; a path
    that is there is an error."""
    spark = ranked.sparkSession
    if exists(spark, path):
        raise FileExistsError(path)
    draft = f"{path.rstrip('/')}-draft-{uuid.uuid4().hex}"
    parts = max(1, -(-ranked.count() // rows_per_shard))
    ranked.repartitionByRange(parts, "rank").sortWithinPartitions("rank").write.parquet(f"{draft}/rows")
    written = spark.read.parquet(f"{draft}/rows").select(F.col("_metadata.file_name").alias("file"), "rank")
    per_file = written.groupBy("file").agg(F.min("rank").alias("first"), F.max("rank").alias("last"), F.count("*").alias("n_rows"))
    per_file.coalesce(1).write.json(f"{draft}/manifest")  # a row for each file
    moved(spark, draft, path)
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")


def read_shards(spark: SparkSession, path: str, after_step: int = 0, batch_size: int = 1) -> DataFrame:
    """The rows that are left after `after_step` batches. Files that lie before them are not opened."""
    skipped = after_step * batch_size
    files = [r["file"] for r in manifest(spark, path).where(F.col("last") > skipped).select("file").orderBy("first").collect()]
    whole = spark.read.parquet(f"{path}/rows")
    if not files:
        return whole.limit(0)
    return spark.read.schema(whole.schema).parquet(*[f"{path}/rows/{f}" for f in files]).where(F.col("rank") > skipped)
