"""Annotation files, image listings and metrics logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.columns import last_segment
from . import annotations


def read_items(spark: SparkSession, root: str, splits: Sequence[str] = ("train", "val"), on_fault: str = "raise") -> DataFrame:
    """Items of {root}/{dataset}/{split}/json/*.json with dataset and split; one multi-line JSON document per file.

    Splits that no dataset has are skipped; an unknown key is ignored; a value of another type than declared is null. A malformed file
    ends the job by name, or with "skip" stands in annotations.rejected_files alone."""
    rows = annotations.typed(annotations.file_items(annotations.annotation_files(spark, root, splits), on_fault))
    return rows.select("dataset", "split", "query", "answer", "bbox", "image_path")


def image_listing(spark: SparkSession, root: str, splits: Sequence[str] = ("train", "val")) -> DataFrame:
    """path and length of the images; the content column is pruned and never read."""
    return spark.read.format("binaryFile").load(f"{root.rstrip('/')}/*/{{{','.join(splits)}}}/img/*").select("path", "length")


def rebase(items: DataFrame, root: str) -> DataFrame:
    """image_path as {root}/{dataset}/{split}/img/{last segment}."""
    folder = F.concat_ws("/", F.lit(root.rstrip("/")), "dataset", "split", F.lit("img"))
    return items.withColumn("image_path", F.concat(folder, F.lit("/"), last_segment(F.col("image_path"))))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.METRIC).json(path)


def append_metrics(rows: DataFrame, path: str) -> None:
    rows.select(*[x.split()[0] for x in schemas.METRIC.split(", ")]).write.mode("append").json(path)
