"""Folders that the driver and all executors share, and the few file operations that whole-table writes don't cover."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under spark.checkpoint.dir, or under the warehouse where the session names none. A warehouse on a disk of the
    driver's machine serves local sessions only: on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = known.get() if known.isDefined() else None
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir")
        if not spark.sparkContext.master.startswith("local") and store(spark, root)[0].getUri().getScheme() == "file":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/groundlane/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """A table as Parquet in the shared folder, read from there: its plan runs once."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store(spark: SparkSession, path: str):
    """The file system of a path, and the path as it names it."""
    named = spark._jvm.org.apache.hadoop.fs.Path(path)
    return named.getFileSystem(spark._jsc.hadoopConfiguration()), named


def exists(spark: SparkSession, path: str) -> bool:
    fs, named = store(spark, path)
    return fs.exists(named)


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in one folder, in order; none if there is no such folder."""
    fs, named = store(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(named)) if fs.exists(named) else []


def moved(spark: SparkSession, source: str, target: str) -> None:
    """Renames a file or folder; a file that is there is replaced in one step."""
    fs, path = store(spark, source)
    hadoop = spark._jvm.org.apache.hadoop.fs
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(path), fs.makeQualified(hadoop.Path(target)), over)


def removed(spark: SparkSession, path: str) -> None:
    fs, named = store(spark, path)
    fs.delete(named, True)


def put(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file as a whole: under another name first, then renamed."""
    draft = f"{path.rpartition('/')[0]}/_draft-{uuid.uuid4().hex}"
    fs, named = store(spark, draft)
    out = fs.create(named, True)
    out.write(text.encode())
    out.close()
    moved(spark, draft, path)


def text_of(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    return spark.read.text(path, wholetext=True).first()["value"]
