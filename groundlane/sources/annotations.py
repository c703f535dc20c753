"""Annotation files read whole and strictly: no file or item vanishes, and absent, null and empty values stay apart.

A file is one JSON document {"items": [...]}, on as many lines as it likes; dataset and split are folders above it, named plainly
(set/train/json/a.json) or as Spark partitions (dataset=set/split=train/a.txt). Documents are VARIANT values, so that a key that is
absent, one that is null and one of another type than declared are three things.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import store

PLACES = r"/(?:dataset=)?([^/]+)/(?:split=)?([^/]+)(?:/json)?/[^/]+$"
#: What can be wrong with a file, and with an item before any rule looks at it.
FILE_FAULTS = ("malformed", "no_items")
ITEM_FAULTS = ("no_object", "no_image_path", "no_length")


def globbed(root: str, splits: Sequence[str]) -> list[tuple[str, str]]:
    """The folders that may hold files, and the files' names in them."""
    root, names = root.rstrip("/"), ",".join(splits)
    return [(f"{root}/*/{{{names}}}/json", "*.json"), (f"{root}/dataset=*/split={{{names}}}", "*")]


def escaped(path: str) -> str:
    """A path as a pattern that only it matches."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def empty_files(spark: SparkSession, statuses) -> list[str]:
    """The paths of those of an array of file statuses that hold nothing. The driver gets the statuses as one text, and asks for a
    status by itself only where the text says that it is empty, or doesn't tell."""
    told = re.findall(r"; isDirectory=(?:true|false; length=(\d+));", spark._jvm.org.apache.commons.lang3.ArrayUtils.toString(statuses))
    maybe = [k for k, n in enumerate(told) if n in ("", "0")] if len(told) == len(statuses) else range(len(statuses))
    return [statuses[k].getPath().toString() for k in maybe if not statuses[k].getLen()]


def annotation_files(spark: SparkSession, root: str, splits: Sequence[str] = ("train", "val")) -> DataFrame:
    """dataset, split, file, document (VARIANT) and fault of every annotation file. `malformed`: no JSON document in UTF-8, or one that names
    a key twice; `no_items`: `items` is absent or no list. Splits that no dataset has are skipped. The
    driver lists the folders, as it does for any source."""
    fs, path = store(spark, root)[0], spark._jvm.org.apache.hadoop.fs.Path
    content, empty = [], []
    for folders, name in globbed(root, splits):
        files = fs.globStatus(path(f"{folders}/{name}"))
        if files is None or not len(files):
            continue
        # Whole files as they are. Folders are read, not files by name, each of which Spark would list by a task of its own.
        found = [x.getPath().toString() for x in fs.globStatus(path(folders)) if x.isDirectory()]
        content.append(spark.read.format("binaryFile").option("pathGlobFilter", name).load([escaped(x) for x in found]).select(F.col("path").alias("file"), "content"))
        # Spark's sources pass over empty files, so these are named here.
        empty += empty_files(spark, files)
    if not content:
        raise FileNotFoundError(f"{root}: no dataset has a file for any of {list(splits)}")
    whole = content[0] if len(content) == 1 else content[0].unionAll(content[1])
    rows = whole.select("file", F.try_parse_json(F.try_validate_utf8(F.col("content").cast("string"))).alias("document"))
    if empty:
        rows = rows.unionAll(spark.createDataFrame([(x,) for x in empty], "file string").select("file", F.parse_json(F.lit(None).cast("string"))))
    items = F.expr("try_variant_get(document, '$.items', 'array<variant>')")
    fault = F.when(F.col("document").isNull(), FILE_FAULTS[0]).when(items.isNull(), FILE_FAULTS[1])
    return rows.select(F.regexp_extract("file", PLACES, 1).alias("dataset"), F.regexp_extract("file", PLACES, 2).alias("split"), "file", "document", fault.alias("fault"))


def rejected_files(files: DataFrame) -> DataFrame:
    """The files that no items can be had from, and why."""
    return files.where("fault IS NOT NULL").select("dataset", "split", "file", "fault")


def file_items(files: DataFrame, on_fault: str = "raise") -> DataFrame:
    """dataset, split, file, place (from 0) and item (VARIANT). A faulty file ends the job by name, or with "skip" is left to
    rejected_files."""
    if on_fault not in ("raise", "skip"):
        raise ValueError(f"on_fault is raise or skip, not {on_fault!r}")
    message = F.concat(F.lit("annotation file "), F.col("file"), F.lit(": "), F.col("fault"))
    stop = F.raise_error(message).cast("array<variant>") if on_fault == "raise" else F.lit(None).cast("array<variant>")
    items = F.when(F.col("fault").isNotNull(), stop).otherwise(F.expr("try_variant_get(document, '$.items', 'array<variant>')"))
    return files.select("dataset", "split", "file", F.posexplode(items).alias("place", "item"))


def kind(value: Column) -> Column:
    """absent, null, or a value's type: string, array, object, boolean, bigint, decimal, double."""
    return F.when(value.isNull(), "absent").when(F.is_variant_null(value), "null").otherwise(F.lower(F.regexp_extract(F.schema_of_variant(value), "^[A-Za-z]+", 0)))


def field(name: str) -> Column:
    return F.expr(f"try_variant_get(item, '$.{name}', 'variant')")


def length(value: Column, kinds: Column) -> Column:
    """How many parts a list, text or object has; null for what has no length."""
    return (
        F.when(kinds == "array", F.size(F.try_variant_get(value, "$", "array<variant>")))
        .when(kinds == "string", F.length(F.try_variant_get(value, "$", "string")))
        .when(kinds == "object", F.size(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))))
    )


def typed(items: DataFrame) -> DataFrame:
    """Of every item: dataset, split, file, place, query, answer, bbox and image_path in the declared types (null where a value has
    another), the kind of each as {name}_kind, how long bbox and answer are (n_...), whether they count as none
    (no_...), n_bad_boxes and item_fault.

    A bad box is no list of four numbers with a fraction: whole numbers and other counts pass the rules and fail where boxes are
    drawn. item_fault: `no_object`, an item that is no object; `no_image_path`, without a path as text; `no_length`, whose boxes or
    answers are there and have no length."""
    kinds = {n: kind(field(n)) for n in ("query", "answer", "bbox", "image_path")}
    number = F.expr("try_variant_get(item, '$.bbox', 'array<variant>')")

    def bad(box: Column) -> Column:
        coordinates = F.try_variant_get(box, "$", "array<variant>")
        return ~F.coalesce((F.size(coordinates) == 4) & F.forall(coordinates, lambda c: kind(c).isin("decimal", "double")), F.lit(False))

    rows = items.select(
        "dataset", "split", "file", "place", "item",
        F.expr("try_variant_get(item, '$.query', 'string')").alias("query"), F.expr("try_variant_get(item, '$.answer', 'array<string>')").alias("answer"),
        F.expr("try_variant_get(item, '$.bbox', 'array<array<double>>')").alias("bbox"), F.expr("try_variant_get(item, '$.image_path', 'string')").alias("image_path"),
        *[k.alias(f"{n}_kind") for n, k in kinds.items()], kind(F.col("item")).alias("item_kind"),
        F.coalesce(F.size(F.filter(number, bad)), F.lit(0)).alias("n_bad_boxes"),
    )
    rows = rows.withColumns({f"n_{n}": length(field(n), F.col(f"{n}_kind")) for n in ("bbox", "answer")})
    rows = rows.withColumns({f"no_{n}": nothing(n) for n in ("bbox", "answer")})
    unsized = [F.col(f"n_{n}").isNull() & ~F.col(f"no_{n}") for n in ("bbox", "answer")]
    fault = F.when(F.col("item_kind") != "object", ITEM_FAULTS[0]).when(F.col("image_path_kind") != "string", ITEM_FAULTS[1]).when(unsized[0] | unsized[1], ITEM_FAULTS[2])
    return rows.withColumn("item_fault", fault)


def nothing(name: str) -> Column:
    """Whether a value counts as none: absent, null, empty, zero or false."""
    zero = F.expr(f"try_variant_get(item, '$.{name}', 'double')") == 0
    off = ~F.expr(f"try_variant_get(item, '$.{name}', 'boolean')")
    k = F.col(f"{name}_kind")
    by_kind = F.when(k.isin("bigint", "decimal", "double"), zero).when(k == "boolean", off).otherwise(F.col(f"n_{name}") == 0)
    return k.isin("absent", "null") | F.coalesce(by_kind, F.lit(False))


def strict_reason(has_image: Column) -> Column:
    """The first rule that a typed item fails, else null. An absent or empty query is empty, a null one is not."""
    return (
        F.when((F.col("query_kind") == "absent") | ((F.col("query_kind") == "string") & (F.col("query") == "")), "empty_query")
        .when(F.col("no_bbox"), "empty_bbox")
        .when(F.col("no_answer"), "empty_answer")
        .when(F.col("n_bbox") != F.col("n_answer"), "len_mismatch")
        .when(~has_image, "missing_image")
    )
