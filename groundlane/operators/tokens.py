"""Epoch order, batches, padding and label masks over token arrays. Tokenizers are external; tests use a hashing stand-in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RunSettings
from ..functions.columns import hash_order

IGNORED = -100


def global_rank(rows: DataFrame, order: Column, ties: str, name: str = "rank", digits: int = 4) -> DataFrame:
    """1, 2, ... over all rows in the order of a hex hash, without one task that sees all rows: rows are ranked within the first hex
    digits of the hash, and the at most 16 ** digits counts of those groups are summed up before them."""
    one = rows.withColumn("_all", F.lit(0))
    return rank_within(one, ["_all"], order, ties, name, digits=digits).drop("_all")


def rank_within(rows: DataFrame, within: list[str], order: Column, ties: str, name: str = "rank", size: str | None = None, digits: int = 4) -> DataFrame:
    """The same within each value of some columns, however few values they have; `size` names a column for the rows of that value."""
    held = rows.withColumn("_o", order).withColumn("_g", F.substring("_o", 1, digits))
    sizes = held.groupBy(*within, "_g").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*within)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sizes.select(*within, "_g", before.alias("_b"), F.sum("_n").over(whole).alias(size or "_s"))
    placed = held.withColumn("_r", F.row_number().over(Window.partitionBy(*within, "_g").orderBy("_o", ties)))
    return placed.join(sums, [*within, "_g"]).withColumn(name, F.col("_r") + F.col("_b")).drop("_o", "_g", "_r", "_b", "_s")


def first_by_hash(rows: DataFrame, within: list[str], order: Column, ties: str, wanted: Callable[[Column], Column], digits: int = 4) -> DataFrame:
    """Of each value of some columns, exactly the first wanted(n) of its n rows in the order of a hex hash. Counts of the hash's first
    digits tell in which prefix the last of them lies: rows of lesser prefixes pass by a filter, and that prefix alone is ranked."""
    held = rows.withColumn("_o", order).withColumn("_g", F.substring("_o", 1, digits))
    whole = Window.partitionBy(*within)
    sizes = held.groupBy(*within, "_g").agg(F.count("*").alias("_n"))
    sums = sizes.select(*within, "_g", "_n", F.sum("_n").over(whole.orderBy("_g")).alias("_to"), wanted(F.sum("_n").over(whole)).alias("_wanted"))
    edge = sums.where("_to >= _wanted AND _to - _n < _wanted").select(*within, F.col("_g").alias("_edge"), (F.col("_wanted") - F.col("_to") + F.col("_n")).alias("_need"))
    near = held.join(edge, within)  # a row for each value: Catalyst broadcasts it if it is small
    last = near.where("_g = _edge").withColumn("_r", F.row_number().over(whole.orderBy("_o", ties))).where("_r <= _need").drop("_r")
    return near.where("_g < _edge").unionByName(last).select(*rows.columns)


def running_sum(rows: DataFrame, order: str, value: Column, name: str, ranges: int = 256, ties: str | None = None) -> DataFrame:
    """The sum of `value` over all rows up to and including each, in the order of a numeric column: a prefix sum over ranges. Quantiles
    cut the column into ranges, the sums of these are summed up before them, and each range is summed on its own; no task sees all
    rows. Of rows with equal `order` the lesser `ties` comes first; without it their order is undefined. Null orders come last."""
    from pyspark.ml.feature import Bucketizer

    held = rows.withColumns({"_x": F.coalesce(F.col(order).cast("double"), F.lit(float("inf"))), "_v": value})
    cuts = sorted({x for x in held.approxQuantile("_x", [k / ranges for k in range(1, ranges)], 0.001) if abs(x) < float("inf")})
    placed = Bucketizer(splits=[-float("inf"), *(cuts or [0.0]), float("inf")], inputCol="_x", outputCol="_g", handleInvalid="keep").transform(held)
    sums = placed.groupBy("_g").agg(F.sum("_v").alias("_s")).withColumn("_all", F.lit(0))
    before = F.sum("_s").over(Window.partitionBy("_all").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1))  # `ranges` rows
    keys = [F.col(order).asc_nulls_last(), *([ties] if ties else [])]
    own = F.sum("_v").over(Window.partitionBy("_g").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    bases = F.broadcast(sums.select("_g", F.coalesce(before, F.lit(0)).alias("_b")))
    return placed.withColumn("_own", own).join(bases, "_g").withColumn(name, F.col("_own") + F.col("_b")).drop("_x", "_v", "_g", "_own", "_b")


def epoch_order(rows: DataFrame, seed: int, key: str) -> DataFrame:
    return global_rank(rows, hash_order(seed, key), key)


def batches(ranked: DataFrame, size: int) -> DataFrame:
    return ranked.withColumn("batch_id", F.floor((F.col("rank") - 1) / size))


def epoch(rows: DataFrame, settings: RunSettings, key: str, global_step: int = 0) -> DataFrame:
    """The batches of an epoch as a run's settings order and cut them, from a global step on."""
    return resumed(batches(epoch_order(rows, settings.dataloader_seed, key), settings.batch_size), global_step, settings.batch_size)


def resumed(ranked: DataFrame, global_step: int, batch_size: int) -> DataFrame:
    """What is left of an epoch after `global_step` batches: the same order, its first rows skipped."""
    return ranked.where(F.col("rank") > global_step * batch_size)


def padded(rows: DataFrame, pad_id: int, by: str = "batch_id") -> DataFrame:
    """ids, attention and labels of equal length within a batch, filled on the right with pad_id, 0 and IGNORED."""
    missing = F.max(F.size("ids")).over(Window.partitionBy(by)) - F.size("ids")
    out = rows.withColumn("_missing", missing)
    fill = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), F.col("_missing")))
    out = out.withColumns({"ids": fill("ids", pad_id), "attention": fill("attention", 0), "labels": fill("labels", IGNORED)})
    return out.drop("_missing")


def _ignored_first(ids: Column, n: Column) -> Column:
    """ids with their first n ignored, as one run and a slice: `n` is found once for a row, not at each id."""
    n = F.greatest(n.cast("int"), F.lit(0))
    return F.concat(F.array_repeat(F.lit(IGNORED).cast("bigint"), n), F.slice(ids, n + 1, F.size(ids)))


def masked_to_marker(ids: Column, marker: Column) -> Column:
    """Labels: all up to and including the first marker is ignored. A text without the marker is an error."""
    at = F.array_position(ids, marker)
    checked = F.when(at == 0, F.raise_error(F.lit("no assistant marker in the tokens")).cast("bigint")).otherwise(at)
    return _ignored_first(ids, checked)


def masked_prefix(ids: Column, prompt_size: Column) -> Column:
    """Labels: as many ids as the prompt has, at most all, are ignored."""
    return _ignored_first(ids, F.least(prompt_size, F.size(ids)))


def masked_padding(labels: Column, attention: Column) -> Column:
    return F.zip_with(labels, attention, lambda x, a: F.when(a == 0, F.lit(IGNORED).cast("bigint")).otherwise(x))


def batch_patches(rows: DataFrame) -> DataFrame:
    """Per batch, the image patches of its rows one after the other in the order of `rank`, and one flag of 1 for each."""
    per = rows.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("rank", "patches"))).alias("_p"))
    patches = F.flatten(F.transform("_p", lambda p: p["patches"]))
    return per.select("batch_id", patches.alias("patches"), F.transform(patches, lambda p: F.lit(1)).alias("image_flags"))
