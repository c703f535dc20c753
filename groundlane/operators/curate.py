"""Rejecting, counting, splitting and capping items."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import check_split_size
from ..functions.columns import half_even, hash32, hash_order
from .tokens import first_by_hash, rank_within

REASONS = ("empty_query", "empty_bbox", "empty_answer", "len_mismatch", "missing_image")


def reject_reason(has_image: Column) -> Column:
    """The first rule that fails, else null. One expression, so that no plan changes which rule is named."""
    empty = lambda c: F.col(c).isNull() | (F.size(c) == 0)
    return (
        F.when(F.col("query").isNull() | (F.col("query") == ""), F.lit(REASONS[0]))
        .when(empty("bbox"), F.lit(REASONS[1]))
        .when(empty("answer"), F.lit(REASONS[2]))
        .when(F.size("bbox") != F.size("answer"), F.lit(REASONS[3]))
        .when(~has_image, F.lit(REASONS[4]))
    )


def judged(items: DataFrame, listing: DataFrame, reason: Callable[[Column], Column] = reject_reason, segments: int = 1) -> DataFrame:
    """Items with image_key and reject_reason, by a rule that is told whether the image is there: whether the listing has a path of
    the same last `segments`. Catalyst broadcasts the listing's keys only if they are small."""
    key = lambda path: F.substring_index(path, "/", -segments)
    known = listing.select(key("path").alias("_key")).distinct().withColumn("_there", F.lit(True))
    rows = items.withColumn("image_key", key("image_path"))
    rows = rows.join(known, F.col("image_key") == F.col("_key"), "left")
    return rows.withColumn("reject_reason", reason(F.coalesce("_there", F.lit(False)))).drop("_key", "_there")


def kept(items: DataFrame, listing: DataFrame) -> DataFrame:
    return judged(items, listing).where("reject_reason IS NULL").drop("reject_reason")


def filter_stats(rows: DataFrame) -> DataFrame:
    """Per (dataset, split): total, kept and one counter per reason; total = kept + the counters."""
    counters = [F.count_if(F.col("reject_reason") == r).alias(r) for r in REASONS]
    return rows.groupBy("dataset", "split").agg(F.count("*").alias("total"), F.count_if(F.col("reject_reason").isNull()).alias("kept"), *counters)


def sampled_groups(rows: DataFrame, size: int | float, seed: int = 117, key: str = "image_key") -> DataFrame:
    """Exactly `size` (a count, or a fraction rounded half to even) of each dataset's distinct images, in the order of a seeded hash."""
    check_split_size(size)
    wanted = lambda n: F.least(n, F.lit(size)) if isinstance(size, int) else half_even(n * F.lit(size))
    return first_by_hash(rows.select("dataset", key).distinct(), ["dataset"], hash_order(seed, key), key, wanted)


def group_split(rows: DataFrame, size: int | float, seed: int = 117, key: str = "image_key") -> DataFrame:
    """Rows with `chosen`: all rows of a sampled image are on one side, so no image is on both."""
    picked = sampled_groups(rows, size, seed, key).withColumn("_chosen", F.lit(True))
    return rows.join(picked, ["dataset", key], "left").withColumn("chosen", F.coalesce("_chosen", F.lit(False))).drop("_chosen")


def capped(rows: DataFrame, most: int = 500, seed: int = 117, by: str = "dataset", key: str = "item_id") -> DataFrame:
    """At most `most` rows of each dataset, in the order of a seeded hash; the rest is dropped, as the cap of a validation set.
    Every task drops what is beyond its own first `most` before rows move."""
    w = Window.partitionBy(by).orderBy(hash_order(seed, key), key)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most).drop("_rank")


def prepared(judged_rows: DataFrame, own: float = 0.99, carved: float = 0.2, seed: int = 117) -> DataFrame:
    """final_split: a dataset that has a val split (before filtering) keeps `own` of its val images and drops the others, another
    gives `carved` of its train images to val."""
    has_val = judged_rows.groupBy("dataset").agg(F.max(F.col("split") == "val").alias("has_val"))
    rows = judged_rows.where("reject_reason IS NULL").join(has_val, "dataset")
    # A dataset's images are drawn from one of its splits alone, so one draw serves both rules.
    pool = F.col("split") == F.when(F.col("has_val"), "val").otherwise("train")
    share = F.when(F.col("has_val"), F.lit(own)).otherwise(F.lit(carved))
    images = rows.where(pool).select("dataset", "image_key", "has_val").distinct()
    picked = first_by_hash(images, ["dataset", "has_val"], hash_order(seed, "image_key"), "image_key", lambda n: half_even(n * share))
    picked = picked.select("dataset", "image_key", F.lit(True).alias("_picked"))
    chosen = pool & F.coalesce("_picked", F.lit(False))
    final = F.when(chosen, "val").when(F.col("has_val") & pool, "dropped").otherwise("train")
    return rows.join(picked, ["dataset", "image_key"], "left").withColumn("final_split", final).drop("has_val", "_picked")


def require_rows(rows: DataFrame, what: str) -> DataFrame:
    if rows.isEmpty():
        raise ValueError(f"{what} is empty")
    return rows


def checked_splits(train: DataFrame, val: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training can't start without rows to train on, and only warns where there are none to validate on."""
    require_rows(train, "the training set")
    if val.isEmpty():
        warnings.warn("the validation set is empty", stacklevel=2)
    return train, val


def negatives(rows: DataFrame, seed: int = 658) -> DataFrame:
    """For rows of a negative polarity, another image of the same split: the one a seeded number of places further in a seeded
    order of the split's images. Every image but the own one can be met; a split of one image has none, and gives null."""
    images = rows.select("dataset", "split", "image_key").distinct()
    order = rank_within(images, ["dataset", "split"], hash_order(seed, "image_key"), "image_key", "place", size="n").withColumn("place", F.col("place") - 1)
    at = rows.join(order, ["dataset", "split", "image_key"]).withColumn("swap_to", F.when(F.col("n") > 1, (F.col("place") + 1 + hash32(seed, "item_id") % F.greatest(F.col("n") - 1, F.lit(1))) % F.col("n")))
    other = order.select("dataset", "split", F.col("place").alias("swap_to"), F.col("image_key").alias("swapped"))
    return at.join(other, ["dataset", "split", "swap_to"], "left").drop("place", "n", "swap_to")
