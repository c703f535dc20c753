"""Bounding boxes: scaling, texts, quality flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import half_even


def bad(box: Column) -> Column:
    """Not four coordinates: such a box passes the item filter and can't be scaled."""
    return box.isNull() | (F.size(box) != 4) | F.exists(box, lambda c: c.isNull())


def scaled(box: Column, w: Column | int, h: Column | int) -> Column:
    """array<bigint> of round(c * w) and round(c * h), ties to even; null for a bad box."""
    w, h = (F.lit(x) if isinstance(x, int) else x for x in (w, h))
    return F.when(~bad(box), F.transform(box, lambda c, i: half_even(c * F.when(i % 2 == 0, w).otherwise(h))))


def target_side(family: Column, side: Column) -> Column:
    """What a coordinate is multiplied by: the resized side in pixels for one family, 1000 for the others."""
    return F.when(family == "qwen2.5", side).otherwise(F.lit(1000))


def text(box: Column) -> Column:
    return F.concat(F.lit("<box> "), F.array_join(box.cast("array<string>"), " "), F.lit(" </box>"))


def with_box_text(rows: DataFrame, box: str = "box") -> DataFrame:
    """Rows of one box each, with its text as box_str."""
    return rows.withColumn("box_str", text(F.col(box)))


def texts(bbox: Column, w: Column | int = 1000, h: Column | int = 1000) -> Column:
    return F.transform(bbox, lambda b: text(scaled(b, w, h)))


def joined(box_texts: Column) -> Column:
    return F.array_join(box_texts, " ")


def interleaved(answers: Column, box_texts: Column) -> Column:
    """Answer i without its outer periods, a space and box i; the pairs are joined by " ."."""
    return F.array_join(F.zip_with(answers, box_texts, lambda a, b: F.concat(F.btrim(a, F.lit(".")), F.lit(" "), b)), " .")
