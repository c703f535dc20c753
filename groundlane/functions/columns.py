"""Column functions with exact semantics: hash buckets that any engine can repeat, rounding half to even, list texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(seed: int | str, *keys) -> Column:
    """The first 32 bits of md5(seed|key|...): equal on every run, partitioning and engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_order(seed: int | str, key: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def half_even(x: Column) -> Column:
    """Rounds to an integer, ties to the even neighbour."""
    return F.rint(x).cast("bigint")


def last_segment(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


#: Control, format, private, unassigned characters and all separators but the space.
UNPRINTABLE = r"[\p{C}\p{Z}&&[^ ]]"


def list_repr(items: Column) -> Column:
    """The text that Python's repr() gives for a list of strings: single quotes, double ones around a text that holds only single
    quotes; backslashes and what can't be printed escaped. Null lists give null, null items `None`. Which of the latest code points
    are assigned, and so printable, is the JVM's table."""

    def code(c: Column) -> Column:
        digits = F.lower(F.hex(F.ascii(c)))
        size = F.length(digits)
        return F.when(size <= 2, F.concat(F.lit("\\x"), F.lpad(digits, 2, "0"))).when(size <= 4, F.concat(F.lit("\\u"), F.lpad(digits, 4, "0"))).otherwise(F.concat(F.lit("\\U"), F.lpad(digits, 8, "0")))

    def coded(s: Column) -> Column:
        each = F.transform(F.split(s, ""), lambda c: F.when(c.rlike(UNPRINTABLE), code(c)).otherwise(c))
        return F.when(s.rlike(UNPRINTABLE), F.array_join(each, "")).otherwise(s)

    def one(s: Column) -> Column:
        body = F.replace(s, F.lit("\\"), F.lit("\\\\"))
        for raw, shown in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
            body = F.replace(body, F.lit(raw), F.lit(shown))
        body = coded(body)
        double = F.contains(s, F.lit("'")) & ~F.contains(s, F.lit('"'))
        single = F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
        return F.coalesce(F.when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(single), F.lit("None"))

    return F.concat(F.lit("["), F.array_join(F.transform(items, one), ", "), F.lit("]"))
