"""What the operators of this subpackage share: shared storage, native word splitting, hashing of words."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import removed, shared_dir

#: Runs of characters that separate words of [0-9a-z] and everything beyond ASCII, after A-Z are lower-cased.
ALNUM_BREAKS = r"[^0-9a-z\P{ASCII}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes df once to the shared folder and reads it from there: later uses don't recompute it, and lost executors lose nothing."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that saved() returned and that nothing reads any more."""
    for t in tables:
        removed(t.sparkSession, t.saved_at)


#: Rows of a few numbers that a broadcast may have.
BROADCAST_ROWS = 500_000


def light(narrow: DataFrame) -> DataFrame:
    """A written table of a few numbers a row as one side of a join: broadcast if it has at most BROADCAST_ROWS rows, which are
    counted, else left to Spark's own choice."""
    return F.broadcast(narrow) if narrow.count() <= BROADCAST_ROWS else narrow


def nested(docs: DataFrame, **keys: Column) -> DataFrame:
    """Whole rows as a struct `row` beside the keys, so that no name in them can clash."""
    return docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row"), *[k.alias(n) for n, k in keys.items()])


def unnested(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"row.`{n}`").alias(n) for n in rows.schema["row"].dataType.names])


def alnum_words(text: Column) -> Column:
    """Words of a whole text as an array, A-Z lower-cased; null and empty texts have none."""
    return F.filter(alnum_split(text), lambda w: w != "")


def alnum_split(text: Column) -> Column:
    """The same in one compiled expression; an empty string stands first or last where a text begins or ends with no word."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), ALNUM_BREAKS)


#: Of an array `words` from alnum_split: how many empty strings stand in front, and how many words there are.
LEAD = "IF(words[0] = '', 1, 0)"
N_WORDS = f"CAST(size(words) - {LEAD} - IF(size(words) > 1 AND words[size(words) - 1] = '', 1, 0) AS BIGINT)"


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a bound."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit hash per window of `size` consecutive ids; a shorter, non-empty sequence is one window."""
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64)
    size = min(size, n)
    out, each = np.full(n - size + 1, size, np.uint64), mixed(ids)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + each[k : n - size + 1 + k]
    return mixed(out)
