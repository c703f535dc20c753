"""Token counts through a digest cache.

A count depends only on a text and a tokenizer file, so the cache is a Parquet table of (content_digest, tokenizer_digest, n_tokens)
that only grows. Each call joins its digests to the cache, encodes one text per missing digest, appends those counts, and joins
them to the documents.

Normalised content is the text with null as empty; nothing else may be folded, as this would change counts. A copy group, however
large, sends at most one text per input partition: rows shrink to their first text per digest before they move. A cache path may be
shared by any number of calls; the query opens a fresh one each time, so that its figures don't hang on what ran before.
Edge cases: null and empty texts have 0 bytes and 0 tokens; an empty table gives an empty result; repeated rows are counted each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import saved
from .tok import counter, file_digest

CACHE_SCHEMA = "content_digest string, tokenizer_digest string, n_tokens long"


def read_cache(spark, path: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException:  # not there yet
        return spark.createDataFrame([], CACHE_SCHEMA)


def _firsts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each digest, the first text in this partition."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for d in batch["content_digest"]:
            k = bytes.fromhex(d)
            keep.append(k not in seen)
            seen.add(k)
        if any(keep):
            yield batch[keep]


def token_counts(docs: DataFrame, tokenizer: str, cache: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens of each document; `cache` is the path of the cache table, `tokenizer` that of the file."""
    spark = docs.sparkSession
    version = file_digest(tokenizer)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("content_digest", F.sha2("text", 256))
    held = read_cache(spark, cache).where(F.col("tokenizer_digest") == version).select("content_digest").distinct()
    firsts = rows.select("content_digest", "text").mapInPandas(_firsts, "content_digest string, text string")

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, seen = counter(tokenizer), {}
        for batch in batches:
            out = {}
            for d, t in zip(batch["content_digest"], batch["text"], strict=True):
                if d not in seen:
                    out[d] = seen[d] = count(t)
            if out:
                yield pd.DataFrame({"content_digest": list(out), "tokenizer_digest": version, "n_tokens": list(out.values())})

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    misses = firsts.repartition(parts, "content_digest").join(held.hint("shuffle_hash"), "content_digest", "left_anti")
    misses.mapInPandas(encoded, CACHE_SCHEMA).write.mode("append").parquet(cache)
    # Written, so that both sides of the last join are exchanged for it and a hot digest's rows can be split over tasks.
    counts = saved(read_cache(spark, cache).where(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    narrow = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content_digest")
    return narrow.join(counts, "content_digest", "left").select("doc_id", "n_bytes", "n_tokens")


def digest(text: str | None) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()
