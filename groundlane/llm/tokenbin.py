"""Token-id shards for random access to short documents.

A shard holds one zstd frame per document, all compressed with one dictionary that was trained on serialised id arrays. Layout:

    magic "GLTOKEN1" | sha256 of the dictionary (32 bytes) | dictionary size u32 | dictionary | frames ...
    | index: per document doc_id i64, frame offset u64, frame size u32, n_tokens u32 | number of documents u64 | index offset u64

Texts are encoded and compressed where they are read; only frames move. Documents stand in ascending doc_id order across shards
(range partitions, sorted within), and starts add the totals of the shards before. Ids are little-endian u16 where vocabulary and end
id allow and u32 elsewhere; checks are over u32.
Edge cases: null and empty texts hold the end id alone; rows that share a doc_id each keep an entry, ordered by size and frame; a null
doc_id sorts first and is stored as the least i64; an empty table has no shard and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .base import saved, shared_dir
from .tok import json_encoder

MAGIC, ENTRY, NO_ID = b"GLTOKEN1", np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("size", "<u4"), ("n_tokens", "<u4")]), -(2**63)
SAMPLE, SAMPLE_CHARS, DICTIONARY, LEVEL, SHARD_DOCS, SHARD_BYTES = 1_000, 20_000, 64_000, 3, 200_000, 128_000_000

#: Bytes of text that are encoded at a time: of each block's distinct pieces every one is looked up once.
BLOCK = 16_000_000


class Shard:
    """Documents of a shard, one by one through its index or in order in one reading."""

    def __init__(self, uri: str):
        self.uri = uri
        store, path = files.opened(uri)
        self.file = store.open_input_file(path)
        head = self.file.read(44)
        if head[:8] != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        self.dictionary_hash = head[8:40].hex()
        dictionary = self.file.read(struct.unpack("<I", head[40:])[0])
        if hashlib.sha256(dictionary).hexdigest() != self.dictionary_hash:
            raise ValueError(f"{uri}: its dictionary doesn't have its hash")
        self.reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
        self.file.seek(self.file.size() - 16)
        n, at = struct.unpack("<QQ", self.file.read(16))
        self.file.seek(at)
        self.index = np.frombuffer(self.file.read(n * ENTRY.itemsize), ENTRY)

    def wide(self, frame: bytes, n_tokens: int) -> np.ndarray:
        data = self.reader.decompress(frame)
        return np.frombuffer(data, "<u2" if len(data) == 2 * n_tokens else "<u4").astype("<u4", copy=False)

    def ids(self, k: int) -> np.ndarray:
        """The ids of the document at place k of the index."""
        e = self.index[k]
        self.file.seek(int(e["offset"]))
        return self.wide(self.file.read(int(e["size"])), int(e["n_tokens"]))

    def all_ids(self, most: int = 16_000_000) -> Iterator[np.ndarray]:
        """The ids of every document in order, from reads of about `most` bytes."""
        offsets, sizes, n = (self.index[x].astype(np.int64) for x in ("offset", "size", "n_tokens"))
        k = 0
        while k < len(n):
            end = max(k + 1, int(np.searchsorted(offsets + sizes, offsets[k] + most, "right")))
            self.file.seek(int(offsets[k]))
            data = memoryview(self.file.read(int(offsets[end - 1] + sizes[end - 1] - offsets[k])))
            for a, size, tokens in zip((offsets[k:end] - offsets[k]).tolist(), sizes[k:end].tolist(), n[k:end].tolist(), strict=True):
                yield self.wide(data[a : a + size], tokens)
            k = end


def serialiser(tokenizer: str, end_id: int):
    """(column of texts -> their ids and the end id as bytes, bytes of one id): u16 if the vocabulary and the end id allow, else u32."""
    encoder = json_encoder(tokenizer, "bytes")
    width = 2 if encoder.type == "<u2" and end_id < 65_536 else 4
    end = end_id.to_bytes(width, "little")
    if width == int(encoder.type[-1]):
        return lambda texts: [x + end for x in encoder.encode_column(texts, BLOCK)], width
    return lambda texts: [np.frombuffer(x, encoder.type).astype("<u4").tobytes() + end for x in encoder.encode_column(texts, BLOCK)], width


def trained(docs: DataFrame, tokenizer: str, end_id: int, sample: int = SAMPLE) -> bytes:
    """A dictionary from the first SAMPLE_CHARS characters of at most `sample` documents (smallest hashes of doc_id)."""
    names = docs.select("doc_id").where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    able = docs.select("doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text")).where("text <> ''")
    texts = sorted(r["text"] for r in able.join(F.broadcast(names), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).collect())
    serialised, _ = serialiser(tokenizer, end_id)
    arrays = serialised(pa.array(texts, pa.string()))
    size = min(DICTIONARY, sum(map(len, arrays)) // 10)
    try:
        return zstandard.train_dictionary(size, arrays).as_bytes() if size >= 1024 else b""
    except zstandard.ZstdError:  # too few or too uniform texts
        return b""


def frames(docs: DataFrame, tokenizer: str, end_id: int, dictionary: bytes) -> DataFrame:
    """doc_id, n_tokens and frame of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serialised, width = serialiser(tokenizer, end_id)
        made = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for k in range(0, batch.num_rows, 5_000):
                b = batch.slice(k, 5_000)
                data = serialised(b["text"])
                yield pa.record_batch({"doc_id": b["doc_id"], "n_tokens": pa.array([len(x) // width for x in data], pa.int64()), "frame": pa.array([made.compress(x) for x in data], pa.binary())})

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, frame binary")


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Writes shards under `folder`; returns one row (part, number, file, n_docs, n_tokens) per shard, in order of (part, number)."""
    spark = docs.sparkSession
    dictionary = trained(docs, tokenizer, end_id)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # Written, as a range partitioning reads its input twice: once to find the ranges.
    made = saved(frames(docs, tokenizer, end_id, dictionary), "token-frames", "none")
    ordered = made.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "n_tokens", "frame")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number = TaskContext.get().partitionId(), 0
        head = MAGIC + hashlib.sha256(dictionary).digest() + struct.pack("<I", len(dictionary)) + dictionary
        held, entries, at = [], [], len(head)

        def close() -> pd.DataFrame:
            nonlocal number, held, entries, at
            uri = f"{folder}/part-{part:06d}-{number:04d}.tok"
            index = np.array(entries, ENTRY)
            files.publish(uri, [head, *held, index.tobytes(), struct.pack("<QQ", len(index), at)])
            out = pd.DataFrame({"part": [part], "number": [number], "file": [uri], "n_docs": [len(index)], "n_tokens": [int(index["n_tokens"].sum(dtype=np.int64))]})
            number, held, entries, at = number + 1, [], [], len(head)
            return out

        for b in batches:
            for doc, n, frame in zip(b["doc_id"], b["n_tokens"], b["frame"], strict=True):
                held.append(frame)
                entries.append((doc, at, len(frame), n))
                at += len(frame)
                if len(entries) >= SHARD_DOCS or at >= SHARD_BYTES:
                    yield close()
        if entries:
            yield close()

    return saved(ordered.mapInPandas(run, "part int, number int, file string, n_docs long, n_tokens long"), "tokens-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the shards named in the manifest."""
    spark = manifest.sparkSession
    # One row per shard: their running total is the only step over all shards at once.
    before = 0
    named = []
    for r in sorted(manifest.select("part", "number", "file", "n_tokens").collect()):
        named.append((r["file"], before))
        before += r["n_tokens"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for uri, start in zip(b["file"], b["start"], strict=True):
                shard = Shard(uri)
                n = shard.index["n_tokens"].astype(np.int64)
                starts = start + np.cumsum(n) - n
                sums = [zlib.crc32(ids) for ids in shard.all_ids()]
                ids = pd.array(shard.index["doc_id"], "Int64")
                ids[shard.index["doc_id"] == NO_ID] = pd.NA
                yield pd.DataFrame({"doc_id": ids, "start": starts, "n_tokens": n, "ids_crc32": sums})

    rows = spark.createDataFrame(named, "file string, start long").repartition(max(1, min(len(named), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return rows.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    return read(write(docs, shared_dir(docs.sparkSession, "tokens"), tokenizer, end_id))
