"""Dictionary-compressed WARC archives.

A dictionary is trained on a bounded sample of records and stands, itself a zstd frame, in a skippable frame (magic 0x184D2A5D) at
the start of each archive; each record is one frame of its own, compressed with that dictionary, so any record can be read alone.

Records whose payloads are equal and have at least 100 bytes: the one with the smallest page_id is a response, the others are
revisits that name it (WARC-Refers-To and its target) and carry no payload. Digests meet on narrow rows, and the task that reads a
page writes it: payloads move only if revisits are too many to be broadcast.
A task closes an archive at `roll` bytes; files are named by partition and number, so a repeated task replaces its own files.
Edge cases: null html is an empty payload; null url gives an empty target; a null page_id is written under the id `none` and is
never a revisit's target; equal page_ids with equal payloads are all responses and no revisits of themselves; empty tables write
nothing; other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .base import saved, shared_dir

MAGIC = 0x184D2A5D
LEAST, ROLL, DICTIONARY, SAMPLE, SAMPLE_BYTES, LEVEL = 100, 64_000_000, 64_000, 1_000, 65_536, 3
STEP = 4_096
REVISITS = 100_000  # rows of some 300 bytes that may be broadcast
DATE = "2024-01-01T00:00:00Z"  # archives of equal pages are equal files


def record_id(page_id, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}\n{url}\n{digest}')}>"


def target(url: str | None) -> str:
    """A URL as a header value: white space and control characters as their percent codes."""
    return "".join(c if c > " " and c != "\x7f" and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def record(kind: str, page_id, url: str | None, digest: str, payload: bytes, refers_to) -> bytes:
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, url, digest)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target(url)}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-Id: {'none' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        first, first_url = refers_to
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(first, first_url, digest)}",
            f"WARC-Refers-To-Target-URI: {target(first_url)}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-Id: {first}",
        ]
    head += [f"X-Payload-Bytes: {len(payload)}", "Content-Type: text/html; charset=utf-8"]
    body = payload if kind == "response" else b""
    return ("\r\n".join([*head, f"Content-Length: {len(body)}"]) + "\r\n\r\n").encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def leading_frame(dictionary: bytes) -> bytes:
    body = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", MAGIC, len(body)) + body


def records(data: bytes) -> Iterator[bytes]:
    """The records of an archive, from its bytes alone."""
    at, dictionary = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
        at = 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    view = memoryview(data)
    while at < len(data):
        one, parts = reader.decompressobj(), []
        while not one.eof:  # in steps, as what a frame leaves of its input is copied
            if at >= len(data):
                raise ValueError("the archive ends within a record")
            parts.append(one.decompress(view[at : at + STEP]))
            at += STEP
        at = min(at, len(data)) - len(one.unused_data)
        yield b"".join(parts)


def trained(pages: DataFrame, sample: int = SAMPLE, size: int = DICTIONARY) -> bytes:
    """A dictionary from at most `sample` records of at most SAMPLE_BYTES each (smallest hashes of page_id)."""
    whole = pages.where(f"octet_length(html) BETWEEN 1 AND {SAMPLE_BYTES}")
    names = whole.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    rows = whole.join(F.broadcast(names.distinct()), "page_id").select("page_id", "url", "html").limit(2 * sample).collect()
    texts = [record("response", r["page_id"], r["url"], "0" * 64, r["html"].encode("utf-8", "surrogatepass"), None) for r in sorted(rows, key=lambda r: (r["page_id"], r["html"]))]
    size = min(size, sum(map(len, texts)) // 10)
    try:
        return zstandard.train_dictionary(size, texts).as_bytes() if size >= 1024 else b""
    except zstandard.ZstdError:  # too few or too uniform records for a dictionary
        return b""


def write(pages: DataFrame, folder: str, roll: int = ROLL) -> DataFrame:
    """Writes all pages to archives under `folder`; returns one row (file, n_records) per archive."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html")).withColumn("digest", F.sha2("html", 256))
    long = rows.where(f"octet_length(html) >= {LEAST} AND page_id IS NOT NULL").select("page_id", "url", "digest")
    first = long.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    later = long.join(first, "digest").where("page_id <> first.page_id").select("page_id", "digest", "first.url", F.col("first.page_id").alias("refers_to")).distinct()
    later = saved(later.withColumnRenamed("url", "refers_to_url"), "warc-revisits")
    told = rows.join(F.broadcast(later) if later.count() <= REVISITS else later, ["page_id", "digest"], "left")
    dictionary = trained(pages)
    names = {x.name: x.dataType.simpleString() for x in pages.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number = TaskContext.get().partitionId(), 0
        made = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=LEVEL)
        head, held, size = leading_frame(dictionary) if dictionary else b"", [], 0

        def close() -> pd.DataFrame:
            nonlocal number, held, size
            uri = f"{folder}/part-{part:06d}-{number:04d}.warc.zst"
            files.publish(uri, [head, *held])
            out = pd.DataFrame({"file": [uri], "n_records": [len(held)]})
            number, held, size = number + 1, [], 0
            return out

        for b in batches:
            for page, url, text, digest, refers, first_url in zip(b["page_id"].astype(object), b["url"], b["html"], b["digest"], b["refers_to"].astype(object), b["refers_to_url"], strict=True):
                page = None if pd.isna(page) else int(page) if names["page_id"] != "string" else page
                revisit = not pd.isna(refers)
                payload = text.encode("utf-8", "surrogatepass")
                data = record("revisit" if revisit else "response", page, url, digest, payload, (int(refers) if names["page_id"] != "string" else refers, first_url) if revisit else None)
                held.append(made.compress(data))
                size += len(held[-1])
                if size >= roll:
                    yield close()
        if held:
            yield close()

    return saved(told.mapInPandas(run, "file string, n_records long"), "warc-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """One row per record of the archives named in the manifest: its fields, and size and digest of the payload that stands there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for uri in b["file"]:
                out = []
                for data in records(files.read(uri)):
                    f, body = parsed(data)
                    full = f["WARC-Type"] == "response"
                    digest = f["WARC-Payload-Digest"].removeprefix("sha256:")
                    if full and hashlib.sha256(body).hexdigest() != digest:
                        raise ValueError(f"{uri}: a payload doesn't have its digest")
                    page, refers = f["X-Page-Id"], f.get("X-Refers-To-Page-Id")
                    out.append((None if page == "none" else page, len(body) if full else int(f["X-Payload-Bytes"]), digest, f["WARC-Type"], refers, f["WARC-Target-URI"]))
                yield pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    spread = manifest.select("file").repartition(max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1))
    return spread.mapInPandas(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string")


def round_trip(pages: DataFrame) -> DataFrame:
    folder = shared_dir(pages.sparkSession, "warc")
    kind = dict(pages.dtypes)["page_id"]
    return read(write(pages, folder)).select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind), "url")
