"""Mixture-controlled packing: deficit round-robin over source queues.

Every sequence of 2048 tokens takes from each queue its share of the mixture; what a queue is owed in fractions of a token is
carried to the next sequence. The carried deficit has a closed form: the queues stand in a tree that halves them by name, and of the
first n tokens of a node, n * share, rounded, come from its first half and the others from its second. These counts are monotone for
any share, so after any number of sequences every queue has given its share within half a token for each level of the tree, and any
task knows what any sequence holds: partitions need no order among them, and deficits carry over partitions as over sequences. Only the last sequence is short.

A queue is a source. Of more than OWN sources, the OWN with most tokens have queues of their own, and the others, each owed less than
half a token a sequence, share OWN more queues by the hash of their names, each at its share; this bounds what the driver holds.
Shares are the queues' token counts, so that all end together, unless `targets` names others: those hold until the first queue would
run out, and the rest is packed in proportion to what remains. Any share above 0 is held; a source without a target is an error.

A document's tokens are encoded where it is read, are never shuffled by source, and are cut at sequence borders. Within a queue,
documents stand in order of input partition and row; sums per (partition, queue) place them.
Edge cases: null and empty texts hold the end id alone; a null source is a source of its own; rows that share a doc_id are packed
each; an empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import saved
from .tok import json_encoder

SIZE, OWN, SCALE = 2048, 4096, 10**9
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


@dataclass
class Phase:
    """Sequences first .. first + count - 1, which hold `tokens` tokens. `names`: the queues in order; `sums`: running sums of their
    shares, from 0; `low`: how many tokens of each went into earlier phases."""

    first: int
    count: int
    tokens: int
    names: list[str]
    sums: list[int]
    low: dict[str, int]
    known: dict[str, list[tuple[int, int, bool]]] = field(default_factory=dict)

    def path(self, name: str) -> list[tuple[int, int, bool]]:
        """From the root to a queue: (share of the first half, share of both, whether the queue is in the second)."""
        if name not in self.known:
            at, lo, hi, out = bisect_right(self.names, name) - 1, 0, len(self.names), []
            while hi - lo > 1:
                middle = (lo + hi) // 2
                out.append((self.sums[middle] - self.sums[lo], self.sums[hi] - self.sums[lo], at >= middle))
                lo, hi = (middle, hi) if at >= middle else (lo, middle)
            self.known[name] = out
        return self.known[name]

    def given(self, w: int, name: str) -> int:
        """Tokens that a queue has given to this phase before its sequence w."""
        n = min(w * SIZE, self.tokens)
        for part, both, second in self.path(name):
            half = (n * part + both // 2) // both
            n = n - half if second else half
        return n

    def last_at(self, n: int, name: str) -> int:
        """The last sequence before which a queue has given at most n tokens; `count` if none goes beyond."""
        lo, hi = 0, 1
        while hi <= self.count and self.given(hi, name) <= n:
            lo, hi = hi, hi * 2
        hi = min(hi, self.count + 1)
        while hi - lo > 1:
            middle = (lo + hi) // 2
            lo, hi = (middle, hi) if self.given(middle, name) <= n else (lo, middle)
        return lo

    def table(self, w: int, m: int, name: str) -> tuple[np.ndarray, np.ndarray]:
        """For sequences w .. w + m: what the queue has given before each, and what the queues ahead of it have given."""
        n = np.minimum((w + np.arange(m + 1)) * SIZE, self.tokens)
        ahead = np.zeros(m + 1, np.int64)
        for part, both, second in self.path(name):
            # The same without leaving 64 bits: exact at the first sequence, small steps from there.
            base, left = divmod(int(n[0]) * part + both // 2, both)
            half = base + (left + (n - n[0]) * part) // both
            ahead, n = (ahead + half, n - half) if second else (ahead, half)
        return n, ahead

    def borders(self, name: str, a: int, b: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(sequence, first token of the queue there, its offset there) of the sequences that hold a queue's tokens [a, b), both
        counted from the queue's first in this phase."""
        w = self.last_at(a, name)
        most = max(1, min(1024, 2**62 // (SIZE * self.sums[-1])))
        share = self.given(self.count, name) * 8 >= self.count  # else most sequences hold none of it
        while a < b:
            m = min(most, self.count - w) if share else 1
            n, ahead = self.table(w, m, name)
            held = np.flatnonzero((n[1:] > n[:-1]) & (n[1:] > a) & (n[:-1] < b))
            if len(held):
                yield self.first + w + held, n[held], np.diff(ahead)[held]
            a = max(a, int(n[-1]))
            w = w + m if share else self.last_at(a, name)


def planned(totals: dict[str, int], targets: dict[str, float] | None = None) -> list[Phase]:
    """The phases for the queues' token counts."""
    left = {s: n for s, n in sorted(totals.items()) if n > 0}
    if targets and (lacking := [s for s in left if targets.get(s, 0) <= 0]):
        raise ValueError(f"no target for {len(lacking)} sources, {lacking[0]!r} first")
    phases, low, first = [], dict.fromkeys(left, 0), 0
    sums = lambda shares: [0, *np.cumsum(np.array(shares, object)).tolist()]
    if targets and left:
        shares = [max(1, round(Fraction(targets[s]) / sum(Fraction(targets[x]) for x in left) * SCALE)) for s in left]
        total = sum(left.values())
        phase = Phase(0, total // SIZE, total, list(left), sums(shares), dict(low))
        count = min(phase.last_at(n, s) for s, n in left.items())
        if count:
            phase = Phase(0, count, count * SIZE, list(left), sums(shares), dict(low))
            low = {s: phase.given(count, s) for s in left}
            left = {s: n - low[s] for s, n in left.items() if n > low[s]}
            phases, first = [phase], count
    if total := sum(left.values()):
        phases.append(Phase(first, -(-total // SIZE), total, list(left), sums(list(left.values())), low))
    return phases


def cut(phases: list[Phase], name: str, starts: np.ndarray, end: int) -> tuple[np.ndarray, ...]:
    """Documents that follow each other in a queue, by the tokens of it before each, and where the last ends: their pieces, as
    (document, first token in the queue, length, sequence, offset there)."""
    a, out = int(starts[0]), []
    for p in phases:
        if name in p.low and name in p.names[(at := bisect_right(p.names, name) - 1) : at + 1]:
            low = p.low[name]
            high = low + p.given(p.count, name)
            for w, n, offset in p.borders(name, max(a, low) - low, min(end, high) - low):
                out.append((w, n + low, offset))
    w, n, offset = (np.concatenate(x) for x in zip(*out, strict=True))
    at = np.unique(np.concatenate([n[n > a], starts]))
    i, doc = np.searchsorted(n, at, "right") - 1, np.searchsorted(starts, at, "right") - 1
    return doc, at, np.diff(np.append(at, end)), w[i], offset[i] + at - n[i]


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, source, part, from_token (of this source in this partition), n_tokens and ids (little-endian, u16 if the vocabulary
    allows, else u32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder, at = TaskContext.get().partitionId(), json_encoder(tokenizer, "words"), {}
        width = 2 if encoder.type == "<u2" and end_id < 65_536 else 4
        end = end_id.to_bytes(width, "little")
        for batch in batches:
            for k in range(0, batch.num_rows, 2_500):
                b = batch.slice(k, 2_500)
                data = encoder.encode_column(b["text"], 4_000_000)
                data = [x + end for x in (data if width == int(encoder.type[-1]) else [np.frombuffer(x, encoder.type).astype("<u4").tobytes() for x in data])]
                sizes, starts = [len(x) // width for x in data], []
                for source, n in zip(b["source"].to_pylist(), sizes, strict=True):
                    starts.append(at.get(source, 0))
                    at[source] = starts[-1] + n
                columns = {"part": pa.array([part] * len(data), pa.int32()), "from_token": pa.array(starts, pa.int64()), "n_tokens": pa.array(sizes, pa.int64()), "ids": pa.array(data, pa.binary())}
                yield pa.record_batch({"doc_id": b["doc_id"], "source": b["source"]} | columns)

    # A null source gets a name that no other has, as the others are marked.
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")).alias("source"), "text")
    return named.mapInArrow(run, "doc_id long, source string, part int, from_token long, n_tokens long, ids binary")


def packed(docs: DataFrame, tokenizer: str, end_id: int = 1, targets: dict[str, float] | None = None, own: int = OWN) -> DataFrame:
    """One row per piece."""
    rows = saved(encoded(docs, tokenizer, end_id), "packing-ids")
    sums = saved(rows.groupBy("part", "source").agg(F.sum("n_tokens").alias("n")), "packing-sums")
    largest = sums.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "source").limit(own + 1).collect()
    queue = F.col("source")
    if targets is None and len(largest) > own:
        shared = F.concat(F.lit("~"), F.pmod(F.xxhash64("source"), F.lit(own)).cast("string"))
        queue = F.when(F.col("source").isin([r["source"] for r in largest[:own]]), F.col("source")).otherwise(shared)
    sums = sums.withColumn("queue", queue)
    before = F.sum("n").over(Window.partitionBy("queue").orderBy("part", "source").rowsBetween(Window.unboundedPreceding, -1))
    bases = saved(sums.select("part", "source", "queue", F.coalesce(before, F.lit(0)).alias("base"), "n"), "packing-bases")
    # One sum per queue: at most 2 * own, or as many as there are targets.
    totals = bases.groupBy("queue").agg(F.sum("n").alias("n"))
    if targets is not None and (odd := totals.where(~F.col("queue").isin([f"={s}" for s in targets])).limit(1).collect()):
        raise ValueError(f"no target for the source {odd[0]['queue']!r}")
    phases = planned({r["queue"]: r["n"] for r in totals.collect()}, None if targets is None else {f"={s}": v for s, v in targets.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            # Rows of a source and partition follow each other in their queue, and in a batch in the order of the partition.
            for (queue, source, _), rows in b.groupby(["queue", "source", "part"], sort=False):
                rows = rows.sort_values("at", kind="stable")
                starts, sizes = rows["at"].to_numpy(np.int64), rows["n_tokens"].to_numpy(np.int64)
                for lo, hi in runs(starts, sizes):
                    data = b"".join(rows["ids"].iloc[lo:hi])
                    n = int(sizes[lo:hi].sum())
                    ids = memoryview(np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype("<u4").tobytes())
                    doc, at, length, sequence, offset = cut(phases, queue, starts[lo:hi], int(starts[lo]) + n)
                    edges = (4 * (at - starts[lo])).tolist() + [4 * n]
                    yield pd.DataFrame({
                        "doc_id": rows["doc_id"].astype("Int64").array[lo:hi][doc], "start": at - starts[lo:hi][doc], "length": length,
                        "ids_crc32": [zlib.crc32(ids[x:y]) for x, y in zip(edges[:-1], edges[1:], strict=True)], "doc_tokens": sizes[lo:hi][doc],
                        "sequence_id": sequence, "offset": offset, "source": source[1:] if source[0] == "=" else None,
                    })

    placed = rows.join(bases, ["part", "source"]).select("doc_id", "part", "source", "queue", (F.col("from_token") + F.col("base")).alias("at"), "n_tokens", "ids")
    return placed.mapInPandas(run, PIECES)


def runs(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows that follow each other without a gap."""
    edges = [0, *(np.flatnonzero(starts[1:] != starts[:-1] + sizes[:-1]) + 1).tolist(), len(starts)]
    return zip(edges[:-1], edges[1:], strict=True)
