"""Best-fit packing in bulk-synchronous rounds: documents into as few sequences of CAPACITY tokens as best fit finds.

A document of more tokens than a sequence holds is cut; its first piece takes the rest, the others fill a sequence each. Pieces of
more than half a sequence open one, as no two of them fit together. Then, until every piece has its place, a round
1. sorts pieces and gaps (open sequences by the space left) into ranges from large to small, a gap ahead of pieces of its size;
2. sweeps each range once: a piece takes the least gap that fits (its successor), whose rest is a gap again;
3. resolves what ranges leave: pieces that found no gap and gaps as large as any piece of later ranges stand in the order of their
   sizes, by rank. The ranges' counts tell which pieces take which gaps of ranges ahead: the smallest first, one piece a gap;
4. updates the gaps and drops those that no piece left can fill;
5. where hardly any piece found a gap, opens sequences: of the largest pieces left as many by rank as surely fit together, for as many
   sequences as the tokens left fill.
Only keys, sizes and places move; token ids stay where texts are read. The driver holds a row of counts for each range. A round is two
written tables, so that a lost executor costs no earlier round.

Edge cases: null and empty texts hold the end id alone; rows that share a doc_id are packed each, a null one too; equal sizes go by
their order of reading; an empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import dropped, saved
from .tokenbin import serialiser

CAPACITY, RANGE_ROWS = 1024, 100_000
STATE = "key long, size int, gap boolean, sequence_id long, offset int"


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """key (of the piece), doc_id, piece, start, length and ids_crc32 of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, (serialised, width) = TaskContext.get().partitionId() << 36, serialiser(tokenizer, end_id)
        for whole in batches:
            for k in range(0, whole.num_rows, 5_000):
                b, rows = whole.slice(k, 5_000), []
                for i, data in enumerate(serialised(b["text"])):
                    ids = memoryview(np.frombuffer(data, f"<u{width}").astype("<u4").tobytes())
                    n = len(ids) // 4
                    edges = [0, *range(n % capacity or capacity, n, capacity), n]
                    rows += [(i, j, x, y - x, zlib.crc32(ids[4 * x : 4 * y])) for j, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
                i, *columns = np.array(rows, np.int64).reshape(-1, 5).T
                names = ("piece", "start", "length", "ids_crc32")
                yield pa.record_batch({"key": pa.array(np.arange(len(i)) + key), "doc_id": b["doc_id"].take(pa.array(i)), **dict(zip(names, map(pa.array, columns), strict=True))})
                key += len(i)

    rows = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
    return rows.mapInArrow(run, "key long, doc_id long, piece long, start long, length long, ids_crc32 long")


def swept(state: DataFrame, parts: int, capacity: int) -> DataFrame:
    """The rows of STATE after a sweep of each range, with part and, of what the ranges leave to each other, rank: pieces from the
    largest on, gaps from the largest on. Placed pieces have a sequence_id."""
    order = [F.desc("size"), F.desc("gap"), F.asc("key")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, lowest, n_left = TaskContext.get().partitionId(), capacity, 0
        # Gaps by the space left, and which spaces occur, as the bits of one number.
        gaps: list[list[int]] = [[] for _ in range(capacity + 1)]
        there = 0

        def told(rows: list[tuple]) -> pa.RecordBatch:
            names = ("key", "size", "gap", "sequence_id", "offset", "rank")
            types = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [()] * 6
            return pa.record_batch({"part": pa.array([part] * len(rows), pa.int32()), **{n: pa.array(c, t) for n, c, t in zip(names, columns, types, strict=True)}})

        for b in batches:
            rows = []
            for key, size, gap in zip(*(b[c].to_pylist() for c in ("key", "size", "gap")), strict=True):
                lowest = size
                if gap:
                    gaps[size].append(key)
                    there |= 1 << size
                    continue
                fit = there >> size
                if not fit:
                    rows.append((key, size, False, None, None, n_left))
                    n_left += 1
                    continue
                free = size + (fit & -fit).bit_length() - 1
                sequence = gaps[free].pop()
                if not gaps[free]:
                    there ^= 1 << free
                rows.append((key, size, False, sequence, capacity - free, None))
                if left := free - size:
                    gaps[left].append(sequence)
                    there |= 1 << left
            yield told(rows)
        rest, n = [], 0
        for free in range(capacity, 0, -1):
            for key in gaps[free]:
                rest.append((key, free, True, None, None, n if free >= lowest else None))
                n += 1
        for k in range(0, len(rest), 10_000):
            yield told(rest[k : k + 10_000])

    sorted_in = state.select("key", "size", "gap").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return sorted_in.mapInArrow(run, f"part int, {STATE}, rank long")


def crossing(counts: list) -> tuple[list[tuple], dict[int, int]]:
    """Which pieces that ranges left take which gaps of ranges ahead: (piece's part, its first rank, number, gap's part, its last rank,
    first match number), and how many pieces of each part are matched."""
    open_gaps, runs, matched, base = [], [], {}, 0
    for part, pieces, gaps in counts:
        rank = 0
        while rank < pieces and open_gaps:
            ahead, left = open_gaps.pop()
            n = min(pieces - rank, left)
            runs.append((part, rank, n, ahead, left - 1, base))
            rank, base = rank + n, base + n
            if left > n:
                open_gaps.append((ahead, left - n))
        matched[part] = rank
        if gaps:
            open_gaps.append((part, gaps))
    return runs, matched


def crossed(rows: DataFrame, runs: list[tuple], capacity: int) -> DataFrame:
    """The rows of a sweep with the matches between ranges carried out."""
    spark = rows.sparkSession
    plan = F.broadcast(spark.createDataFrame(runs, "piece_part int, first long, n long, gap_part int, last long, base long"))
    left = rows.where("sequence_id IS NULL")
    ranks = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))
    pieces = left.where("NOT gap").join(plan, (F.col("part") == F.col("piece_part")) & ranks, "left")
    ranks = (F.col("rank") <= F.col("last")) & (F.col("rank") > F.col("last") - F.col("n"))
    gaps = left.where("gap").join(plan, (F.col("part") == F.col("gap_part")) & ranks, "left")
    number = lambda df, m: df.select("part", "key", "size", "gap", "rank", m.alias("m"))
    both = number(pieces, F.col("base") + F.col("rank") - F.col("first")).unionAll(number(gaps, F.col("base") + F.col("last") - F.col("rank")))
    alone = both.where("m IS NULL").select("part", "key", "size", "gap", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("int").alias("offset"), "rank")
    met = both.where("m IS NOT NULL AND NOT gap").select("m", "part", "key", "size").join(both.where("m IS NOT NULL AND gap").select("m", F.col("key").alias("sequence_id"), F.col("size").alias("free")), "m")
    row = "named_struct('key', {}, 'size', {}, 'gap', {}, 'sequence_id', {}, 'offset', {})"
    placed = row.format("key", "size", "false", "sequence_id", f"cast({capacity} - free AS int)")
    rest = row.format("sequence_id", "free - size", "true", "cast(NULL AS bigint)", "cast(NULL AS int)")
    made = met.select("part", F.expr(f"inline(array({placed}, {rest}))"), F.lit(None).cast("long").alias("rank"))
    return alone.unionAll(made.where("NOT gap OR size > 0"))


def opened(rows: DataFrame, before: dict[int, int], per: int, sequences: int, capacity: int) -> DataFrame:
    """The rows after the largest pieces left, `per` by rank for each of `sequences`, have opened these. `before`: what to add to the
    ranks of a part to number all pieces left from 0."""
    spark = rows.sparkSession
    base = F.broadcast(spark.createDataFrame(sorted(before.items()), "part int, more long"))
    numbered = rows.where("NOT gap AND sequence_id IS NULL").join(base, "part").withColumn("group", F.expr(f"(rank + more) div {per}"))
    sequence, stay = Window.partitionBy("group").orderBy(F.col("rank") + F.col("more")), F.col("group") >= sequences
    held = numbered.where(~stay).select("part", "key", "size", "rank", F.first("key").over(sequence).alias("sequence_id"), F.sum("size").over(sequence).alias("end"), F.lead("key").over(sequence).isNull().alias("ends"))
    placed = held.select("part", "key", "size", F.lit(False).alias("gap"), "sequence_id", (F.col("end") - F.col("size")).cast("int").alias("offset"), "rank")
    gaps = held.where(F.col("ends") & (F.col("end") < capacity)).select("part", F.col("sequence_id").alias("key"), (capacity - F.col("end")).cast("int").alias("size"), F.lit(True), F.lit(None).cast("long"), F.lit(None).cast("int"), "rank")
    others = rows.where("gap OR sequence_id IS NOT NULL").unionAll(numbered.where(stay).select(*rows.columns))
    return others.unionAll(placed).unionAll(gaps)


def best_fit(items: DataFrame, capacity: int = CAPACITY, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, list[DataFrame]]:
    """key, sequence_id and offset of every item (key, size from 1 to capacity), and the written tables that they are read from. A
    sequence is named by the key of the item that opened it."""
    spark = items.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    large = F.col("size") * 2 > capacity
    done = [items.where(large).select("key", F.col("key").alias("sequence_id"), F.lit(0).alias("offset"))]
    state, held = items.where(F.col("size") < capacity).select("key", F.when(large, capacity - F.col("size")).otherwise(F.col("size")).cast("int").alias("size"), large.alias("gap")), []
    facts = items.agg(F.count("*").alias("n"), F.sum(F.expr(f"IF(size * 2 > {capacity}, 0L, 1L)")).alias("pieces"), F.min("size").alias("least")).first()
    n, pieces, least = facts["n"], facts["pieces"] or 0, facts["least"]
    while pieces:
        rows = saved(swept(state.where(~F.col("gap") | (F.col("size") >= least)), min(most, -(-n // range_rows)), capacity), "best-fit-sweep")
        per_part = rows.groupBy("part").agg(
            F.count_if(F.expr("NOT gap AND sequence_id IS NULL")).alias("left"), F.count_if(F.expr("gap AND rank IS NOT NULL")).alias("open"),
            F.sum(F.expr("IF(NOT gap AND sequence_id IS NULL, size, 0L)")).alias("tokens"), F.min(F.expr("IF(NOT gap AND sequence_id IS NULL, size, NULL)")).alias("least"),
            F.max(F.expr("IF(NOT gap AND sequence_id IS NULL, size, NULL)")).alias("largest"), F.count_if("gap").alias("gaps"),
        ).orderBy("part").collect()
        runs, matched = crossing([(r["part"], r["left"], r["open"]) for r in per_part])
        left = sum(r["left"] for r in per_part)
        unmatched = left - sum(matched.values())
        held.append(rows)
        done.append(rows.where("sequence_id IS NOT NULL").select("key", "sequence_id", "offset"))
        after = crossed(rows, runs, capacity) if runs else rows.where("sequence_id IS NULL")
        if (pieces - unmatched) * 50 < pieces:
            before, at = {}, 0
            for r in per_part:
                before[r["part"]] = at - matched[r["part"]]
                at += r["left"] - matched[r["part"]]
            per = capacity // max(r["largest"] for r in per_part if r["left"] > matched[r["part"]])
            sequences = -(-sum(r["tokens"] for r in per_part) * unmatched // left // capacity)
            after = opened(after, before, per, sequences, capacity)
            unmatched -= min(unmatched, per * sequences)
        if runs or unmatched < left:
            after = saved(after, "best-fit-round")
            held.append(after)
            done.append(after.where("sequence_id IS NOT NULL").select("key", "sequence_id", "offset"))
        state = after.where("sequence_id IS NULL")
        pieces, n, least = unmatched, unmatched + sum(r["gaps"] for r in per_part), min((r["least"] for r in per_part if r["least"]), default=1)
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out, held


def packed(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece, as a written table."""
    pieces = saved(cut(docs, tokenizer, end_id, capacity), "best-fit-pieces")
    places, held = best_fit(pieces.select("key", F.col("length").cast("int").alias("size")), capacity, range_rows)
    out = pieces.join(places, "key").select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"))
    whole = saved(out, "best-fit")
    dropped(pieces, *held)
    return whole
