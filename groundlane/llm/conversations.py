"""Conversation structure repair: the cheapest edits that give each conversation the role pattern (s?(ua)+)? of initials.

Turns are taken in order of turn (nulls first, then by a digest of role and text). A row's first fault counts: blank (no character but
space and controls 9 to 13), duplicate (its role and text stand earlier in the conversation), truncated (its last such character is
none of .!?). Edits: Keep 0, Rerole to user or assistant 3, Delete 4, which blank and duplicate rows need, Insert an empty user or
assistant turn anywhere 3; a truncated row that stays adds 3. Among the cheapest the least string of initials (the audit) wins.

How: rows are range-partitioned, numbered within their conversation, and told apart by fault and initial, one letter each. Segments of
at most SEGMENT letters are dealt out by the hash of (conversation, segment). A recursive DuckDB query over each batch of them
advances one turn of all its segments at a time and keeps, for each grammar state at the segment's start and each state reached, the
least cost and audit. Segments of long conversations are then composed, at most FAN of them in a group, until one is left for each
conversation. This is exact: two audits of equal cost over the same rows are never prefixes of each other, as what follows the prefix
would be insertions, which cost; so the lesser stays the lesser whatever follows. A conversation of any length is spread over tasks;
its audit, a letter a turn, is one string as the result asks. The states that it passes name the way of each segment, and texts meet
these on (conversation, position), never by conversation.

Edge cases: nulls in role and text count as one space, a null conversation id is a conversation, null turns come first; a role that is
neither s, u nor a by its initial can be kept nowhere; equal rows are interchangeable, all but the first are duplicates; long texts
are only read where they stand; an empty table gives empty results; further columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import dropped, saved

SEGMENT, FAN = 256, 64
#: Costs of the edits, and what a truncated row adds that stays.
COSTS = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED = 3
INITIALS, FAULTS = "suax", ("", "truncated", "blank", "duplicate")
#: States: nothing yet, after s, after u, after a. MOVES[state][initial] is the next one.
MOVES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTED = (0, 3)
#: What a way over a segment is: from one state to another, at what cost, with which edits. `made` is what these make of the rows;
#: `states`, of a group of segments, the state after each of them, a digit each.
WAYS = "conv string, seg long, start int, state int, cost long, audit string, "


def letter(fault: int, initial: str) -> str:
    return chr(ord("A") + 4 * fault + INITIALS.index(initial))


def inserted(state: int) -> Iterator[tuple[int, str]]:
    """States that up to two insertions lead to, with the roles inserted; three lead nowhere that one doesn't."""
    yield state, ""
    for a in "ua":
        if a in MOVES[state]:
            yield MOVES[state][a], a.upper()
            for b in "ua":
                if b in MOVES[MOVES[state][a]]:
                    yield MOVES[MOVES[state][a]][b], (a + b).upper()


def edges() -> list[tuple[str, int, int, int, str, str]]:
    """(letter of a row, state, next state, cost, initials of the edits, what they make) of the best way over one row. What they make:
    U and A are insertions, u and a new roles, = the row as it is, - nothing."""
    best: dict[tuple[str, int, int], tuple[int, str, str]] = {}
    for fault, name in enumerate(FAULTS):
        for initial in INITIALS:
            for state in range(4):
                for at, roles in inserted(state):
                    ways = [("D", "-", at)]
                    if name not in ("blank", "duplicate"):
                        ways += [("K", "=", MOVES[at][initial])] if initial in MOVES[at] else []
                        ways += [("R", r, MOVES[at][r]) for r in "ua" if r in MOVES[at]]
                    for edit, made, to in ways:
                        cost = COSTS["I"] * len(roles) + COSTS[edit] + (TRUNCATED if name == "truncated" and edit != "D" else 0)
                        key, way = (letter(fault, initial), state, to), (cost, "I" * len(roles) + edit, roles + made)
                        best[key] = min(best.get(key, way), way)
    return [(*k, *v) for k, v in sorted(best.items())]


def endings() -> list[tuple[int, int, str, str]]:
    """(state, cost, initials, what they make) of the insertions that complete the pattern."""
    found = [min((COSTS["I"] * len(r), "I" * len(r), r) for at, r in inserted(s) if at in ACCEPTED) for s in range(4)]
    return [(s, *x) for s, x in enumerate(found)]


def faulty(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered rows: conv, pos (from 0 in each conversation), turn, role, text, key (a digest of role and text), initial, blank and
    truncated; and the written table that they are read from."""
    spark = rows.sparkSession
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in ("role", "text"))
    named = rows.select(conv_name(F.col("`conv_id`")).alias("conv"), F.col("`turn`").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    named = named.withColumn("key", F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))).withColumn("row", F.monotonically_increasing_id())
    order = ["conv", "turn", "key", "row"]
    ordered = named.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            conv = b["conv"].to_numpy(zero_copy_only=False)
            new = np.append(conv[0] != last, conv[1:] != conv[:-1])
            at, place = np.arange(len(conv)), np.arange(len(conv)) + n
            first = np.maximum.accumulate(np.where(new, at, -1))
            pos = np.where(first >= 0, at - first, place)
            last, n = conv[-1], int(pos[-1]) + 1
            yield pa.record_batch({**{c: b[c] for c in ("conv", "turn", "role", "text", "key")}, "part": pa.array([part] * len(conv), pa.int32()), "n": pa.array(pos, pa.int64())})

    placed = saved(ordered.mapInArrow(run, "conv string, turn long, role string, text string, key string, part int, n long"), "turns")
    before = F.sum("rows").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = placed.groupBy("conv", "part").agg(F.count("*").alias("rows"))
    # Only the first conversation of a partition can have begun in an earlier one: at most a row for each partition.
    base = sizes.select("conv", "part", before.alias("base")).where("base > 0")
    shown = F.rtrim("text", F.lit(" \t\n\x0b\f\r"))
    return placed.join(F.broadcast(base), ["conv", "part"], "left").select(
        "conv", (F.col("n") + F.coalesce("base", F.lit(0))).alias("pos"), "turn", "role", "text", "key",
        F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x").alias("initial"),
        (shown == "").alias("blank"), (~F.substring(shown, -1, 1).isin(".", "!", "?")).alias("truncated"),
    ), placed


def conv_name(conv_id: Column) -> Column:
    """A conversation's name as a string; a null id has one that no other has, as the others are marked."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit("null"))


def judged(rows: DataFrame) -> DataFrame:
    """conv, pos, turn, initial and code of every row: its first fault and initial as one letter."""
    narrow = rows.select("conv", "pos", "turn", "key", "initial", "blank", "truncated")
    first = narrow.groupBy("conv", "key").agg(F.min("pos").alias("pos")).select("conv", "pos", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), 2).when(F.col("first").isNull(), 3).when(F.col("truncated"), 1).otherwise(0)
    code = F.expr("char(ascii('A') + 4 * fault + locate(initial, 'suax') - 1)")
    # Joined on places, which are all different, so that a row repeated without end burdens no task.
    return narrow.join(first, ["conv", "pos"], "left").withColumn("fault", fault).select("conv", "pos", "turn", "initial", "fault", code.alias("code"))


def segments(rows: DataFrame, size: int) -> DataFrame:
    """conv, seg, codes, and illegal: the pairs of neighbours, the next segment's first row included, that aren't su, ua or au."""
    seg = F.expr(f"pos div {size}")
    also = F.when((F.col("pos") % size == 0) & (F.col("pos") > 0), F.array(seg, seg - 1)).otherwise(F.array(seg))
    each = rows.select("conv", "pos", "code", "initial", F.explode(also).alias("seg"))
    held = each.groupBy("conv", "seg").agg(F.sort_array(F.collect_list(F.struct("pos", "code", "initial"))).alias("x"))
    return held.select(
        "conv", "seg", F.expr(f"array_join(transform(filter(x, r -> r.pos < (seg + 1) * {size}), r -> r.code), '')").alias("codes"),
        F.expr("IF(size(x) < 2, 0L, cast(size(filter(sequence(1, greatest(size(x) - 1, 1)), i -> concat(x[i - 1].initial, x[i].initial) NOT IN ('su', 'ua', 'au'))) as long))").alias("illegal"),
    )


#: One turn further for all segments of a batch at once.
ADVANCE = """
WITH RECURSIVE walk AS (
  SELECT id, codes, 0 AS i, start, start AS state, 0::BIGINT AS cost, '' AS audit, '' AS made
  FROM batch, (VALUES (0), (1), (2), (3)) s(start) WHERE start = 0 OR seg > 0
  UNION ALL
  SELECT id, codes, i, start, state, best.cost, best.audit, best.made FROM (
    SELECT id, any_value(codes) AS codes, i + 1 AS i, start, dst AS state,
      min({'cost': w.cost + e.cost, 'audit': audit || edits, 'made': made || makes}) AS best
    FROM walk w JOIN edge e ON e.code = substr(codes, i + 1, 1) AND e.src = w.state
    WHERE i < length(codes) GROUP BY id, i, start, dst)
)
SELECT id, start, state, cost, audit, made FROM walk WHERE i = length(codes)"""
#: One segment further for all groups of segments of a batch.
COMPOSE = """
WITH RECURSIVE step AS MATERIALIZED (SELECT id, n, unnest(steps, recursive := true) FROM batch),
walk AS (
  SELECT id, n, 0 AS place, b AS origin, b AS now, 0::BIGINT AS spent, '' AS edits, '' AS passed
  FROM (SELECT DISTINCT id, n, start AS b FROM step WHERE i = 0)
  UNION ALL
  SELECT id, n, place, origin, now, best.cost, best.audit, best.states FROM (
    SELECT w.id, w.n, w.place + 1 AS place, w.origin, s.state AS now,
      min({'cost': spent + cost, 'audit': edits || audit, 'states': passed || states}) AS best
    FROM walk w JOIN step s ON s.id = w.id AND s.i = w.place AND s.start = w.now WHERE w.place < w.n GROUP BY w.id, w.n, w.place, w.origin, s.state)
)
SELECT id, origin AS start, now AS state, spent AS cost, edits AS audit, passed AS states FROM walk WHERE place = n"""


def recursed(rows: DataFrame, query: str, columns: list[str], last: str) -> DataFrame:
    """The ways that a recursive query finds in each batch of rows (conv, seg and `columns`), with their `last` column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "temp_directory": "", "memory_limit": "1GB"}) as db:
            db.execute("CREATE TABLE edge (code VARCHAR, src INTEGER, dst INTEGER, cost BIGINT, edits VARCHAR, makes VARCHAR)")
            db.executemany("INSERT INTO edge VALUES (?, ?, ?, ?, ?, ?)", edges())
            for whole in batches:
                for k in range(0, whole.num_rows, 2_000):
                    b = whole.slice(k, 2_000)
                    db.register("batch", pa.table({"id": pa.array(np.arange(b.num_rows), pa.int64()), **{c: b[c] for c in ("seg", *columns)}}))
                    out = db.sql(query).to_arrow_table()
                    db.unregister("batch")
                    at = out["id"].combine_chunks()
                    names = {"conv": b["conv"].take(at), "seg": b["seg"].take(at)}
                    found = {c: out[c].combine_chunks().cast(t) for c, t in (("start", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), (last, pa.string()))}
                    yield pa.record_batch(names | found)

    return rows.select("conv", "seg", *columns).mapInArrow(run, f"{WAYS}{last} string")


@dataclass(frozen=True)
class Repairs:
    """`audits`: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, states and tail (roles inserted at the end) of each
    conversation. `ways`: those of each segment. `rows`: the numbered rows. `held`: the written tables that all are read from."""

    audits: DataFrame
    ways: DataFrame
    rows: DataFrame
    size: int
    held: list[DataFrame]


def repairs(rows: DataFrame, size: int = SEGMENT, fan: int = FAN) -> Repairs:
    numbered, turns = faulty(rows)
    marked = saved(judged(numbered), "faults")
    cut = saved(segments(marked, size), "segments")
    ways = saved(recursed(cut, ADVANCE, ["codes"], "made"), "ways")
    walks = ways.select("conv", "seg", "start", "state", "cost", "audit", F.col("state").cast("string").alias("states"))
    made = []
    while not walks.where("seg > 0").isEmpty():
        steps = F.struct((F.col("seg") % fan).alias("i"), "start", "state", "cost", "audit", "states")
        groups = walks.groupBy("conv", F.expr(f"seg div {fan}").alias("seg")).agg((F.max(F.col("seg") % fan) + 1).alias("n"), F.collect_list(steps).alias("steps"))
        walks = saved(recursed(groups, COMPOSE, ["n", "steps"], "states"), "walks")
        dropped(*made)
        made = [walks]
    cost, edits, tail = (F.element_at(F.create_map(*[y for x in endings() for y in (F.lit(x[0]), F.lit(x[k]))]), F.col("state")) for k in (1, 2, 3))
    end = F.struct((F.col("cost") + cost).alias("cost"), F.concat("audit", edits).alias("audit"), "states", tail.alias("tail"))
    best = walks.groupBy("conv").agg(F.min(end).alias("best"))
    counts = marked.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(F.expr(f"IF(fault = {k}, 1L, 0L)")).alias(name) for k, name in enumerate(FAULTS) if k],
    )
    illegal = cut.groupBy("conv").agg(F.sum("illegal").alias("illegal"))
    out = saved(counts.join(illegal, "conv").join(best, "conv").select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "best.*"), "audits")
    dropped(marked, cut, *made)
    return Repairs(out, ways, numbered, size, [out, ways, turns])


def repaired(r: Repairs) -> DataFrame:
    """conv, pos, k, role and text of the repaired conversations' turns, in order of pos and k. The states that a conversation passes
    name the way of each of its segments, so that no row holds more of what is made than a segment's."""
    digits = lambda c: F.split(c, "(?<=.)(?=.)")
    both = F.arrays_zip(digits(F.concat(F.lit("0"), "states")).alias("start"), digits(F.col("states")).alias("state"))
    passed = r.audits.select("conv", F.posexplode(both).alias("seg", "s")).where("s.state IS NOT NULL")
    passed = passed.select("conv", F.col("seg").cast("long").alias("seg"), F.col("s.start").cast("int").alias("start"), F.col("s.state").cast("int").alias("state"))
    own = r.ways.join(passed, ["conv", "seg", "start", "state"]).select("conv", "seg", F.posexplode(F.expr("regexp_extract_all(made, '[UA]*[ua=-]', 0)")).alias("place", "way"))
    tails = r.audits.where("tail <> ''").select("conv", F.lit(2**62).alias("pos"), F.col("tail").alias("way"))
    ways = own.select("conv", (F.col("seg") * r.size + F.col("place")).alias("pos"), "way").where("way <> '-'").unionAll(tails)
    both = ways.join(r.rows.select("conv", "pos", "role", "text"), ["conv", "pos"], "left")
    turns = both.select("conv", "pos", "text", "role", F.posexplode(F.split("way", "(?<=.)(?=.)")).alias("k", "sign")).where("sign <> '-'")
    name = F.when(F.lower("sign") == "u", "user").when(F.lower("sign") == "a", "assistant").otherwise(F.col("role"))
    return turns.select("conv", "pos", "k", name.alias("role"), F.when(F.col("sign").isin("U", "A"), "").otherwise(F.col("text")).alias("text"))


def digests(turns: DataFrame) -> DataFrame:
    """conv and the SHA-256 of its turns as role:text, joined by line ends. The hash is a chain, so a conversation passes through one
    task, which holds a batch of it at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for b in batches:
            names, found = [], []
            for conv, role, text in zip(*(b[c].to_pylist() for c in ("conv", "role", "text")), strict=True):
                if conv != last:
                    if state:
                        names.append(last)
                        found.append(state.hexdigest())
                    last, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield pa.record_batch({"conv": pa.array(names, pa.string()), "repaired_sha256": pa.array(found, pa.string())})
        if state:
            yield pa.record_batch({"conv": pa.array([last]), "repaired_sha256": pa.array([state.hexdigest()])})

    dealt = turns.repartition("conv").sortWithinPartitions("conv", "pos", "k")
    return dealt.mapInArrow(run, "conv string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with planted faults by crc32 of conv_id:turn modulo 20: 0 drops a row, 1 empties its text, 2 takes its .!? away, 3 repeats
    it, 4 makes its role user."""
    space = F.lit(" ")
    conv, turn, role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), space) for c in ("conv_id", "turn", "role", "text"))
    hit = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    kept = rows.select("`conv_id`", "`turn`", role.alias("role"), text.alias("text"), hit.alias("hit")).where("hit <> 0")
    return kept.select(
        "conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("hit") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def report(originals: DataFrame, rows: DataFrame, size: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """A row for every conv_id of `originals`: what was wrong in `rows`, the repair's cost and audit, and the digest of the result."""
    found = repairs(rows, size, fan)
    ids = originals.select(F.col("`conv_id`").alias("conv_id")).distinct().withColumn("conv", conv_name(F.col("conv_id")))
    whole = saved(ids.join(found.audits.drop("states", "tail"), "conv", "left").join(digests(repaired(found)), "conv", "left"), "repairs")
    dropped(*found.held)
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
