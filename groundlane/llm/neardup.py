"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets and star-shaped candidate edges.

1. Each text gives its set of 5-word shingles as 64-bit hashes. One hash per shingle serves all 128 bins: the leading bits choose the
   bin, the least hash in it is the bin's value. An empty bin copies the bin that a fixed random sequence of its own reaches first
   (optimal densification). 32 bands of 4 bins become bucket keys.
2. Equal sets collapse to one node before anything else, so a copy group of any size is one node from here on.
3. A bucket gives edges from one hub to its other members: the member that shares most buckets with others, as the original of a
   family does. So these pairs grow with bucket sizes, not with their squares.
4. What that leaves apart is swept exactly. Members of buckets that still hold more than one component are listed under their rarest
   shingles (prefix filter): of n shingles, ordered by how many members have them, the first n - ceil(s n) + 1 as the longer of two
   sets and the first n - ceil(2 s n / (1 + s)) + 1 as the shorter. The first shingle that two sets at similarity s share is among
   both. Lists without a row of a shorter set go; within the others, stars go on while they link; then every pair of a shorter and
   a longer set of different components that sizes and places allow is taken, in blocks of members against members.
5. Each pair is confirmed on the full shingle sets. Components are the smallest label over confirmed links.

Chance: two sets at similarity s share no bucket with probability (1 - s**4) ** 32: under 1e-10 at 0.85, 5e-8 at 0.8. No other step
can lose a link. The sweep is exact for any input; its cost is bounded by the pairs that sizes and places allow, which is quadratic
only for texts that are all nearly similar and not similar.

`percent` is the similarity in hundredths: 80 is the default, op8's contract has 85.
Edge cases: null and blank texts have no shingles and are linked with nothing; fewer words than five are one shingle; a null doc_id
is linked with nothing and kept; rows that share a doc_id but not their set are documents of their own under that id; ties go to the
smallest doc_id; empty tables give empty results; other columns are ignored whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import WordHashes, dropped, light, mixed, nested, saved, unnested, window_hashes

SHINGLE, BINS, BANDS, PERCENT, BLOCK = 5, 128, 32, 80, 1000
ROWS = BINS // BANDS
SET = ["set_a", "set_b", "n_shingles"]


def probes(tries: int = 64) -> np.ndarray:
    """For each bin, the bins that it looks at when it is empty, in order."""
    at = np.arange(BINS * tries, dtype=np.uint64).reshape(BINS, tries)
    return (mixed(at + np.uint64(0xA5A5A5A5)) % np.uint64(BINS)).astype(np.int64)


PROBES = probes()


def shingles(text: str | None, known: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes.lower() touches A-Z only
    return np.unique(window_hashes(known.of(words), SHINGLE))


def set_name(hashes: np.ndarray) -> tuple[int, int]:
    """Two numbers that equal sets share: with the size, 128 bits and more tell sets apart."""
    x = np.array([hashes.sum(dtype=np.uint64), np.bitwise_xor.reduce(mixed(hashes + np.uint64(1))) if len(hashes) else 0], np.uint64)
    return tuple(x.view(np.int64).tolist())


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One bucket key per band of a non-empty sorted set."""
    edges = np.searchsorted(hashes, np.arange(BINS, dtype=np.uint64) << np.uint64(64 - 7))
    full = np.diff(np.append(edges, len(hashes))) > 0
    value = np.zeros(BINS, np.uint64)
    value[full] = hashes[edges[full]]
    empty = np.flatnonzero(~full)
    if len(empty):
        seen = full[PROBES[empty]]
        first, filled = seen.argmax(1), np.flatnonzero(full)
        source = np.where(seen.any(1), PROBES[empty, first], filled[empty % len(filled)])
        value[empty] = mixed(value[source])
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + value.reshape(BANDS, ROWS)[:, r])
    return key


def sliced(batches: Iterator[pd.DataFrame], rows: int = 2_000) -> Iterator[pd.DataFrame]:
    """Smaller batches: the sets of one are held at a time."""
    for b in batches:
        for k in range(0, len(b), rows):
            yield b.iloc[k : k + rows]


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, the set's name and size, and its bucket keys, of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for b in sliced(batches):
            sets = [shingles(t, known) for t in b["text"]]
            names = [set_name(h) for h in sets]
            keys = [band_keys(h).view(np.int64) if len(h) else np.empty(0, np.int64) for h in sets]
            yield pd.DataFrame({"doc_id": b["doc_id"], "text_hash": b["text_hash"], "set_a": [a for a, _ in names], "set_b": [c for _, c in names], "n_shingles": [len(h) for h in sets], "keys": keys})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInPandas(run, "doc_id long, text_hash long, set_a long, set_b long, n_shingles long, keys array<long>")


def shingle_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and its full set, for a written table of nodes (node, doc, set_a); texts move only if the nodes are many."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for b in sliced(batches):
            sets = [shingles(t, known) for t in b["text"]]
            right = np.array([set_name(h)[0] for h in sets], np.int64) == b["set_a"].to_numpy(np.int64)  # a doc_id may have other texts
            yield pd.DataFrame({"node": b["node"], "shingles": [h.view(np.int64) for h in sets]})[right]

    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(light(nodes), "doc").select("node", "set_a", "text")
    sets = saved(texts.mapInPandas(run, "node long, shingles array<long>"), "sets")
    if sets.groupBy("node").count().where("count > 1").isEmpty():
        return sets
    once = saved(sets.dropDuplicates(["node"]), "sets")  # of repeated rows
    dropped(sets)
    return once


def components(links: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """node, component (the smallest node reachable) over undirected links (a, b): labels flow along links and then jump to their
    own label's label, so rounds grow with the logarithm of the longest chain. Each round is a written table."""
    both = saved(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component"))
    if start is not None:
        labels = labels.union(start).groupBy("node").agg(F.min("component").alias("component"))
    table = saved(labels, "labels")
    while True:
        labels = table.select("node", "component")
        near = both.join(labels.withColumnRenamed("node", "a"), "a").groupBy("b").agg(F.min("component").alias("near"))
        flowed = labels.join(near.withColumnRenamed("b", "node"), "node", "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("via"))
        far = labels.select(F.col("node").alias("via"), F.col("component").alias("far"))
        after = saved(flowed.join(far, "via", "left").select("node", "old", F.least("via", "far").alias("component")), "labels")
        dropped(table)
        table = after
        if after.where("component <> old").isEmpty():
            dropped(both)
            return after.select("node", "component")


def grouped(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of every row: doc_id, text_hash, n_shingles, component (a node; null where nothing can be linked) and component_id."""
    sigs = saved(signatures(docs), "signatures")
    able = sigs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # Written, so that the last join exchanges both sides: a hot set's rows are dealt by doc_id here and can be split there.
    copies = saved(able.groupBy(*SET).agg(F.min("doc_id").alias("doc"), F.any_value("keys").alias("keys")), "copies")
    # A node is named by its smallest doc_id, but for the sets that share it with another set: they take a hash.
    clash = saved(copies.groupBy("doc").agg(F.count("*").alias("n"), F.min(F.struct(*SET)).alias("first")).where("n > 1").select("doc", "first"), "clashes")
    node = F.when(F.col("first").isNull() | (F.col("first") == F.struct(*SET)), F.col("doc")).otherwise(F.xxhash64(*SET, "doc"))
    nodes = copies.join(light(clash), "doc", "left").withColumn("node", node).drop("first")

    buckets = nodes.select("node", F.col("n_shingles").alias("size"), F.explode("keys").alias("key"))
    many = saved(buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
    shared = saved(buckets.join(light(many), "key"), "buckets")
    # Popularity: with how many a node shares buckets, over all its buckets.
    popular = saved(shared.groupBy("node").agg(F.sum("n").alias("popularity")), "popularity")
    rated = saved(shared.join(light(popular), "node").select("key", "node", "size", "popularity"), "rated")
    wanted = saved(nodes.select("node", "doc", "set_a").join(light(popular.select("node")), "node"), "wanted")
    dropped(many, shared)
    sets = shingle_sets(docs, wanted)
    labels = linked(rated, sets, percent)
    dropped(rated, sets, popular)

    heads = labels.join(light(wanted.select("node", "doc")), "node").groupBy("component").agg(F.min("doc").alias("component_id"))
    headed = saved(labels.join(heads, "component"), "components")
    dropped(wanted)
    # Labels meet the distinct sets first; the rows, of which a third may share one set, come last and are narrow.
    final = nodes.join(light(headed), "node", "left").select(*SET, F.coalesce("component", "node").alias("component"), F.coalesce("component_id", "doc").alias("component_id"))
    rows = sigs.select("doc_id", "text_hash", *SET)
    placed = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").join(final, SET).select("doc_id", "text_hash", "n_shingles", "component", "component_id")
    alone = rows.where("NOT (n_shingles > 0 AND doc_id IS NOT NULL)")
    return placed.union(alone.select("doc_id", "text_hash", "n_shingles", F.lit(None).cast("long"), "doc_id"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    out = grouped(docs, percent).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def linked(rated: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node and component of all that are linked: stars of the buckets, then the sweep of what they leave apart."""
    hub = rated.groupBy("key").agg(F.max(F.struct("popularity", (-F.col("node")).alias("_n"), "size")).alias("h")).select("key", (-F.col("h._n")).alias("hub"), F.col("h.size").alias("hub_size"))
    links = confirmed(star(rated, hub, percent), sets, percent)
    labels = components(links)
    unsettled = saved(several(labelled(rated, labels)).select("node").distinct(), "unsettled")
    lists = rare_lists(sets.join(light(unsettled), "node", "left_semi"), percent)
    turn = 0
    while True:
        placed = saved(several(labelled(lists, labels), F.max("index")), "placed")
        # The first hub of a list is the one that shares most lists with others, further ones are drawn anew in each list.
        order = F.col("popularity") if turn == 0 else F.xxhash64("node", "key", F.lit(turn))
        hub = placed.groupBy("key").agg(F.max(F.struct(order.alias("o"), (-F.col("node")).alias("_n"), "size", "at", "component")).alias("h"))
        hub = hub.select("key", (-F.col("h._n")).alias("hub"), F.col("h.size").alias("hub_size"), F.col("h.at").alias("hub_at"), F.col("h.component").alias("hub_component"))
        found = confirmed(star(placed, hub, percent, apart=True), sets, percent)
        if found.isEmpty():
            break
        turn += 1
        links = links.union(found)
        labels = components(links, labels)
        dropped(placed)
    found = confirmed(crossed(placed, percent), sets, percent)
    dropped(placed, lists, unsettled)
    return labels if found.isEmpty() else components(links.union(found), labels)


def labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def several(placed: DataFrame, able: Column | None = None) -> DataFrame:
    """The members of keys that hold more than one component and for which `able` holds."""
    keys = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), (F.lit(True) if able is None else able).alias("able")).where("lo < hi AND able")
    return placed.join(keys.select("key"), "key")


def rare_lists(sets: DataFrame, percent: int) -> DataFrame:
    """key (a shingle), node, size, at (its place in the node's order from rare to common), index and popularity; shingles of one node
    alone take their places and give no row.

    Two similar sets share at least percent / (100 + percent) of both sizes together. So at the first shingle that they share, as much
    is left of the shorter one as 2 * percent / (100 + percent) of its size, and of the longer one percent / 100: rows that could be
    the shorter set's are `index`, and the others are there for index rows to meet."""
    each = sets.select("node", F.size("shingles").alias("size"), F.explode("shingles").alias("key"))
    known = saved(each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shingle-counts")
    ordered = each.join(light(known), "key").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("common"))
    placed = ordered.select("node", "size", F.size("common").alias("_c"), F.posexplode("common").alias("_p", "_s"))
    placed = placed.select(F.col("_s.key").alias("key"), "node", "size", (F.col("size") - F.col("_c") + F.col("_p")).alias("at"), F.col("_s.n").alias("n"))
    left = F.col("size") - F.col("at")
    first = saved(placed.where(left * 100 >= F.col("size") * percent).withColumn("index", left * (100 + percent) >= F.col("size") * (2 * percent)), "prefixes")
    lists = saved(first.join(first.groupBy("node").agg(F.sum("n").alias("popularity")), "node").select("key", "node", "size", "at", "index", "popularity"), "lists")
    dropped(known, first)
    return lists


def long_enough(size: str, at: str, other_size: str, other_at: str, percent: int) -> Column:
    """Whether sets that share no shingle before these places can still be similar: what is left of the shorter holds the intersection."""
    return F.least(F.col(size) - F.col(at), F.col(other_size) - F.col(other_at)) * (100 + percent) >= (F.col(size) + F.col(other_size)) * percent


def sized(size: str, other_size: str, percent: int) -> Column:
    return F.least(size, other_size) * 100 >= F.greatest(size, other_size) * percent


def star(members: DataFrame, hubs: DataFrame, percent: int, apart: bool = False) -> DataFrame:
    """Distinct pairs (hub, node) whose sizes allow the similarity; `apart`: of lists, and only between components."""
    pairs = members.join(hubs, "key").where("node <> hub")
    if apart:
        pairs = pairs.where("component <> hub_component").where(long_enough("size", "at", "hub_size", "hub_at", percent))
    return pairs.where(sized("size", "hub_size", percent)).select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()


def crossed(placed: DataFrame, percent: int) -> DataFrame:
    """All distinct pairs (a, b) that share a list, are of different components and may be similar: an index row of the shorter set
    with a row of the longer one.

    Sizes fall into classes, of which similar sets have the same or the next, and lists are taken apart by the class of the shorter.
    In each part the component with most members never meets itself, so that one large component costs no more than its meetings
    with others. What still has more than BLOCK members is cut into blocks, and each two blocks meet in a cell of their own: no
    task holds a whole crowded list."""
    step = math.log(100 / percent * 1.000001)  # a little over the ratio, so that rounding can't part what may be similar
    group = F.floor(F.log("size") / step)
    shorter = placed.where("index").select("key", group.alias("class"), "node", "size", "at", "component", F.lit(True).alias("short"))
    longer = placed.select("key", F.explode(F.array(group, group - 1)).alias("class"), "node", "size", "at", "component", F.lit(False).alias("short"))
    per = shorter.unionAll(longer).groupBy("key", "class", "component").agg(F.count_if("short").alias("i"), F.count_if(~F.col("short")).alias("p"))
    parts = per.groupBy("key", "class").agg(F.sum("i").alias("i"), F.sum("p").alias("p"), F.max_by("component", F.col("i") + F.col("p")).alias("main"), F.count("*").alias("n")).where("n > 1 AND i > 0")
    cells = saved(parts.select("key", "class", "main", F.ceil(F.col("i") / BLOCK).alias("i"), F.ceil(F.col("p") / BLOCK).alias("p")), "cells")

    def side(rows: DataFrame, own: str, other: str, main: list[int], rest: list[int]) -> DataFrame:
        """Rows in each of the cells that they are in: meeting 0 is of the main component's shorter sets, 1 of its longer ones, 2 of none."""
        meetings = F.when(F.col("component") == F.col("main"), F.array(*map(F.lit, main))).otherwise(F.array(*map(F.lit, rest)))
        dealt = rows.join(light(cells), ["key", "class"]).withColumn(f"b_{own}", F.pmod(F.xxhash64("node"), F.col(own))).withColumn(f"b_{other}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        return dealt.select("key", "class", "b_i", "b_p", F.explode(meetings).alias("meeting"), "node", "size", "at", "component")

    x, y = side(shorter, "i", "p", [0], [1, 2]), side(longer, "p", "i", [1], [0, 2])
    y = y.select("key", "class", "b_i", "b_p", "meeting", *[F.col(c).alias(f"y_{c}") for c in ("node", "size", "at", "component")])
    pairs = x.join(y, ["key", "class", "b_i", "b_p", "meeting"]).where("component <> y_component AND (size < y_size OR size = y_size AND node < y_node)")
    pairs = pairs.where(sized("size", "y_size", percent)).where(long_enough("size", "at", "y_size", "y_at", percent))
    return pairs.select(F.least("node", "y_node").alias("a"), F.greatest("node", "y_node").alias("b")).distinct()


def confirmed(found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * |intersection| >= percent * |union|, as a written table. Only sets of pairs' members move."""
    pairs = saved(found, "pairs")
    ends = saved(pairs.select("b").distinct(), "pair-ends")
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")).join(light(pairs), "a")
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")).join(light(ends), "b", "left_semi")
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - common
    out = saved(left.join(right, "b").where(common * 100 >= union * percent).select("a", "b"), "confirmed")
    dropped(pairs, ends)
    return out


def filtered(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with its own columns: a row of its smallest doc_id (of several texts of that id, the one with the
    least hash). Rows with a null doc_id stay; of rows with equal doc_id and text, one stays."""
    rows = saved(grouped(docs, percent), "groups")
    gone = rows.where("component IS NOT NULL AND doc_id <> component_id").select("doc_id", "text_hash").distinct()
    held = rows.where("doc_id IS NOT NULL AND (component IS NULL OR doc_id = component_id)")
    group = F.when(F.col("component").isNull(), F.col("text_hash")).otherwise(F.col("component"))
    several = held.groupBy("doc_id", F.isnull("component").alias("blank"), group.alias("group")).agg(F.count("*").alias("n"), F.min("text_hash").alias("least")).where("n > 1")
    chosen = saved(held.withColumn("blank", F.isnull("component")).withColumn("group", group).join(several, ["doc_id", "blank", "group"]).select("doc_id", "text_hash", "least").distinct(), "repeated")
    gone = saved(gone.union(chosen.where("text_hash <> least").select("doc_id", "text_hash")), "gone")
    left = nested(docs, doc_id=F.col("`doc_id`").cast("long"), text_hash=F.xxhash64(F.col("`text`"))).join(light(gone), ["doc_id", "text_hash"], "left_anti")
    if chosen.isEmpty():
        return unnested(left)
    again = light(saved(chosen.where("text_hash = least").select("doc_id", "text_hash"), "repeated"))
    once = left.join(again, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return unnested(left.join(again, ["doc_id", "text_hash"], "left_anti").unionByName(once))
