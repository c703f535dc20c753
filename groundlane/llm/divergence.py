"""Source divergence audit: how far the words of each source lie from those of the other sources of its language, and which words do it.

Terms are runs of ASCII letters, lower-cased, and of all beyond ASCII. Each language keeps the V terms that at least LEAST of its
documents hold. Every (language, source) group and every language give each kept term the share p = 1 + floor(SCALE * (count + 1) /
(N + V)), N being their count of kept terms; the divergence of a term is floor((p - q)**2 / q). All arithmetic is in whole numbers.

How: terms are counted where texts are read, and what each task has counted is added up by (language, source, term). The groups that
hold a term form its posting. A pair of groups needs the sum over all V terms, and most terms are in few groups:
- heavy terms, in more than a third of their language's groups, become tiles of terms x TILE groups x TILE groups in numpy;
- light ones are first taken as absent everywhere, which is one product for a pair; each group then corrects its own terms against
  absence, once for each count it gives terms; and each two groups of a posting correct what both corrected.
The partial sums of all three are integers and add up to the exact sum, in any order. No term meets all groups and no group all
terms in one row; work follows postings and the pairs of groups, which the result lists. Group sizes, eight bytes a group, go to all
tasks: the result has a row for every two groups of a language, so they are about the root of it.

Edge cases: null text, language and source count as ''; a group without terms is a group with count 0; a language without kept terms
has pairs of value 0 and no term rows; equal rows count each; ties of rank go to the lesser item in UTF-8; very long texts are split
into words a megabyte at a time; an empty table gives an empty result; further columns are ignored whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import LOWER, UPPER, dropped, light, saved

LEAST, SCALE, TILE, TOP = 3, 10**9, 256, 200
#: ASCII bytes that are no letters become spaces, capitals small letters.
FOLD = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))
PARTS = "lang string, g int, h int, value long"


def words(text: str | None, most: int = 1_000_000) -> Iterator[list[bytes]]:
    """The terms of a whole text, from blocks of about `most` bytes that end at a space."""
    data, at = (text or "").encode("utf-8", "surrogatepass").translate(FOLD), 0
    while at < len(data):
        end = data.find(b" ", at + most)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def counted(docs: DataFrame, held: int = 200_000) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with it), added up within each task as far as `held` entries go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, docs, size = defaultdict(Counter), defaultdict(Counter), 0

        def told() -> Iterator[pa.RecordBatch]:
            for (lang, source), c in n.items():
                own = docs[lang, source]
                yield pa.record_batch({
                    "lang": pa.array([lang] * len(c), pa.string()), "source": pa.array([source] * len(c), pa.string()),
                    "term": pa.array(list(c), pa.binary()).cast(pa.string()), "n": pa.array(list(c.values()), pa.int64()), "docs": pa.array([own[t] for t in c], pa.int64()),
                })
            n.clear()
            docs.clear()

        for b in batches:
            for lang, source, text in zip(*(b[c] for c in ("lang", "source", "text")), strict=True):
                key, seen = (lang.as_py(), source.as_py()), set()
                mine, before = n[key], len(n[key])
                for block in words(text.as_py()):
                    mine.update(block)
                    seen.update(block)
                docs[key].update(seen)
                size += len(mine) - before
                if size > held:
                    yield from told()
                    size = 0
        yield from told()

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def shares(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (n + 1) / d) by long division in steps of 1000, exact for d up to 9e15."""
    left, out = n + 1, 0
    for _ in range(3):
        q, left = np.divmod(left * 1000, d)
        out = out * 1000 + q
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def share(n: str, size: str) -> Column:
    return F.expr(f"1L + (CAST({SCALE} AS DECIMAL(19, 0)) * CAST({n} + 1 AS DECIMAL(19, 0))) div CAST({size} AS DECIMAL(19, 0))")


def summed(lang: str, g: np.ndarray, h: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """Values added up by (g, h), the pairs of a group with itself left out."""
    able = g != h
    key, at = np.unique(np.stack([g[able], h[able]]), axis=1, return_inverse=True)
    out = np.zeros(key.shape[1], np.int64)
    np.add.at(out, at.reshape(-1), values[able])
    return pa.record_batch({"lang": pa.array([lang] * len(out), pa.string()), "g": pa.array(key[0], pa.int32()), "h": pa.array(key[1], pa.int32()), "value": pa.array(out, pa.int64())})


def by_key(b: pa.RecordBatch, *names: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    places = defaultdict(list)
    for i, key in enumerate(zip(*(b[c].to_pylist() for c in names), strict=True)):
        places[key].append(i)
    for key, at in places.items():
        yield key, b.take(pa.array(at))


def flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of postings: the number of each one's entries, and all groups and counts."""
    lists = [b[c] for c in ("gs", "ns")]
    sizes = np.diff(lists[0].offsets.to_numpy())
    return sizes, *(x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)


def dense(postings: DataFrame, sizes, tile: int, chunk: int = 2_048) -> DataFrame:
    """Sums over heavy terms: each two blocks of `tile` groups of a language meet in a tile of their own."""
    blocks = F.expr(f"(n_groups + {tile} - 1) div {tile}")
    cells = postings.select("lang", "gs", "ns", blocks.alias("blocks"), F.explode(F.sequence(F.lit(0).cast("long"), blocks * blocks - 1)).alias("cell"))
    cells = cells.select("lang", "gs", "ns", F.expr("cast(cell div blocks as int)").alias("i"), F.expr("cast(cell % blocks as int)").alias("j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for (lang, i, j), b in by_key(whole, "lang", "i", "j"):
                d = sizes.value[lang][1]
                total = np.zeros((len(d[i * tile : (i + 1) * tile]), len(d[j * tile : (j + 1) * tile])), np.int64)
                for k in range(0, b.num_rows, chunk):
                    n, g, c = flat(b.slice(k, chunk))
                    term = np.repeat(np.arange(len(n)), n)

                    def side(x: int, n=n, g=g, c=c, term=term) -> np.ndarray:
                        own = g // tile == x
                        counts = np.zeros((len(n), len(d[x * tile : (x + 1) * tile])), np.int64)
                        counts[term[own], g[own] - x * tile] = c[own]
                        return shares(counts, d[x * tile : (x + 1) * tile])

                    p, q = side(i), side(j)
                    for a in range(p.shape[1]):
                        total[a] += apart(p[:, a : a + 1], q).sum(0)
                a, e = np.indices(total.shape)
                yield summed(lang, (a + i * tile).ravel(), (e + j * tile).ravel(), total.ravel())

    return cells.mapInArrow(run, PARTS)


def absent(groups: DataFrame, sizes) -> DataFrame:
    """For every pair of groups of a language, its light terms as if neither held any: this lists every pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, g, n in zip(*(b[c].to_pylist() for c in ("lang", "g", "n_light")), strict=True):
                kept, d = sizes.value[lang]
                h = np.arange(len(d))
                none = shares(np.zeros(len(d), np.int64), d) if kept else np.ones(len(d), np.int64)
                yield summed(lang, np.full(len(d), g), h, n * apart(none[g], none))

    return groups.select("lang", "g", "n_light").mapInArrow(run, PARTS)


def alone(histogram: DataFrame, sizes) -> DataFrame:
    """Corrections for the terms that a group has, against other groups without them: once for each count that it gives terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for (lang,), b in by_key(whole, "lang"):
                d = sizes.value[lang][1]
                none, h = shares(np.zeros(len(d), np.int64), d), np.arange(len(d))
                for (g,), own in by_key(b, "g"):
                    n, times = (own[c].to_numpy(zero_copy_only=False).astype(np.int64)[:, None] for c in ("n", "times"))
                    there, here = np.zeros(len(d), np.int64), np.zeros(len(d), np.int64)
                    step = max(1, 2_000_000 // len(d))
                    for k in range(0, len(n), step):
                        p, m = shares(n[k : k + step], d[g]), times[k : k + step]
                        there += (m * (apart(p, none) - apart(none[g], none))).sum(0)
                        here += (m * (apart(none, p) - apart(none, none[g]))).sum(0)
                    at = np.full(len(d), g)
                    yield summed(lang, np.concatenate([at, h]), np.concatenate([h, at]), np.concatenate([there, here]))

    return histogram.mapInArrow(run, PARTS)


def together(postings: DataFrame, sizes) -> DataFrame:
    """Corrections for the light terms that both groups of a pair have: each two entries of a posting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for (lang,), b in by_key(whole, "lang"):
                d = sizes.value[lang][1]
                none = shares(np.zeros(len(d), np.int64), d)
                n, gs, ns = flat(b)
                first = np.cumsum(n) - n
                p = shares(ns, d[gs])
                for k in np.unique(n):
                    rows = first[n == k]
                    for s in range(0, len(rows), max(1, 4_000_000 // int(k * k))):
                        at = rows[s : s + max(1, 4_000_000 // int(k * k)), None] + np.arange(k)
                        x, y = (z.ravel() for z in np.broadcast_arrays(at[:, :, None], at[:, None, :]))
                        x, y = x[x != y], y[x != y]
                        g, h = gs[x], gs[y]
                        yield summed(lang, g, h, apart(p[x], p[y]) - apart(p[x], none[h]) - apart(none[g], p[y]) + apart(none[g], none[h]))

    return postings.where("size(gs) > 1").select("lang", "gs", "ns").mapInArrow(run, PARTS)


def divergences(docs: DataFrame, least: int = LEAST, top: int = TOP, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` holds every other source of the language, part `term` the `top` terms that
    set the group apart from its language."""
    spark = docs.sparkSession
    lang, source = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))
    groups = docs.select(lang, source).distinct().withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = saved(groups, "groups")
    n_groups = saved(groups.groupBy("lang").agg(F.count("*").alias("n_groups")), "group-counts")
    terms = counted(docs.select(lang, source, "`text`")).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    entries = terms.join(light(groups), ["lang", "source"]).select("lang", "g", "term", "n", "docs")
    found = entries.groupBy("lang", "term").agg(F.sum("docs").alias("_docs"), F.sum("n").alias("total"), F.collect_list(F.struct("g", "n")).alias("entries")).where(F.col("_docs") >= least)
    found = found.join(light(n_groups), "lang")
    postings = saved(found.select("lang", "term", "total", "n_groups", F.expr("entries.g").alias("gs"), F.expr("entries.n").alias("ns"), (F.size("entries") * 3 > F.col("n_groups")).alias("heavy")), "postings")
    dropped(n_groups)

    kept = postings.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_n"), F.sum(F.expr("IF(heavy, 0L, 1L)")).alias("n_light"))
    each = postings.select("lang", "term", "total", "heavy", F.explode(F.arrays_zip("gs", "ns")).alias("e")).select("lang", "term", "total", "heavy", F.col("e.gs").alias("g"), F.col("e.ns").alias("n"))
    own = each.groupBy("lang", "g").agg(F.sum("n").alias("own_n"))
    known = groups.join(own, ["lang", "g"], "left").join(kept, "lang", "left")
    zero = F.lit(0).cast("long")
    known = saved(known.select("lang", "source", "g", *[F.coalesce(c, zero).alias(c) for c in ("own_n", "kept", "lang_n", "n_light")]), "group-sizes")

    # Eight bytes a group, of which the result holds the pairs.
    by_lang = defaultdict(list)
    for r in known.select("lang", "g", "kept", "own_n").toLocalIterator():
        by_lang[r["lang"]].append((r["g"], r["kept"], r["own_n"] + r["kept"]))
    sizes = spark.sparkContext.broadcast({k: (v[0][1], np.array([d for _, _, d in sorted(v)], np.int64)) for k, v in by_lang.items()})

    rare = postings.where("NOT heavy")
    histogram = each.where("NOT heavy").groupBy("lang", "g", "n").agg(F.count("*").alias("times"))
    sums = dense(postings.where("heavy"), sizes, tile).unionAll(absent(known, sizes)).unionAll(alone(histogram, sizes)).unionAll(together(rare, sizes))
    pairs = saved(sums.groupBy("lang", "g", "h").agg(F.sum("value").alias("value")), "pairs")
    name = known.select("lang", F.col("g").alias("h"), F.col("source").alias("item"))
    own_name = light(known.select("lang", "g", "source"))
    paired = pairs.join(light(name), ["lang", "h"]).join(own_name, ["lang", "g"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    facts = light(known.select("lang", "g", (F.col("own_n") + F.col("kept")).alias("size"), (F.col("lang_n") + F.col("kept")).alias("lang_size")))
    valued = each.select("lang", "g", "term", "n", "total").join(facts, ["lang", "g"]).select("lang", "g", F.col("term").alias("item"), share("n", "size").alias("p"), share("total", "lang_size").alias("q"))
    valued = valued.where("p > q").select("lang", "g", "item", F.expr("(p - q) * (p - q) div q").alias("value"))
    ranked = lambda rows, *keys: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("value").desc(), "item")))
    best = ranked(valued, "lang", "g").where(F.col("rank") <= top).join(own_name, ["lang", "g"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return ranked(paired, "lang", "source").unionByName(best)
