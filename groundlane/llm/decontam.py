"""Benchmark decontamination with DataFrame functions only.

The hashes of all 13-word windows of the benchmark (an item of fewer words is one window) form a hash set. Where a text is read, the
windows of each document are looked up in it within one compiled stage, and only windows found there leave that stage, with their
words. Equal words then confirm each hit and name the items.

The set is broadcast while it has at most MAX_SET hashes (about 100 MB), and the windows' words while they have at most MAX_BYTES,
both of which are counted first. Beyond that, window hashes are joined
to the benchmark's by a shuffle of narrow rows, and the windows found take their words in a second reading. Both ways end in the same
confirmation. `filtered` removes documents, `without_spans` cuts the hit words out of them.
Edge cases: null and empty texts have no words and no hits; empty tables give empty or clean results; repeated items count once
per item_id; rows that share a doc_id are kept apart by their text, and equal rows get equal results; null item_ids are ignored;
other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import LEAD, N_WORDS, alnum_split, alnum_words, dropped, light, nested, saved, unnested

SIZE, MAX_SET, MAX_BYTES = 13, 4_000_000, 100_000_000
#: A word in its original case with what stands before it, and what stands after the last word.
PLACED, TAIL = r"[^0-9A-Za-z\P{ASCII}]*[0-9A-Za-z\P{ASCII}]+", r"[^0-9A-Za-z\P{ASCII}]*$"


def window_hash(size: int) -> str:
    """SQL for the hash of the `size` elements of `words` from index i on."""
    return f"xxhash64({', '.join(f'get(words, i + {k})' for k in range(size))})"


def hash_by_size(sizes: list[int]) -> str:
    return f"CASE {' '.join(f'WHEN size = {s} THEN {window_hash(s)}' for s in sizes)} END"


def benchmark_windows(items: DataFrame) -> DataFrame:
    """item_id, window, size (words in the window) and hash, each window once per item."""
    cut = items.where("item_id IS NOT NULL").select("item_id", alnum_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    cut = cut.withColumn("size", F.least(F.size("words"), F.lit(SIZE)))
    placed = cut.select("item_id", "words", "size", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("size"))).alias("i"))
    window = F.array_join(F.slice("words", F.col("i") + 1, F.col("size")), " ")
    return placed.select("item_id", window.alias("window"), "size", F.expr(hash_by_size(list(range(1, SIZE + 1)))).alias("hash")).distinct()


def found_windows(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Rows doc_id, text_hash, n_words, start, size, window: one per document with start null, and one per window whose hash is in
    the benchmark's set."""
    sizes = sorted({SIZE} | {r["size"] for r in bench.select("size").distinct().collect()}, reverse=True)  # at most SIZE numbers
    hashes = bench.select("hash").union(docs.sparkSession.range(1).select(F.lit(0).cast("long"))).distinct()
    cut = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), alnum_split(F.col("text")).alias("words"))
    # Index -1 stands for the document itself: its hash 0 is in the set, so that each document leaves the stage once.
    rows = cut.select("doc_id", "text_hash", "words", F.explode(F.expr(f"sequence(-1, greatest(size(words) - {sizes[-1]}, -1))")).alias("i"))
    rows = rows.select("*", F.explode(F.array(*map(F.lit, sizes))).alias("size")) if len(sizes) > 1 else rows.withColumn("size", F.lit(SIZE))
    rows = rows.where(f"i >= 0 AND i + size <= size(words) OR i < 0 AND size = {SIZE}")
    rows = rows.withColumn("hash", F.expr(f"CASE WHEN i < 0 THEN 0L ELSE {hash_by_size(sizes)} END"))
    window = F.array_join(F.slice("words", F.greatest(F.col("i"), F.lit(0)) + 1, F.col("size")), " ")
    final = ["doc_id", "text_hash", F.expr(N_WORDS).alias("n_words"), F.expr(f"IF(i < 0, NULL, i - {LEAD})").alias("start"), "size", window.alias("window")]
    if hashes.count() <= MAX_SET:
        return rows.join(F.broadcast(hashes), "hash").select(*final)
    narrow = rows.where("i >= 0").select("doc_id", "text_hash", "i", "size", "hash").join(hashes, "hash", "left_semi").drop("hash").distinct()
    narrow = narrow.withColumnsRenamed({"doc_id": "_d", "text_hash": "_t"})
    again = cut.join(narrow, same_text())
    return cut.withColumns({"i": F.lit(-1), "size": F.lit(SIZE)}).select(*final).union(again.select(*final))


def same_text() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_t"))


def contamination(docs: DataFrame, items: DataFrame, held: list[DataFrame] | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, item_ids (sorted), spans (first word from 0 and length of each hit run) and contaminated.
    `held` gets the written tables that this is read from."""
    bench = saved(benchmark_windows(items), "decontam-benchmark")
    rows = saved(found_windows(docs, bench), "decontam-windows")
    if held is not None:
        held += [bench, rows]
    hits = rows.where("start IS NOT NULL").select("doc_id", "text_hash", "start", "size", "window").distinct()
    size = bench.agg(F.coalesce(F.sum(F.octet_length("window") + 64), F.lit(0)).alias("n")).first()["n"]
    named = F.broadcast(bench) if size <= MAX_BYTES else bench
    true = hits.join(named.select("window"), "window", "left_semi")
    # A window may stand in many items: its hits meet them once a document.
    items_of = hits.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), "window").distinct().join(named.select("window", F.col("item_id").cast("string").alias("id")), "window")
    items_of = items_of.groupBy("_d", "_t").agg(F.array_sort(F.collect_set("id")).alias("item_ids"))
    # A hit opens a run where no earlier one of its document reaches it.
    order = Window.partitionBy("doc_id", "text_hash").orderBy("start", "size")
    reached = F.max(F.col("start") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = true.withColumn("opens", F.coalesce((reached < F.col("start")).cast("int"), F.lit(1)))
    runs = opened.withColumn("run", F.sum("opens").over(order)).groupBy("doc_id", "text_hash", "run")
    runs = runs.agg(F.min("start").alias("first"), F.max(F.col("start") + F.col("size")).alias("end"))
    per = runs.groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).agg(
        F.sum(F.col("end") - F.col("first")).cast("long").alias("n_hit"),
        F.array_sort(F.collect_list(F.struct(F.col("first").alias("first_word"), (F.col("end") - F.col("first")).alias("n_words")))).alias("spans"),
    )
    per = per.withColumnsRenamed({"_d": "_e", "_t": "_u"}).join(items_of, F.col("_e").eqNullSafe(F.col("_d")) & (F.col("_u") == F.col("_t"))).drop("_e", "_u")
    out = rows.where("start IS NULL").select("doc_id", "text_hash", "n_words").join(per, same_text(), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id",
        "text_hash",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce("spans", F.expr("cast(array() as array<struct<first_word: int, n_words: int>>)")).alias("spans"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def keyed(docs: DataFrame) -> DataFrame:
    """Whole rows with doc_id and text_hash beside them."""
    return nested(docs, doc_id=F.col("`doc_id`"), text_hash=F.xxhash64(F.col("`text`")))


def filtered(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with their own columns. What is removed is a small part: texts move only if it has
    more rows than may be broadcast."""
    held: list[DataFrame] = []
    bad = saved(contamination(docs, items, held).where("contaminated").select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).distinct(), "contaminated")
    dropped(*held)
    return unnested(keyed(docs).join(light(bad), same_text(), "left_anti"))


def without_spans(docs: DataFrame, items: DataFrame) -> DataFrame:
    """All documents with their own columns, the hit words cut out of their texts together with what stands before each: for uses that
    keep contaminated documents. Other texts stay as they are."""
    found = contamination(docs, items).where(F.size("spans") > 0).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), "spans").distinct()
    text = F.col("row.`text`")
    both = keyed(docs).join(found, same_text(), "left").withColumn("words", F.when(F.col("spans").isNotNull(), F.regexp_extract_all(text, F.lit(PLACED), F.lit(0))))
    # What stays: from the end of one span to the start of the next, the text's two ends included.
    ends = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["first_word"] + s["n_words"]))
    starts = F.concat(F.transform("spans", lambda s: s["first_word"]), F.array(F.size("words")))
    rest = F.flatten(F.zip_with(ends, starts, lambda a, b: F.slice("words", a + 1, b - a)))
    cut = F.when(F.col("spans").isNull(), text).otherwise(F.concat(F.array_join(rest, ""), F.regexp_extract(text, TAIL, 0)))
    return both.select(*[(cut if n == "text" else F.col(f"row.`{n}`")).alias(n) for n in docs.columns])
