"""Licence scan through a positional index of rare words, with DataFrame functions only.

Templates are indexed as postings (word, template, position), rarest words first; the IDF of each template word comes from all
documents. A file's licence words say which templates it can hold at all: those whose mandatory key phrase has all its words there.
Of each of these, the file's highest-IDF words are looked up: wherever one stands, its posting proposes one place for the template.
A proposal lives only if the key phrase stands at the position it implies; proposals of one template that agree on the place then add
up the IDF of their words, and a template is found where the sum reaches SHARE of what its rarest words have.

The base phrases are templates whose key phrase is the whole template, so each occurrence is one confirmed proposal.
The index grows with the templates, not with the documents; no row, word or document is capped.
Edge cases: null and empty texts have no words, no labels and score 0; an empty table gives an empty result; rows that share a
doc_id are kept apart by their text; words of any length and texts of any size are read whole.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import LEAD, N_WORDS, alnum_split, saved

ANCHORS, SHARE = 4, 0.6
INDEX = "array<struct<t int, most int, key string, key_words array<string>, posts array<struct<word string, at int, part double, key_from int>>>>"


@dataclass(frozen=True)
class Template:
    """`words` are lower-case words of the notice; `key` must stand in it, and is what a match must hold word by word."""

    label: str
    words: str
    key: str
    base: bool = False


#: Fixed values of the contract: base phrases and their labels.
BASE = (
    Template("gpl", "gnu general public license", "gnu general public license", True),
    Template("apache", "apache license", "apache license", True),
    Template("cc-by", "cc by", "cc by", True),
    Template("mit", "mit license", "mit license", True),
)
#: Words of public licence notices.
NOTICES = (
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("lgpl", "gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license", "gnu affero general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("cc0", "cc0 1 0 universal public domain dedication", "public domain dedication"),
    Template("creative-commons", "this work is licensed under a creative commons attribution international license", "creative commons attribution"),
    Template("all-rights-reserved", "all rights reserved", "all rights reserved"),
)


def document_frequencies(docs: DataFrame, words: list[str]) -> tuple[int, dict[str, int]]:
    """Number of documents, and of those with each word. What comes back is one row per template word."""
    cut = docs.select(F.array_intersect(alnum_split(F.col("text")), F.array(*map(F.lit, words))).alias("has"))
    rows = cut.select(F.explode(F.concat(F.array(F.lit("")), "has")).alias("word")).groupBy("word").count().collect()
    found = {r["word"]: r["count"] for r in rows}
    return found.pop("", 0), found


def index(templates: tuple[Template, ...], idf: dict[str, float]) -> Column:
    """The templates with their postings, rarest words first, as one constant array that grows with the templates only. `most` of a
    template's words are looked up in a file; of the base phrases, one, so that an occurrence is one proposal."""
    out = []
    for k, t in enumerate(templates):
        words, most = t.words.split(), 1 if t.base else ANCHORS
        ranked = sorted(range(len(words)), key=lambda i: (-idf[words[i]], i))
        total = sum(idf[words[i]] for i in ranked[:most])
        key_at = len(f" {t.words} ".split(f" {t.key} ")[0].split())
        posts = [{"word": words[i], "at": i, "part": idf[words[i]] / total, "key_from": key_at - i} for i in ranked]
        out.append({"t": k, "most": most, "key": t.key, "key_words": t.key.split(), "posts": posts})
    return F.from_json(F.lit(json.dumps(out)), INDEX)


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES) -> DataFrame:
    """Per document: doc_id, n_words, places (template, first word from 0, score) confirmed, and their summary."""
    vocabulary = sorted({w for t in templates for w in t.words.split()})
    n, df = document_frequencies(docs, vocabulary)
    idf = {w: log((n + 1) / (df.get(w, 0) + 1)) + 1e-3 for w in vocabulary}
    cut = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), alnum_split(F.col("text")).alias("words"))
    cut = cut.withColumn("has", F.array_intersect("words", F.array(*map(F.lit, vocabulary))))
    held = F.filter(index(templates, idf), lambda t: F.forall(t["key_words"], lambda w: F.array_contains("has", w)))
    cut = cut.withColumn("held", held)

    def proposals(t: Column) -> Column:
        highest = F.slice(F.filter(t["posts"], lambda p: F.array_contains("has", p["word"])), F.lit(1), t["most"])
        return F.flatten(F.transform(highest, lambda p: F.transform(F.filter("at", lambda i: agrees(t, p, i)), lambda i: F.struct(
            t["t"].alias("t"), (i - p["at"] - F.expr(LEAD)).alias("place"), p["part"].alias("part"), p["at"].alias("at")))))

    def agrees(t: Column, p: Column, i: Column) -> Column:
        start = i + p["key_from"]
        there = F.array_join(F.slice("words", start + 1, F.size(t["key_words"])), " ")
        return (F.get("words", i) == p["word"]) & (start >= 0) & (there == t["key"])

    # Lookup, relative positions and key phrases are checked in the stage that reads the text; only confirmed proposals leave it.
    # Files that can hold no template have no places to look at.
    at = F.when((F.size("held") > 0) & (F.size("words") > 0), F.sequence(F.lit(0), F.size("words") - 1)).otherwise(F.array().cast("array<int>"))
    met = cut.withColumn("at", at).select("doc_id", "text_hash", F.expr(N_WORDS).alias("n_words"), F.flatten(F.transform("held", proposals)).alias("found"))
    itself = F.array(F.struct(F.lit(-1).alias("t"), F.lit(None).cast("int").alias("place"), F.lit(0.0).alias("part"), F.lit(0).alias("at")))
    met = met.select("doc_id", "text_hash", "n_words", F.inline(F.concat(itself, "found")))
    rows = saved(met, "licence-proposals")
    p = rows.where("t >= 0").select("doc_id", "text_hash", "t", "place", "part", "at").distinct()
    places = p.groupBy("doc_id", "text_hash", "t", "place").agg(F.least(F.sum("part"), F.lit(1.0)).alias("score")).where(F.col("score") >= SHARE)
    label = F.array(*[F.lit(t.label) for t in templates])[F.col("t")]
    base = F.col("t") < sum(t.base for t in templates)
    per = places.groupBy("doc_id", "text_hash").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("place"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("place"))).cast("long").alias("last_word"),
        F.array_sort(F.collect_set(F.when(base, label))).alias("base_labels"),
        F.array_sort(F.collect_set(label)).alias("labels"),
        F.round(F.max("score"), 6).alias("score"),
    )
    per = per.withColumnsRenamed({"doc_id": "_d", "text_hash": "_t"})
    out = rows.where("t < 0").select("doc_id", "text_hash", "n_words").join(per, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_t")), "left")
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
