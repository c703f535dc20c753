"""Toxicity: cumulative-link ordinal regression over sparse text features.

P(grade > k) = sigmoid(w.x - theta_k): one weight vector shared by all thresholds theta_0 < theta_1 < ..., so grades stay ordered.
The prediction is the expected severity, the sum of those probabilities (0 to the highest grade), and a document is toxic from CUT on.

Features are whole words and their leading 4, 5 and 6 letters (inflected forms of a stem share them), with weight log(1 + count).
Grades are the values of the label `toxic`, 0 (clean) to K: K thresholds are fitted, one where labels only say 0 or 1, and values that
no document has are no steps of the scale. At each threshold the features that are MIN_RATIO times as frequent above it as below, in
MIN_DOCS documents above at least, are candidates, so that words which part the higher grades are among them; the MAX_FEATURES
strongest at any threshold are the model's. Only words that speak for severity are: clean words can't outweigh them.

Fitting uses at most `max_rows` labelled documents that have a text (smallest hashes of doc_id, one text of each id), one per near-copy
sketch, so that a large group of copies can't teach its incidental words. Prediction covers every document and its whole text.
Edge cases: null and empty texts, and any text if no labels allow a fit, have severity 0; a doc_id with several labels has the
highest of them; labels of unknown documents and null labels are ignored; repeated rows are scored each.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import dropped, saved

WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)
MAX_ROWS, MAX_FEATURES, MIN_DOCS, MIN_RATIO, CUT = 20_000, 2_000, 5, 8.0, 0.5


def features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) > k)]


def sketch(words: list[str]) -> int:
    """Equal for near copies in most cases: the smallest hash of three words in a row."""
    return min((xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0) >> 1


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)

    def scorer(self):
        """text -> expected severity; what a word adds is looked up once per worker."""
        known: dict[str, tuple[str, ...]] = {}
        weights, theta = self.weights, np.array(self.thresholds)

        def score(text: str | None) -> float:
            if not text or not weights:
                return 0.0
            got: Counter = Counter()
            for w, n in Counter(WORD.findall(text.lower())).items():
                hit = known.get(w)
                if hit is None:
                    if len(known) > 400_000:
                        known.clear()
                    hit = known[w] = tuple(f for f in features(w) if f in weights)
                for f in hit:
                    got[f] += n
            z = sum(weights[f] * np.log1p(n) for f, n in got.items())
            return float((1 / (1 + np.exp(np.clip(theta - z, -60, 60)))).sum())

        return score


def fit_ordinal(rows: list[list[tuple[int, float]]], grades: np.ndarray, n_features: int, n_grades: int, steps: int = 400, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds by maximum likelihood with an L2 penalty (Adam, full batch, no random numbers)."""
    at = np.array([i for i, r in enumerate(rows) for _ in r], np.int64)
    col = np.array([f for r in rows for f, _ in r], np.int64)
    val = np.array([v for r in rows for _, v in r], np.float64)
    n, k = len(rows), n_grades - 1
    p = np.zeros(n_features + k)
    p[n_features] = 1.0  # theta_0; the others are softplus steps above it
    m, v = np.zeros_like(p), np.zeros_like(p)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    for step in range(1, steps + 1):
        w, raw = p[:n_features], p[n_features:]
        theta = raw[0] + np.concatenate([[0], np.cumsum(np.logaddexp(0, raw[1:]))])
        z = np.bincount(at, val * w[col], n)
        above = np.column_stack([np.ones(n), *(sigmoid(z - t) for t in theta), np.zeros(n)])  # P(grade >= 0..k+1)
        prob = np.maximum(above[np.arange(n), grades] - above[np.arange(n), grades + 1], 1e-12)
        slope = above * (1 - above)
        dz = -(slope[np.arange(n), grades] - slope[np.arange(n), grades + 1]) / prob / n
        dt = np.zeros(k)
        for j in range(k):
            dt[j] = (slope[:, j + 1] * ((grades == j + 1) / prob - (grades == j) / prob)).sum() / n
        g = np.empty_like(p)
        g[:n_features] = np.bincount(col, val * dz[at], n_features) + l2 * w
        g[n_features] = dt.sum()
        for j in range(1, k):
            g[n_features + j] = dt[j:].sum() * sigmoid(raw[j])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    raw = p[n_features:]
    return p[:n_features], raw[0] + np.concatenate([[0], np.cumsum(np.logaddexp(0, raw[1:]))])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.greatest(F.max(F.col("toxic").cast("int")), F.lit(0)).alias("grade"))
    # Labels of documents that aren't there take no place in the sample.
    known = known.join(docs.where("text IS NOT NULL").select("doc_id"), "doc_id", "left_semi")
    # At most max_rows narrow rows: safe to broadcast.
    chosen = saved(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows), "toxicity-labels")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text IS NOT NULL")
    texts = texts.groupBy("doc_id", "grade").agg(F.min("text").alias("text"))

    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"sketch": [sketch(WORD.findall(t.lower())) for t in b["text"]], "grade": b["grade"], "doc_id": b["doc_id"], "text": b["text"]})

    marked = saved(texts.mapInPandas(sketched, "sketch long, grade int, doc_id long, text string"), "toxicity-sample")
    dropped(chosen)
    try:
        return fitted(marked)
    finally:
        dropped(marked)


def chosen_features(counts: DataFrame) -> list[str]:
    """The features of a model by counts (feature, grade, n) of a sample's documents, `''` being all of them; strongest first."""
    totals = {r["grade"]: r["n"] for r in counts.where("feature = ''").collect()}  # a row for each grade
    steps = sorted(totals)[1:]
    if not steps:
        return []
    n_docs = sum(totals.values())
    above = {t: sum(n for g, n in totals.items() if g >= t) for t in steps}
    whole = F.create_map(*[F.lit(x) for t, n in above.items() for x in (t, n)])
    each = counts.where("feature <> ''").withColumn("all", F.sum("n").over(Window.partitionBy("feature")))
    each = each.select("feature", "n", "all", F.explode(F.filter(F.array(*map(F.lit, steps)), lambda t: t <= F.col("grade"))).alias("step"))
    per = each.groupBy("feature", "step").agg(F.sum("n").alias("high"), (F.first("all") - F.sum("n")).alias("low")).withColumn("whole", whole[F.col("step")])
    ratio = ((F.col("high") + 0.5) / (F.col("whole") + 1)) / ((F.col("low") + 0.5) / (F.lit(n_docs) - F.col("whole") + 1))
    able = per.where(F.col("high") >= MIN_DOCS).withColumn("ratio", ratio).where(F.col("ratio") >= MIN_RATIO)
    best = able.groupBy("feature").agg(F.max(F.col("high") * F.log("ratio")).alias("strength"))
    return [r["feature"] for r in best.orderBy(F.desc("strength"), "feature").limit(MAX_FEATURES).collect()]


def fitted(marked: DataFrame) -> Model:
    """The model of a sample (sketch, grade, doc_id, text)."""
    firsts = marked.groupBy("sketch", "grade").agg(F.min("doc_id").alias("doc_id"))
    sample = marked.join(F.broadcast(firsts), ["sketch", "grade", "doc_id"]).select("grade", "text")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: dict[int, Counter] = defaultdict(Counter)
        for b in batches:
            for t, y in zip(b["text"], b["grade"].tolist(), strict=True):
                n[y].update({"", *(f for w in set(WORD.findall(t.lower())) for f in features(w))})
        for y, c in n.items():
            yield pd.DataFrame({"feature": list(c), "grade": y, "n": list(c.values())})

    counts = saved(sample.mapInPandas(counted, "feature string, grade int, n long").groupBy("feature", "grade").agg(F.sum("n").alias("n")), "toxicity-counts")
    try:
        names = chosen_features(counts)
    finally:
        dropped(counts)
    if not names:
        return Model()
    number = {f: i for i, f in enumerate(names)}

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, y in zip(b["text"], b["grade"], strict=True):
                got: Counter = Counter()
                for w, n in Counter(WORD.findall(t.lower())).items():
                    for f in features(w):
                        if f in number:
                            got[number[f]] += n
                out.append((y, list(got), [float(np.log1p(n)) for n in got.values()]))
            yield pd.DataFrame(out, columns=["grade", "at", "value"])

    rows = sorted((r["grade"], list(r["at"]), list(r["value"])) for r in sample.mapInPandas(vectors, "grade int, at array<int>, value array<double>").collect())  # max_rows short vectors
    place = {g: k for k, g in enumerate(sorted({y for y, _, _ in rows}))}
    grades = np.array([place[y] for y, _, _ in rows])
    w, theta = fit_ordinal([list(zip(a, v, strict=True)) for _, a, v in rows], grades, len(names), len(place))
    return Model({f: float(w[i]) for f, i in number.items() if abs(w[i]) > 1e-6}, [float(t) for t in theta])


def severity(model: Model, text: Column) -> Column:
    """Expected severity of a text column."""

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = model.scorer()
        for batch in texts:
            yield pd.Series([score(t) for t in batch], dtype="float64")

    return scored(text)


def graded(docs: DataFrame, model: Model) -> DataFrame:
    scored = docs.select("doc_id", severity(model, F.col("text")).alias("severity"))
    return scored.withColumn("toxic", F.col("severity") >= CUT)


def filtered(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that aren't toxic, with their own columns; one pass, no shuffle."""
    names = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), severity(model, F.col("`text`")).alias("s"))
    return held.where(F.col("s") < CUT).select(*[F.col(f"row.`{n}`").alias(n) for n in names])
