"""Toxicity with four grades and labels of unknown documents, against a plain version of the whole query."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from groundlane.llm import toxicity

WORDS = [f"{a}{b}{c}" for a in "bdfgk" for b in ("ala", "ero", "ino", "ous") for c in ("t", "m", "rin", "sel")]


def corpus(n=400):
    rng, rows, labels = random.Random(11), [], []
    for i in range(n):
        grade = rng.choice([0, 0, 0, 0, 1, 2, 3])
        words = rng.choices(WORDS, k=rng.randint(20, 60))
        for g, word in ((1, "mildly"), (2, "coarsely"), (3, "grossly")):
            words += [word] * (grade >= g and rng.random() < 0.9) + ["only" + word] * (grade == g and rng.random() < 0.8)
        rng.shuffle(words)
        rows.append((i, " ".join(words) if i % 40 else None))
        labels.append((i, grade))
    rows += [(9000 + i, rows[3][1]) for i in range(60)] + [(3, rows[3][1])]
    labels += [(9000 + i, labels[3][1]) for i in range(60)] + [(100_000 + i, i % 4) for i in range(5000)] + [(None, 3), (5, None), (7, 0)]
    return rows, labels


def plain(rows, labels, order, max_rows):
    """(features chosen, document -> severity) by loops over the sample."""
    grade = {}
    for d, y in labels:
        if d is not None and y is not None:
            grade[d] = max(grade.get(d, 0), y)
    texts = {}
    for d, t in rows:
        if t is not None:
            texts[d] = min(texts.get(d, t), t)
    chosen = sorted((d for d in grade if d in texts), key=lambda d: (order[d], d))[:max_rows]
    firsts = {}
    for d in chosen:
        key = (toxicity.sketch(toxicity.WORD.findall(texts[d].lower())), grade[d])
        firsts[key] = min(firsts.get(key, d), d)
    sample = [(grade[d], texts[d]) for d in firsts.values()]
    grades, strength = sorted({y for y, _ in sample}), {}
    bags = [(y, {f for w in set(toxicity.WORD.findall(t.lower())) for f in toxicity.features(w)}) for y, t in sample]
    for step in grades[1:]:
        high, low, n = Counter(), Counter(), sum(y >= step for y, _ in bags)
        for y, bag in bags:
            (high if y >= step else low).update(bag)
        for f, k in high.items():
            ratio = ((k + 0.5) / (n + 1)) / ((low[f] + 0.5) / (len(bags) - n + 1))
            if k >= toxicity.MIN_DOCS and ratio >= toxicity.MIN_RATIO:
                strength[f] = max(strength.get(f, 0), k * np.log(ratio))
    names = sorted(strength, key=lambda f: (-strength[f], f))

    def vector(t):
        got = Counter()
        for w, n in Counter(toxicity.WORD.findall((t or "").lower())).items():
            got.update({f: n for f in toxicity.features(w) if f in strength})
        return [(names.index(f), float(np.log1p(n))) for f, n in got.items()]

    w, theta = toxicity.fit_ordinal([vector(t) for _, t in sample], np.array([grades.index(y) for y, _ in sample]), len(names), len(grades))
    return names, lambda t: sum(1 / (1 + np.exp(x - sum(w[i] * v for i, v in vector(t)))) for x in theta) if t else 0.0


def test_the_whole_query_is_the_plain_version(spark):
    rows, labels = corpus()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int").repartition(3)
    ids = spark.createDataFrame([(d,) for d in {d for d, _ in labels if d is not None}], "doc_id long").select("doc_id", F.xxhash64("doc_id").alias("h")).collect()
    names, severity = plain(rows, labels, {r["doc_id"]: r["h"] for r in ids}, 300)
    model = toxicity.fit(docs, marks, max_rows=300)
    assert set(model.weights) <= set(names) and len(model.weights) >= len(names) - 2 and len(model.thresholds) == 3
    assert {"mildly", "coarsely", "grossly", "onlygrossly"} <= set(model.weights)
    got = toxicity.graded(docs, model).collect()
    want = sorted((d, severity(t)) for d, t in rows)
    for r, (d, s) in zip(sorted(got, key=lambda r: (r["doc_id"], r["severity"])), want, strict=True):
        assert r["doc_id"] == d and abs(r["severity"] - s) < 1e-3 and r["toxic"] == (r["severity"] >= toxicity.CUT)
    held = {d: y for d, y in labels if d is not None and d < 400}
    mean = [np.mean([r["severity"] for r in got if held.get(r["doc_id"]) == y and r["doc_id"] % 40]) for y in range(4)]
    assert mean == sorted(mean) and mean[3] > 2.5 and mean[0] < 0.3


def test_unknown_labels_alone_allow_no_fit(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(2, 1), *[(i, i % 2) for i in range(50, 90)]], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels).weights == {}
    assert toxicity.fit(docs.limit(0), labels).weights == {} and toxicity.fit(docs, labels.limit(0)).weights == {}
