"""The sweep of near-duplicates: families of one template cost little, and no link is lost in crowded lists of unequal sizes."""

import random

import pytest
from pyspark.sql import functions as F

from groundlane.llm import neardup

from .test_edges import shingle_set
from .test_methods import classes


def brute(texts, percent):
    sets = [shingle_set(t) for t in texts]
    return [(i, k) for k in range(len(texts)) for i in range(k) if 100 * len(sets[i] & sets[k]) >= percent * len(sets[i] | sets[k])]


def test_a_template_family_leaves_no_pair_to_compare(spark, monkeypatch):
    """100 shared words and 12 own ones: all sets share most shingles and no two are similar enough."""
    seen = []
    crossed = neardup.crossed
    monkeypatch.setattr(neardup, "crossed", lambda placed, percent: seen.append(placed.count()) or crossed(placed, percent))
    shared = " ".join(f"s{i}" for i in range(100))
    rows = [(n, f"{shared} " + " ".join(f"w{n}x{i}" for i in range(12))) for n in range(800)]
    assert neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).where("NOT kept").isEmpty()
    assert seen == [0]


@pytest.mark.parametrize("percent,block", [(85, 7), (80, 1000), (80, 5)])
def test_unequal_sizes_and_a_large_component(spark, monkeypatch, percent, block):
    """Near copies of one text, and texts that share much of it, longer and shorter, some of them similar to a few."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(percent + block)
    base = [f"b{i}" for i in range(90)]
    texts = []
    for i in range(260):
        words = base[: rng.choice([90, 90, 84, 78, 70, 62])]
        for at in rng.sample(range(len(words)), rng.choice([0, 1, 1, 2, 3])):
            words[at] = f"e{rng.randrange(5)}x{at}"
        texts.append(" ".join(words + [f"t{rng.randrange(4)}x{k}" for k in range(rng.choice([0, 3, 9, 20]))]))
    want = classes(brute(texts, percent), range(len(texts)))
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_crossed_gives_every_pair_that_sizes_and_places_allow(spark, monkeypatch):
    """Against all pairs of a random list table, over several parts, blocks and components; only pairs of one component are spared."""
    monkeypatch.setattr(neardup, "BLOCK", 3)
    rng, percent, rows = random.Random(1), 80, []
    for key in range(4):
        for node in range(40):
            size = rng.choice([10, 11, 12, 13, 15, 20, 40])
            at = rng.randint(0, size // 5)
            if (size - at) * 100 >= size * percent:
                rows.append((key, node, size, at, (size - at) * 180 >= size * 160, rng.choice([0, 0, 0, 1, node])))
    want = set()
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1] and a[5] != b[5] and 100 * min(a[2], b[2]) >= percent * max(a[2], b[2]):
                short, long = (a, b) if (a[2], a[1]) < (b[2], b[1]) else (b, a)
                if short[4] and min(a[2] - a[3], b[2] - b[3]) * (100 + percent) >= (a[2] + b[2]) * percent:
                    want.add((a[1], b[1]))
    placed = spark.createDataFrame(rows, "key long, node long, size int, at int, index boolean, component long").withColumn("popularity", F.lit(1))
    monkeypatch.setattr(neardup, "light", lambda t: t)
    assert {tuple(r) for r in neardup.crossed(placed, percent).collect()} == want
