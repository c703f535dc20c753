"""Source divergence against exact fractions over all pairs and terms, with tiles and postings cut small."""

import random
import re
from collections import Counter, defaultdict
from itertools import groupby

import pytest

from groundlane.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, g long, n long, term string"


def corpus(n_sources, n_docs=150):
    rng, fold = random.Random(n_sources), ["Alpha", "beta", "GAMMA", "déjà", "VU", "中文", "x", "Y", "ǅ", "İ"]
    rare = [f"rare{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)]
    rows = []
    for i in range(n_docs):
        s = rng.randrange(n_sources) if rng.random() < 0.7 else 0
        text = rng.choice([" ", ", ", "-", "1", "\x00"]).join(rng.choices(fold, k=rng.randint(0, 30)) + rng.choices(rare[s : s + 40], k=rng.randint(0, 8)))
        rows.append((i, text, rng.choice(["en", "en", "de"]), f"s{s}", 1, 2, "t"))
    return rows + [rows[3], rows[3], (None, None, None, None, 1, 2, "t"), (900, "", "en", "bare", 1, 2, "t"), (901, "one two", "only", "a", 1, 2, "t"), (902, None, "only", "é", 1, 2, "t"), (903, "word " * 5, "fr", "z", 1, 2, "t")]


def expected(rows, top=200):
    words, own, docs = {}, defaultdict(Counter), defaultdict(Counter)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, r in enumerate(rows):
        lang, source = r[2] or "", r[3] or ""
        words[i] = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r[1] or "").translate(lower))
        own[lang, source].update(words[i])
        docs[lang].update(set(words[i]))
    found = []
    for lang in {k[0] for k in own}:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        teams = {s: c for (x, s), c in own.items() if x == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}  # noqa: B023, E731
        ps, q = {s: share(c) for s, c in teams.items()}, share(sum(teams.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s, p in ps.items():
            pair = [(sum(f(p[t], o[t]) for t in kept), other) for other, o in ps.items() if other != s]
            term = [(f(p[t], q[t]), t) for t in kept if teams[s][t] and p[t] > q[t]]
            for part, values, most in (("pair", pair, None), ("term", term, top)):
                found += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(sorted(values, key=lambda x: (-x[0], x[1].encode()))[:most], 1)]
    return sorted(found)


@pytest.mark.parametrize("n_sources,tile,top", [(3, 256, 200), (14, 4, 5)])
def test_divergence_is_exact(spark, n_sources, tile, top):
    rows = corpus(n_sources)
    got = divergence.divergences(spark.createDataFrame(rows, SCHEMA).repartition(5), top=top, tile=tile).collect()
    assert sorted(map(tuple, got)) == expected(rows, top)
    assert all([r["rank"] for r in x] == [*range(1, 1 + len(x))] for _, g in groupby(sorted(got, key=lambda r: (r["lang"], r["source"], r["part"], r["rank"])), key=lambda r: (r["lang"], r["source"], r["part"])) for x in [list(g)])


def test_counts_in_small_steps_and_long_texts(spark):
    assert [w for block in divergence.words("Ab cd, EF-" * 50, most=7) for w in block] == [b"ab", b"cd", b"ef"] * 50
    df = spark.createDataFrame([(i, f"w{chr(97 + i % 7)} again", "en", "s", 1, 2, "t") for i in range(50)], SCHEMA).coalesce(1)
    sums = Counter()
    for r in divergence.counted(df.select("lang", "source", "text"), held=3).collect():
        sums[r["term"]] += r["docs"]
    assert sums["again"] == 50 and sums["wa"] == 8


def test_shares_are_exact_and_empty_tables(spark):
    import numpy as np

    rng = random.Random(1)
    for _ in range(300):
        d = rng.choice([1, 7, 10**9 + 1, 9 * 10**15, rng.randrange(1, 10**12)])
        n = rng.randrange(0, d)
        assert int(divergence.shares(np.array([n]), np.array([d]))[0]) == 1 + 10**9 * (n + 1) // d
    assert divergence.divergences(spark.createDataFrame([], SCHEMA)).count() == 0
