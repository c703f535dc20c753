"""Best-fit packing: every id in one piece, sequences without gaps, and hardly more of them than sequential best fit needs."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from groundlane.llm import bestfit
from groundlane.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, key long, size long, rank long"


def best_fit_decreasing(sizes, capacity):
    """Sequences that one piece after another, from the largest on, needs."""
    free = np.zeros(capacity + 1, int)
    n = 0
    for s in sorted(sizes, reverse=True):
        fit = np.flatnonzero(free[s:])
        n += not len(fit)
        at = s + int(fit[0]) if len(fit) else capacity
        free[at] -= bool(len(fit))
        free[at - s] += at > s
    return n


SIZES = {
    "even": lambda rng: [rng.randint(1, 64) for _ in range(3000)],
    "equal": lambda rng: [5] * 1500,
    "small": lambda rng: [rng.randint(1, 4) for _ in range(4000)],
    "large": lambda rng: [rng.randint(33, 64) for _ in range(300)],
    "third": lambda rng: [rng.choice([20, 21, 22, 43]) for _ in range(2000)],
    "one large": lambda rng: [64, 40, *[2] * 700],
    "one": lambda rng: [7],
}


@pytest.mark.parametrize("kind", SIZES)
def test_places_are_whole_and_few(spark, kind):
    sizes = SIZES[kind](random.Random(2))
    items = spark.createDataFrame(list(enumerate(sizes)), "key long, size int").repartition(3)
    places, _ = bestfit.best_fit(items, capacity=64, range_rows=400)
    got = [tuple(r) for r in places.collect()]
    assert sorted(k for k, _, _ in got) == [*range(len(sizes))]
    held = defaultdict(list)
    for k, sequence, offset in got:
        held[sequence].append((offset, sizes[k]))
    for x in held.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:i]) for i in range(len(x))] and sum(n for _, n in x) <= 64
    best = best_fit_decreasing(sizes, 64)
    assert len(held) <= best + max(2, best // 50)


def test_pieces_are_the_documents(spark):
    texts = [None, "", "one", "two words", "<|endoftext|> x", "long text, more of it. " * 900, "word " * 1023, "word " * 1022, "Ünïcödé 中文 \x00 z", "one", "one"]
    rows = [(i if i < 10 else None, t, "en", "s", 1, 2, 3) for i, t in enumerate(texts)] + [(3, "two words", None, None, 9, 9, 9)]
    got = [r.asDict() for r in bestfit.packed(spark.createDataFrame(rows, SCHEMA), tokenizer("byte_bpe_50k.json"), range_rows=5).collect()]
    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        n = len(ids)
        edges = [0, *range(n % 1024 or 1024, n, 1024), n]
        want += [(i, k, x, y - x, zlib.crc32(np.array(ids[x:y], "<u4").tobytes())) for k, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
    assert sorted(map(str, (tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got))) == sorted(map(str, want))
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sum(n for _, n in x) <= 1024 and [o for o, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:i]) for i in range(len(x))] for x in held.values())
    assert len(held) == best_fit_decreasing([r["length"] for r in got], 1024)
    assert bestfit.packed(spark.createDataFrame([], SCHEMA), tokenizer("byte_bpe_50k.json")).count() == 0
