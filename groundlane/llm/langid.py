"""Language identification with labelled spans.

Script ranges narrow the candidates of each word to languages seen in that script; a word's scores are log posteriors from word
counts that back off to letter trigrams; Viterbi with a switching penalty labels the words, so that mixed texts come out as spans.
A document's language is the one with most letters, its score that share.

Fitting uses at most `max_rows` labelled documents (smallest hashes of doc_id, one text of each id and language). `max_words` bounds the model:
each language keeps its most frequent words, max_words / number of languages of them, so that no language crowds another out; words
beyond that are scored by their trigrams.
Viterbi is exact on whole texts of any length: texts are cut into blocks, each block gives its best scores from every state to
every state, and blocks are chained, which lets one array operation serve all blocks at once.
Words are letters and the marks after them; digits and numerals of any script are none.
Edge cases: null texts and texts without letters give `und`, score 0 and no spans, as does everything if nothing was learnt; repeated
rows are predicted each; other columns are ignored whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import saved

#: Letters of Latin-1, where no marks stand; other texts need letters and marks by their categories.
LATIN1, BEYOND = re.compile("[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+").findall, re.compile("[^\x00-\xff]").search
MAX_ROWS, MAX_WORDS, PENALTY, BLOCK = 20_000, 200_000, 4.0, 64
UND = "und"
#: First and last code point of the main ranges of scripts; letters elsewhere are of the script "other".
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF),
    ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)
NAMES = [*dict.fromkeys(name for name, _, _ in SCRIPTS), "other"]


@lru_cache(maxsize=1)
def letters_and_marks():
    import regex

    return regex.compile(r"\p{L}[\p{L}\p{M}]*").findall


def words_of(text: str) -> list[str]:
    """The words of a text, lower-cased."""
    text = text.lower()
    return letters_and_marks()(text) if BEYOND(text) else LATIN1(text)


def script(words: list[str]) -> np.ndarray:
    """The number of each word's script by its first letter: the place in NAMES."""
    c = np.array([ord(w[0]) for w in words], np.int64)
    at = np.maximum(np.searchsorted([a for _, a, _ in SCRIPTS], c, "right") - 1, 0)
    low, high = np.array([a for _, a, _ in SCRIPTS])[at], np.array([b for _, _, b in SCRIPTS])[at]
    number = np.array([NAMES.index(name) for name, _, _ in SCRIPTS])[at]
    return np.where((low <= c) & (c <= high), number, NAMES.index("other"))


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the trigrams of ^^word$ for all words one after the other, and how many each word has. The upper bits of a code,
    past 21, are that of its first two letters."""
    c = np.frombuffer("".join(f"^^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum([len(w) + 3 for w in words])
    c = np.append(c, np.zeros(2, np.uint64))
    code = c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:]
    inside = np.ones(len(code), bool)
    inside[ends - 1] = inside[ends - 2] = False
    return code[inside], np.array([len(w) + 1 for w in words], np.int64)


def place(known: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Where each code stands in the sorted codes known, else -1."""
    if not len(known):
        return np.full(len(codes), -1)
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    return np.where(known[at] == codes, at, -1)


class Model:
    """langs and, of each word kept, its count per language; trigram and script tables follow from these once, on the driver."""

    def __init__(self, langs: list[str] | None = None, words: list[str] | None = None, counts: np.ndarray | None = None):
        self.langs = langs or []
        n = len(self.langs)
        words = words or []
        self.words = {w: i for i, w in enumerate(words)}
        self.counts = np.zeros((0, n)) if counts is None else counts.astype(float)
        self.totals = self.counts.sum(0)
        if not words:
            return
        codes, sizes = trigrams(words)
        self.tri, tri = summed(codes, self.counts, sizes)
        self.two, two = summed(codes >> np.uint64(21), self.counts, sizes)
        two = np.concatenate([two, np.zeros((1, n))])  # the last row, -1, stands for pairs of letters never seen
        self.tri_log = np.log((tri + 0.1) / (two[place(self.two, self.tri >> np.uint64(21))] + 4.0))
        self.two_log = np.log(0.1 / (two + 4.0))
        numbers = script(words)
        seen = np.column_stack([np.bincount(numbers, self.counts[:, k], len(NAMES)) for k in range(n)])
        self.allowed = seen >= 0.01 * np.maximum(self.totals, 1)
        self.allowed[~self.allowed.any(1)] = True

    def scores(self, words: list[str]) -> np.ndarray:
        """Log posteriors over langs, one row per word."""
        parts = [self._scores(words[i : i + 20_000]) for i in range(0, len(words), 20_000)]
        return np.concatenate(parts) if parts else np.empty((0, len(self.langs)))

    def _scores(self, words: list[str]) -> np.ndarray:
        codes, sizes = trigrams(words)
        at = place(self.tri, codes)
        logs = np.where((at >= 0)[:, None], self.tri_log[at], self.two_log[place(self.two, codes >> np.uint64(21))])
        spelt = np.add.reduceat(logs, np.cumsum(sizes) - sizes)
        known = np.array([self.words.get(w, -1) for w in words])
        with np.errstate(divide="ignore"):
            counted = np.log(np.where((known >= 0)[:, None], self.counts[known], 0.0))
        p = np.logaddexp(counted, np.log(20.0) + spelt) - np.log(self.totals + 20.0)
        p = np.where(self.allowed[script(words)], p, p.max(1, keepdims=True) - 30)
        p -= p.max(1, keepdims=True)
        p -= np.log(np.exp(p).sum(1, keepdims=True))
        return np.maximum(p, -8.0)


def summed(codes: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the sums of their words' counts; sizes says how many codes each word has."""
    known, at = np.unique(codes, return_inverse=True)
    return known, np.column_stack([np.bincount(at, np.repeat(c, sizes), len(known)) for c in counts.T])


def viterbi(scores: np.ndarray, sizes: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best label of each word: `scores` holds the words of all texts one after the other, `sizes` how many each text has."""
    n_langs = scores.shape[1]
    blocks = -(-sizes // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    nb = int(first[-1])
    if not nb:
        return np.empty(0, np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(len(scores)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    slot = (first[text] + within // BLOCK) * BLOCK + within % BLOCK
    s = np.zeros((nb * BLOCK, n_langs))  # slots past a text's end score 0 in all languages and change no label
    s[slot] = scores
    s = s.reshape(nb, BLOCK, n_langs)
    best = np.where(np.eye(n_langs, dtype=bool), 0.0, -penalty)[None].repeat(nb, 0) + s[:, :1, :]  # from state, to state
    for t in range(1, BLOCK):
        best = np.maximum(best, best.max(2, keepdims=True) - penalty) + s[:, t : t + 1, :]
    before = np.zeros((nb, n_langs))  # best score of what precedes a block, by the state it ends in
    after = np.zeros((len(sizes), n_langs))
    for k in range(int(blocks.max())):
        live = np.flatnonzero(blocks > k)
        at = first[live] + k
        before[at] = after[live]
        after[live] = (after[live][:, :, None] + best[at]).max(1)
    end, start = np.zeros(nb, np.int64), np.zeros(nb, np.int64)
    state = after.argmax(1)
    for k in range(int(blocks.max()) - 1, -1, -1):
        live = np.flatnonzero(blocks > k)
        at = first[live] + k
        end[at] = state[live]
        start[at] = state[live] = (before[at] + best[at, :, state[live]]).argmax(1)
    rows, back = np.arange(nb), np.zeros((BLOCK, nb, n_langs), np.int8)
    v = np.where(np.arange(n_langs)[None] == start[:, None], 0.0, -penalty) + s[:, 0]
    for t in range(1, BLOCK):
        top = v.argmax(1)
        move = v[rows, top][:, None] - penalty > v
        back[t] = np.where(move, top[:, None], np.arange(n_langs)[None])
        v = np.where(move, v[rows, top][:, None] - penalty, v) + s[:, t]
    labels = np.zeros((nb, BLOCK), np.int64)
    labels[:, -1] = end
    for t in range(BLOCK - 1, 0, -1):
        labels[:, t - 1] = back[t, rows, labels[:, t]]
    return labels.reshape(-1)[slot]


SPANS = "lang_pred string, score double, spans array<struct<first_word: int, n_words: int, lang: string>>"


def labelled(model: Model):
    """Iterator of text batches -> iterator of frames with the columns of SPANS."""
    langs = model.langs
    many = 2_000  # texts at a time

    def frame(texts: list[str | None]) -> pd.DataFrame:
        cut = [words_of(t) if t and langs else [] for t in texts]
        words = [w for c in cut for w in c]
        rows: dict[str, int] = {}
        at = [rows.setdefault(w, len(rows)) for w in words]
        labels = viterbi(model.scores(list(rows))[at], np.array([len(c) for c in cut])) if words else np.empty(0, np.int64)
        letters, out, i = np.array([len(w) for w in words], float), [], 0
        for c in cut:
            if not c:
                out.append((UND, 0.0, []))
                continue
            mine, size = labels[i : i + len(c)], np.bincount(labels[i : i + len(c)], letters[i : i + len(c)], len(langs))
            edge = np.concatenate([[0], np.flatnonzero(np.diff(mine)) + 1, [len(c)]])
            spans = [(int(a), int(b - a), langs[mine[a]]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            out.append((langs[int(size.argmax())], float(size.max() / size.sum()), spans))
            i += len(c)
        return pd.DataFrame(out, columns=["lang_pred", "score", "spans"])

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list(batch)
            parts, held, size = [], [], 0
            for t in texts:
                held.append(t)
                size += len(t or "")
                if len(held) >= many or size > 4_000_000:
                    parts.append(frame(held))
                    held, size = [], 0
            if held or not parts:
                parts.append(frame(held))
            yield pd.concat(parts, ignore_index=True)

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS) -> Model:
    """From documents that aren't held out and have a language; `max_rows` bounds the sample, `max_words` the model."""
    able = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = able.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # narrow rows, at most max_rows
    texts = able.select("doc_id", "lang", "text").join(F.broadcast(chosen.distinct()), "doc_id").where("text IS NOT NULL")
    texts = texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for lang, t in zip(b["lang"], b["text"], strict=True):
                n[lang].update(words_of(t))
        yield pd.DataFrame([(a, w, k) for a, c in n.items() for w, k in c.items()], columns=["lang", "word", "n"])

    counts = texts.mapInPandas(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = saved(counts, "language-counts")
    quota = max_words // max(1, counts.select("lang").distinct().count())
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "word"))
    chosen = counts.withColumn("rank", rank).where(F.col("rank") <= quota).select("word").distinct()
    kept = counts.join(chosen, "word").groupBy("word").agg(F.collect_list(F.struct("lang", "n")).alias("by"))
    # At most max_words rows reach the driver, as Arrow columns: row objects would take many times their size.
    found = saved(kept.orderBy("word"), "language-words").toArrow()
    by = found.column("by").combine_chunks()
    entries = by.flatten()
    names = entries.field("lang").to_pylist()
    langs = sorted(set(names))
    number = {x: i for i, x in enumerate(langs)}
    counts = np.zeros((found.num_rows, len(langs)))
    row = np.repeat(np.arange(found.num_rows), by.value_lengths().to_numpy(zero_copy_only=False))
    counts[row, [number[x] for x in names]] = entries.field("n").to_numpy()
    return Model(langs, found.column("word").to_pylist(), counts)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and spans (word positions) of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(SPANS)
    def udf(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from labelled(held.value)(texts)

    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), udf(F.col("text")).alias("x"))
    return found.select("doc_id", "held_out", "x.lang_pred", "x.score", "x.spans")
