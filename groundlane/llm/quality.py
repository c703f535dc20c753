"""Quality rules: a ledger of measurements and failure bits, and versioned policies applied to it.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed rule, so that a new policy
or an ablation is a bitwise pass over narrow rows and never reads a text again: stored() writes it for them. filtered() is for where
one policy alone is wanted: it applies the same bits in the pass that measures.

Edge cases: a null or empty text has no words, all measurements are 0 and it fails `few_words`; repeated rows get one ledger row
each; other columns of the input are ignored whatever their names; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import nested, saved, unnested, window_hashes

WINDOW = 8
MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
#: Fixed values of the contract: symbols, and the code points between words.
SYMBOLS = "#*$%&|<>"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def repeat_words(words: list[bytes]) -> int:
    """Words inside 8-word windows that stand twice or more in the text, the first occurrence included."""
    n = len(words)
    if n <= WINDOW:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.uint64)
    if len(numbers) == n:
        return 0
    hashes = window_hashes(ids, WINDOW)
    order = np.sort(hashes)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(hashes, twice))
    keys = [ids[i : i + WINDOW].tobytes() for i in at]  # equal hashes are confirmed on the words themselves
    seen = Counter(keys)
    edges = np.zeros(n + 1, np.int64)
    for i, key in zip(at, keys, strict=True):
        if seen[key] > 1:
            edges[i] += 1
            edges[i + WINDOW] -= 1
    return int((np.cumsum(edges[:n]) > 0).sum())


def measure_text(text: str | None) -> tuple[int, int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()  # bytes.split() parts at exactly the six code points of SPACES
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


def _measures(text: Column) -> Column:
    names = [x.split()[0] for x in MEASURES.split(", ")]

    @F.pandas_udf(MEASURES)
    def udf(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([measure_text(t) for t in batch], columns=names, dtype="int64")

    return udf(text)


@dataclass(frozen=True)
class Rule:
    """Fails where `fails` holds of the measurements; the bit number is the place in RULES and never changes."""

    name: str
    fails: str


RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbol_heavy", "n_symbols > 2 * n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines AND n_dup_lines >= 10"),
    Rule("very_long_words", "word_chars > 100 * n_words AND n_words > 0"),
)


@dataclass(frozen=True)
class Policy:
    """A document is rejected if it fails any of the rules named. Versions are only ever added."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [r.name for r in RULES]
        return sum(1 << names.index(x) for x in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
STRICT = Policy("v1", tuple(r.name for r in RULES))


def ledger_columns(measured: str) -> list[Column]:
    """Measurements and failure bits from a struct column of measurements."""
    names = [x.split()[0] for x in MEASURES.split(", ")]
    return [F.col(f"{measured}.{n}").alias(n) for n in names]


def fail_bits() -> Column:
    return sum((F.when(F.expr(r.fails), F.lit(1 << k)).otherwise(F.lit(0)) for k, r in enumerate(RULES)), F.lit(0)).cast("long")


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and fail_bits of each document."""
    measured = docs.select("doc_id", _measures(F.col("text")).alias("m"))
    return measured.select("doc_id", *ledger_columns("m")).withColumn("fail_bits", fail_bits())


def stored(docs: DataFrame) -> DataFrame:
    """The ledger as a written table, without texts."""
    return saved(ledger(docs), "quality-ledger")


def passes(policy: Policy, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask)) == 0


def filtered(docs: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """The documents that the policy keeps, with their own columns; one pass, no shuffle."""
    rows = nested(docs, m=_measures(F.col("`text`"))).select("row", *ledger_columns("m")).withColumn("fail_bits", fail_bits())
    return unnested(rows.where(passes(policy)))


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: how many documents fail it, fail it alone, and stay if it is left out.

    The ledger first shrinks to one count per bit pattern (at most 2 ** rules), so no step depends on the number of documents.
    An empty ledger gives zeros.
    """
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    cells = [
        F.struct(
            F.lit(r.name).alias("rule"),
            F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.lit(1 << k)) != 0, F.col("n"))), F.lit(0)).alias("n_fail"),
            F.coalesce(F.sum(F.when(F.col("bits") == (1 << k), F.col("n"))), F.lit(0)).alias("n_fail_alone"),
            F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.lit(policy.mask & ~(1 << k))) == 0, F.col("n"))), F.lit(0)).alias("n_kept_without"),
        )
        for k, r in enumerate(RULES)
        if r.name in policy.rules
    ]
    return patterns.agg(F.array(*cells).alias("cells")).select(F.inline("cells")).withColumn("policy", F.lit(policy.version))
