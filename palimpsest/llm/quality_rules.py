"""Quality rules as a short-circuit cascade: cost and selectivity are estimated on a sample, cheap strong rules run first.

A rule is a predicate over a document's lazily computed statistics; a statistic is computed once, and only if a rule
that runs asks for it.  The order changes the time taken, never the verdict.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.shipping import ship

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
_UPPER = re.compile("[A-ZÀ-ÖØ-Þ]+")


class Statistics:
    """Of one text; null counts as empty."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, BLANKS))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def n_upper(self) -> int:
        return sum(map(len, _UPPER.findall(self.text)))

    @cached_property
    def lines(self) -> list[str]:
        """Those with a word."""
        return [x for x in self.text.split("\n") if x.strip(BLANKS)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in 5-word windows that the text holds twice or more."""
        n = self.n_words - 4
        if n < 2:
            return 0
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in self.words), np.int64, self.n_words)
        code, top = ids[:n], len(known)
        for j in range(1, 5):
            if top * len(known) >= 2**62:  # number the sequences so far anew, so that a code stays exact
                seen, code = np.unique(code, return_inverse=True)
                top = len(seen)
            code, top = code * len(known) + ids[j : j + n], top * len(known)
        _, back, count = np.unique(code, return_inverse=True, return_counts=True)
        if count.max() < 2:
            return 0
        cover = np.zeros(self.n_words + 1, np.int64)
        at = np.flatnonzero(count[back] > 1)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + 5, -1)
        return int((np.cumsum(cover) > 0).sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Statistics], bool]
    base: bool = False


#: base rules are the contract's; the others are lenient, as running prose is to pass them.
RULES = (
    Rule("few_words", lambda d: d.n_words < 10, base=True),
    Rule("repeated_windows", lambda d: 100 * d.n_repeat_words > 20 * d.n_words, base=True),
    Rule("symbols", lambda d: 100 * d.n_symbols > 25 * d.n_words),
    Rule("shouting", lambda d: 2 * d.n_upper > d.word_chars),
    Rule("word_length", lambda d: d.word_chars > 20 * d.n_words or d.word_chars < 2 * d.n_words),
    Rule("repeated_lines", lambda d: 2 * d.n_dup_lines > len(d.lines)),
)


@dataclass(frozen=True)
class Estimate:
    name: str
    seconds: float
    rejected: float

    @property
    def gain(self) -> float:
        """Rejections for a second's work."""
        return self.rejected / max(self.seconds, 1e-9)


def estimate(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 400) -> list[Estimate]:
    """Cost and selectivity of each rule by itself, over at most sample_rows rows spread evenly by hash of the text.

    A fixed number of rows serves a corpus of any size, as an estimate's error depends on the sample alone.
    """
    ship(docs.sparkSession)
    share = min(1.0, 2.0 * sample_rows / max(1, docs.count()))
    picked = docs.select(F.col(text).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).limit(sample_rows)
    names = [r.name for r in rules]
    told = picked.mapInArrow(_timed(tuple(names)), "name string, texts long, seconds double, hits long")
    sums = {r.name: r for r in told.groupBy("name").agg(F.sum("texts").alias("texts"), F.sum("seconds").alias("seconds"), F.sum("hits").alias("hits")).collect()}
    return [Estimate(x, sums[x].seconds / sums[x].texts, sums[x].hits / sums[x].texts) if x in sums else Estimate(x, 0.0, 0.0) for x in names]


def _timed(names: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = {r.name: r for r in RULES}
        for batch in batches:
            texts = batch.column(0).to_pylist()
            rows = []
            for name in names if texts else ():
                began = time.perf_counter()
                hits = sum(rules[name].rejects(Statistics(x)) for x in texts)
                rows.append((name, len(texts), time.perf_counter() - began, hits))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["name", "texts", "seconds", "hits"])

    return run


def ordered(rules: tuple[Rule, ...], estimates: list[Estimate]) -> tuple[Rule, ...]:
    """By rejection per cost, greatest first."""
    gain = {e.name: e.gain for e in estimates}
    return tuple(sorted(rules, key=lambda r: -gain[r.name]))


_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _cascade(order: tuple[str, ...], stats: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_name = {r.name: r for r in RULES}
        cascade = [by_name[x] for x in order]
        base = [r for r in RULES if r.base]
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                d = Statistics(text)
                why = next((r.name for r in cascade if r.rejects(d)), None)
                row = [why is None, why]
                if stats:
                    row += [any(r.rejects(d) for r in base), *(getattr(d, x) for x in _STATS)]
                rows.append(row)
            kinds = [pa.bool_(), pa.string(), pa.bool_(), *[pa.int64()] * 5] if stats else [pa.bool_(), pa.string()]
            names = ["kept", "rejected_by", "base_failed", *_STATS][: len(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))] if rows else [batch.column(0), *(pa.array([], k) for k in kinds)], ["doc_id", *names])

    return run


def apply_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", stats: bool = False, sample_rows: int = 400) -> DataFrame:
    """One row per row of docs: doc_id, kept boolean, rejected_by string (the first rule of the cascade that rejects).

    stats adds base_failed boolean and the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long).
    Null or empty text: no words, rejected.  Null ids and repeated rows: a row each.  Other columns, of any name, are
    left out.  No rows: none, and the rules keep their order.  Which rule rejects first may differ between runs, since
    costs are measured; kept does not.
    """
    ship(docs.sparkSession)
    order = tuple(r.name for r in ordered(RULES, estimate(docs, text, RULES, sample_rows)))
    schema = "doc_id " + dict(docs.dtypes)[doc_id] + ", kept boolean, rejected_by string"
    if stats:
        schema += ", base_failed boolean, " + ", ".join(f"{x} long" for x in _STATS)
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_cascade(order, stats), schema)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of what apply_rules(stats=True) returns."""
    return found.select("doc_id", *_STATS, "base_failed", "kept")
