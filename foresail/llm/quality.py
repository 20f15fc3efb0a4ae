"""Quality rules: text statistics in Spark SQL and a decision list learned from labelled documents.

Sequential covering: a rule is a conjunction of thresholds on the statistics, grown on two thirds of
the labelled rows by information gain and pruned on the last third; what an accepted rule covers is
taken out and the next rule is learned. The list becomes one ordered conditional expression."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from foresail.llm.common import WORD_BREAK, settle_table

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share")
_WINDOW = 5


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, however often and wherever it is used."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeated_words(words: Column) -> Column:
    """Words inside five-word windows that occur twice or more, by sorting the windows' hashes with their places."""
    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twin = lambda x, i: (F.get(s, i - 1).h.eqNullSafe(x.h)) | (F.get(s, i + 1).h.eqNullSafe(x.h))
            return F.sort_array(F.transform(F.filter(s, twin), lambda x: x.i))

        step = lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(_WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(_WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
        return _let(_let(ordered, places), step)

    starts = F.when(F.size(words) >= _WINDOW, F.sequence(F.lit(0), F.size(words) - _WINDOW)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(_WINDOW))))
    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))


def text_statistics(text: Column) -> Column:
    """Struct of COUNTS of a text column, all long; a null text counts as empty."""
    filled = F.coalesce(text.cast("string"), F.lit(""))

    def count(words: Column) -> Column:
        lines = F.filter(F.split(filled, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            (F.char_length(filled) - F.char_length(F.regexp_replace(filled, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
            _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            _repeated_words(words).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
        )

    return _let(F.array_remove(F.split(filled, WORD_BREAK), ""), count)


def features(stats: Column) -> dict[str, Column]:
    """Ratios that the rules are made of; 0 where there is nothing to divide by."""
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return {
        "n_words": stats.n_words.cast("double"),
        "mean_word": share(stats.word_chars, stats.n_words),
        "symbol_share": share(stats.n_symbols, stats.word_chars),
        "dup_line_share": share(stats.n_dup_lines, stats.n_lines),
        "repeat_share": share(stats.n_repeat_words, stats.n_words),
    }


def base_failed(stats: Column) -> Column:
    return (stats.n_words < 10) | (100 * stats.n_repeat_words > 20 * stats.n_words)


@dataclass(frozen=True)
class Threshold:
    feature: str
    above: bool
    value: float

    def holds(self, values: dict[str, Column]) -> Column:
        return values[self.feature] > self.value if self.above else values[self.feature] <= self.value

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.value:.6g}"


Rule = tuple[Threshold, ...]


def learn_rules(rows: np.ndarray, bad: np.ndarray, cuts: int = 32, precision: float = 0.97, least: int = 5) -> list[Rule]:
    """Ordered rules for the bad rows of a feature matrix (columns as in FEATURES).

    A rule is kept if on the pruning rows at least ``precision`` of what it covers is bad and it covers
    at least ``least`` bad rows overall; learning stops at the first rule that fails. Empty or
    one-sided labels give no rules."""
    if not len(rows) or bad.all() or not bad.any():
        return []
    literals: list[Threshold] = []
    holds = []
    for k, name in enumerate(FEATURES):
        seen = np.unique(rows[:, k])
        for cut in np.unique(np.quantile(rows[:, k], np.linspace(0, 1, cuts + 1), method="lower")):
            following = np.searchsorted(seen, cut, side="right")
            if following < len(seen):  # the threshold lies halfway to the next value seen
                for above in (True, False):
                    literals.append(Threshold(name, above, float(cut + seen[following]) / 2))
                    holds.append(rows[:, k] > cut if above else rows[:, k] <= cut)
    if not literals:
        return []
    table = np.array(holds)
    grow = np.arange(len(rows)) % 3 != 2
    left = np.ones(len(rows), bool)
    rules: list[Rule] = []
    while (left & grow & bad).any():
        picked = _grow(table, left & grow, bad)
        picked = _prune(table, picked, left & ~grow, bad)
        covered = left & np.logical_and.reduce(table[picked], axis=0) if picked else np.zeros(len(rows), bool)
        held = covered & ~grow
        if not picked or (covered & bad).sum() < least or not held.any() or (held & bad).sum() < precision * held.sum() or (covered & bad).sum() < precision * covered.sum():
            break
        rules.append(tuple(literals[k] for k in picked))
        left &= ~covered
    return rules


def _grow(table: np.ndarray, rows: np.ndarray, bad: np.ndarray) -> list[int]:
    """Add the threshold of the largest information gain until only bad rows are covered or nothing is gained."""
    picked: list[int] = []
    cover = rows.copy()
    while True:
        p, n = int((cover & bad).sum()), int((cover & ~bad).sum())
        if not p or not n:
            return picked
        hit, miss = table[:, cover & bad].sum(axis=1), table[:, cover & ~bad].sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(hit > 0, hit * (np.log2(hit / (hit + miss)) - math.log2(p / (p + n))), -np.inf)
        best = int(np.argmax(gain))
        if gain[best] <= 1e-9:
            return picked
        picked.append(best)
        cover &= table[best]


def _prune(table: np.ndarray, picked: list[int], rows: np.ndarray, bad: np.ndarray) -> list[int]:
    """Cut thresholds off the end where that doesn't lower (bad - good) / (bad + good) on the pruning rows."""
    def worth(rule: list[int]) -> float:
        cover = rows & np.logical_and.reduce(table[rule], axis=0) if rule else rows
        p, n = int((cover & bad).sum()), int((cover & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    best = list(picked)
    for size in range(len(picked) - 1, 0, -1):
        if worth(picked[:size]) >= worth(best):
            best = picked[:size]
    return best


def fit_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000, **how) -> list[Rule]:
    """Learn the rules from at most ``max_rows`` labelled documents, those of the smallest hashed ids.

    A document is bad if the mean of its labels is under a half; null labels and ids don't count, nor do
    documents that fail the base rules anyway. Of several rows with one id the smallest statistics count."""
    judged = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg((F.avg(label_col) < 0.5).alias("bad"))
    picked = judged.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")  # at most max_rows rows
    judged_text = _let(text_statistics(F.col("text")), lambda s: F.struct(base_failed(s).alias("failed"), *(c.alias(f) for f, c in features(s).items())))
    stats = settle_table(texts.select("id", "bad", judged_text.alias("f")), "quality-sample").where(~F.col("f.failed"))
    rows = stats.groupBy("id", "bad").agg(F.min(F.struct(*(f"f.{f}" for f in FEATURES))).alias("f")).orderBy(F.xxhash64("id"), "id").collect()
    return learn_rules(np.array([tuple(r.f) for r in rows], float).reshape(-1, len(FEATURES)), np.array([r.bad for r in rows], bool), **how)


def verdict(stats: Column, rules: list[Rule]) -> Column:
    """True for documents to keep: the first rule that holds rejects, otherwise the document stays."""
    values = features(stats)
    listed = None
    for rule in rules:
        holds = F.lit(True)
        for threshold in rule:
            holds = holds & threshold.holds(values)
        listed = F.when(holds, F.lit(False)) if listed is None else listed.when(holds, F.lit(False))
    return F.lit(True) if listed is None else listed.otherwise(F.lit(True))


def quality_table(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts, base_failed, kept) of every row; null texts count as empty and fail the base rules."""
    stats = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_statistics(F.col(text_col)).alias("s"))
    failed = base_failed(F.col("s"))
    return stats.select("doc_id", *(F.col(f"s.{c}").alias(c) for c in COUNTS[:5]), failed.alias("base_failed"), (~failed & verdict(F.col("s"), rules)).alias("kept"))


def keep_good(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass the base rules and the decision list, with all their columns."""
    # One expression, so that pushing the filter down cannot compute the statistics once per threshold.
    return docs.where(_let(text_statistics(F.col(text_col)), lambda s: ~base_failed(s) & verdict(s, rules)))
