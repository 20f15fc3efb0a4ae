"""Periodic runs of words in whole texts, found through a dictionary of basic factors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from foresail.llm.common import map_arrow, words_of
from foresail.llm.factors import maximal_runs

#: Documents are examined together up to so many words; a longer document is examined alone.
WORDS_AT_ONCE = 1 << 19

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _symbols(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Words as numbers, equal only within a text, and each text's first place; a number of its own around each text."""
    total = sum(map(len, texts)) + len(texts) + 1
    symbols, starts = np.empty(total, np.int64), np.empty(len(texts) + 1, np.int64)
    symbols[0], used, at = 0, 1, 1
    for k, words in enumerate(texts):
        seen: dict[bytes, int] = {}
        starts[k] = at
        symbols[at:at + len(words)] = [seen.setdefault(w, used + len(seen)) for w in words]
        at += len(words)
        used += len(seen)
        symbols[at] = used
        used, at = used + 1, at + 1
    starts[-1] = at
    return symbols, starts


def _collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    kept = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


def _examine(texts: list[list[bytes]], shortest: int) -> Iterator[tuple[np.ndarray, bytes]]:
    """(runs as rows of start, length, period; kept words) of each text."""
    symbols, starts = _symbols(texts)
    start, length, period = maximal_runs(symbols, shortest)
    edges = np.searchsorted(start, starts)
    for k, words in enumerate(texts):
        a, b = edges[k], edges[k + 1]
        if a == b:
            yield np.zeros((0, 3), np.int64), b" ".join(words)
            continue
        own = start[a:b] - starts[k]
        yield np.stack([own, length[a:b], period[a:b]], axis=1), _collapsed(words, own, length[a:b], period[a:b])


def _chunks(column: pa.Array) -> Iterator[list[list[bytes]]]:
    chunk, size = [], 0
    for value in column:
        words = (value.as_py() or "").encode().split()
        if chunk and size + len(words) > WORDS_AT_ONCE:
            yield chunk
            chunk, size = [], 0
        chunk.append(words)
        size += len(words)
    if chunk:
        yield chunk


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 12) -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, collapsed): one row per input row.

    A run is a maximal stretch of words with smallest period q and at least max(``shortest``, 2 q) words;
    ``runs`` are ascending by start, then period. ``collapsed`` are the words that no run contains after its
    first q words, joined by one space. Texts are read whole: a null one has no words, like an empty or
    blank one, and gives no runs and an empty text. Repeated rows and null ids stay as rows of their own;
    other columns are not read. A text is examined in one task, with 4 bytes a word for each power of two
    up to its longest repeat."""
    def examine(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        done = 0
        for texts in _chunks(batch.column(1)):
            found = list(_examine(texts, shortest))
            rows = np.concatenate([r for r, _ in found])
            runs = pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *(len(r) for r, _ in found)]), pa.int32()),
                pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(3)], fields=list(_RUN)))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(done, len(texts)), pa.array([len(w) for w in texts], pa.int64()), runs,
                pa.array([c.decode() for _, c in found], pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])
            done += len(texts)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(narrow, examine, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def longest_run(runs: Column) -> Column:
    """The run of greatest length; ties go to the smallest start, then period. Null without runs."""
    ordered = F.array_sort(F.transform(runs, lambda r: F.struct((-r.length).alias("key"), r.start.alias("start"), r.period.alias("period"))))
    best = F.get(ordered, 0)
    return F.when(F.size(runs) > 0, F.struct(best.start.alias("start"), (-best.key).alias("length"), best.period.alias("period")))


def made_periodic(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Test text: every tenth document by crc32 of its id repeats a part of its words from a place on.

    With h = crc32(decimal id) and g = floor(h / 10): where h is a multiple of ten, each word i >= a = g % n
    becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)). A null id counts as empty text."""
    text = F.col(text_col).cast("string")
    h = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def repeat(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")

    made = F.get(F.transform(F.array(words_of(text)), lambda ws: F.when(F.size(ws) > 0, repeat(ws)).otherwise(text)), 0)
    return F.when(h % 10 == 0, made).otherwise(text)
