"""Secrets in text: fixed patterns, and candidates whose format a learned grammar finds likely.

The base patterns label strings as credentials by kind, and every other run of credential characters
as plain, long or short. One automaton per label is learned (``automata``); a run is reported if some
credential automaton finds it as likely as the credentials it was calibrated on, by itself and against
the plain automata."""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate
from statistics import mean, pstdev

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foresail.llm.automata import Automaton
from foresail.llm.common import map_arrow, settle_table

KINDS = ("assign", "access", "hex")
GRAMMAR = "grammar"
PLAIN, SHORT = "plain", "short"
LABELS = (*KINDS, PLAIN, SHORT)
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_HINT = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Candidates: runs of credential characters as short as the base patterns take, without a full stop at either end.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{4,}[A-Za-z0-9+/_=-]")
#: Length from which plain runs are long, and verdicts a Python worker remembers at a time.
LONG, _KNOWN = 16, 200_000


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, credential) of the base patterns, by start, then kind."""
    found = []
    low = text.lower()
    if any(h in low for h in _ASSIGN_HINT):
        found += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found)


def runs(text: str) -> list[tuple[int, str]]:
    """(start, run) of every run of credential characters."""
    return [(m.start(), m[0]) for m in _CANDIDATE.finditer(text)]


class _Reach:
    """Spans by start, with how far any span up to there reaches: one search per run, however many spans."""

    def __init__(self, base: list[tuple[int, int, int, str]]):
        self.starts = [a for a, *_ in base]
        self.ends = list(accumulate((e for _, _, e, _ in base), max))

    def covers(self, start: int, stop: int) -> bool:
        """Whether one span holds all of [start, stop)."""
        at = bisect_right(self.starts, start)
        return at > 0 and self.ends[at - 1] >= stop

    def touches(self, start: int, stop: int) -> bool:
        at = bisect_left(self.starts, stop)
        return at > 0 and self.ends[at - 1] > start


def labelled_strings(docs: DataFrame, per_label: int, text_col: str = "text") -> dict[str, list[str]]:
    """At most ``per_label`` distinct strings of each label, those of the smallest hash, in a fixed order.

    Runs that touch no base span are plain, the long and the short ones apart. Every batch sends on no
    more than its own ``per_label`` first of each label, among which the first of all are."""
    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        seen: dict[str, set[str]] = {k: set() for k in LABELS}
        for cell in batch.column(0):
            text = cell.as_py() or ""
            base = base_spans(text)
            for _, k, _, value in base:
                seen[KINDS[k]].add(value)
            reach = _Reach(base)
            free = [v for s, v in runs(text) if not reach.touches(s, s + len(v))] if base else _CANDIDATE.findall(text)
            for v in free:
                seen[PLAIN if len(v) >= LONG else SHORT].add(v)
        out = [(k, *r) for k in LABELS for r in heapq.nsmallest(per_label, ((_rank(v), v) for v in seen[k]))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())], ["label", "rank", "value"])

    sent = map_arrow(docs.select(F.col(text_col).cast("string").alias("text")), rows, "label string, rank long, value string")
    distinct = settle_table(sent.distinct(), "secret-labels")
    return {k: [r.value for r in distinct.where(F.col("label") == k).orderBy("rank", "value").limit(per_label).collect()] for k in LABELS}


def _rank(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "big") >> 1


class FormatModel:
    """Automata of the labels, and what a run must reach under a credential automaton to count as one.

    A fifth of each label's credentials is held out of its automaton. At most the share ``missed`` of
    them lies below the floor of the likelihood per symbol, and at most as many below the margin over
    the plain automata (``_lowest``); in any case a run is likelier under the credential automaton. So no number of
    unlabelled credentials among the plain strings raises the bar beyond what labelled ones reach. Plain
    strings that pass are credential-like outliers: the plain automata are fitted again without them."""

    def __init__(self, labelled: dict[str, list[str]], missed: float = 0.01):
        self.kinds, self.floor, held = [], [], []
        for values in (v for k, v in labelled.items() if k not in (PLAIN, SHORT) and v):
            out = values[4::5] or values  # fewer than five: judged by themselves
            automaton = Automaton([v for k, v in enumerate(values) if k % 5 != 4])
            self.kinds.append(automaton)
            self.floor.append(_lowest([automaton.log_likelihood(v) / len(v) for v in out], missed))
            held.append(out)
        plain = [v for v in (labelled.get(PLAIN), labelled.get(SHORT)) if v]
        while True:
            self.plain = [Automaton(v) for v in plain]
            self.margin = [max(0.0, _lowest([(a.log_likelihood(v) - self._plain(v)) / len(v) for v in out], missed)) for a, out in zip(self.kinds, held)]
            kept = [[v for v in part if not self.accepts(v)] for part in plain]
            if kept == plain:
                break
            plain = [v for v in kept if v]

    def _plain(self, value: str) -> float:
        return max((a.log_likelihood(value) for a in self.plain), default=-len(value) * 4.0)

    def score(self, value: str) -> float:
        """Log likelihood ratio per symbol of the best credential grammar against the plain ones."""
        if not self.kinds or not value:
            return float("-inf")
        return (max(a.log_likelihood(value) for a in self.kinds) - self._plain(value)) / len(value)

    def accepts(self, value: str) -> bool:
        n, plain = len(value), None
        for automaton, floor, margin in zip(self.kinds, self.floor, self.margin):
            likely = automaton.log_likelihood(value) if n else -math.inf
            if n and likely / n >= floor:
                plain = self._plain(value) if plain is None else plain
                if likely > plain and (likely - plain) / n >= margin:
                    return True
        return False


def _lowest(values: list[float], share: float) -> float:
    """Where values like these end below: the share of the lowest left out, three deviations under the mean of the rest, or the least of it."""
    rest = sorted(values)[int(share * len(values)):]
    return min(rest[0], mean(rest) - 3 * pstdev(rest))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_label: int = 1000, missed: float = 0.01) -> DataFrame:
    """(doc_id, spans array<struct<start, kind, stop>>) of every row, by start, then kind; code points, end exclusive.

    Kinds: the base kinds, and 'grammar' for runs that the learned automata accept and no single base
    span covers. The automata are fitted on at most ``per_label`` distinct labelled strings of each label
    (smallest hash first); every run of every text is scored. Null and empty texts have no spans; rows
    with equal ids are each scanned; without any base match there is no grammar and nothing is added.
    Other columns are not read."""
    model = FormatModel(labelled_strings(docs, per_label, text_col), missed)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("stop", pa.int64())]))

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        out = []
        for cell in batch.column(1):
            text = cell.as_py() or ""
            base = base_spans(text)
            marks = [(s, k, e) for s, k, e, _ in base]
            found = set(_CANDIDATE.findall(text)) if model.kinds else set()
            for v in found:
                if v not in known:
                    known[v] = model.accepts(v)
            if any(map(known.get, found)):
                reach = _Reach(base)
                marks += [(s, len(KINDS), s + len(v)) for s, v in runs(text) if known[v] and not reach.covers(s, s + len(v))]
            out.append([{"start": s, "kind": (*KINDS, GRAMMAR)[k], "stop": e} for s, k, e in sorted(marks)])
            if len(known) > _KNOWN:
                known = {}
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), rows, "doc_id long, spans array<struct<start:long,kind:string,stop:long>>")


def span_digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, digest of the base spans and the list of all spans, as strings kind:start:end."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.stop)), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    base = F.filter("spans", lambda s: s.kind != GRAMMAR)
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(text(base), 256).alias("base_sha256"),
                        text(F.col("spans")).alias("spans"), count(GRAMMAR).alias("n_grammar"))
