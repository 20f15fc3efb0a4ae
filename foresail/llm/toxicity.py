"""Toxicity of whole texts by a weighted grammar of clauses, composed from finite-state transducers.

Words become symbols (insult, threat, target, negation, report); negation and reported speech rewrite the
insults and threats in their reach; the clause transducer then names, at a clause's end, the pattern it
has seen. A text's log odds are a bias and the weights of its clauses' patterns: isolated words have none.

The insult lexicon is learned from labelled texts, words whose share of toxic texts cannot be chance, and
so are the weights, by logistic regression around stated prior weights. Only text enters a score."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from foresail.llm.common import map_arrow, settle_table
from foresail.llm.transducers import Transducer, compose, tabulate

#: Words of the grammar in the four languages, lower case.
SEED_INSULTS = "idiot idiots stupid moron morons fool fools dumm dummkopf trottel idiota idiotas tonto imbécil estúpido estúpida imbécile crétin abruti".split()
THREATS = "kill hurt destroy beat stab shoot strangle töten umbringen vernichten schlagen erschießen matar destruir golpear apuñalar tuer détruire frapper étrangler".split()
TARGETS = "you your yours he she him her they them du dich dir euch ihr ihn sie er tu te toi vous lui elle il ils tú usted ustedes él ella ellos".split()
NEGATIONS = "not no never neither nor without don doesn didn isn aren wasn weren won ain cannot nicht kein keine keinen nie niemals nein ne pas jamais aucun sans nunca jamás ningún sin".split()
REPORTS = "said says say told tells called calls wrote writes quoted claimed sagte sagt schrieb nannte behauptete dit disait écrit appelé dijo dice escribió llamó".split()

SYMBOLS = ["word", "insult", "threat", "target", "negation", "report", "quote", "end", "line"]
#: How many words a negation reaches.
NEGATION_REACH = 3
#: Parts that make up a clause's weight, as they are without labels, and the patterns of a clause by their parts.
PRIOR = {"insult": 1.0, "several": 0.5, "aimed": 1.0, "threat": 0.5, "negated": -0.2, "reported": 0.1}
PATTERNS = {"insult": ["insult"], "insults": ["insult", "several"], "insult+target": ["insult", "aimed"], "insults+target": ["insult", "several", "aimed"],
            "threat": ["threat"], "threat+target": ["threat", "aimed"], "insult+threat": ["insult", "threat"], "insult+threat+target": ["insult", "threat", "aimed"],
            "negated": ["negated"], "reported": ["reported"]}
PRIOR_BIAS, PRIOR_ROWS = -3.0, 2.0
#: Labelled texts that a model is fitted on, by the hash of their id; and the words it may learn.
FIT_ROWS, FIT_WORDS = 20_000, 500
#: Chance that a fit takes up any word that is no insult.
WRONG_WORD = 0.01
#: A learned word is at least so many times as frequent in toxic texts as in all.
LIFT = 4.0

_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:,]|[\"“”„«»]|\n")
_MARKS = dict.fromkeys(".!?;:,", "end") | dict.fromkeys("\"“”„«»", "quote") | {"\n": "line"}


def negation() -> Transducer:
    """Marks insults and threats in the reach of a negation; the state is what is left of the reach."""
    rules = {}
    for left in range(NEGATION_REACH + 1):
        after = max(left - 1, 0)
        for symbol in ("word", "target", "report"):
            rules[left, symbol] = (after, symbol, 0.0)
        for symbol in ("insult", "threat"):
            rules[left, symbol] = (after, "negated" if left else symbol, 0.0)
        rules[left, "negation"] = (NEGATION_REACH, "word", 0.0)
        rules[left, "end"] = (0, "end", 0.0)
        rules[left, "line"] = (0, "line", 0.0)
    return Transducer(0, rules)


def reported_speech() -> Transducer:
    """Marks insults and threats after a reporting verb, to the clause's end, and in quotes, to the line's end at most."""
    rules = {}
    for state in ("own", "told", "quoted"):
        inside = state != "own"
        for symbol in ("insult", "threat"):
            rules[state, symbol] = (state, "reported" if inside else symbol, 0.0)
        rules[state, "report"] = ("quoted" if state == "quoted" else "told", "word", 0.0)
        rules[state, "quote"] = ("own" if state == "quoted" else "quoted", "word", 0.0)
        rules[state, "end"] = ("quoted" if state == "quoted" else "own", "end", 0.0)
        rules[state, "line"] = ("own", "line", 0.0)
    return Transducer("own", rules)


def insult() -> Transducer:
    """Counts a clause's insults, as none, one or more, and hands the count on at its end."""
    rules = {}
    for n in range(3):
        rules[n, "insult"] = (min(n + 1, 2), "word", 0.0)
        for mark in ("end", "line"):
            rules[n, mark] = (0, ("end", "end:insult", "end:insults")[n], 0.0)
    return Transducer(0, rules)


def threat() -> Transducer:
    """Adds a clause's threat to what is handed on at its end."""
    rules = {}
    for seen in (False, True):
        rules[seen, "threat"] = (True, "word", 0.0)
        for mark, joined in (("end", "end:threat"), ("end:insult", "end:insult+threat"), ("end:insults", "end:insult+threat")):
            rules[seen, mark] = (False, joined if seen else mark, 0.0)
    return Transducer(False, rules)


def target(weights: dict[str, float]) -> Transducer:
    """Names the clause's pattern, with its weight, whether a target is in it or not; else the marks in it."""
    rules = {}
    for aimed in (False, True):
        for mark in ("none", "negated", "reported"):
            state = (aimed, mark)
            rules[state, "target"] = ((True, mark), "word", 0.0)
            for found in ("negated", "reported"):
                rules[state, found] = ((aimed, found), "word", 0.0)
            rules[state, "end"] = ((False, "none"), "word" if mark == "none" else mark, weights.get(mark, 0.0))
            for kind in ("insult", "insults", "threat", "insult+threat"):
                name = f"{kind}+target" if aimed else kind
                rules[state, f"end:{kind}"] = ((False, "none"), name, weights.get(name, 0.0))
    return Transducer((False, "none"), rules)


def grammar(weights: dict[str, float]) -> Transducer:
    """The whole grammar over ``SYMBOLS``."""
    return reduce(lambda a, b: compose(a, b, SYMBOLS), [negation(), reported_speech(), insult(), threat(), target(weights)])


def pattern_weights(parts: dict[str, float]) -> dict[str, float]:
    return {name: sum(parts[part] for part in made) for name, made in PATTERNS.items()}


@dataclass
class ToxicityModel:
    words: list[str] = field(default_factory=list)
    #: Weight of every pattern.
    weights: dict[str, float] = field(default_factory=lambda: pattern_weights(PRIOR))
    bias: float = PRIOR_BIAS


def tokens(text: str | None) -> list[str]:
    """Words in lower case, punctuation that ends clauses or quotes, and line ends, of a whole text."""
    return _TOKEN.findall((text or "").lower())


class ClauseMatcher:
    """Counts the patterns of a text's clauses."""

    def __init__(self, words: Iterable[str]):
        kinds = {w: kind for kind, listed in (("insult", [*SEED_INSULTS, *words]), ("report", REPORTS), ("negation", NEGATIONS), ("target", TARGETS), ("threat", THREATS)) for w in listed}
        self.symbol = {token: SYMBOLS.index(kind) for token, kind in (kinds | _MARKS).items()}
        self.patterns = list(PATTERNS)
        self.following, self.emitted = tabulate(grammar(pattern_weights(PRIOR)), SYMBOLS, self.patterns)
        self.matters = {SYMBOLS.index("insult"), SYMBOLS.index("threat")}
        self.line = SYMBOLS.index("line")

    def __call__(self, text: str | None) -> list[int]:
        counts = [0] * len(self.patterns)
        symbols = list(map(self.symbol.get, tokens(text)))
        if self.matters.isdisjoint(symbols):
            return counts  # no clause of this text names a pattern
        state, following, emitted = 0, self.following, self.emitted
        for s in [*symbols, self.line]:
            s = s or 0
            out = emitted[state][s]
            if out >= 0:
                counts[out] += 1
            state = following[state][s]
        return counts


def count_patterns(docs: DataFrame, words: list[str], text_col: str, *keep: str) -> DataFrame:
    """Columns ``keep`` and ``counts``: per row, how many clauses of its text have each pattern, in the order of ``PATTERNS``."""
    narrow = docs.select(*keep, F.col(text_col).cast("string").alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema.fields}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = ClauseMatcher(words)
        for batch in batches:
            counts = [matcher(t.as_py()) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(counts, pa.list_(pa.int64()))], names=[*keep, "counts"])

    return narrow.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keep), "counts array<bigint>"]))


def labelled_texts(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(text, toxic): labelled rows for fitting, at most ``fit_rows`` ids by the least hash, as a settled table.

    Labels other than 0 and 1 and null ids are left out; an id with both labels counts as toxic."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("labelled_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(fit_rows)
    joined = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id"))
    return settle_table(joined.select("text", "toxic"), "labelled-texts")


def _word_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Per word of a batch: toxic and clean texts that have it, and a 64-bit sketch of its neighbours in toxic texts."""
    held: dict[str, list[int]] = {}
    for text, toxic in zip(batch.column(0), batch.column(1)):
        words = [t for t in tokens(text.as_py()) if t[0].isalpha()]
        toxic = toxic.as_py()
        for w in set(words):
            held.setdefault(w, [0, 0, 0])[1 - toxic] += 1
        if toxic:
            for before, w, after in zip(["", *words], words, [*words[1:], ""]):
                held[w][2] |= 1 << (zlib.crc32(f"{before} {after}".encode()) & 63)
    sketch = np.array([h[2] for h in held.values()], np.uint64).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([h[0] for h in held.values()], pa.int64()),
                                      pa.array([h[1] for h in held.values()], pa.int64()), pa.array(sketch)], names=["word", "toxic", "clean", "around"])


def learn_words(texts: DataFrame, fit_words: int = FIT_WORDS) -> list[str]:
    """Words whose share of toxic texts is no chance: a binomial tail bound below ``WRONG_WORD`` over all words.

    Toxic texts count only as far as the word's neighbours differ in them, so the words of one copied text
    are no evidence however often it was copied."""
    rows = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if len(rows) < 2:
        return []
    rate = rows[1] / (rows[0] + rows[1])
    words = map_arrow(texts, _word_rows, "word string, toxic long, clean long, around long").groupBy("word").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_count(F.bit_or("around")).alias("around"))
    words = settle_table(words, "word-counts")
    needed = math.log(max(words.count(), 1) / WRONG_WORD)
    places = F.when(F.col("around") < 64, -64 * F.log(1 - F.col("around") / 64)).otherwise(F.col("toxic"))
    own = F.least(F.col("toxic").cast("double"), places)
    n = own + F.col("clean")
    share = own / n
    less = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    evidence = F.when(share >= F.least(F.lit(1.0), LIFT * F.lit(rate)), n * (share * F.log(share / rate) + less)).otherwise(0.0)
    best = words.where("toxic > 0").withColumn("evidence", evidence).where(F.col("evidence") >= needed)
    return [r.word for r in best.orderBy(F.desc("evidence"), "word").limit(fit_words).collect()]


def fit_weights(counts: np.ndarray, toxic: np.ndarray, times: np.ndarray) -> tuple[float, dict[str, float]]:
    """(bias, pattern weights) of a logistic regression on the parts of the clauses' weights.

    Drawn to the prior as by ``PRIOR_ROWS`` rows; no part but ``negated`` lowers a score."""
    prior = np.array([PRIOR_BIAS, *PRIOR.values()])
    made = np.array([[part in parts for part in PRIOR] for parts in PATTERNS.values()], float)
    x = np.column_stack([np.ones(len(counts)), counts @ made])
    theta = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (times * (toxic - p)) - PRIOR_ROWS * (theta - prior)
        curve = (x * (times * p * (1 - p))[:, None]).T @ x + PRIOR_ROWS * np.eye(len(theta))
        step = np.clip(np.linalg.solve(curve, slope), -2, 2)
        theta += step
        if np.abs(step).max() < 1e-9:
            break
    parts = {k: round(float(t), 6) for k, t in zip(PRIOR, theta[1:])}
    return round(float(theta[0]), 6), pattern_weights({k: w if k == "negated" else max(w, 0.0) for k, w in parts.items()})


def fit_model(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_words: int = FIT_WORDS) -> ToxicityModel:
    """Lexicon and weights from the labelled rows in ``labels`` (doc_id, toxic); without labels the prior grammar.

    Collects at most ``fit_words`` words and ``fit_rows`` labelled texts' pattern counts, grouped by equal ones."""
    texts = labelled_texts(docs, labels, fit_rows)
    words = learn_words(texts, fit_words)
    grouped = count_patterns(texts, words, "text", "toxic").groupBy("counts", "toxic").count().orderBy("counts", "toxic").collect()
    if not grouped:
        return ToxicityModel(words)
    bias, weights = fit_weights(*(np.array([r[c] for r in grouped], float) for c in ("counts", "toxic", "count")))
    return ToxicityModel(words, weights, bias)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, patterns map<string, long>, score): one row per input row, from its whole text alone.

    ``patterns`` counts the clauses by pattern, those that occur. Null, empty and blank texts have no
    clauses and get the bias's score; null ids and repeated rows stay; other columns are not read."""
    names = list(PATTERNS)
    found = count_patterns(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), model.words, "text", "doc_id")
    odds: Column = F.lit(model.bias)
    for i, name in enumerate(names):
        odds = odds + F.lit(model.weights[name]) * F.get("counts", F.lit(i))
    patterns = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.col("counts")), lambda _, n: n > 0)
    return found.select("doc_id", patterns.alias("patterns"), (1 / (1 + F.exp(-odds))).alias("score"))


def is_held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is a multiple of five; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0
