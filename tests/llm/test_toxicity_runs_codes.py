"""Toxicity grammar, periodic runs and vector codes: against plain Python, planted cases and odd tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from foresail.llm import queries, runs, toxicity, vector_codes
from foresail.llm.factors import basic_factors, maximal_runs
from foresail.llm.gnat import Gnat
from foresail.llm.transducers import Transducer, compose, tabulate

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _brute_runs(x, shortest):
    found = {}
    for q in range(1, len(x) // 2 + 1):
        t = 0
        while t < len(x) - q:
            if x[t] != x[t + q]:
                t += 1
                continue
            s = t
            while t < len(x) - q and x[t] == x[t + q]:
                t += 1
            if t + q - s >= max(shortest, 2 * q):
                found.setdefault((s, t + q - s), q)
    return sorted((s, q, length) for (s, length), q in found.items())


def _found_runs(x, shortest):
    start, length, period = maximal_runs(np.array([0, *(c + 1 for c in x), max(x, default=0) + 2], np.int64), shortest)
    return list(zip((start - 1).tolist(), period.tolist(), length.tolist()))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=7), max_size=4), st.integers(1, 4), st.integers(2, 12))
def test_maximal_runs(parts, times, shortest):
    x = [c for p in parts for c in p * times]
    assert _found_runs(x, shortest) == _brute_runs(x, shortest)


def test_runs_of_special_words():
    fibonacci, before = [0, 1], [0]
    while len(fibonacci) < 200:
        fibonacci, before = fibonacci + before, fibonacci
    # Squares around a centre: many periods share one progression of factor occurrences.
    centre = [0, 1] * 30 + [0] + [0, 1] * 30
    for x in (fibonacci, centre, [0] * 150, [], [0], list(range(20)) * 2):
        assert _found_runs(x, 2) == _brute_runs(x, 2)


def test_basic_factors_name_equal_substrings():
    x = [0, 1, 2, 1, 2, 1, 2, 3, 9]
    for k, (names, active) in enumerate(basic_factors(np.array(x))):
        for a in range(len(x)):
            for b in range(a):
                same = x[a:a + 2**k] == x[b:b + 2**k] and a + 2**k <= len(x)
                assert (names[a] == names[b]) == same
        assert set(active.tolist()) == {a for a in range(len(x)) if (names == names[a]).sum() > 1}


def _periodic(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    return words


def _run_row(doc_id, text):
    words = _periodic(doc_id, text)
    ids = {}
    found = _brute_runs([ids.setdefault(w, len(ids)) for w in words], 12) if len(words) < 5000 else None
    if found is None:  # the long odd text: one word over and over
        assert len(set(words)) == 1
        found = [(0, 1, len(words))]
    gone = {i for s, q, length in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[2], r[0], r[1]), default=None)
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    longest = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    return (doc_id, len(found), *longest, digest("".join(f"{s},{length},{q}\n" for s, q, length in found)),
            digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periodic_run_query(spark, tiny, documents, odd_docs, tmp_path):
    odd_docs.withColumnRenamed("line", "start").write.parquet(f"{tmp_path}/documents.parquet")
    for folder, docs in ((tiny, documents), (str(tmp_path), odd_docs)):
        got = collections.Counter(tuple(r) for r in queries.op12_periodic_runs(spark, folder).collect())
        assert got == collections.Counter(_run_row(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert runs.find_runs(odd_docs.limit(0)).count() == 0


def test_texts_of_a_batch_do_not_mix(spark, monkeypatch):
    texts = ["a b " * 10, "a b " * 3, "", None, "x " * 11, "x " * 12 + "y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for at_once in (1, 30, 1 << 19):
        monkeypatch.setattr(runs, "WORDS_AT_ONCE", at_once)
        got = {r.doc_id: [tuple(x) for x in r.runs] for r in runs.find_runs(docs).collect()}
        assert got == {0: [(0, 20, 2)], 1: [], 2: [], 3: [], 4: [], 5: [(0, 12, 1)]}


@pytest.mark.parametrize("scale", [1, 1 << 40])
def test_gnat_is_exact(scale):
    rng = np.random.default_rng(3)
    for _ in range(60):
        high = int(rng.choice([2, 5, 5000]))
        entries = rng.integers(-high, high, (int(rng.integers(1, 40)), 3))
        rows = rng.integers(-high, high, (50, 3))
        kind = object if scale > 1 else np.int64
        index, distance = Gnat(entries.astype(kind) * scale).nearest(rows.astype(kind) * scale)
        every = ((rows[:, None] - entries[None]) ** 2).sum(axis=2)
        assert index.tolist() == every.argmin(axis=1).tolist()
        assert [int(d) for d in distance] == [int(d) * scale * scale for d in every.min(axis=1)]


def test_gnat_skips_subtrees(monkeypatch):
    rng = np.random.default_rng(4)
    entries = np.concatenate([rng.integers(0, 50, (100, 4)) + 100_000 * k for k in range(4)])
    looked = []
    from foresail.llm import gnat
    tree, real = Gnat(entries), gnat.squared
    monkeypatch.setattr(gnat, "squared", lambda rows, point: (looked.append(len(rows)), real(rows, point))[1])
    tree.nearest(rng.integers(0, 50, (100, 4)))
    assert sum(looked) < 100 * len(entries) / 3


def _brute_codes(rows, parts=8, entries=16, rounds=6):
    """Rows (vec_id, vector or None, label) by the definition, in Python's whole numbers."""
    kept = [(i, v, c) for i, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return {}, []
    length = max(1, -(-max(len(v) for _, v, _ in kept) // parts)) * parts
    whole = [[math.floor(x * 4096) if abs(x) < 2.0**53 else int(x) * 4096 for x in (*v, *[0.0] * (length - len(v)))] for _, v, _ in kept]
    width = length // parts
    cut = [[w[p * width:(p + 1) * width] for p in range(parts)] for w in whole]
    first = {}
    for (i, v, _), c in zip(kept, cut):
        key = (i is None, i or 0)
        first[key] = min(first.get(key, ((math.inf,), None)), ((*v, *[0.0] * (length - len(v))), c))
    books = [[list(first[k][1][p]) for k in sorted(first)[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (gap(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, code in zip(cut, codes) if code[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    codes = assign()
    error = [sum(gap(c[p], books[p][code[p]]) for p in range(parts)) for c, code in zip(cut, codes)]
    total = collections.Counter()
    for (_, _, label), e in zip(kept, error):
        total[label] += e
    fits = lambda x: x if x < 1 << 63 else None
    out = collections.Counter((i, "".join(f"{x:02x}" for x in code), fits(e), fits(total[label])) for (i, _, label), code, e in zip(kept, codes, error))
    return out, books


def _codes_equal(df, **more):
    coded, books = vector_codes.compress(df, **more)
    expect, expected_books = _brute_codes([(r.vec_id, r.embedding, r.label) for r in df.select("vec_id", "embedding", "label").collect()])
    assert collections.Counter(tuple(r) for r in coded.select("vec_id", "code", "error", "label_error").collect()) == collections.Counter(expect)
    if expect:
        assert books == expected_books
    return books


def test_vector_codes_equal_the_definition(spark, tiny):
    df = spark.read.parquet(f"{tiny}/embeddings.parquet")
    books = _codes_equal(df)
    row = queries.op13_vector_codes(spark, tiny).first()
    assert row.codebooks_sha256 == hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def test_vector_codes_of_odd_tables(spark):
    rng = np.random.default_rng(8)
    vector = lambda: [float(x) for x in rng.normal(size=16)]
    same = vector()
    rows = [(k, vector(), k % 3) for k in range(30)] + [
        (5, vector(), None), (5, same, 1), (40, same, None), (40, same, None), (None, same, None), (None, vector(), 9),
        (41, None, 1), (42, [*vector()[:15], None], 1), (43, [*vector()[:15], math.nan], 1), (44, [*vector()[:15], math.inf], 1),
        (45, [], 2), (46, vector()[:3], 2)]
    schema = "vec_id long, embedding array<double>, label int"
    extra = lambda df: df.selectExpr("*", "1 code", "2 error", "3 label_error", "4 of", "5 n", "6 vector", "7 part")
    _codes_equal(extra(spark.createDataFrame(rows, schema)))
    _codes_equal(extra(spark.createDataFrame(rows[:3], schema)))
    _codes_equal(spark.createDataFrame([], schema))
    huge = [(k, [x * 10.0 ** (3 * k) for x in vector()], k % 2) for k in range(20)] + [(30, [1.7e308] * 16, 0)]
    _codes_equal(spark.createDataFrame(huge, schema))


def test_many_labels_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "HOT_SHARE", 0.2)
    rng = np.random.default_rng(9)
    rows = [(k, [float(x) for x in rng.normal(size=8)], 0 if k < 30 else k if k < 50 else None) for k in range(60)]
    _codes_equal(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))


def test_composed_transducers():
    flip = Transducer(0, {(0, "a"): (1, "b", 1.0), (1, "a"): (0, "a", 0.5)})
    count = Transducer("none", {("none", "b"): ("one", "c", 2.0)})
    both = compose(flip, count, ["a", "x"])
    state, out, weight = both.start, [], 0.0
    for symbol in "aaxaa":
        state, symbol, w = both.step(state, symbol)
        out.append(symbol)
        weight += w
    assert out == ["c", "a", "x", "b", "a"] and weight == 1.0 + 2.0 + 0.5 + 1.0 + 0.5
    following, emitted = tabulate(both, ["a", "x"], ["c"])
    assert emitted[0] == [0, -1] and following[0][1] == 0


@pytest.mark.parametrize("text, expect", [
    ("You are an idiot.", {"insult+target": 1}), ("They saw the idiot there.", {"insult+target": 1}), ("That idiot, that moron!", {"insult": 2}),
    ("that stupid idiot", {"insults": 1}), ("That man is no idiot.", {"negated": 1}), ("No man of all those there was an idiot.", {"insult": 1}),
    ("The paper said that an idiot came.", {"reported": 1}), ('A sign: "idiot". Then an idiot.', {"reported": 1, "insult": 1}),
    ('An open " quote\nidiot', {"insult": 1}), ("I will kill you", {"threat+target": 1}), ("Kill the process.", {"threat": 1}),
    ("I will never hurt anyone", {"negated": 1}), ("idiot, I kill you", {"insult": 1, "threat+target": 1}), ("kill that idiot", {"insult+threat": 1}),
    ("kill you idiot", {"insult+threat+target": 1}), ("Du bist ein Idiot!", {"insult+target": 1}), ("Nothing here; you said so.", {}), ("", {}), (None, {}),
])
def test_clause_patterns(text, expect):
    matcher = toxicity.ClauseMatcher([])
    assert {p: n for p, n in zip(matcher.patterns, matcher(text)) if n} == expect


def _labelled(spark, toxic_word, n=300):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    docs, labels = [], []
    for k in range(n):
        text = [str(w) for w in rng.choice(words, 40)]
        if toxic := k % 6 == 0:
            for at in rng.choice(40, 4, replace=False):
                text[at] = toxic_word
        docs.append((k, " ".join(text) + "."))
        labels.append((k, int(toxic)))
    # One toxic text copied fifty times: its words are no evidence.
    copied = " ".join(f"copied{i}" for i in range(30))
    docs += [(n + k, f"{copied} {toxic_word}, {toxic_word}, {toxic_word}") for k in range(50)]
    labels += [(n + k, 1) for k in range(50)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learned_words_and_scores(spark):
    docs, labels = _labelled(spark, "wrzkl")
    model = toxicity.fit_model(docs, labels)
    assert model.words == ["wrzkl"]
    fresh = spark.createDataFrame([(1, "abc wrzkl def. wrzkl, you wrzkl!"), (2, "abc def"), (3, None), (4, "copied3 copied4 copied5")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.score(fresh, model).collect()}
    assert score[1] > 0.5 > 0.2 > score[2] == score[3] == score[4] > 0


def test_toxicity_learns_only_from_its_labels(spark, tiny, tmp_path):
    from pyspark.sql import functions as F
    spark.read.parquet(f"{tiny}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    spark.read.parquet(f"{tiny}/labels.parquet").withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))).write.parquet(f"{tmp_path}/labels.parquet")
    one, two = (sorted(map(tuple, queries.op11_toxicity(spark, folder).collect())) for folder in (tiny, str(tmp_path)))
    assert one == two
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= s <= 1 and p == (s >= 0.5) for i, h, s, p in one)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [(r.predicted, labels[r.doc_id]) for r in queries.op11_toxicity(spark, folder).collect() if r.held_out and labels.get(r.doc_id) is not None]
    assert sum(p == t for p, t in rows) >= 0.95 * len(rows)
    assert sum(p for p, t in rows if t == 0) <= 0.01 * len(rows)


def test_toxicity_of_odd_tables(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (9, None), (7, 5)], "doc_id long, toxic int")
    one_sided = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    for labels in (none, odd, one_sided):
        model = toxicity.fit_model(odd_docs, labels)
        assert model.words == []
        rows = toxicity.score(odd_docs, model).collect()
        assert collections.Counter(r.doc_id for r in rows) == collections.Counter(r.doc_id for r in odd_docs.collect())
        assert all(0 < r.score < 1 for r in rows)
    assert toxicity.fit_model(odd_docs, none) == toxicity.ToxicityModel()
    assert toxicity.score(odd_docs.limit(0), toxicity.ToxicityModel()).count() == 0
