"""Whole results against plain Python: secrets, chats, kept documents, decoding and the pipeline's rows."""

import collections
import hashlib
import re
import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from foresail.llm import bpe, chat, common, hamming, mixing, quality, queries, secrets
from foresail.llm.wavelet import WaveletMatrix
from test_corpus_operators import FIRST, _brute_lines, _groups, _print
from test_text_operators import SAID, _brute_stats

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


def _brute_base(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    count = [sum(k == n for _, k, _ in found) for n in range(3)]
    return (*count, sha(",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))))


def test_base_secrets_of_whole_tables(spark, documents, odd_docs):
    made = ["token: 'abc", "API_KEY=a.b-c=dé password==x123456", "secret\t:abcdef", "AKIA" + "A1" * 8 + " AKIAAKIA" + "0" * 30, "ſecret=abcdefgh toKen = abcdefgh",
            "0123456789abcdef" * 40_000, "x" * 30 + "deadbeef" * 3 + "X", "token=" + "a" * 24 + " api_key:'deadbeefdeadbeefdeadbeef"]
    extra = spark.createDataFrame([(5000 + k, t) for k, t in enumerate(made)], "doc_id long, text string")
    for docs in (documents.select("doc_id", "text").union(extra), odd_docs):
        got = secrets.span_digest(secrets.find_secrets(docs)).collect()
        assert collections.Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == collections.Counter(
            (r.doc_id, *_brute_base(r.text)) for r in docs.select("doc_id", "text").collect())
        for r in got:  # the method only adds spans
            assert sum(not s.startswith("grammar:") for s in r.spans.split(",") if s) == r.n_assign + r.n_access + r.n_hex


def test_many_secrets_in_one_text(spark):
    text = " ".join(f"{k:x}".rjust(8, "f") * 5 for k in range(6000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    begin = time.perf_counter()
    assert secrets.span_digest(secrets.find_secrets(docs)).first().n_hex == 6000
    assert time.perf_counter() - begin < 60
    reach = secrets._Reach([(0, 0, 10, ""), (2, 1, 4, ""), (20, 0, 25, "")])
    covers = [(a, b) for a in range(30) for b in range(a + 1, 31) if reach.covers(a, b)]
    touches = [(a, b) for a in range(30) for b in range(a + 1, 31) if reach.touches(a, b)]
    spans = [(0, 10), (2, 4), (20, 25)]
    assert covers == [(a, b) for a in range(30) for b in range(a + 1, 31) if any(s <= a and b <= e for s, e in spans)]
    assert touches == [(a, b) for a in range(30) for b in range(a + 1, 31) if any(s < b and a < e for s, e in spans)]


def _brute_chat(turns):
    """Rows (turn, role, text) of one conversation, in order."""
    said, loss, chars = "", "", len("<s>")
    for _, role, text in turns:
        role, text = role or "", text or ""
        said += f"{role}\n{text}\n"
        if role == "user":
            chars += len("[INST]") + len(chat.escape(text)) + len("[/INST]")
        elif role == "assistant":
            chars += len("[REPLY]") + len(chat.escape(text)) + len("</s>")
            loss += text
        else:
            chars += len("[ROLE]") + len(chat.escape(role)) + len("[TEXT]") + len(chat.escape(text)) + len("[/ROLE]")
    return len(turns), sha(said), len(loss), sha(loss), chars


def _chats(rows):
    held = collections.defaultdict(list)
    for r in rows:
        held[r.conv_id].append((r.turn, r.role, r.text))
    none_first = lambda x: (x is not None, x if x is not None else 0)
    text_first = lambda x: (x is not None, (x or "").encode())
    return {c: _brute_chat(sorted(t, key=lambda x: (none_first(x[0]), text_first(x[1]), text_first(x[2])))) for c, t in held.items()}


def test_all_conversations(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    probe = spark.createDataFrame([(-7, 0, "user", SAID), (-7, 1, "assistant", SAID)], "conv_id long, turn long, role string, text string").collect()
    got = {r.conv_id: tuple(r)[1:] for r in queries.op2_chat_format(spark, tiny).collect()}
    assert got == _chats([*rows, *probe])


def test_odd_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "b"), (1, None, "user", None), (None, 3, "assistant", SAID), (None, 3, None, None),
            (2, 1, "", ""), (3, 1, "[ROLE]", "\\[/ROLE]\\"), (4, 1, "assistant", "word " * 40_000), (4, 0, "user", "é\x00\u2028</s>")]
    turns = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, ids string, part int, mask int")
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = chat.read_chat(common.settle_table(chat.format_chat(turns, path, part_tokens=100), "odd-chat"), path).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == _chats(turns.collect()) and len(got) == 5


def _holds(rules, text):
    """The decision list's verdict and the base rules in plain Python."""
    n, chars, symbols, dup, repeat = _brute_stats(text)
    lines = len([x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")])
    share = lambda a, b: a / b if b else 0.0
    values = {"n_words": float(n), "mean_word": share(chars, n), "symbol_share": share(symbols, chars), "dup_line_share": share(dup, lines), "repeat_share": share(repeat, n)}
    failed = n < 10 or 100 * repeat > 20 * n
    rejected = any(all(values[t.feature] > t.value if t.above else values[t.feature] <= t.value for t in rule) for rule in rules)
    return failed, not failed and not rejected


def test_kept_documents(spark, documents, odd_docs):
    cut = quality.Threshold
    made = [(cut("symbol_share", True, 0.001),), (cut("mean_word", True, 4.0), cut("n_words", False, 60.0)), (cut("dup_line_share", True, 0.1), cut("repeat_share", True, 0.0))]
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    learned = quality.fit_rules(docs, labels)
    assert learned  # else nothing would be compared
    for rules, table in ((made, documents), (made, odd_docs), (learned, docs), (learned, odd_docs)):
        rows = table.select("doc_id", "text").collect()
        got = collections.Counter((r.doc_id, r.base_failed, r.kept) for r in quality.quality_table(table, rules).collect())
        assert got == collections.Counter((r.doc_id, *_holds(rules, r.text)) for r in rows)
        kept = collections.Counter((r.doc_id, r.text) for r in quality.keep_good(table, rules).collect())
        assert kept == collections.Counter((r.doc_id, r.text) for r in rows if _holds(rules, r.text)[1])


def test_odd_labels_give_no_rules(spark, documents):
    for rows in ([], [(1, 1), (2, 1)], [(1, 0)], [(None, 0), (3, None)]):
        assert quality.fit_rules(documents, spark.createDataFrame(rows, "doc_id long, quality int")) == []


def test_decoding_from_ids(spark, documents, odd_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    clash = documents.select("doc_id", "text").selectExpr("*", "'x' ids", "'y' n_tokens", "'z' token")
    for docs in (clash, odd_docs):
        coded = common.settle_table(bpe.encode(docs, path), "ids")
        ids = collections.Counter((r.doc_id, tuple(r.ids)) for r in coded.collect())
        expect = [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()]
        assert ids == collections.Counter((d, tuple(i)) for d, i in expect)
        assert collections.Counter((r.doc_id, r.text) for r in bpe.decode(coded, path).collect()) == collections.Counter(
            (d, library.decode(i, skip_special_tokens=False)) for d, i in expect)


def test_long_words_have_their_own_tree():
    path = public_tokenizers.path("word_bpe_49k.json")
    coder, library = bpe.WordBpe(path), Tokenizer.from_file(path)
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("etaoinshr"), n)) for n in (1, 2, 3, 8, 9, 100, 1023, 1024, 5000)] + ["a" * 3000, "ab" * 700]
    for word in words:
        raw = np.frombuffer(word.encode(), np.uint8)
        ids = [*coder.inside[raw[:-1]].tolist(), int(coder.last[raw[-1]])]
        want = library.encode(word, add_special_tokens=False).ids
        assert bpe.merge_word(ids, coder.pairs) == want
        row = np.full((1, max(2, 1 << (len(ids) - 1).bit_length())), -1, np.int64)
        row[0, :len(ids)] = ids
        merged = bpe.merge_words(row, coder.pairs)
        assert merged[merged >= 0].tolist() == want
    begin = time.perf_counter()
    coder._learn_words(["".join(rng.choice(list("etaoinshr"), 60_000))])
    assert time.perf_counter() - begin < 10


def test_what_does_not_fit_is_an_error(spark):
    with pytest.raises(ValueError, match="16 bits"):
        WaveletMatrix.build(np.array([1, 65_536]))
    with pytest.raises(Exception, match="more than 64 components"):
        hamming.sign_codes(spark.createDataFrame([(1, [1.0] * 65)], "vec_id long, embedding array<float>")).collect()


def test_search_among_clashing_columns(spark):
    rows = [(k, [1.0 if k >> i & 1 else -1.0 for i in range(5)]) for k in range(20)] + [(3, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "7 id", "8 code", "9 query", "1 bound", "2 distance")
    codes = common.settle_table(hamming.sign_codes(vectors), "clash-codes")
    got = hamming.top_k(codes, codes.where("id = 3"), k=3).collect()
    plain = [(r.id, r.code) for r in codes.collect()]
    for query, code in {p for p in plain if p[0] == 3}:
        best = sorted(((code ^ c).bit_count(), i) for i, c in plain if i != 3)[:3]
        assert [(r.distance, r.neighbor_id) for r in got].count(best[0]) >= 1
    assert len(got) == 6


def test_pipeline_rows(spark, tiny):
    """Every stage in plain Python; copies by the mixing operator itself, whose invariants have a test of their own."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rules = quality.fit_rules(docs, spark.read.parquet(f"{tiny}/labels.parquet"))
    rows = [r.asDict() for r in docs.collect() if _holds(rules, r.text)[1]]
    gone = _brute_lines([(r["doc_id"], r["text"]) for r in rows])
    for r in rows:
        lines = gone[r["doc_id"], r["text"]]
        r["text"] = r["text"] if not lines else "\n".join(x for k, x in enumerate(r["text"].split("\n")) if k not in lines)
        r["n_chars"] = len(r["text"])
    groups = _groups([_print(r["text"]) for r in rows])
    best = {}
    for r, g in zip(rows, groups):
        best[g] = min(best.get(g, r), r, key=lambda x: FIRST(x["doc_id"]))
    single = list(best.values())
    mixed = mixing.mix(spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in single], docs.schema))
    copies = {r.doc_id: r.copies for r in mixed.collect()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expect = collections.Counter()
    for r in single:
        expect[r["doc_id"], tuple(library.encode(r["text"], add_special_tokens=False).ids)] += copies[r["doc_id"]]
    got = collections.Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, tiny).collect())
    assert got == +expect and len(got) > 50
