"""Near copies, lines, passages, mixing and search against plain Python, and the pipeline's stages."""

import collections
import hashlib
import re

import numpy as np
import xxhash

import corpus_pipeline
from foresail.llm import common, hamming, lines, mixing, simhash, suffix_dedup
from foresail.llm.suffix_sort import BlindTrie, repeated

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FIRST = lambda i: (i is None, i or 0)


def _print(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    bits = np.unpackbits(np.array([xxhash.xxh64_intdigest(g.encode(), 42) for g in grams], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0) > len(grams), bitorder="little").view("<u8")[0]) if grams else 0


def _groups(prints):
    parent = list(range(len(prints)))
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                parent[root(a)] = root(b)
    return [root(k) for k in range(len(prints))]


def test_simhash_groups(odd_docs, documents):
    for docs in (odd_docs, documents):
        rows = docs.select("doc_id", "text").collect()
        group = _groups([_print(r.text) for r in rows])
        least = {}
        for r, g in zip(rows, group):
            least[g] = min((x for x in (least.get(g), r.doc_id) if x is not None), default=None)
        expect = collections.Counter((r.doc_id, _print(r.text), least[g]) for r, g in zip(rows, group))
        got = simhash.simhash_groups(docs, tile=7).collect()
        assert collections.Counter((r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in got) == expect
        kept = simhash.drop_near_copies(docs)
        assert kept.columns == docs.columns and kept.count() == len(set(group))
    assert simhash.simhash_groups(odd_docs.limit(0)).count() == 0


def test_tiles_keep_all_links():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    codes = np.unique(np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64))]))
    u, v = simhash.tile_links(codes, codes, True, 2)
    assert len(u) == len(codes) - len({_groups(list(map(int, codes)))[k] for k in range(len(codes))})


def _brute_lines(rows):
    seen, out = [], {}
    for r in sorted(set(rows), key=lambda r: FIRST(r[0])):
        gone = []
        for k, line in enumerate([] if r[1] is None else r[1].split("\n")):
            words = frozenset(WORD.findall(line))
            if words:
                if any(5 * len(words & s) >= 4 * len(words | s) for s in seen):
                    gone.append(k)
                seen.append(words)
        out[r] = gone
    return out


def test_lines(spark, documents, odd_docs):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    expect = _brute_lines(rows)
    got = lines.removed_lines(documents).collect()
    assert {r.doc_id: r.removed for r in got} == {k[0]: v for k, v in expect.items()}
    cleaned = lines.drop_lines(odd_docs)
    assert cleaned.columns == odd_docs.columns and cleaned.count() == odd_docs.count()
    texts = collections.Counter((r.doc_id, r.text) for r in cleaned.collect())
    assert texts[(1, odd_docs.where("doc_id = 1").first().text)] == 1 and texts[(2, "")] == 2 and texts[(3, None)] == 1
    assert lines.removed_lines(odd_docs.limit(0)).count() == 0


def test_lines_meet_by_neighbours(spark):
    """A word that many lines have brings no two of them together, at any share the result is exact."""
    from pyspark.sql import functions as F
    sets = [[f"shared{k % 3}", *(f"own{k}_{j}" for j in range(11))] for k in range(300)]
    docs = spark.createDataFrame([(k, " ".join(words)) for k, words in enumerate(sets)], "doc_id long, text string")
    found = lines.document_lines(docs, lambda h: h, (4, 5), "doc_id", "text").withColumns({"found": F.lit(None).cast("long"), "no": F.col("doc_id")})
    rows = lines.neighbour_rows(found, (4, 5))
    assert 0 < rows.count() <= 300 * 5 and rows.groupBy("pair").count().agg(F.max("count")).first()[0] == 1

    rng = np.random.default_rng(3)
    base = [[f"w{w}" for w in rng.choice(60, size, replace=False)] for size in (1, 2, 3, 4, 5, 6, 9, 12, 20, 30) for _ in range(4)]
    texts = []
    for k in range(60):
        cut = []
        for _ in range(8):
            words = list(base[rng.integers(len(base))])
            for _ in range(rng.integers(0, len(words) // 3 + 1)):
                words[rng.integers(len(words))] = f"w{rng.integers(60)}" if rng.random() < 0.5 else f"new{rng.integers(500)}"
            cut.append("  ".join(words))
        texts.append((k, "\n".join(cut)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for a, b in ((4, 5), (1, 2), (2, 5)):
        seen, expect = [], {}
        for doc, text in texts:
            expect[doc] = []
            for k, words in enumerate(frozenset(line.split()) for line in text.split("\n")):
                if any(b * len(words & s) >= a * len(words | s) for s in seen):
                    expect[doc].append(k)
                seen.append(words)
        assert any(expect.values()) and {r.doc_id: r.removed for r in lines.removed_lines(docs, share=(a, b)).collect()} == expect


def test_lines_of_a_crowd(spark, monkeypatch):
    """A passage that many lines quote brings none of them together, variants of one text meet by their sketches; the result is exact."""
    from pyspark.sql import functions as F
    monkeypatch.setattr(lines, "SAMPLE", 1)
    monkeypatch.setattr(lines, "CROWD", 20)
    rng = np.random.default_rng(8)
    filler = lambda n: [f"fill{w}" for w in rng.choice(120, n, replace=False)]
    texts = [filler(14) for _ in range(560)] + [[*(f"quoted{j}" for j in range(10)), *filler(14)] for _ in range(60)]
    for edits in rng.integers(0, 12, 80):
        words = [f"text{j}" for j in range(40)]
        for place in rng.choice(40, edits, replace=False):
            words[place] = f"fill{rng.integers(120)}"
        texts.append(words)
    rows = [(int(k), " ".join(texts[i])) for k, i in enumerate(rng.permutation(len(texts)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = lines.document_lines(docs, lines.rarity(docs, (4, 5)), (4, 5), "doc_id", "text").withColumns({"found": F.lit(None).cast("long"), "no": F.col("doc_id"), "at": F.col("doc_id")})
    assert lines.neighbour_rows(found, (4, 5)).groupBy("pair").count().agg(F.max("count")).first()[0] < 20
    crowd = {r.no: r for r in lines.crowd_rows(found).collect()}
    words = {k: set(text.split()) for k, text in rows}
    odd = lambda r, o: sum(((x ^ y) % (1 << 64)).bit_count() for x, y in zip(r.sketch, o.sketch))
    assert len(crowd) >= 40 and all(odd(crowd[x], crowd[y]) <= len(words[x] ^ words[y]) for x in crowd for y in crowd)
    expect = {k[0]: v for k, v in _brute_lines(rows).items()}
    assert 10 <= sum(map(bool, expect.values())) <= 80 and {r.doc_id: r.removed for r in lines.removed_lines(docs).collect()} == expect


def test_lines_few_sets_are_not_led(spark, monkeypatch):
    """Only neighbours that many sets drew lead to lines read again before the join; the result is exact, null ids and repeated rows included."""
    pairs, verified = [], lines._verified
    monkeypatch.setattr(lines, "_verified", lambda p, *rest: pairs.append(p.count()) or verified(p, *rest))
    variant = lambda g, k: " ".join(f"new{g}_{k}" if j == k % 30 else f"w{g}_{j}" for j in range(30))
    few = [(100 * k + g, f"{variant(g, k)}\n\n{variant(g, k)}\nown{g}_{k}") for g in range(20) for k in range(3)]
    few += [(None, variant(3, 9)), (None, variant(3, 9)), (5000, None), (5001, "")]
    many = [(k, variant(0, k)) for k in range(40)]
    for rows in (few, many):
        got = lines.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_lines", "removed").collect()
        expect = _brute_lines(rows)
        assert sorted(map(repr, got)) == sorted(repr(type(got[0])(doc_id=d, n_lines=0 if t is None else t.count("\n") + 1, removed=gone)) for (d, t), gone in expect.items())
        assert sum(map(len, expect.values())) > len(rows) / 2
    assert pairs[0] == 0 < pairs[1] and pairs[2] > 0


def _brute_passages(rows, span=50):
    seen, out, waiting = set(), collections.Counter(), []
    for doc, text in sorted(rows, key=lambda r: FIRST(r[0])):
        if waiting and waiting[0] != doc:
            seen.update(*waiting[1:])
            waiting = []
        raw = (text or "").encode()
        windows = [raw[i:i + span] for i in range(len(raw) - span + 1)]
        gone = np.zeros(len(raw), bool)
        for i, w in enumerate(windows):
            if w in seen:
                gone[i:i + span] = True
        waiting = [doc, *waiting[1:], windows]
        out[(doc, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest(), int(gone.sum()))] += 1
    return out


def test_passages(documents, odd_docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 60_000)
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 30_000)  # the long text is cut into overlapping slices
    for docs in (documents, odd_docs):
        got = suffix_dedup.dedup_passages(docs).collect()
        found = collections.Counter((r.doc_id, hashlib.sha256(r.kept).hexdigest(), len(r.text) - len(r.kept)) for r in got)
        assert found == _brute_passages([(r.doc_id, r.text) for r in docs.collect()])
    assert suffix_dedup.dedup_passages(odd_docs.limit(0)).count() == 0


def test_repeated_bytes_are_sent_once(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 30_000)
    texts = [" " * 90_000, "word " * 9_000 + "end", "x" * 70 + " " * 20_000, "-" * 49, "-" * 50 + "word " * 4_000, None, " " * 90_000]
    docs = spark.createDataFrame([*enumerate(texts), (1, " " * 200), (None, "word " * 100)], "doc_id long, text string").coalesce(2)
    docs = docs.union(docs.where("doc_id = 2")).union(docs.where("doc_id = 2"))
    got = suffix_dedup.dedup_passages(docs).collect()
    found = collections.Counter((r.doc_id, hashlib.sha256(r.kept).hexdigest(), len(r.text) - len(r.kept)) for r in got)
    assert found == _brute_passages([(r.doc_id, r.text) for r in docs.collect()])
    sent = suffix_dedup.piece_blocks(suffix_dedup._keyed(docs, "doc_id", "text").select("doc", "key", "text"), 8, 50)
    assert sum(len(r.block or b"") for r in sent.collect()) < 0.2 * sum(len(r.text or "") for r in docs.collect())
    pieces, _ = suffix_dedup.cut([b" " * 30_000], np.zeros(1, np.int64), np.zeros(1, np.int64), 50)
    assert len(pieces.left) > 29_000  # a piece for every byte, were they all sent


def test_blind_trie_sorts():
    rng = np.random.default_rng(2)
    words = [bytes(rng.integers(97, 99, 9).astype(np.uint8)) for _ in range(300)]
    trie = BlindTrie()
    for k, w in enumerate(words):
        trie.insert(w, k)
    assert [s for s, _ in trie.ordered()] == sorted(set(words)) and sum(len(m) for _, m in trie.ordered()) == 300
    text = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123" * 2 + bytes(8), np.uint8)
    index, group = repeated(text, np.array([0, 30, 1]), 28, np.array([1, 2, 3]))
    assert index.tolist() == [0, 1] and group.tolist() == [0, 0]


def test_mixing(odd_docs, documents):
    for docs in (odd_docs, documents):
        mixed = mixing.mix(docs).collect()
        assert len(mixed) == docs.count() and all(0 <= r.copies <= 2 for r in mixed)
        total = sum(r.size for r in mixed)
        by = collections.defaultdict(list)
        for r in mixed:
            by[(r.source is None, r.source or "")].append(r)
        assert abs(sum(rows[0].target for rows in by.values()) - 1.5 * total) < 1e-6 * max(1, total)
        for rows in by.values():
            assert rows[0].target <= 2 * rows[0].source_size + 1e-9
            assert abs(sum(r.copies * r.size for r in rows) - rows[0].target) <= max(r.size for r in rows)
        again = mixing.mix(docs.repartition(5)).collect()
        order = lambda rows: sorted((FIRST(r.doc_id), r.text_hash or 0, r.copies) for r in rows)
        assert order(mixed) == order(again)
        made = mixing.mixed_documents(docs)
        assert made.columns == docs.columns and made.count() == sum(r.copies for r in mixed)
    assert mixing.mix(odd_docs.limit(0)).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.standard_normal(64).tolist()) for k in range(150)] + [(200 + k, [1.0] * 64) for k in range(30)] + [(300, None), (None, [1.0, None]), (200, [1.0] * 64)]
    codes = common.settle_table(hamming.sign_codes(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), "codes")
    plain = [(r.id, r.code % (1 << 64)) for r in codes.collect()]
    got = collections.defaultdict(list)
    for r in hamming.top_k(codes, codes.where("id % 50 = 0"), k=4).collect():
        got[r.query_id].append((r.rank, r.neighbor_id, r.distance))
    for q, code in {p for p in plain if p[0] is not None and p[0] % 50 == 0}:
        best = sorted(((code ^ c).bit_count(), FIRST(i)) for i, c in plain if i != q)[:4]
        assert sorted(got[q]) == [(k + 1, None if n[0] else n[1], d) for k, (d, n) in enumerate(best)]
    assert hamming.top_k(codes.limit(0), codes.limit(0)).count() == 0


def test_pipeline_stages(spark, tiny, odd_docs):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.settle_table(stage(spark, docs, tiny), name)
        assert after.columns == docs.columns, name
        assert stage(spark, odd_docs, tiny).columns == odd_docs.columns
        assert stage(spark, docs.limit(0), tiny).count() == 0
        docs = after
    assert corpus_pipeline.STAGES[-1][1](spark, docs, tiny).count() == docs.count() > 0
