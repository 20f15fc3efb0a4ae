"""Byte-pair encoding by a segment tree over adjacent pair ranks.

Each word's symbols are the leaves; a leaf holds rank * width + position of the pair that starts
there, an inner node the minimum of its children. The root is therefore the leftmost pair of the
lowest rank. A merge changes three leaves and the logarithmically many nodes above them, until the
root holds no pair. The trees of all new words of a batch are kept in one array and advance together,
so the Python interpreter runs once per merge step and not once per word."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from foresail.llm.common import map_arrow

#: From this many bytes on a word has a tree of its own, in plain numbers: arrays only pay for many words at once.
_WIDE = 1024
#: Words encoded together, and distinct chunks remembered by a Python worker before it starts anew.
_TOGETHER, _REMEMBERED = 8192, 500_000

#: Ids joined by spaces, vocabulary strings joined by spaces, number of ids.
Coded = tuple[str, str, int]


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    made, extra = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in made:
            made[b] = chr(extra)
            extra += 1
    return [made[b] for b in range(256)]


class PairTable:
    """Rank and result of every mergeable pair of token ids, looked up for whole arrays."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.base = max(vocab.values()) + 2
        key = np.array([vocab[a] * self.base + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        _, first = np.unique(key, return_index=True)
        self.key, self.rank, self.made = key[first], first.astype(np.int64), made[first]
        self._known: dict[int, tuple[int, int]] | None = None

    def known(self) -> dict[int, tuple[int, int]]:
        """The table by pair, for single words; made when the first one needs it."""
        if self._known is None:
            self._known = dict(zip(self.key.tolist(), zip(self.rank.tolist(), self.made.tolist())))
        return self._known

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index into the table and whether the pair is there; a negative id pairs with nothing."""
        want = left * self.base + right
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return at, (self.key[at] == want) & (left >= 0) & (right >= 0)


def merge_words(symbols: np.ndarray, pairs: PairTable) -> np.ndarray:
    """Merge every row of ``symbols`` (ids, -1 after the end) to its end; merged-away places become -1."""
    n, width = symbols.shape
    no_pair = np.int64(len(pairs.key)) * width  # above rank * width + place of every pair
    ids = symbols.copy()
    rows = np.arange(n)
    follow = np.where(np.arange(width) + 1 < (symbols >= 0).sum(axis=1)[:, None], np.arange(1, width + 1), width)
    before = np.broadcast_to(np.arange(-1, width - 1), (n, width)).copy()
    made = np.zeros((n, width), np.int64)
    tree = np.full((n, 2 * width), no_pair, np.int64)

    def leaf(row: np.ndarray, place: np.ndarray) -> None:
        nxt = follow[row, place]
        right = np.where(nxt < width, ids[row, np.minimum(nxt, width - 1)], -1)
        at, there = pairs.find(ids[row, place], right)
        made[row, place] = pairs.made[at]
        tree[row, width + place] = np.where(there, pairs.rank[at] * width + place, no_pair)

    def lift(row: np.ndarray, place: np.ndarray) -> None:
        node = (width + place) >> 1
        while node.size and node[0]:
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
            node = node >> 1

    everywhere = np.nonzero(symbols >= 0)
    leaf(*everywhere)
    level = width >> 1
    while level:
        tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2])
        level >>= 1
    root = 1 if width > 1 else 0
    live = rows[tree[:, root] < no_pair] if width > 1 else rows[:0]
    while live.size:
        place = tree[live, root] % width
        gone = follow[live, place]
        ids[live, place] = made[live, place]
        ids[live, gone] = -1
        nxt = follow[live, gone]
        follow[live, place] = nxt
        inner = nxt < width
        before[live[inner], nxt[inner]] = place[inner]
        tree[live, width + gone] = no_pair
        leaf(live, place)
        prior = before[live, place]
        has = prior >= 0
        leaf(live[has], prior[has])
        lift(live, gone)
        lift(live, place)
        lift(live[has], prior[has])
        live = live[tree[live, root] < no_pair]
    return ids


def merge_word(symbols: list[int], pairs: PairTable) -> list[int]:
    """The same for one word, of any length: its ids after all merges."""
    known, base = pairs.known(), pairs.base
    n = len(symbols)
    width = 1 << (n - 1).bit_length() if n > 1 else 1
    no_pair = len(pairs.key) * width
    ids, follow, before = list(symbols), [*range(1, n), -1], list(range(-1, n - 1))
    tree = [no_pair] * (2 * width)

    def rank(place: int) -> int:
        nxt = follow[place]
        found = known.get(ids[place] * base + ids[nxt]) if nxt >= 0 else None
        return no_pair if found is None else found[0] * width + place

    def put(place: int, value: int) -> None:
        node = width + place
        tree[node] = value
        node >>= 1
        while node:
            low, high = tree[2 * node], tree[2 * node + 1]
            least = low if low < high else high
            if tree[node] == least:
                break
            tree[node] = least
            node >>= 1

    tree[width:width + n] = [rank(place) for place in range(n)]
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    while width > 1 and tree[1] < no_pair:
        place = tree[1] % width
        gone = follow[place]
        ids[place] = known[ids[place] * base + ids[gone]][1]
        ids[gone], follow[place] = -1, follow[gone]
        if follow[gone] >= 0:
            before[follow[gone]] = place
        put(gone, no_pair)
        put(place, rank(place))
        if before[place] >= 0:
            put(before[place], rank(before[place]))
    return [i for i in ids if i >= 0]


class WordBpe:
    """Encoder for a tokenizer file of words with an end mark: composed, lower-cased, white space dropped.

    Gives the ids that the file's own library gives without added special tokens; the strings of the
    file's special tokens inside a text become their ids, as there."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"]
        self.pairs = PairTable(self.vocab, [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]])
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.token = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.any_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        letters = byte_alphabet()
        self.inside = np.array([self.vocab[c] for c in letters], np.int64)
        self.last = np.array([self.vocab[c + self.suffix] for c in letters], np.int64)
        self.digits = [str(i) for i in range(max(self.token) + 1)]
        self.strings = [self.token.get(i, "") for i in range(max(self.token) + 1)]
        self.words: dict[str, Coded] = {}
        self.chunks: dict[str, Coded] = {}
        self.older: dict[str, Coded] = {}

    def _learn_words(self, words: list[str]) -> None:
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            raw = word.encode("utf-8", "surrogatepass")
            if len(raw) >= _WIDE:
                ids = merge_word([*self.inside[np.frombuffer(raw[:-1], np.uint8)].tolist(), int(self.last[raw[-1]])], self.pairs)
                self.words[word] = (" ".join([self.digits[i] for i in ids]), " ".join([self.strings[i] for i in ids]), len(ids))
                continue
            by_width.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((word, raw))
        for width, group in by_width.items():
            # Wide trees in smaller lots: the lot's memory stays the same, whatever the words' length.
            lot = max(1, min(_TOGETHER, (1 << 18) // width))
            for k in range(0, len(group), lot):
                part = group[k:k + lot]
                size = np.array([len(raw) for _, raw in part])
                flat = np.frombuffer(b"".join(raw for _, raw in part), np.uint8)
                ids = np.full((len(part), width), -1, np.int64)
                ids[np.arange(width) < size[:, None]] = self.inside[flat]
                ids[np.arange(len(part)), size - 1] = self.last[flat[np.cumsum(size) - 1]]
                out = merge_words(ids, self.pairs)
                keep = out >= 0
                flat_ids, ends = out[keep].tolist(), np.cumsum(keep.sum(axis=1)).tolist()
                digits, strings = [self.digits[i] for i in flat_ids], [self.strings[i] for i in flat_ids]
                begin = 0
                for (word, _), end in zip(part, ends):
                    self.words[word] = (" ".join(digits[begin:end]), " ".join(strings[begin:end]), end - begin)
                    begin = end

    def _parts(self, chunk: str) -> list[str | int]:
        """Words and special ids of one run without white space."""
        if chunk.isascii():
            if chunk.isalpha():
                return [chunk.lower()]
            if "<|" not in chunk:
                return self.word.findall(chunk.lower())
        out: list[str | int] = []
        for piece in self.any_special.split(chunk) if "<|" in chunk else [chunk]:
            if piece in self.special:
                out.append(self.special[piece])
            elif piece:
                out += self.word.findall(piece.lower() if piece.isascii() else self.normalizer.normalize_str(piece))
        return out

    def learn(self, chunks: set[str]) -> dict[str, Coded]:
        """Codes of at least all given runs; remembers two generations of runs, so memory is bounded."""
        if len(self.chunks) > _REMEMBERED:
            self.chunks, self.older = {}, self.chunks
            self.words = {}
        fresh = chunks.difference(self.chunks)
        parts = {}
        for c in fresh:
            if (known := self.older.get(c)) is not None:
                self.chunks[c] = known
            else:
                parts[c] = self._parts(c)
        self._learn_words(list({w for p in parts.values() for w in p if w.__class__ is str}.difference(self.words)))
        for chunk, found in parts.items():
            coded = [(self.digits[p], self.strings[p], 1) if p.__class__ is int else self.words[p] for p in found]
            self.chunks[chunk] = coded[0] if len(coded) == 1 else (" ".join(x[0] for x in coded), " ".join(x[1] for x in coded), sum(x[2] for x in coded))
        return self.chunks


_SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_RUN = regex.compile(f"[^{_SPACE}]+")


def runs(text: str) -> list[str]:
    """Runs without Unicode white space; U+001C to U+001F, which ``str.split`` takes for space, are not."""
    return _RUN.findall(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordBpe:
    return WordBpe(path)


def _encoded(batch: pa.RecordBatch, path: str) -> Iterator[tuple[int, str, str, int]]:
    """(row, ids joined by spaces, decoded text, number of ids) for each row of a batch's second column."""
    coder = _encoder(path)
    at = 0
    while at < batch.num_rows:
        texts, size, begin = [], 0, at
        while at < batch.num_rows and (not texts or size < 8_000_000):
            texts.append(runs(batch.column(1)[at].as_py() or ""))
            size += sum(map(len, texts[-1]))
            at += 1
        known = coder.learn(set().union(*texts))
        for k, parts in enumerate(texts):
            if not parts:
                yield begin + k, "", "", 0
                continue
            ids, strings, sizes = zip(*map(known.__getitem__, parts))
            if 0 in sizes:  # a run that normalizes to nothing
                ids, strings = [x for x in ids if x], [x for x in strings if x]
            yield begin + k, " ".join(ids), " ".join(strings), sum(sizes)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids array<int>) for every row; a null or blank text has no ids. Other columns are not read."""
    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for begin in range(0, batch.num_rows, 1000):
            piece = batch.slice(begin, 1000)
            ids = [np.fromstring(x[1], np.int32, sep=" ") if x[1] else np.zeros(0, np.int32) for x in _encoded(piece, path)]
            counts = pa.array(map(len, ids), pa.int64())
            yield pa.RecordBatch.from_arrays([piece.column(0), counts, pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "n_tokens", "ids"])
    return map_arrow(_narrow(docs, id_col, text_col), rows, "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the vocabulary's strings joined by spaces, as a file without a decoder decodes; null ids give ''."""
    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        token = _encoder(path).token
        text = [" ".join(token[i] for i in x or () if i in token) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["doc_id", "text"])
    return map_arrow(encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")), rows, "doc_id long, text string")


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row, without moving ids between processes.

    One pass and no shuffle: a word's ids and decoded string are remembered together, so the decoded
    text of a document is put together from the same encoding."""
    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        count, ids, text = [], [], []
        for _, joined, decoded, n in _encoded(batch, path):
            count.append(n)
            ids.append(hashlib.sha256(joined.encode()).hexdigest())
            text.append(hashlib.sha256(decoded.encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(count, pa.int64()), pa.array(ids), pa.array(text)],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return map_arrow(_narrow(docs, id_col, text_col), rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
