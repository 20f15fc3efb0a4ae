"""Remove text that repeats a passage of an earlier document, byte by byte and exactly.

A byte goes if it lies in a string of ``span`` bytes that also starts in a document with a smaller id.
Equal strings choose the same anchor, the 8 bytes of smallest hash inside them. So all windows of a
text that share an anchor are cut out as one piece of at most 2 * span - 8 bytes and sent to the
bucket of the anchor, where every equal window of any document arrives too. A bucket orders the
suffixes of its pieces by deep-shallow sorting (``suffix_sort``); neighbours with a common prefix of
``span`` bytes are equal windows, and the smallest document of each run keeps its bytes.

Before the shuffle, pieces that a smaller document of the same batch has word for word are settled on
the spot and not sent, so a passage shared by a third of all documents reaches its bucket about once
per batch. Of pieces that a document repeats within a batch only the first is sent whole, for the others
(twins) their places: a megabyte of spaces is one piece of bytes. Pieces, and at the end the texts that
the found ranges are cut from, travel compressed, many to a row."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from foresail.llm.common import settle_table
from foresail.llm.suffix_sort import repeated

ANCHOR = 8
#: Bytes of text cut into pieces at a time, bytes of pieces packed together, and text whose pieces make one bucket on average.
BATCH_BYTES, HELD_BYTES, BUCKET_BYTES = 1 << 20, 40 << 20, 6 << 20
_PRESS_LEVEL = 6
_LAST = (1 << 63) - 1
_PLACE = np.uint64((1 << 24) - 1)


class Pieces:
    """Columns of pieces: document and row key, place in the text, bytes before and from the anchor, content."""

    def __init__(self, doc: np.ndarray, key: np.ndarray, pos: np.ndarray, left: np.ndarray, right: np.ndarray, flat: np.ndarray, begin: np.ndarray):
        self.doc, self.key, self.pos, self.left, self.right, self.flat, self.begin = doc, key, pos, left, right, flat, begin

    def aligned(self, span: int) -> np.ndarray:
        """One row of bytes per piece with the anchors under each other, zero outside."""
        before = span - ANCHOR
        width = -(-(before + span) // 8) * 8
        out = np.zeros((len(self.left), width), np.uint8)
        column = np.arange(width, dtype=np.int32) - before
        for at in range(0, len(out), 1 << 14):
            part = slice(at, at + (1 << 14))
            inside = (column >= -self.left[part, None]) & (column < self.right[part, None])
            source = (self.begin[part] + self.left[part])[:, None] + column
            out[part][inside] = self.flat[source[inside]]
        return out

    def content(self) -> np.ndarray:
        """The pieces' bytes one after the other."""
        size = self.left + self.right
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.begin - (ends - size), size) + np.arange(size.sum())]

    def take(self, rows: np.ndarray) -> Pieces:
        return Pieces(self.doc[rows], self.key[rows], self.pos[rows], self.left[rows], self.right[rows], self.flat, self.begin[rows])


def cut(texts: list[bytes], docs: np.ndarray, keys: np.ndarray, span: int) -> tuple[Pieces, np.ndarray]:
    """All pieces of some texts and their anchors' hashes."""
    size = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer(b"".join(texts) + bytes(2 * span), np.uint8)
    n = int(size.sum())
    ends = np.cumsum(size)
    word = np.ndarray(n + 2 * span - 7, "<u8", flat.data, 0, (1,))
    with np.errstate(over="ignore"):
        mixed = word[:n + span] * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    best = (mixed & ~_PLACE) | np.arange(len(mixed), dtype=np.uint64)
    windows = span - ANCHOR + 1
    reach = 1
    while 2 * reach <= windows:
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    best = np.minimum(best[:-(windows - reach)], best[windows - reach:]) if windows > reach else best
    counts = np.maximum(size - span + 1, 0)
    owner = np.repeat(np.arange(len(texts)), counts)
    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + (ends - size)[owner]
    chosen = best[start]
    first = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])])) if len(start) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(start))[:len(first)] - 1
    anchor = (chosen[first] & _PLACE).astype(np.int64)
    who = owner[first]
    pieces = Pieces(docs[who], keys[who], start[first] - (ends - size)[who], anchor - start[first], start[last] + span - anchor, flat, start[first])
    return pieces, chosen[first] >> np.uint64(24)


def _fingerprint(rows: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of bytes (a multiple of 8) and of further columns."""
    out = np.full(len(rows), 0x243F6A8885A308D3, np.uint64)
    with np.errstate(over="ignore"):
        for column in (*np.ascontiguousarray(rows).view("<u8").T, *(m.astype(np.uint64) for m in more)):
            out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
    return out


def _copies(pieces: Pieces, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per piece: the first equal piece (smallest document, then row), and whether that is a smaller document's."""
    print_ = _fingerprint(table, pieces.left, pieces.right)
    order = np.lexsort((pieces.doc, print_))
    head = np.concatenate([[True], print_[order][1:] != print_[order][:-1]]) if len(order) else np.zeros(0, bool)
    first = np.empty(len(order), np.int64)
    first[order] = order[np.flatnonzero(head)][np.cumsum(head) - 1] if len(order) else order
    moved = np.flatnonzero(first != np.arange(len(first)))
    same = (table[moved] == table[first[moved]]).all(axis=1) & (pieces.left[moved] == pieces.left[first[moved]]) & (pieces.right[moved] == pieces.right[first[moved]])
    first[moved[~same]] = moved[~same]  # hashes agree, bytes don't
    return first, pieces.doc[first] < pieces.doc


def _merge(key: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges joined where they touch or overlap, per key."""
    if not len(key):
        return key, begin, end
    order = np.lexsort((begin, key))
    key, begin, end = key[order], begin[order], end[order]
    shift = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) * (1 << 33)
    reach = np.maximum.accumulate(end + shift)
    fresh = np.concatenate([[True], (begin + shift)[1:] > reach[:-1]])
    at = np.flatnonzero(fresh)
    return key[at], begin[at], (reach - shift)[np.append(at[1:], len(key)) - 1]


#: Pieces that repeat another one of their document: key, place, and that piece's number.
Twins = tuple[np.ndarray, np.ndarray, np.ndarray]


def earlier_windows(pieces: Pieces, span: int, twins: Twins) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, begin, end): merged ranges of the windows of a bucket's pieces and twins that a smaller document has too."""
    table = pieces.aligned(span)
    first, gone = _copies(pieces, table)
    size = (pieces.left + pieces.right).astype(np.int64)
    own = np.flatnonzero((first != np.arange(len(first))) & ~gone)
    # A piece that repeats within one document shares the verdict of its first.
    twin_key, twin_pos = np.concatenate([twins[0], pieces.key[own]]), np.concatenate([twins[1], pieces.pos[own]])
    twin_of = np.concatenate([twins[2], own])
    lost = gone[twin_of]
    found = [(pieces.key[gone], pieces.pos[gone], pieces.pos[gone] + size[gone]), (twin_key[lost], twin_pos[lost], twin_pos[lost] + size[twin_of[lost]])]
    by_first = np.flatnonzero(~lost)[np.argsort(first[twin_of[~lost]], kind="stable")]
    twin_key, twin_pos, twin_first = twin_key[by_first], twin_pos[by_first], first[twin_of[by_first]]
    lone = np.flatnonzero(first == np.arange(len(first)))
    before, side = span - ANCHOR, (span - ANCHOR) // 2
    # Equal windows reach at least half of the rest beyond the anchor on one side: a cheap test for partners.
    partner = np.zeros(len(lone), bool)
    left, right = pieces.left[lone], pieces.right[lone]
    for fits, columns in ((right >= span - side, table[lone, before:before + span - side]), (left >= side, table[lone, before - side:before + ANCHOR])):
        rows = np.flatnonzero(fits)
        padded = np.zeros((len(rows), -(-columns.shape[1] // 8) * 8), np.uint8)
        padded[:, :columns.shape[1]] = columns[rows]
        print_ = _fingerprint(padded)
        order = np.argsort(print_, kind="stable")
        if len(order):
            cuts = np.flatnonzero(np.concatenate([[True], print_[order][1:] != print_[order][:-1]]))
            who = pieces.doc[lone[rows[order]]]
            mixed = np.minimum.reduceat(who, cuts) != np.maximum.reduceat(who, cuts)
            partner[rows[order][np.repeat(mixed, np.diff(np.append(cuts, len(order))))]] = True
    rows = lone[partner]
    counts = size[rows] - span + 1
    row = np.repeat(np.arange(len(rows)), counts)
    step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    text = np.concatenate([table[rows].reshape(-1), np.zeros(8, np.uint8)])
    starts = row * table.shape[1] + before - pieces.left[rows][row] + step
    owner = pieces.doc[rows][row]
    index, group = repeated(text, starts, span, owner)
    if len(index):
        cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        least = np.minimum.reduceat(owner[index], cuts)[group]
        hit = index[owner[index] > least]
        source = rows[row[hit]]
        low, high = np.searchsorted(twin_first, source, "left"), np.searchsorted(twin_first, source, "right")
        again = np.repeat(np.arange(len(hit)), high - low)
        other = np.repeat(low, high - low) + np.arange(len(again)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
        found.append((pieces.key[source], pieces.pos[source] + step[hit], pieces.pos[source] + step[hit] + span))
        found.append((twin_key[other], twin_pos[other] + step[hit][again], twin_pos[other] + step[hit][again] + span))
    return _merge(*(np.concatenate(c) for c in zip(*found)))


def _pack(doc: np.ndarray, key: np.ndarray, pos: np.ndarray, left: np.ndarray, right: np.ndarray, content: np.ndarray, twins: Twins) -> bytes:
    """Pieces and twins as one compressed block: documents once, then columns, then the contents."""
    names, at, number = np.unique(np.concatenate([key, twins[0]]), return_index=True, return_inverse=True)
    docs = np.concatenate([doc, doc[twins[2]]])[at]
    n = len(key)
    # places and numbers as steps from the one before: they rise slowly, and the steps press well
    step = lambda x: np.diff(x, prepend=0).astype("<i8").astype("<u4")
    parts = [names.astype("<i8"), docs.astype("<i8"), step(number[:n]), step(pos), left.astype(np.uint8), right.astype(np.uint8),
             step(number[n:]), step(twins[1]), step(twins[2]), content]
    raw = b"".join([struct.pack("<III", len(names), n, len(twins[0])), *(p.tobytes() for p in parts)])
    return zstandard.ZstdCompressor(level=_PRESS_LEVEL).compress(raw)


class _Held:
    """Pieces and twins sorted by bucket, batch by batch, until there is enough to pack."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, Twins]] = []
        self.size = 0

    def add(self, pieces: Pieces, bucket: np.ndarray, twin_bucket: np.ndarray, twins: Twins) -> None:
        """Both sorted by bucket; a twin's number is that of its piece among ``pieces``."""
        size = pieces.left + pieces.right
        content = pieces.content()
        self.parts.append((bucket, [pieces.doc, pieces.key, pieces.pos, pieces.left, pieces.right, np.cumsum(size) - size], content, twin_bucket, twins))
        self.size += len(content) + 16 * len(twin_bucket)

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        names = np.unique(np.concatenate([p[0] for p in self.parts]))
        edges = [[(np.searchsorted(p[i], names, "left"), np.searchsorted(p[i], names, "right")) for i in (0, 3)] for p in self.parts]
        for k, name in enumerate(names.tolist()):
            columns: list[list[np.ndarray]] = [[] for _ in range(5)]
            twins: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
            text, before = [], 0
            for (_, own, content, _, mates), ((low, high), (from_, upto)) in zip(self.parts, edges):
                a, b = low[k], high[k]
                if a == b:
                    continue
                for column, values in zip(columns, own):
                    column.append(values[a:b])
                text.append(content[own[5][a]:own[5][b - 1] + own[3][b - 1] + own[4][b - 1]])
                for column, values in zip(twins, mates):
                    column.append(values[from_[k]:upto[k]])
                twins[2][-1] = twins[2][-1] - a + before
                before += b - a
            yield name, _pack(*(np.concatenate(c) for c in columns), np.concatenate(text), tuple(np.concatenate(c) for c in twins))
        self.parts, self.size = [], 0


def _unpack(blocks: list[bytes]) -> tuple[Pieces, Twins]:
    columns: list[list[np.ndarray]] = [[] for _ in range(6)]
    twins: list[list[np.ndarray]] = [[] for _ in range(3)]
    press = zstandard.ZstdDecompressor()
    before = 0
    for block in blocks:
        raw = press.decompress(block)
        m, n, t = struct.unpack_from("<III", raw)
        at, got = 12, []
        for kind, count in (("<i8", m), ("<i8", m), ("<u4", n), ("<u4", n), ("u1", n), ("u1", n), ("<u4", t), ("<u4", t), ("<u4", t)):
            got.append(np.frombuffer(raw, kind, count, at))
            at += got[-1].nbytes
        names, docs, number, pos, left, right, twin_number, twin_pos, twin_of = (np.cumsum(g, dtype=np.uint32) if k in (2, 3, 6, 7, 8) else g for k, g in enumerate(got))
        for column, values in zip(columns, (docs[number], names[number], pos.astype(np.int64), left.astype(np.int64), right.astype(np.int64), np.frombuffer(raw, np.uint8, offset=at))):
            column.append(values)
        for column, values in zip(twins, (names[twin_number], twin_pos.astype(np.int64), twin_of.astype(np.int64) + before)):
            column.append(values)
        before += n
    doc, key, pos, left, right, flat = (np.concatenate(c) for c in columns)
    size = left + right
    return Pieces(doc, key, pos, left, right, flat, np.cumsum(size) - size), tuple(np.concatenate(c) for c in twins)


_NONE = (np.zeros(0, np.int64),) * 3
_RANGES = pa.schema([("key", pa.int64()), ("ranges", pa.list_(pa.int32()))])


def _range_rows(key: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Table:
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    pairs = np.stack([begin, end], axis=1).reshape(-1).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(2 * np.append(cuts, len(key)), pa.int32()), pa.array(pairs))
    return pa.Table.from_arrays([pa.array(key[cuts], pa.int64()), lists], schema=_RANGES)


def piece_blocks(docs: DataFrame, buckets: int, span: int) -> DataFrame:
    """(bucket, block, key, ranges): blocks of pieces for every bucket, and ranges settled already.

    ``docs`` is (doc, key, text)."""
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
        held, size = ([], [], []), 0
        for batch in source:
            for doc, key, text in zip(*(batch.column(k) for k in range(3))):
                raw = text.as_py()
                if size and size + len(raw) > BATCH_BYTES:
                    yield held
                    held, size = ([], [], []), 0
                for column, value in zip(held, (doc.as_py(), key.as_py(), raw)):
                    column.append(value)
                size += len(raw)
        if held[0]:
            yield held

    def rows(names: list[int], blocks: list[bytes | None], settled: pa.Table) -> pa.RecordBatch:
        n, m = len(blocks), settled.num_rows
        keys = settled["key"].to_pylist()
        return pa.RecordBatch.from_arrays(
            [pa.array(names + [k % buckets for k in keys], pa.int64()), pa.array(blocks + [None] * m, pa.binary()),
             pa.array([None] * n + keys, pa.int64()), pa.array([None] * n + settled["ranges"].to_pylist(), pa.list_(pa.int32()))],
            ["bucket", "block", "key", "ranges"])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches(source):
            for name, key, text, offset in _slices(*batch, span):
                pieces, hashes = cut(text, np.array(name, np.int64), np.array(key, np.int64), span)
                if not len(hashes):
                    continue
                pieces.pos = pieces.pos + offset
                first, gone = _copies(pieces, pieces.aligned(span))
                size = pieces.left + pieces.right
                if gone.any():
                    yield rows([], [], _range_rows(*_merge(pieces.key[gone], pieces.pos[gone], pieces.pos[gone] + size[gone])))
                bucket = (hashes % np.uint64(buckets)).astype(np.int64)
                itself = first == np.arange(len(first))
                left, twin = np.flatnonzero(itself & ~gone), np.flatnonzero(~itself & ~gone)
                left, twin = left[np.argsort(bucket[left], kind="stable")], twin[np.argsort(bucket[twin], kind="stable")]
                number = np.zeros(len(first), np.int64)
                number[left] = np.arange(len(left))
                held.add(pieces.take(left), bucket[left], bucket[twin], (pieces.key[twin], pieces.pos[twin], number[first[twin]]))
                if held.size >= HELD_BYTES:
                    packed = list(held.blocks())
                    yield rows([k for k, _ in packed], [b for _, b in packed], _range_rows(*_NONE))
        if held.size:
            packed = list(held.blocks())
            yield rows([k for k, _ in packed], [b for _, b in packed], _range_rows(*_NONE))

    return docs.mapInArrow(run, "bucket long, block binary, key long, ranges array<int>")


def _slices(ids: list[int], keys: list[int], texts: list[bytes], span: int) -> Iterator[tuple[list[int], list[int], list[bytes], int]]:
    """The batch as it is, or, for one long text, overlapping slices that together have all its windows; with their offset."""
    if len(texts) > 1 or len(texts[0]) <= BATCH_BYTES:
        yield ids, keys, texts, 0
        return
    for at in range(0, len(texts[0]) - span + 1, BATCH_BYTES):
        yield ids, keys, [texts[0][at:at + BATCH_BYTES + span - 1]], at


def _buckets(docs: DataFrame) -> int:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // BUCKET_BYTES))


def removed_ranges(docs: DataFrame, span: int, buckets: int) -> DataFrame:
    """(key, ranges array<int> begin, end, begin, ...) of removed bytes, several rows per key, for (doc, key, text)."""
    sent = piece_blocks(docs, buckets, span)

    def resolve(key: tuple, rows: pa.Table) -> pa.Table:
        known = rows.select(["key", "ranges"]).filter(rows["key"].is_valid())
        blocks = [b for b in rows["block"].to_pylist() if b is not None]
        tables = [pa.Table.from_arrays(known.columns, schema=_RANGES)]
        if blocks:
            pieces, twins = _unpack(blocks)
            tables.append(_range_rows(*earlier_windows(pieces, span, twins)))
        return pa.concat_tables(tables)

    return sent.groupBy("bucket").applyInArrow(resolve, "key long, ranges array<int>")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "utf-8")
    long_id = F.col(id_col).cast("long")
    return docs.select(long_id.alias("doc_id"), F.coalesce(long_id, F.lit(_LAST)).alias("doc"), F.xxhash64(long_id, text).alias("key"), text.alias("text"))


def _text_blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block): the rows of (doc_id, key, text) packed and compressed by their key's bucket.

    Rows of one key in a block are one entry with their number."""
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[int, list]] = {}
        size = 0

        def packed() -> pa.RecordBatch:
            blocks = []
            for entries in held.values():
                docs, texts, times = zip(*entries.values())
                head = [np.array(list(entries), "<i8"), np.array([d or 0 for d in docs], "<i8"), np.array(list(map(len, texts)), "<u4"), np.array(times, "<u4"), np.array([d is not None for d in docs], np.uint8)]
                blocks.append(zstandard.ZstdCompressor(level=3).compress(b"".join([struct.pack("<I", len(entries)), *(h.tobytes() for h in head), *texts])))
            return pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(blocks, pa.binary())], ["bucket", "block"])

        for batch in source:
            for doc, key, text in zip(*(batch.column(k) for k in range(3))):
                number = key.as_py()
                entry = held.setdefault(number % buckets, {}).setdefault(number, [doc.as_py(), text.as_py(), 0])
                entry[2] += 1
                size += 16 + (len(entry[1]) if entry[2] == 1 else 0)
                if size >= HELD_BYTES:
                    yield packed()
                    held, size = {}, 0
        if held:
            yield packed()

    return docs.mapInArrow(run, "bucket long, block binary")


def _texts(block: bytes) -> Iterator[tuple[int | None, int, bytes, int]]:
    """(doc_id, key, text, number of rows) of the entries of a block."""
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, = struct.unpack_from("<I", raw)
    keys, docs = np.frombuffer(raw, "<i8", n, 4).tolist(), np.frombuffer(raw, "<i8", n, 4 + 8 * n).tolist()
    sizes, times = np.frombuffer(raw, "<u4", n, 4 + 16 * n).tolist(), np.frombuffer(raw, "<u4", n, 4 + 20 * n).tolist()
    known = np.frombuffer(raw, np.uint8, n, 4 + 24 * n).tolist()
    at = 4 + 25 * n
    for key, doc, size, there, rows in zip(keys, docs, sizes, known, times):
        yield doc if there else None, key, raw[at:at + size], rows
        at += size


_KEPT = pa.schema([("doc_id", pa.int64()), ("text", pa.binary()), ("kept", pa.binary()), ("ranges", pa.list_(pa.int32())), ("times", pa.int64())])


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 50) -> DataFrame:
    """(doc_id, text binary, kept binary, ranges array<int>) of every row: merged removed ranges and what is left.

    Texts are UTF-8 bytes; a null text is empty; matches never cross documents; windows are judged on
    the input. Null ids come after all others and, like equal ids, do not remove each other; rows that
    repeat id and text get the same result. Texts shorter than ``span`` lose nothing."""
    keyed = _keyed(docs, id_col, text_col)
    buckets = _buckets(keyed)
    ranges = settle_table(removed_ranges(keyed.select("doc", "key", "text"), span, buckets), "passage-ranges")

    def cut_out(found: pa.Table, packed: pa.Table) -> pa.Table:
        lists: dict[int, list[np.ndarray]] = {}
        for key, pairs in zip(found["key"].to_pylist(), found["ranges"]):
            lists.setdefault(key, []).append(pairs.values.to_numpy().astype(np.int64).reshape(-1, 2))
        rows: list[tuple] = []
        for block in packed["block"]:
            for doc, key, text, times in _texts(block.as_py()):
                edges = [0, len(text)]
                if key in lists:
                    pairs = np.concatenate(lists[key])
                    _, low, high = _merge(np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1])
                    edges[1:1] = np.stack([low, high], axis=1).reshape(-1).tolist()
                rows.append((doc, text, b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2])]), edges[1:-1], times))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, _KEPT)], schema=_KEPT)

    placed = ranges.select("key", "ranges", F.pmod("key", F.lit(buckets)).alias("bucket"))
    texts = _text_blocks(keyed.select("doc_id", "key", "text"), buckets)
    found = placed.groupBy("bucket").cogroup(texts.groupBy("bucket")).applyInArrow(cut_out, "doc_id long, text binary, kept binary, ranges array<int>, times long")
    # repeated rows become rows again one by one, outside the task's memory
    return found.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("doc_id", "text", "kept", "ranges")
