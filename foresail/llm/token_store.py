"""Token ids of a corpus in ascending document order, as shards of wavelet-matrix images.

A shard is one self-contained compressed image: documents' ids and lengths, then the wavelet matrix of
their token ids. Spark's own writer commits the images (one binary cell each) to any store that Spark
reaches, so a lost executor leaves no half-written shard."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from foresail.llm.bpe import byte_alphabet
from foresail.llm.common import map_arrow
from foresail.llm.wavelet import WaveletMatrix

_REMEMBERED, _LOT, _BATCH_BYTES = 600_000, 10, 16 << 20
_WHITE = r"[\t\n\x{b}\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A space between white space, or after it at the end: there the file's pattern may join what a cut at spaces parts.
_JOINED = f"{_WHITE} (?:{_WHITE}|$)"


_SPACED = re.compile(r"\s")


class ByteBpe:
    """Byte-level tokenizer file behind a memory of recent units.

    A text is cut before every space; the file's own splitting pattern never reaches over such a cut,
    but for ``_JOINED``. So the ids of its units put together are the ids of the text. Texts with such
    places or with a special token's string go to the library whole. Cutting, numbering equal units and
    joining their ids are array operations; the library sees every new unit once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        if self.library.get_vocab_size(with_added_tokens=True) > 1 << 16:
            raise ValueError("ids are kept in 16 bits: the file has more than 65,536")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.mark = self._ids("\n")[0]
        self.letters = dict(enumerate(byte_alphabet()))
        self.space = self.letters[32]
        self.units: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, units: list[str]) -> list[bytes]:
        """Ids of each unit after a space; remembers two generations of units, so memory is bounded."""
        if len(self.units) > _REMEMBERED:
            self.units, self.older = {}, self.units
        known, older, tokenize = self.units, self.older, self.library.model.tokenize
        out = list(map(known.get, units))
        lone, mixed = [], []
        for k in [k for k, ids in enumerate(out) if ids is None]:
            unit = units[k]
            if (ids := older.get(unit)) is None:
                if unit.isalpha():  # one piece for the file's splitting pattern: straight to its merges
                    inner = unit if unit.isascii() else unit.encode().decode("latin-1").translate(self.letters)
                    ids = array("H", [t.id for t in tokenize(self.space + inner)]).tobytes()
                else:
                    (lone if not unit or _SPACED.search(unit) else mixed).append(k)
                    continue
            out[k] = known[unit] = ids
        for k, coded in zip(lone, self.library.encode_batch_fast([" " + units[k] for k in lone], add_special_tokens=False)):
            out[k] = known[units[k]] = array("H", coded.ids).tobytes()
        # A line feed between units without white space is a token of its own.
        ids: list[int] = []
        for coded in self.library.encode_batch_fast([" " + "\n ".join([units[k] for k in mixed[i:i + _LOT]]) for i in range(0, len(mixed), _LOT)], add_special_tokens=False):
            ids += coded.ids
            ids.append(self.mark)
        flat = np.array(ids, np.uint16)
        raw, begin = flat.tobytes(), 0
        for k, end in zip(mixed, (2 * np.flatnonzero(flat == self.mark)).tolist(), strict=True):
            out[k] = known[units[k]] = raw[begin:end]
            begin = end + 2
        return out

    def _whole(self, texts: pa.StringArray) -> np.ndarray:
        """Which texts have to go to the library whole."""
        found = pc.match_substring_regex(texts, _JOINED)
        for content in self.special:
            found = pc.or_(found, pc.match_substring(texts, content))
        return found.to_numpy(zero_copy_only=False)

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (no nulls) one after the other, unsigned 16-bit, and the number of ids of each."""
        whole = self._whole(texts)
        direct = {k: array("H", self._ids(texts[k].as_py())).tobytes() for k in np.flatnonzero(whole).tolist()}
        if direct:
            texts = pc.if_else(pa.array(whole), "", texts)
        pieces = pc.split_pattern(texts, " ")
        numbered = pieces.flatten().dictionary_encode()
        bounds = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
        blobs = self._learn(numbered.dictionary.to_pylist())
        first = bounds[:-1]
        index = np.array(numbered.indices)
        # Units that open a text have no space before them: they are numbered anew behind the others.
        opening = pc.list_element(pieces, 0).to_pylist()
        index[first] = len(blobs) + np.arange(len(opening))
        coded = self.library.encode_batch_fast(opening, add_special_tokens=False)
        blobs += [direct[k] if k in direct else array("H", c.ids).tobytes() for k, c in enumerate(coded)]
        # A batch is a few megabytes, or one text of less than 2 GB: 32 bits number its ids.
        sizes = np.fromiter(map(len, blobs), np.int32, len(blobs)) >> 1
        pool = np.frombuffer(b"".join(blobs), np.uint16)
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        each = sizes[index]
        ends = np.cumsum(each, dtype=np.int32)
        place = np.repeat(starts[index] - (ends - each), each)
        place += np.arange(len(place), dtype=np.int32)
        totals = np.concatenate([[0], ends])
        return pool[place], totals[bounds[1:]] - totals[first]


@lru_cache(maxsize=2)
def _coder(path: str) -> ByteBpe:
    return ByteBpe(path)


def token_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shard_tokens: int = 1 << 17) -> DataFrame:
    """(part, seq, n_tokens, n_docs, image): the corpus in ascending id order, null ids last.

    Rows with equal ids follow each other by text; a null text counts as empty and has the end id
    alone. A shard is closed by the document that brings it to ``shard_tokens``; documents are never
    cut. ``part`` and ``seq`` order the shards. Other columns are not read."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    ranged = narrow.repartitionByRange(*order).sortWithinPartitions(*order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        sizes: list[int] = []
        ids: list[np.ndarray] = []

        def shard() -> pa.RecordBatch:
            known = np.array([n is not None for n in names], np.uint8)
            payload = b"".join([known.tobytes(), np.array([n or 0 for n in names], "<i8").tobytes(), np.array(sizes, "<u4").tobytes()])
            image = WaveletMatrix.build(np.concatenate(ids)).to_bytes(payload)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([held], pa.int64()), pa.array([len(names)], pa.int64()), pa.array([image], pa.binary())],
                ["part", "seq", "n_tokens", "n_docs", "image"])

        coder, end = _coder(path), np.array([end_id], np.uint16)
        for batch in batches:
            for piece in _pieces(batch):
                flat, counts = coder.encode(piece.column(1))
                ends = np.cumsum(counts).tolist()
                for name, count, stop in zip(piece.column(0).to_pylist(), counts.tolist(), ends):
                    names.append(name)
                    sizes.append(count + 1)
                    ids += [flat[stop - count:stop], end]
                    held += count + 1
                    if held >= shard_tokens:
                        yield shard()
                        seq, held, names, sizes, ids = seq + 1, 0, [], [], []
        if names:
            yield shard()

    return ranged.mapInArrow(run, "part int, seq int, n_tokens long, n_docs long, image binary")


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a bounded number of bytes of text, one row at least."""
    size = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
    begin = held = 0
    for k, n in enumerate(size.tolist()):
        if held and held + n > _BATCH_BYTES:
            yield batch.slice(begin, k - begin)
            begin, held = k, 0
        held += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def write_shards(shards: DataFrame, path: str) -> None:
    shards.write.parquet(path)


def read_shards(spark, path: str) -> DataFrame:
    return spark.read.schema("part int, seq int, n_tokens long, n_docs long, image binary").parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, seq, base): tokens in all shards before. One window per part; the parts' own totals, one
    row per written partition, are added up in one small window."""
    sizes = shards.select("part", "seq", "n_tokens")
    inside = sizes.select("part", "seq", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")).alias("inside"))
    totals = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return inside.join(before, "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("base"))


def _documents(image: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    matrix, payload = WaveletMatrix.from_bytes(image)
    n = len(payload) // 13
    known = np.frombuffer(payload, np.uint8, n)
    names = [x if k else None for x, k in zip(np.frombuffer(payload, "<i8", n, n).tolist(), known)]
    return matrix, names, np.frombuffer(payload, "<u4", n, 9 * n).astype(np.int64)


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<int>) of every document, decoded from the images."""
    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for k in range(batch.num_rows):
            matrix, names, sizes = _documents(batch.column(2)[k].as_py())
            ends = np.cumsum(sizes)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(matrix.values().astype(np.int32)))
            yield _placed(batch, k, names, ends, sizes, ids, "ids")
    return _with_start(shards, map_arrow(shards.select("part", "seq", "image"), rows, "part int, seq int, doc_id long, inside long, n_tokens long, ids array<int>"), "ids")


def document_checksums(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the images."""
    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for k in range(batch.num_rows):
            matrix, names, sizes = _documents(batch.column(2)[k].as_py())
            ends = np.cumsum(sizes)
            raw = memoryview(matrix.values().astype("<u4").tobytes())
            sums = [zlib.crc32(raw[4 * (e - s):4 * e]) for e, s in zip(ends.tolist(), sizes.tolist())]
            yield _placed(batch, k, names, ends, sizes, pa.array(sums, pa.int64()), "ids_crc32")
    return _with_start(shards, map_arrow(shards.select("part", "seq", "image"), rows, "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long"), "ids_crc32")


def _placed(batch: pa.RecordBatch, k: int, names: list, ends: np.ndarray, sizes: np.ndarray, last: pa.Array, name: str) -> pa.RecordBatch:
    same = lambda column: pa.array([batch.column(column)[k].as_py()] * len(names), pa.int32())
    return pa.RecordBatch.from_arrays(
        [same(0), same(1), pa.array(names, pa.int64()), pa.array(ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), last],
        ["part", "seq", "doc_id", "inside", "n_tokens", name])


def _with_start(shards: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    return rows.join(shard_starts(shards), ["part", "seq"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", name)


def occurrences(shards: DataFrame, token_ids: list[int]) -> DataFrame:
    """(token_id, place): every place of the given ids in the whole sequence, found in the compressed shards."""
    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for k in range(batch.num_rows):
            matrix, _ = WaveletMatrix.from_bytes(batch.column(2)[k].as_py())
            for symbol in token_ids:
                found = matrix.occurrences(symbol) if 0 <= symbol < 1 << matrix.bits else np.zeros(0, np.int64)
                same = lambda column: pa.array([batch.column(column)[k].as_py()] * len(found), pa.int32())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([same(0), same(1), pa.array([symbol] * len(found), pa.int64()), pa.array(found, pa.int64())], ["part", "seq", "token_id", "inside"])
    found = map_arrow(shards.select("part", "seq", "image"), rows, "part int, seq int, token_id long, inside long")
    return found.join(shard_starts(shards), ["part", "seq"]).select("token_id", (F.col("base") + F.col("inside")).alias("place"))


def token_counts(shards: DataFrame, token_ids: list[int]) -> DataFrame:
    """(token_id, n): how often the given ids occur, from rank queries alone."""
    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for k in range(batch.num_rows):
            matrix, _ = WaveletMatrix.from_bytes(batch.column(0)[k].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(token_ids, pa.int64()), pa.array([matrix.count(t) for t in token_ids], pa.int64())], ["token_id", "n"])
    counted = map_arrow(shards.select("image"), rows, "token_id long, n long")
    return counted.groupBy("token_id").agg(F.sum("n").alias("n"))
