"""Chat formatting on token level: segments encoded apart, reserved ids between them, masks by prefix sums.

Template, one conversation:  <s> turn turn ...  with the turns
    user       [INST] text [/INST]
    assistant  [REPLY] text </s>
    other      [ROLE] role [TEXT] text [/ROLE]
(without the blanks). Control strings are reserved ids above the vocabulary, so no text can produce
one. The formatted *string* stays unambiguous too: a control string occurring in a text is escaped by
a backslash, backslashes right before it or at a segment's end are doubled."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

#: Control strings in the order of their reserved ids, which follow the vocabulary's.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[REPLY]", "[ROLE]", "[TEXT]", "[/ROLE]")
_START, _REPLY_END, _USER, _USER_END, _REPLY, _ROLE, _TEXT, _ROLE_END = range(len(CONTROLS))
_ANY = "|".join(map(re.escape, CONTROLS))
_ESCAPE = re.compile(rf"(\\*)({_ANY}|\Z)")
_UNESCAPE = re.compile(rf"(\\+)({_ANY}|\Z)")


def escape(text: str) -> str:
    """Text in which every control string stands after an odd number of backslashes and the end after an even one."""
    return _ESCAPE.sub(lambda m: m[1] * 2 + ("\\" if m[2] else "") + m[2], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "\\" * (len(m[1]) // 2) + m[2], text)


class ChatTokens:
    """A byte-level tokenizer file with the control strings as reserved ids after its own."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        self.first = self.library.get_vocab_size(with_added_tokens=True)

    def encode(self, segments: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(segments, add_special_tokens=False)]

    def decode(self, segments: list[list[int]]) -> list[str]:
        return self.library.decode_batch(segments, skip_special_tokens=False)


@lru_cache(maxsize=2)
def _tokens(path: str) -> ChatTokens:
    return ChatTokens(path)


def turn_pieces(role: str | None, text: str | None) -> list[int | str]:
    """A turn as control numbers and raw segments; a null role or text counts as empty."""
    if role == "user":
        return [_USER, text or "", _USER_END]
    if role == "assistant":
        return [_REPLY, text or "", _REPLY_END]
    return [_ROLE, role or "", _TEXT, text or "", _ROLE_END]


def loss_mask(ids: np.ndarray, first: int, inside: int = 0) -> tuple[np.ndarray, int]:
    """1 for ids between [REPLY] and </s>, both excluded: a prefix sum over their positions.

    ``inside`` is the sum before the first id, the second result the sum after the last."""
    opened, closed = ids == first + _REPLY, ids == first + _REPLY_END
    depth = np.cumsum(opened.astype(np.int32) - closed) + inside
    return ((depth > 0) & ~opened).astype(np.int8), int(depth[-1]) if len(ids) else inside


def _sorted_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    narrow = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                          F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    return narrow.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_chat(turns: DataFrame, path: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_tokens: int = 8192) -> DataFrame:
    """(conv_id, part, ids array<int>, mask array<tinyint>): every conversation as token ids and loss mask.

    Parts of at most ``part_tokens`` ids follow each other in order, so a conversation of any length is
    never held whole: turns arrive sorted (Spark sorts and spills) and are encoded as they come. Turns
    of equal number are ordered by role, then text, nulls first; a null number comes first; rows with a
    null conversation id form one conversation. Null texts and roles count as empty. Other columns are
    not read; an empty table gives no rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(path)
        conv, started, part, inside = None, False, 0, 0
        held: list[int] = []
        out: list[tuple[int | None, int, np.ndarray, np.ndarray]] = []

        def flush(n: int) -> None:
            nonlocal held, part, inside
            ids = np.array(held[:n], np.int32)
            mask, inside = loss_mask(ids, tokens.first, inside)
            out.append((conv, part, ids, mask))
            held, part = held[n:], part + 1

        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                rows = batch.slice(begin, 500)
                pieces = [turn_pieces(r, t) for r, t in zip(rows.column(2).to_pylist(), rows.column(3).to_pylist())]
                coded = iter(tokens.encode([escape(p) for turn in pieces for p in turn if isinstance(p, str)]))
                for name, turn in zip(rows.column(0).to_pylist(), pieces):
                    if not started or name != conv:
                        if held:
                            flush(len(held))
                        conv, started, part, inside, held = name, True, 0, 0, [tokens.first + _START]
                    for piece in turn:
                        if isinstance(piece, int):
                            held.append(tokens.first + piece)
                        else:
                            held += next(coded)
                    while len(held) >= part_tokens:
                        flush(part_tokens)
                if out:
                    yield _parts(out)
                    out.clear()
        if held:
            flush(len(held))
        if out:
            yield _parts(out)

    return _sorted_turns(turns, conv_col, turn_col, role_col, text_col).mapInArrow(run, "conv_id long, part int, ids array<int>, mask array<tinyint>")


def _parts(out: list[tuple[int | None, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    conv, part, ids, mask = zip(*out)
    return pa.RecordBatch.from_arrays(
        [pa.array(conv, pa.int64()), pa.array(part, pa.int32()), pa.array(ids, pa.list_(pa.int32())), pa.array(mask, pa.list_(pa.int8()))],
        ["conv_id", "part", "ids", "mask"])


class _Reader:
    """Takes a conversation's ids and mask part by part; keeps one segment and the running digests."""

    def __init__(self, tokens: ChatTokens):
        self.tokens, self.turns, self.chars, self.loss_chars = tokens, 0, 0, 0
        self.turn_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()
        self.segment: list[int] = []
        self.masked = False
        self.role = ""

    def take(self, ids: np.ndarray, mask: np.ndarray) -> None:
        at = 0
        for k in np.flatnonzero(ids >= self.tokens.first):
            self._grow(ids[at:k], mask[at:k])
            self._control(int(ids[k]) - self.tokens.first)
            at = k + 1
        self._grow(ids[at:], mask[at:])

    def _grow(self, ids: np.ndarray, mask: np.ndarray) -> None:
        if len(ids):
            self.segment += ids.tolist()
            self.masked = bool(mask[0])
            if (mask != mask[0]).any():
                raise ValueError("the loss mask changes inside a segment")

    def _control(self, number: int) -> None:
        coded = self.tokens.decode([self.segment])[0] if self.segment else ""
        text, masked = unescape(coded), self.masked and bool(self.segment)
        self.chars += len(coded) + len(CONTROLS[number])
        self.segment, self.masked = [], False
        if masked:
            self.loss_chars += len(text)
            self.loss_hash.update(text.encode())
        if number == _TEXT:
            self.role = text
        elif number in (_USER_END, _REPLY_END, _ROLE_END):
            role = {_USER_END: "user", _REPLY_END: "assistant"}.get(number, self.role)
            self.turns += 1
            self.turn_hash.update(f"{role}\n{text}\n".encode())

    def row(self, conv: int | None) -> dict:
        return {"conv_id": conv, "n_turns": self.turns, "turns_sha256": self.turn_hash.hexdigest(), "loss_chars": self.loss_chars,
                "loss_sha256": self.loss_hash.hexdigest(), "formatted_chars": self.chars}


def read_chat(parts: DataFrame, path: str, in_order: bool = False) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read from ids and masks alone.

    ``in_order`` says that every conversation's parts stand together and in order, as ``format_chat``
    leaves them; otherwise (a stored table) they are dealt and sorted first. Parts are streamed."""
    if not in_order:
        parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, reader, conv, out = _tokens(path), None, None, []
        for batch in batches:
            for k in range(batch.num_rows):
                name = batch.column(0)[k].as_py()
                if reader is None or name != conv:
                    if reader:
                        out.append(reader.row(conv))
                    reader, conv = _Reader(tokens), name
                reader.take(batch.column(2)[k].values.to_numpy(), batch.column(3)[k].values.to_numpy())
            if out:
                yield pa.RecordBatch.from_pylist(out, _READ)
                out = []
        if reader:
            yield pa.RecordBatch.from_pylist([reader.row(conv)], _READ)

    return parts.select("conv_id", "part", "ids", "mask").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
