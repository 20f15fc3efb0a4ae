"""SimHash near-duplicates: fingerprints of word shingles, compared exactly in tiles.

Fingerprints within ``radius`` differing bits are linked; documents whose fingerprints are connected
form one group. The comparison is exact: distinct fingerprints are laid out in tiles by population
count (taken separately over four 16-bit segments, which skips far more than one total would), tile
pairs whose counts differ by more than the radius in sum are never formed, and every other pair is
compared whole with exclusive-or and bit counts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from foresail.llm.common import map_arrow, settle_table

BITS, SEGMENTS, FIELD = 64, 4, 5
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles whose hashes are held at a time, so that memory does not follow a text's length.
_BLOCK = 1 << 16


def text_fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of one text: a bit is set if it is in over half of the shingles' hashes.

    A-Z are lower-cased; fewer words than ``shingle`` make one shingle; no words give zero."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    total = len(words) - shingle + 1
    grams = map(b" ".join, zip(*(islice(words, k, None) for k in range(shingle))))
    hashes = map(xxhash.xxh64_intdigest, grams, repeat(seed))
    counts = np.zeros(BITS, np.int64)
    for begin in range(0, total, _BLOCK):
        n = min(_BLOCK, total - begin)
        block = np.fromiter(islice(hashes, n), "<u8", n)
        counts += np.unpackbits(block.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, text_hash, fingerprint as a signed long) for every row; a null text counts as empty."""
    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        made = np.fromiter((text_fingerprint(t.as_py(), shingle, seed) for t in batch.column(2)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made.view(np.int64))], ["doc_id", "text_hash", "fingerprint"])

    text = F.col(text_col).cast("string")
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")), rows, "doc_id long, text_hash long, fingerprint long")


def _offsets(radius: int) -> list[int]:
    """Differences of packed segment counts whose absolute sum is at most the radius, one of each sign pair."""
    steps = [d for d in product(range(-radius, radius + 1), repeat=SEGMENTS) if sum(map(abs, d)) <= radius and d >= (0,) * SEGMENTS]
    return [sum(x << (FIELD * k) for k, x in enumerate(reversed(d))) for d in steps]


def _forest(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest label of each connected set after adding the links left[i] - right[i]."""
    while True:
        a, b = labels[left], labels[right]
        if (a == b).all():
            return labels
        low = np.minimum(a, b)
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        while (labels[labels] != labels).any():
            labels = labels[labels]


def tile_links(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of all pairs of two tiles within the radius; whole tiles, block by block."""
    codes = a if same else np.concatenate([a, b])
    shift = 0 if same else len(a)
    labels = np.arange(len(codes))
    step = max(1, (1 << 20) // max(1, len(b)))
    for begin in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[begin:begin + step, None] ^ b[None, :]) <= radius)
        i += begin
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            labels = _forest(labels, i, j + shift)
    moved = np.flatnonzero(labels != np.arange(len(codes)))
    return codes[moved], codes[labels[moved]]


def near_links(codes: DataFrame, radius: int = 2, tile: int = 4096) -> DataFrame:
    """(u, v): links that connect exactly the codes connected through pairs within ``radius`` bits.

    ``codes`` has one distinct long column ``fingerprint``. Within a tile pair only a spanning forest
    of the links found is emitted, so a dense group of n codes yields O(n) rows, not n squared."""
    count = [F.bit_count(F.shiftrightunsigned("fingerprint", 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(SEGMENTS)]
    key = sum((F.shiftleft(c.cast("long"), FIELD * k) for k, c in enumerate(count)), F.lit(0).cast("long"))
    keyed = settle_table(codes.select("fingerprint", key.alias("key")), "simhash-codes")
    # At most 17^4 = 83,521 keys whatever the input, so this side may be broadcast.
    sizes = keyed.groupBy("key").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles"))
    tiles = (
        keyed.join(F.broadcast(sizes), "key")
        .withColumn("tile", F.pmod(F.xxhash64("fingerprint"), F.col("tiles")).cast("int"))
        .groupBy("key", "tile").agg(F.collect_list("fingerprint").alias("codes"))
    )
    tiles = settle_table(tiles, "simhash-tiles")
    other = sizes.select(F.col("key").alias("key_b"), F.col("tiles").alias("tiles_b"))
    pairs = (
        sizes.select("key", "tiles", F.explode(F.array([F.lit(o).cast("long") for o in _offsets(radius)])).alias("step"))
        .withColumn("key_b", F.col("key") + F.col("step")).join(F.broadcast(other), "key_b")
        .withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .withColumn("tile_b", F.explode(F.sequence(F.lit(0), F.col("tiles_b") - 1)))
        .where((F.col("step") != 0) | (F.col("tile") <= F.col("tile_b")))
        .select("key", "tile", "key_b", "tile_b")
    )
    right = tiles.select(F.col("key").alias("key_b"), F.col("tile").alias("tile_b"), F.col("codes").alias("codes_b"))
    work = pairs.join(tiles, ["key", "tile"]).join(right, ["key_b", "tile_b"]).select(
        "codes", "codes_b", ((F.col("key") == F.col("key_b")) & (F.col("tile") == F.col("tile_b"))).alias("same"))

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        a, b, same = batch.column(0), batch.column(1), batch.column(2).to_pylist()
        flat = [np.asarray(x.values).view(np.uint64) for x in (a, b)]
        at = [np.asarray(x.offsets) for x in (a, b)]
        found = [tile_links(flat[0][at[0][k]:at[0][k + 1]], flat[1][at[1][k]:at[1][k + 1]], same[k], radius) for k in range(batch.num_rows)]
        u, v = (np.concatenate([f[side] for f in found]).view(np.int64) for side in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return map_arrow(work, rows, "u long, v long")


def connected(edges: DataFrame) -> DataFrame:
    """(u, root): for every node that is not its component's smallest, that smallest node.

    Alternating large-star and small-star rounds; all state is written to the shared folder, the
    driver sees a count and a checksum per round."""
    now = settle_table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    while True:
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if sign == mark or not sign[0]:
            return now.select("u", F.col("v").alias("root"))
        mark = sign
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = settle_table(small.select("e.u", "e.v").where("u <> v").distinct(), "links")


def _rooted(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, seed: int, tile: int) -> DataFrame:
    prints = settle_table(fingerprints(docs, id_col, text_col, shingle, seed), "simhash-prints")
    star = connected(near_links(prints.select("fingerprint").distinct(), radius, tile))
    return prints.join(star.withColumnRenamed("u", "fingerprint"), "fingerprint", "left").select(
        "doc_id", "text_hash", "fingerprint", F.coalesce("root", "fingerprint").alias("root"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, seed: int = 42, tile: int = 4096) -> DataFrame:
    """(doc_id, fingerprint long, component_id) for every row of ``docs``.

    ``component_id`` is the smallest id whose document is reachable through links. Null texts count as
    empty; empty texts share fingerprint zero and are linked like any other; rows with equal ids are
    kept as they are; a null id is kept and is never the smallest (a group of only null ids gets null).
    Other columns are not read. Exact copies share a fingerprint and never meet in pairs."""
    rooted = _rooted(docs, id_col, text_col, shingle, radius, seed, tile)
    first = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(first, "root", "left").select("doc_id", "fingerprint", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, seed: int = 42, tile: int = 4096) -> DataFrame:
    """Exactly one row of each SimHash group, with all columns of ``docs``: the smallest id, null ids last.

    Of several texts under that id the one of the smallest hash stays; rows that repeat id and text are
    one document, and one of them stays."""
    rooted = _rooted(docs, id_col, text_col, shingle, radius, seed, tile)
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("best"))
    tag = "__near"
    while any(c.startswith(tag) for c in docs.columns):
        tag += "_"
    none, name, text = (f"{tag}_{c}" for c in ("none", "id", "text"))
    long_id = F.col(id_col).cast("long")
    marked = docs.withColumns({none: long_id.isNull(), name: F.coalesce(long_id, F.lit(0).cast("long")), text: F.xxhash64(F.col(text_col).cast("string"))})
    keep = best.select(F.col("best.none").alias(none), F.coalesce("best.doc_id", F.lit(0).cast("long")).alias(name), F.col("best.text_hash").alias(text))
    return marked.join(keep, [none, name, text], "left_semi").dropDuplicates([none, name, text]).select(*docs.columns)
