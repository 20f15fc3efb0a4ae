"""Vector compression into part codes: codebooks refined in whole numbers, nearest entries by a GNAT.

Components become whole numbers, vectors are cut into equal parts, and every part position has a codebook.
A round is one pass over the table: each task finds its parts' nearest entries and hands on sums by (part,
entry, position), whose number does not depend on the rows. All arithmetic is exact, so any partitioning
and any rerun give the same codebooks."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foresail.llm.common import map_arrow, settle_table
from foresail.llm.gnat import Gnat, is_wide

#: Components are multiplied by this and rounded down.
SCALE = 4096
#: Sums travel in limbs of so many bits: four million partial sums of one limb still fit a long.
LIMB_BITS = 40
#: Labels above this share of the rows are joined as a broadcast: at most 1 / share of them exist.
HOT_SHARE = 0.001

Codebooks = list[list[list[int]]]


def _whole(x: float) -> int:
    return math.floor(x * SCALE) if abs(x) < 2.0 ** 53 else int(x) * SCALE


def whole_components(values: np.ndarray, width: int, largest: int = 0) -> np.ndarray:
    """floor(4096 x) of float64 vectors; an object matrix where 64 bits might not do for distances.

    ``largest`` is the greatest magnitude that they will be compared with, ``width`` a part's length."""
    top = float(np.abs(values).max(initial=0.0))
    if is_wide(max(largest, _whole(top) + 1), width):
        return np.array([[_whole(float(x)) for x in row] for row in values], object).reshape(values.shape)
    return np.floor(values * SCALE).astype(np.int64)


def usable_vectors(df: DataFrame, id_col: str, vector_col: str, parts: int, label_col: str | None) -> DataFrame:
    """(vec_id, label, vector array<double>) of rows without null or non-finite components, as a settled table.

    Shorter vectors are filled up with zeros to the longest one's length, rounded up to whole parts of one
    component at least: vectors of one length that the parts divide stay as they are."""
    v = F.col(vector_col).cast("array<double>")
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    kept = df.select(F.col(id_col).alias("vec_id"), label.alias("label"), v.alias("vector")).where(
        F.col("vector").isNotNull() & F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    kept = settle_table(kept, "vectors")
    sizes = kept.agg(F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most")).first()
    length = max(1, -(-(sizes.most or 0) // parts)) * parts
    if sizes.least in (None, length):
        return kept
    return settle_table(kept.withColumn("vector", F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(length) - F.size("vector")))), "vectors")


def _matrix(batch: pa.RecordBatch, name: str = "vector") -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def first_codebooks(vectors: DataFrame, parts: int, entries: int) -> Codebooks:
    """The parts of the vectors with the smallest ids; of rows that repeat an id the smallest vector, null ids last as one."""
    ids = vectors.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).withColumnRenamed("vec_id", "first_id")
    first = vectors.join(F.broadcast(ids), F.col("vec_id").eqNullSafe(F.col("first_id"))).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rows = first.orderBy(F.col("vec_id").asc_nulls_last()).collect()
    cut = [[_whole(x) for x in r.vector] for r in rows]
    width = len(cut[0]) // parts if cut else 0
    return [[c[p * width:(p + 1) * width] for c in cut] for p in range(parts)]


class _Coder:
    """Nearest entries of a batch of vectors, part by part."""

    def __init__(self, books: Codebooks):
        self.books, self.width = books, len(books[0][0])
        self.largest = max((abs(x) for book in books for entry in book for x in entry), default=0)
        self.trees: dict[bool, list[Gnat]] = {}

    def _trees(self, wide: bool) -> list[Gnat]:
        if wide not in self.trees:
            self.trees[wide] = [Gnat(np.array(book, object if wide else np.int64).reshape(len(book), self.width)) for book in self.books]
        return self.trees[wide]

    def __call__(self, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per part: its whole components, entry indexes, squared distances."""
        whole = whole_components(values, self.width, self.largest)
        for p, tree in enumerate(self._trees(whole.dtype == object)):
            part = whole[:, p * self.width:(p + 1) * self.width]
            yield part, *tree.nearest(part)


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    sign, value, k = (-1, -value, 0) if value < 0 else (1, value, 0)
    while value:
        yield k, sign * (value & ((1 << LIMB_BITS) - 1))
        value >>= LIMB_BITS
        k += 1


def part_sums(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(part, entry, position, limb, value): sums of the components nearest to each entry; position -1 counts them."""
    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, total = _Coder(books), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for p, (part, index, _) in enumerate(coder(_matrix(batch))):
                for e in np.unique(index).tolist():
                    mine = part[index == e]
                    held = total.setdefault((p, e), [0] * (coder.width + 1))
                    for i, s in enumerate(mine.sum(axis=0).tolist()):
                        held[i] += int(s)
                    held[-1] += len(mine)
        rows = [(p, e, -1 if i == coder.width else i, k, v) for (p, e), sums in total.items() for i, s in enumerate(sums) for k, v in _limbs(s)]
        columns = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 4 + [pa.int64()])], names=["part", "entry", "position", "limb", "value"])

    return vectors.select("vector").mapInArrow(add, "part int, entry int, position int, limb int, value long").groupBy("part", "entry", "position", "limb").agg(F.sum("value").alias("value"))


def refine(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round; entries without parts stay. Collects one sum per component of the codebooks."""
    sums: dict[tuple[int, int, int], int] = {}
    for r in part_sums(vectors, books).collect():
        at = (r.part, r.entry, r.position)
        sums[at] = sums.get(at, 0) + (r.value << (LIMB_BITS * r.limb))
    return [[[sums.get((p, e, i), 0) // sums[p, e, -1] for i in range(len(entry))] if (p, e, -1) in sums else entry
             for e, entry in enumerate(book)] for p, book in enumerate(books)]


def codes(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code string, error decimal(38,0)): two hex digits a part; a null error where 38 digits do not hold it."""
    def encode(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        coder = _Coder(books)
        found = [(index, distance) for _, index, distance in coder(_matrix(batch))]
        code = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
        error = [sum(int(d) for d in row) for row in zip(*(distance.tolist() for _, distance in found))]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in code], pa.string()),
                                          pa.array([str(e) for e in error], pa.string())], names=["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    found = map_arrow(vectors, encode, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error string")
    return found.withColumn("error", F.col("error").try_cast("decimal(38,0)"))


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with the sum of errors over rows of the same label, nulls together; null where a summand is.

    Labels with a large share of the rows are few and broadcast; the rest are joined by shuffle, where no
    label is hot."""
    total = F.when(F.count("error") == F.count("*"), F.sum("error"))
    sums = settle_table(coded.groupBy(F.col("label").alias("of")).agg(F.count("*").alias("n"), total.alias("label_error")), "label-sums")
    rows = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = sums.where((F.col("n") > rows * HOT_SHARE) | F.col("of").isNull())
    cold = sums.where(~((F.col("n") > rows * HOT_SHARE) | F.col("of").isNull()))
    marked = coded.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("of")), "left")
    done = marked.where("n is not null").drop("of", "n")
    rest = marked.where("n is null").drop("of", "n", "label_error").join(cold, F.col("label") == F.col("of")).drop("of", "n")
    return done.unionByName(rest)


def book_digest(books: Codebooks) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label",
             parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[DataFrame, Codebooks]:
    """((vec_id, label, code, error, label_error), codebooks) after ``rounds`` rounds; one row per usable vector.

    Rows whose vector is null or holds null or non-finite components are left out; repeated rows stay.
    Codebooks start as the parts of the ``entries`` smallest ids (fewer ids: fewer entries). Vectors of
    unequal length are filled up with zeros. Errors that a long does not hold are null, and so is their
    label's sum. Without usable vectors there are no rows and no entries. At most 256 entries."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    vectors = usable_vectors(df, id_col, vector_col, parts, label_col)
    books = first_codebooks(vectors, parts, entries)
    if not books[0]:
        empty = vectors.where("false").select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return empty, books
    for _ in range(rounds):
        books = refine(vectors, books)
    coded = label_errors(settle_table(codes(vectors, books), "vector-codes"))
    return coded.withColumns({c: F.col(c).try_cast("long") for c in ("error", "label_error")}), books
