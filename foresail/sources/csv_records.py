"""CSV records out of text lines, while files stay splittable.

A quoted cell may hold line breaks, so a line is not always a record. Whether a line begins inside a
quoted cell depends on all lines before it in its file; but a line, and so any stretch of lines, only maps
"open" or "closed" before it to "open" or "closed" behind it. Chunks of a file block are summed up to that
map, one row each, and carried forward per file. Only chunks that a quoted line break touches are put in
order line by line, each by itself; all others, usually all of them, stream through without a shuffle.

Frames here have the columns ``file``, ``block`` (where the file block begins), ``at`` (order inside the
block) and ``value``; any others ride along."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from foresail.session import BROADCAST_ROWS, bounded, settle

PLACE = ("file", "block", "at")
#: Lines (as a power of two) that are summed up to one map and put in order together, whatever a block holds.
CHUNK_BITS = 16
#: A place inside a block: the low bits of ``monotonically_increasing_id``.
_INSIDE = 1 << 33


def placed_lines(text: DataFrame, *more: Column) -> DataFrame:
    """Lines of a text source with their place; ``more`` are further columns."""
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                       F.monotonically_increasing_id().alias("at"), *more)


def _left_open(halved: Column) -> Column:
    """Whether a line, doubled quotes taken out, ends inside a quoted cell; 1 or 0."""
    # a quote opens a cell only where the cell begins; whole quoted cells drop out
    return F.regexp_replace(halved, r'(^|,)"[^"]*"', "$1").rlike(r'(^|,)"[^"]*$').cast("int")


#: The map of a line that changes nothing.
_STAYS = 1


def _line_map(line: Column) -> Column:
    """What a line makes of "closed" (bit 1) and of "open" (bit 0) before it; 1 or 0 each, 1 being open."""
    halved = F.replace(line, F.lit('""'), F.lit(""))
    quotes = F.length(halved) - F.length(F.replace(halved, F.lit('"'), F.lit("")))
    # a single quote closes an open cell, and opens one where a cell begins
    opens = F.startswith(halved, F.lit('"')) | F.contains(halved, F.lit(',"'))
    several = F.lit(2) * _left_open(halved) + _left_open(F.concat(F.lit('"'), halved))
    return F.when(~F.contains(line, F.lit('"')) | (quotes == 0), _STAYS).when(quotes == 1, F.when(opens, 2).otherwise(0)).otherwise(several)


def _inside() -> Column:
    return F.col("at").bitwiseAND(F.lit(_INSIDE - 1))


def _chunk() -> Column:
    return F.shiftright(_inside(), CHUNK_BITS)


def _filled() -> Column:
    """Whether a line or record has any cell."""
    return ~F.col("value").rlike(r"^[\s,]*$")


def chunk_maps(lines: DataFrame) -> DataFrame:
    """(file, block, chunk, head, m0, m1, opens): a row per chunk, ``head`` being its first line with any cell.

    Of each line that changes anything one number moves, its place and map; the rest is counted out where it is read."""
    told = lines.select("file", "block", _chunk().alias("chunk"), _inside().alias("at"), _filled().alias("filled"), _line_map(F.col("value")).alias("m"))
    packed = F.when(F.col("m") != _STAYS, F.col("at") * 4 + F.col("m"))
    maps = told.groupBy("file", "block", "chunk").agg(F.min(F.when(F.col("filled"), F.col("at"))).alias("head"), F.collect_list(packed).alias("maps"))
    # the two ends so far choose a bit each of the next line's map
    bit = lambda m, end: F.when(end == 1, m.bitwiseAND(F.lit(1).cast("long"))).otherwise(F.shiftright(m, 1).bitwiseAND(F.lit(1).cast("long")))
    step = lambda ends, m: bit(m, F.shiftright(ends, 1)) * 2 + bit(m, ends.bitwiseAND(F.lit(1).cast("long")))
    ends = F.aggregate(F.sort_array("maps"), F.lit(_STAYS).cast("long"), step)
    opens = F.exists("maps", lambda m: m.bitwiseAND(F.lit(2).cast("long")) == 2).cast("int")
    folded = maps.select("file", "block", "chunk", "head", ends.cast("int").alias("m"), opens.alias("opens"))
    return settle(folded).select("file", "block", "chunk", "head", F.shiftright("m", 1).alias("m0"), F.col("m").bitwiseAND(F.lit(1)).alias("m1"), "opens")


def _carried(df: DataFrame, window, start: Column | None = None) -> DataFrame:
    """Add ``open_before``: what the maps ``m0``, ``m1`` of the rows before make of ``start`` (closed).

    A map either flips, keeps or sets. The state is what the last setting row left, flipped as often as
    rows after it flip."""
    flips = F.sum(F.when((F.col("m0") == 1) & (F.col("m1") == 0), 1).otherwise(0)).over(window) % 2
    first = F.lit(0) if start is None else start
    marked = df.withColumn("_flips", flips)
    sets = F.when(F.col("m0") == F.col("m1"), F.col("m0").bitwiseXOR(F.col("_flips").cast("int")))
    marked = marked.withColumn("_set", F.last(sets, True).over(window))
    after = F.coalesce("_set", first).bitwiseXOR(F.col("_flips").cast("int"))
    return (marked.withColumn("_after", after)
            .withColumn("open_before", F.coalesce(F.lag("_after").over(window.rowsBetween(-1, -1)), first))
            .drop("_flips", "_set"))


def records(lines: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per record, its lines joined by line feeds, at the place of its first line.

    ``chunks`` are the ``chunk_maps`` of the same lines, or of these and other files. A file that ends inside
    a quoted cell is an error: every line after the quote would be one record. Columns that ride along are
    taken from the record's first line."""
    others = [c for c in lines.columns if c not in (*PLACE, "value")]
    # a number stands for the chunk where lines move and are sorted: paths are long and begin alike
    states = settle(_carried(chunks, Window.partitionBy("file").orderBy("block", "chunk")).withColumn("_id", F.monotonically_increasing_id()))
    broken = states.groupBy("file").agg(F.max_by("_after", F.struct("block", "chunk")).alias("open")).filter("open = 1").first()
    if broken:
        raise ValueError(f"{broken.file} ends inside a quoted cell")
    touched = bounded(states.filter("opens = 1 or open_before = 1").select("file", "block", "chunk", "_id", F.col("open_before").alias("_open")))
    marked = lines.withColumn("chunk", _chunk()).join(touched, ["file", "block", "chunk"], "left")
    single = marked.filter(F.col("_open").isNull()).select(*lines.columns)
    told = marked.filter(F.col("_open").isNotNull()).select("_id", "at", "value", "_open", _line_map(F.col("value")).alias("_m"), *others)
    inside = Window.partitionBy("_id").orderBy("at")
    ordered = _carried(told.withColumns({"m0": F.shiftright("_m", 1), "m1": F.col("_m").bitwiseAND(F.lit(1))}), inside, F.col("_open"))
    begun = ordered.withColumn("_first", F.max(F.when(F.col("open_before") == 0, F.col("at"))).over(inside))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x.value), "\n")
    # grouped where the chunk is; a record's part in another chunk is a row of its own, without a first line there
    grouped = settle(begun.groupBy("_id", "_first").agg(
        whole.alias("value"), F.max_by("_after", "at").alias("_left"), *[F.min_by(c, "at").alias(c) for c in others]))
    parts = grouped.join(touched, "_id")
    cut = F.col("_first").isNull() | (F.col("_left") == 1)
    here = parts.filter(~cut).select("file", "block", F.col("_first").alias("at"), "value", *others)
    # two parts a chunk at most: they belong to the last record begun before them
    place = F.struct("block", "chunk", F.coalesce("_first", F.lit(-1).cast("long")))
    earlier = Window.partitionBy("file").orderBy(place)
    begin = F.when(F.col("_first").isNotNull(), F.struct(F.col("block").alias("b"), F.col("_first").alias("a")))
    spread = parts.filter(cut).withColumn("_place", place).withColumn("_own", F.last(begin, True).over(earlier))
    rest = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", "value"))), lambda x: x.value), "\n")
    joined = spread.groupBy("file", "_own").agg(rest.alias("value"), *[F.min_by(c, "_place").alias(c) for c in others])
    return single.unionByName(here).unionByName(joined.select("file", F.col("_own.b").alias("block"), F.col("_own.a").alias("at"), "value", *others))


def _cells(text: Column, width: int) -> Column:
    """The first ``width`` cells of a record as an array of texts."""
    names = [f"c{i}" for i in range(width)]
    parsed = F.from_csv(text, ", ".join(f"{n} string" for n in names), {"escape": '"', "maxCharsPerColumn": "-1", "maxColumns": str(width + 1000)})
    # inside a lambda the record is parsed once, not once per cell that is asked for
    return F.get(F.transform(F.array(parsed), lambda r: F.array(*[r[n] for n in names])), 0)


def _headers(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """(file, _head, header): the text at every file's first place with any cell."""
    return settle(rows.join(firsts, "file").filter(_at_head()).select("file", "_head", F.col("value").alias("header")))


def _at_head() -> Column:
    return (F.col("block") == F.col("_head.b")) & (_inside() == F.col("_head.a"))


def named_cells(lines: DataFrame, wanted: Sequence[str], required: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Text columns ``wanted`` and ``keep`` of all records of ``lines``, each file read by its own header.

    The first record of a file that has any cell is its header. Headers are one small table: records look
    up at which place each wanted column stands in their file, absent ones are null. A file without a
    required column is an error; its other columns are left out. The number of cells that are cut is that
    of the widest header."""
    chunks = chunk_maps(lines)
    # a record with a line break holds a quote, so its first line has a cell: a file's first such line begins its header
    place = F.when(F.col("head").isNotNull(), F.struct(F.col("block").alias("b"), F.col("head").alias("a")))
    files = settle(chunks.groupBy("file").agg(F.min(place).alias("_head"), F.max("opens").alias("opens")))
    known = files.agg(F.count("*").alias("n"), F.max("opens").alias("opens")).first()
    per_file = F.broadcast if known.n <= BROADCAST_ROWS else (lambda table: table)  # one row a file, a few numbers each
    rows, firsts = lines, files.filter("_head is not null")
    heads = _headers(lines, per_file(firsts.filter("opens = 0").select("file", "_head")))
    if known.opens:
        marked = lines.join(per_file(files.filter("opens = 1").select("file", "opens")), "file", "left")
        joined = records(marked.filter("opens = 1").drop("opens"), chunks.join(per_file(files.filter("opens = 1").select("file")), "file"))
        heads = heads.unionByName(_headers(joined, per_file(firsts.filter("opens = 1").select("file", "_head"))))
        rows = marked.filter("opens is null").drop("opens").unionByName(joined)
    commas = F.length("header") - F.length(F.replace("header", F.lit(","), F.lit("")))
    width = heads.agg(F.max(commas)).first()[0]
    if width is None:
        raise ValueError("no data lines")
    width += 1
    names = heads.withColumn("names", F.transform(_cells(F.col("header"), width), F.trim))
    lacking = [~F.coalesce(F.array_contains("names", c), F.lit(False)) for c in required]
    short = names.filter(reduce(Column.__or__, lacking, F.lit(False))).first()
    if short:
        raise ValueError(f"missing required columns: {[c for c in required if c not in short.names]} in {short.file}")
    places = names.select("file", "_head", *[F.array_position("names", c).cast("int").alias(f"_at{i}") for i, c in enumerate(wanted)])
    parsed = rows.join(per_file(places), "file").filter(~_at_head()).withColumn("_cells", _cells(F.col("value"), width))
    named = F.struct(*[F.when(F.col(f"_at{i}") > 0, F.get("_cells", F.col(f"_at{i}") - 1)).alias(c) for i, c in enumerate(wanted)])
    # exploded, so that a filter on any cell is not moved before the cut, where it would cut the record again
    return parsed.select(F.explode(F.array(named)).alias("_named"), *keep).select(*[F.col("_named")[c].alias(c) for c in wanted], *keep)
