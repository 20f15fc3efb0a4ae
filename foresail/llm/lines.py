"""Near-duplicate lines by an exact set-similarity join, in built-in Spark functions only.

A line is the set of its words, ordered by rarity (rarest first). Words that only one of two sets has
part neighbours of the other, each at most one pair of words that both sets have next to each other;
so two sets with Jaccard similarity of at least ``share`` have some word and its successor in common,
both within their prefixes. Those pairs of neighbours are joined, under length and positional filters,
and survivors are verified on the whole sets. A line is removed if an equal set or a set that similar
occurs earlier in the table (by document id, then line number), whether or not that earlier line stays
itself.

Any order of the words will do, as long as all sets share it. So words that crowd, neighbours in the
prefixes of many different sets, go behind all others: a passage that many lines quote then brings
nobody together who differs in the rest. A set that is crowded words for the most part still has
neighbours of them in its prefix. Such sets, variants of one text mostly, carry a sketch: a bit for
each of 256 hash values, set if an odd number of words has it. Two sets differ in at least as many
words as their sketches in bits, so most of those that are not similar part in the join itself.

One earlier witness decides about a line. So by a few neighbours, drawn by hash from its prefix, each
set first meets only the earliest set that drew the same: that settles most members of a large group
of variants with one verified pair each. Sets still undecided meet all sets of all their neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foresail.llm.common import WORD_BREAK, settle_table

#: Words are counted in this many hash buckets: a fixed size, whatever the vocabulary.
BUCKETS = 1 << 16
#: Documents' ids and numbers of candidate lines are broadcast up to so many 4-byte numbers; beyond, the join shuffles.
FETCH_NUMBERS = 4_000_000
#: Neighbours crowd if so many different sets, and one in so many, have them in the prefix, among documents of one in SAMPLE
#: hashes; as words go back others come to the front, so this is looked at ROUNDS times at most. The sample only chooses
#: the order of words: the result is the same for any.
SAMPLE, CROWD, ONE_IN, ROUNDS = 64, 3, 20_000, 5
#: Levels of crowded words begin here, above those of all others.
CROWDED = 60
#: A neighbour leads to its earliest set if so many sets drew it. Fewer meet each other in the join on all neighbours at
#: less cost than that of reading their lines again.
LED = 8
#: Joins hash a side whose every part, as shuffled, is at most so large.
HASHED = "32m"
#: 64-bit parts of a sketch.
PARTS = 4

Share = tuple[int, int]


@contextmanager
def _join_settings(spark: SparkSession) -> Iterator[None]:
    """What each job shuffles inside is of no use after it and leaves the disks at once; joins whose parts prove small
    once shuffled hash one side instead of sorting both."""
    names = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": HASHED}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _spaced(text: Column) -> Column:
    """The text with a space for every other break but the line feed, so that words are cut at one character."""
    breaks = [text.contains(c) for c in "\t\v\f\r"]
    return F.when(breaks[0] | breaks[1] | breaks[2] | breaks[3], F.regexp_replace(text, r"[\x09\x0B-\x0D]", " ")).otherwise(text)


def _keys(level: dict[int, int]) -> Callable[[Column], Column]:
    """A function from a key's lower 56 bits, of a word's hash, to the key: the level of its bucket, then those bits."""
    levels = F.split(F.lit(",".join(str(level.get(b, 0)) for b in range(BUCKETS))), ",").cast("array<tinyint>")
    # with a default it is never null, and arrays without nulls sort as plain numbers
    return lambda low: F.shiftleft(F.coalesce(F.get(levels, low.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), F.lit(0).cast("tinyint")).cast("long"), 56).bitwiseOR(low)


def _low(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 8)


def _level_crowded(docs: DataFrame, level: dict[int, int], share: Share, text_col: str) -> dict[int, int]:
    """``level`` with the words that are neighbours in the prefixes of many different sets behind all others, in their order."""
    some = docs.select(F.col(text_col).cast("string").alias("t")).where(F.xxhash64("t", F.lit(1)).bitwiseAND(F.lit(SAMPLE - 1)) == 0)
    key = _keys(level)
    sets = some.select(F.explode(F.split(_spaced(F.col("t")), "\n")).alias("t")).select(_tokens(F.col("t"), key).alias("t")).where(F.size("t") > 0)
    sets = settle_table(sets.distinct(), "line-sample")
    least = max(CROWD, sets.count() // ONE_IN)
    for _ in range(ROUNDS):
        key = _keys(level)
        again = F.sort_array(F.transform("t", lambda x: key(x.bitwiseAND(F.lit((1 << 56) - 1)))))  # noqa: B023
        prefix = sets.select(F.slice(again, 1, _neighbours(F.size("t"), share) + 1).alias("t"))
        pair = prefix.select(F.explode(F.arrays_zip(F.col("t").alias("x"), F.slice("t", 2, F.size("t")).alias("y"))).alias("p")).where("p.y IS NOT NULL")
        many = pair.groupBy(F.col("p.x").alias("x"), F.col("p.y").alias("y")).count().where(F.col("count") >= least)
        found = many.select(F.explode(F.array("x", "y")).alias("w")).select(F.col("w").bitwiseAND(F.lit(BUCKETS - 1)).alias("b")).distinct().collect()
        fresh = {r.b: CROWDED + level[r.b] for r in found if level[r.b] < CROWDED}
        if not fresh:
            break
        level = level | fresh
    return level


def rarity(docs: DataFrame, share: Share, text_col: str = "text") -> Callable[[Column], Column]:
    """A function from the bits of a word's hash that ``_low`` keeps to its sort key: half powers of two of its bucket's count, then those
    bits. Counts cover all texts; buckets of crowded words come last. The key is one long and so also stands for the
    word; its order is total and the same everywhere, which is all that the prefix filter needs."""
    words = F.split(F.replace(_spaced(F.col(text_col).cast("string")), F.lit("\n"), F.lit(" ")), " ")
    counted = docs.select(F.explode(words).alias("w")).groupBy(_low(F.xxhash64("w")).bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("b"))
    found = counted.agg(F.least(F.lit(CROWDED - 1), F.floor(2 * F.log2(F.count("*")))).cast("int").alias("level"))
    return _keys(_level_crowded(docs, {r.b: r.level for r in found.collect()}, share, text_col))


def _tokens(line: Column, key: Callable[[Column], Column]) -> Column:
    """Distinct word keys of a line of a ``_spaced`` text, rarest first."""
    lows = F.transform(F.split(line, " "), lambda w: _low(F.xxhash64(w)))
    # leaves out what the empty strings between spaces become, and repeats
    return F.sort_array(F.transform(F.array_except(lows, F.array(_low(F.xxhash64(F.lit(""))))), key))


def _sketch(tokens: Column) -> Column:
    """Bits of the hash values (of 64 * PARTS) that an odd number of words has."""
    value = lambda x, bits: F.shiftright(x, bits).bitwiseAND(F.lit(63))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), value(x, 0).cast("int"))
    part = lambda p: F.aggregate(tokens, F.lit(0).cast("long"), lambda s, x: F.when(value(x, 6) % PARTS == p, s.bitwiseXOR(bit(x))).otherwise(s))
    return F.array(*(part(p) for p in range(PARTS)))


def _unlike(sketch: Column, other: Column) -> Column:
    """How many words two sets differ in at least; 0 if one has no sketch."""
    bits = [F.bit_count(F.get(sketch, F.lit(p)).bitwiseXOR(F.get(other, F.lit(p)))) for p in range(PARTS)]
    return F.coalesce(sum(bits[1:], bits[0]), F.lit(0))


def _neighbours(n: Column, share: Share) -> Column:
    """How many pairs of neighbours of a set of ``n`` words any similar set shares one of.

    If x words are only in this set and y only in the other one of m words, one of the first 2x + y + 1
    is common to both. With z in common, that is 2n + m - 3z + 1, and z is a / (a + b) of n + m at least:
    most for the smallest m, n * a / b, or for a share below one half for the largest."""
    a, b = share
    return F.floor(n.cast("long") * F.lit((b - a) * max(2 * a, b)) / F.lit(a * b)).cast("int") + 1


def _enough(common: Column, n: Column, m: Column, share: Share) -> Column:
    """Whether two sets with so many pairs of neighbours in common within their prefixes can be similar.

    The rth pair of neighbours that both sets have is among the first 2x + y + r of one and x + 2y + r of
    the other; with z words in common there are 3z - n - m - 1 at least. As above, 3z is bounded."""
    a, b = share
    least = 3 * a * (n + m)
    short = [(_neighbours(p, share).cast("long") - 2 * p - q) * (a + b) + least for p, q in ((n, m), (m, n))]
    return common * (a + b) >= F.least(*short, least - (n + m + 1) * (a + b))


def _can_be(p: str, q: str, share: Share) -> Column:
    """Whether the prefixes of two sets leave room for them to be similar.

    Of two prefixes, the one that ends first in the order of words shows all that its words up to there have in common
    with the other set: those that are not in the other prefix are not in the other set."""
    a, b = share
    n, m = (F.col(f"{s}.n").cast("long") for s in (p, q))
    common = F.size(F.array_intersect(f"{p}.prefix", f"{q}.prefix"))
    room = lambda s, n: n - (F.size(F.array_distinct(f"{s}.prefix")) - common)
    return (a + b) * F.greatest(room(p, n), room(q, m)) >= a * (F.col(f"{p}.n") + F.col(f"{q}.n"))


def document_lines(docs: DataFrame, key: Callable[[Column], Column], share: Share, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, line, sid, n, prefix, plain, sketch): a row per line, one with a null line for a null text.

    ``line`` is its number, ``sid`` its set's id (null: no word) and ``n`` that set's size. The prefix
    keeps 31 bits of each word's key; words that agree in them only add candidates, which verification
    drops. ``plain`` of them, the first, are not crowded; sets whose prefix has others have a sketch.
    Rows that repeat id and text repeat their lines."""
    text = F.col(text_col).cast("string")
    each = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode_outer(F.split(_spaced(text), "\n")).alias("line", "words"))
    cut = each.select("doc_id", "text_hash", "line", _tokens(F.col("words"), key).alias("t"))
    t = F.col("t")
    long = F.least(F.size(t), _neighbours(F.size(t), share) + 1)
    prefix = F.transform(F.slice(t, 1, long), lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF).cast("long")).cast("int"))
    crowd = lambda x: F.shiftright(x, 56) >= CROWDED
    deep = (F.size(t) > 0) & crowd(F.get(t, long - 1))
    plain = F.when(deep, F.size(F.filter(F.slice(t, 1, long), lambda x: ~crowd(x)))).otherwise(long)
    return cut.select("doc_id", "text_hash", "line", F.when(F.size(t) > 0, F.xxhash64(t)).alias("sid"), F.size(t).alias("n"), prefix.alias("prefix"), plain.alias("plain"), F.when(deep, _sketch(t)).alias("sketch"))


def _first(doc: str = "doc_id") -> Column:
    """Sort key of a document: null ids last."""
    return F.coalesce(doc, F.lit((1 << 63) - 1))


def _fetch(docs: DataFrame, nodes: DataFrame, key: Callable[[Column], Column], id_col: str, text_col: str) -> DataFrame:
    """(sid, tokens) of the sets in ``nodes`` (sid, doc, line), read again from the documents."""
    where = settle_table(nodes.groupBy("doc").agg(F.collect_set("line").alias("wanted")), "line-fetch")
    # 16 bytes a document and 4 a line: a broadcast has a proven size
    small = (where.agg(F.sum(4 + F.size("wanted"))).first()[0] or 0) <= FETCH_NUMBERS
    narrow = docs.select(_first(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    texts = narrow.join(F.broadcast(where) if small else where, "doc")
    lines = texts.select("wanted", F.posexplode(F.split(_spaced(F.col("text")), "\n")).alias("line", "t")).where(F.array_contains("wanted", F.col("line")))
    tokens = lines.select(_tokens(F.col("t"), key).alias("tokens")).select(F.xxhash64("tokens").alias("sid"), "tokens")
    return tokens.groupBy("sid").agg(F.first("tokens").alias("tokens"))


def _verified(pairs: DataFrame, tokens: DataFrame, share: Share) -> DataFrame:
    """Set ids of ``pairs`` (sid, other) whose whole sets are similar enough."""
    a, b = share
    # both sides are renamed, so that one shuffle serves them
    joined = pairs.toDF("p", "q").join(tokens.toDF("p", "t"), "p").join(tokens.toDF("q", "u"), "q")
    common = F.size(F.array_intersect("t", "u"))
    return joined.where(b * common >= a * (F.size("t") + F.size("u") - common)).select(F.col("p").alias("sid")).distinct()


def _pair_key(token: Column, successor: Column) -> Column:
    """One number for a word and its successor; no successor: for the word alone."""
    return F.shiftleft(token.cast("long"), 32).bitwiseOR(F.coalesce(successor.cast("long"), F.lit((1 << 32) - 1)))


def _leads(prefix: Column, deep: Column) -> Column:
    """The neighbours that a set draws: its words of smallest and of largest hash with their successors, in a crowd some more."""
    drawn = lambda x: _pair_key(x, F.get(prefix, F.array_position(prefix, x).cast("int")))
    # outside of a function of an array's elements, so that Spark compiles it
    two = F.array(drawn(F.array_min(prefix)), drawn(F.array_max(prefix)))
    mixed = lambda x, k: F.xxhash64(x, F.lit(k)).bitwiseAND(F.lit(~0xFFFFFFFF)).bitwiseOR(x.cast("long"))
    more = [F.array_min(F.transform(prefix, lambda x, k=k: mixed(x, k))).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int") for k in range(6)]
    return F.when(deep, F.array_distinct(F.concat(two, F.transform(F.array(*more), drawn)))).otherwise(two)


def _about(n: str = "n") -> Column:
    """Size, place and flag share one number: fewer columns make smaller rows."""
    return F.shiftleft(F.col(n).cast("long"), 32).bitwiseOR(F.coalesce("found", F.lit(0).cast("long")))


def neighbour_rows(sets: DataFrame, share: Share) -> DataFrame:
    """(pair, no, about): a row per pair of neighbours in the prefix of ``sets`` (no, n, prefix, plain, found), but for
    those of two crowded words; any two similar sets have a pair in common, here or in ``crowd_rows``."""
    a, b = share
    as_long = lambda c: F.col(c).cast("long")
    each = sets.select("no", "n", "plain", _about().alias("about"), "prefix", F.posexplode("prefix").alias("pos", "token"))
    about = F.col("about").bitwiseOR(F.shiftleft(as_long("pos"), 1)).alias("about")
    successor = F.get("prefix", F.col("pos") + 1)
    rows = each.where(successor.isNotNull() & (F.col("pos") < F.col("plain"))).select(_pair_key(F.col("token"), successor).alias("pair"), "no", about)
    # Sets of so few words, or for a share of one half or less any sets, need not have neighbours in common, but a word.
    small = [n for n in range(1, 2 * b + 1) if n * (b - a) >= a and n * (2 * a - b) < 2 * b]
    if small:
        alone = each.where(F.lit(2 * a <= b) | (as_long("n") * (2 * a - b) < 2 * b))
        alone = alone.where(F.col("pos") <= F.col("n") - F.ceil(as_long("n") * F.lit(a) / F.lit(b)))
        rows = rows.union(alone.select(_pair_key(F.col("token"), F.lit(None)), "no", about))
    return rows


def crowd_rows(sets: DataFrame) -> DataFrame:
    """(pair, no, at, sketch, pairs, about): the same for neighbours that are two crowded words, ``pairs`` all of the set's."""
    pairs = F.transform(F.sequence(F.col("plain"), F.size("prefix") - 2), lambda k: _pair_key(F.get("prefix", k), F.get("prefix", k + 1)))
    each = sets.where(F.col("plain") <= F.size("prefix") - 2).select("no", "at", "sketch", "plain", _about().alias("about"), pairs.alias("pairs"))
    each = each.select("*", F.posexplode("pairs").alias("k", "pair"))
    return each.select("pair", "no", "at", "sketch", "pairs", F.col("about").bitwiseOR(F.shiftleft((F.col("plain") + F.col("k")).cast("long"), 1)).alias("about"))


def similar_earlier(docs: DataFrame, lines: DataFrame, key: Callable[[Column], Column], share: Share, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(sets, decided): every set's first place, and the ids of sets that resemble an earlier other set."""
    a, b = share
    # once written, the short number ``no`` stands for the set: it compresses, unlike a hash
    every_set = settle_table(lines.where("sid IS NOT NULL").withColumn("doc", _first()).groupBy("sid").agg(F.min(F.struct("doc", "line", "n", "prefix", "plain", "sketch")).alias("m")).select(F.monotonically_increasing_id().alias("no"), "sid", "m.*"), "line-sets")
    # Below this size only equal sets are similar enough.
    joinable = every_set.where(F.col("n").cast("long") * (b - a) >= a)
    as_long = lambda c: F.col(c).cast("long")
    at = F.struct("doc", "line", as_long("n").alias("n"), "sid").alias("at")

    def of_a_size(n: Column, m: Column) -> Column:
        return F.least(n, m) * b >= F.greatest(n, m) * a

    def of_a_sketch(sketch: Column, other: Column, n: Column, m: Column) -> Column:
        """Similar sets differ in (b - a) / (a + b) of both sizes at most."""
        return (a + b) * _unlike(sketch, other) <= (b - a) * (n + m)

    def check(pairs: DataFrame) -> DataFrame:
        nodes = pairs.select("sid", "doc", "line").union(pairs.select("other", "odoc", "oline")).distinct()
        return _verified(pairs.select("sid", "other"), settle_table(_fetch(docs, nodes, key, id_col, text_col), "line-tokens"), share)

    # drawn before they are exploded: Spark compiles the one and the other, but not both in one
    lead = joinable.select(_leads(F.col("prefix"), F.col("sketch").isNotNull()).alias("leads"), at, "sketch").select(F.explode("leads").alias("pair"), "at", "sketch").repartition("pair")
    earliest = lead.groupBy("pair").agg(F.min(F.struct("at", "sketch")).alias("o"), F.count("*").alias("drew")).where(F.col("drew") >= LED).drop("drew")
    found = lead.join(earliest, "pair").where(of_a_size(F.col("at.n"), F.col("o.at.n")) & of_a_sketch(F.col("sketch"), F.col("o.sketch"), F.col("at.n"), F.col("o.at.n")) & (F.col("o.at") < F.col("at")))
    found = found.select("at", F.struct(_unlike(F.col("sketch"), F.col("o.sketch")).alias("unlike"), F.col("o.at").alias("at")).alias("o")).groupBy("at").agg(F.min("o").alias("o"))
    both = [F.col(f"at.{c}").alias(c) for c in ("sid", "doc", "line")], [F.col("o.at.sid").alias("other"), F.col("o.at.doc").alias("odoc"), F.col("o.at.line").alias("oline")]
    decided = settle_table(check(settle_table(found.select(*both[0], *both[1]), "line-pairs")), "line-decided")

    few = decided.count() * 2 <= FETCH_NUMBERS
    flags = decided.select("sid", F.lit(1).cast("long").alias("found"))
    flagged = lambda sets: sets.join(F.broadcast(flags) if few else flags, "sid", "left")
    size = lambda c: F.shiftright(c, 32)
    place = lambda c: F.shiftright(F.col(c).bitwiseAND(F.lit((1 << 32) - 1)), 1)
    is_found = lambda c: F.col(c).bitwiseAND(F.lit(1).cast("long")) == 1
    n, m, i, j = size("about"), size("o.about"), place("about"), place("o.about")
    # A decided set looks for nothing, and similar sets have a / (a + b) of both sizes in common.
    like = of_a_size(n, m) & ((a + b) * (F.least(i, j) + F.least(n - i, m - j)) >= a * (n + m))

    def meet(rows: DataFrame, those: Column) -> DataFrame:
        return rows.join(rows.select("pair", F.struct(*(c for c in rows.columns if c != "pair")).alias("o")), "pair").where(those & like)

    every = neighbour_rows(flagged(joinable.select("sid", "no", "n", "prefix", "plain")), share).repartition("pair")
    met = meet(every, (F.col("no") < F.col("o.no")) & ~(is_found("about") & is_found("o.about")))
    met = met.groupBy(F.col("no").alias("x"), F.col("o.no").alias("y"), n.alias("n"), m.alias("m")).agg(F.count("*").alias("common"))
    met = met.where(_enough(F.col("common"), F.col("n"), F.col("m"), share)).select("x", "y")
    crowd = crowd_rows(flagged(joinable.where("sketch IS NOT NULL").select("sid", "no", "n", "prefix", "plain", "sketch", at))).repartition("pair")
    # Two sets of a crowd share many neighbours: they meet at the smallest.
    smallest = F.array_min(F.array_intersect("pairs", "o.pairs")) == F.col("pair")
    # one condition on both sides: apart from the other side's, it would make of one shuffle two that read all sets
    seeks = F.when(F.col("o.at") < F.col("at"), ~is_found("about")).otherwise(False)
    close = meet(crowd, seeks & of_a_sketch(F.col("sketch"), F.col("o.sketch"), n, m)).where(smallest)
    met = settle_table(met.union(close.select(F.least("no", "o.no"), F.greatest("no", "o.no"))).distinct(), "line-met")
    places = every_set.select("no", F.struct("doc", "line", "n", "sid", "prefix").alias("at"))
    # the few pairs are hashed, so the many sets need no sort
    met = met.hint("shuffle_hash").join(places.toDF("x", "p"), "x").hint("shuffle_hash").join(places.toDF("y", "q"), "y").where(_can_be("p", "q", share))
    met = met.select(F.greatest("p", "q").alias("at"), F.struct(F.least("p", "q").alias("at")).alias("o"))
    more = met.select(*both[0], *both[1]).join(F.broadcast(decided) if few else decided, "sid", "left_anti")
    return every_set.select("sid", "doc", "line"), decided.union(check(settle_table(more, "line-pairs"))).distinct()


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: Share = (4, 5)) -> DataFrame:
    """(doc_id, text_hash, n_lines, removed array<int>): numbers (from 0) of the lines to remove, ascending.

    ``share`` is the similarity as a fraction of whole numbers. One row per distinct (id, text): rows
    that repeat both are one document. Null ids come last and count as one id; a null text has no
    lines, an empty one a single line; lines without a word stay. Lines of one id and number under
    different texts follow each other by their set's hash. Sets are told apart by 64-bit hashes of
    their words' keys; similar pairs are verified word by word. Other columns are not read."""
    with _join_settings(docs.sparkSession):
        key = rarity(docs, share, text_col)
        lines = settle_table(document_lines(docs, key, share, id_col, text_col), "lines")
        sets, decided = similar_earlier(docs, lines, key, share, id_col, text_col)
    kept = sets.join(decided, "sid", "left_anti").select("sid", "doc", "line")
    of = ["doc_id", "text_hash"]
    # Only lines that go are gathered by document; the lines of one lie side by side, so counting them moves a row each.
    gone = lines.where("sid IS NOT NULL").select(*of, "line", "sid", _first().alias("doc")).join(kept, ["sid", "doc", "line"], "left_anti")
    gone = gone.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.sort_array(F.collect_set("line")).alias("gone"))
    counts = lines.groupBy(*of).agg((F.coalesce(F.max("line"), F.lit(-1)) + 1).alias("n_lines"))
    return counts.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left").select(
        *of, "n_lines", F.coalesce("gone", F.array().cast("array<int>")).alias("removed"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: Share = (4, 5)) -> DataFrame:
    """``docs`` with the removed lines taken out of the text; all rows and other columns stay as they are."""
    marks = removed_lines(docs, id_col, text_col, share).where(F.size("removed") > 0).select(
        F.struct(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).alias("__key"), F.col("removed").alias("__gone"))
    tag = "__lines"
    while any(c.startswith(tag) for c in docs.columns):
        tag += "_"
    marks = marks.toDF(f"{tag}_key", f"{tag}_gone")
    key = F.struct(docs[id_col].cast("long").alias("d"), F.xxhash64(docs[text_col].cast("string")).alias("h"))
    joined = docs.join(marks, key.eqNullSafe(marks[f"{tag}_key"]), "left")
    left = F.array_join(F.filter(F.split(docs[text_col], "\n"), lambda line, k: ~F.array_contains(marks[f"{tag}_gone"], k)), "\n")
    return joined.select(*(F.when(marks[f"{tag}_gone"].isNull(), docs[c]).otherwise(left).alias(c) if c == text_col else docs[c] for c in docs.columns))
