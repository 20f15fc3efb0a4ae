"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the expected number of its copies. Rates stay as close to 1 as possible in
relative entropy under one constraint per source, that the rates times sizes add up to the source's
target, and no rate exceeds ``most``. The convex dual has one variable per source: rate =
min(most, exp(theta * size / mean size)). Newton steps on all sources at once, each one aggregate over
the (source, size, number of documents) table, find theta. Systematic rounding in order of size turns
rates into whole copies, so a source's tokens miss the target by less than one large document."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from foresail.functions.ranks import global_rank
from foresail.llm.common import WORD_BREAK, settle_table

WEIGHTS = (3, 1, 2)
#: Rates are counted in this part of a copy: exact whole numbers, so reruns agree whatever the partitions.
UNIT_BITS = 20
UNIT = 1 << UNIT_BITS
#: Starts of the systematic rounding that are compared.
STARTS = 32
_SOURCE = ("none", "source")


def _key(source: Column) -> tuple[Column, Column]:
    """A source as two columns without nulls; the null source sorts last."""
    return source.isNull().alias("none"), F.coalesce(source.cast("string"), F.lit("")).alias("source")


def document_sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, text_hash, none, source, size in words) of every row; a null text has none."""
    text = F.col(text_col).cast("string")
    words = F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), *_key(F.col(source_col)), words.alias("size"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """(none, source, source_size, target): ``share`` of all tokens dealt by weight, at most ``most`` times a source's own.

    Weights go round the sources in order of their UTF-8 bytes, null last. What a full source cannot take is
    dealt again by weight among the others: targets are min(most * size, level * weight) for one level."""
    totals = sizes.groupBy(*_SOURCE).agg(F.sum("size").alias("source_size"))
    ranked = global_rank(totals, [F.col(c) for c in _SOURCE], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int") + 1)
    weighed = settle_table(ranked.select(*_SOURCE, "source_size", weight.alias("weight")), "mix-sources")
    everything = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, None
    while True:
        cap = F.col("source_size") * most
        over = F.lit(False) if full is None else F.col("weight") * F.lit(level) >= cap
        taken, rest, count = weighed.agg(
            F.sum(F.when(over, cap).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight"))), F.count(F.when(over, 1))).first()
        if count == full or not rest:
            break
        level, full = (share * everything - taken) / rest, count
    target = F.least((F.col("source_size") * most).cast("double"), F.col("weight") * F.lit(float(level)))
    return weighed.select(*_SOURCE, "source_size", target.alias("target"))


def tilt(histogram: DataFrame, targets: DataFrame, most: int = 2, exact: float = 1e-7, steps: int = 80) -> DataFrame:
    """(none, source, theta, mean): the dual variable of every source whose target lies between 0 and its most.

    ``histogram`` has (none, source, size, n). Newton steps are kept inside the bracket that the signs
    seen so far leave, else it is halved. Sums are exact decimals: the result does not depend on the
    order of addition."""
    inner = targets.where((F.col("target") > 0) & (F.col("target") < F.col("source_size") * most))
    means = histogram.groupBy(*_SOURCE).agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    nothing = F.lit(None).cast("double")
    state = settle_table(inner.join(means, list(_SOURCE)).select(
        *_SOURCE, "target", "mean", F.lit(0.0).alias("theta"), nothing.alias("low"), nothing.alias("high"), F.lit(False).alias("done")), "mix-state")
    work = settle_table(histogram.join(inner.select(*_SOURCE), list(_SOURCE), "left_semi"), "mix-histogram")
    for _ in range(steps):
        if not state.where(~F.col("done")).limit(1).count():
            break
        x = F.col("size") / F.col("mean")
        exponent = F.col("theta") * x
        rate = F.when(exponent >= math.log(most), F.lit(float(most))).otherwise(F.exp(exponent))
        slope = F.when(exponent >= math.log(most), 0.0).otherwise(F.exp(exponent) * x)
        amount = F.col("n") * F.col("size")
        exactly = lambda c: F.sum(c.cast("decimal(38,8)")).cast("double")
        sums = work.join(state.where(~F.col("done")), list(_SOURCE)).groupBy(*_SOURCE).agg(exactly(amount * rate).alias("total"), exactly(amount * slope).alias("slope"))
        gap = F.col("total") - F.col("target")
        low, high = F.when(gap < 0, F.col("theta")).otherwise(F.col("low")), F.when(gap > 0, F.col("theta")).otherwise(F.col("high"))
        moved = state.join(sums, list(_SOURCE), "left").select(*_SOURCE, "target", "mean", "theta", low.alias("low"), high.alias("high"),
                                                              (F.col("done") | (F.abs(gap) <= exact * F.col("target"))).alias("done"), gap.alias("gap"), "slope")
        newton = F.col("theta") - F.try_divide("gap", "slope")
        inside = newton.isNotNull() & (F.col("low").isNull() | (newton > F.col("low"))) & (F.col("high").isNull() | (newton < F.col("high")))
        apart = (F.when(F.col("low").isNull(), F.col("high") * 2 - 1).when(F.col("high").isNull(), F.col("low") * 2 + 1)
                 .otherwise((F.col("low") + F.col("high")) / 2))
        state = settle_table(moved.select(*_SOURCE, "target", "mean", F.when(F.col("done"), F.col("theta")).when(inside, newton).otherwise(apart).alias("theta"), "low", "high", "done"), "mix-state")
    return state.select(*_SOURCE, "theta", "mean")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """(doc_id, text_hash, source, size, source_size, target, copies) of every row.

    Null texts have size 0 and no copies, as have all texts without a word; null sources form one
    source, the last; rows with equal ids count one by one. Equal rows may get different copies, in no
    fixed order among them. An empty table gives no rows. Other columns are not read."""
    sizes = settle_table(document_sizes(docs, id_col, text_col, source_col), "mix-sizes")
    targets = settle_table(source_targets(sizes, weights, share, most), "mix-targets")
    theta = tilt(sizes.where("size > 0").groupBy(*_SOURCE, "size").agg(F.count("*").alias("n")), targets, most)
    ranked = settle_table(global_rank(sizes, [*(F.col(c) for c in _SOURCE), F.col("size"), F.xxhash64("doc_id"), F.col("doc_id"), F.col("text_hash")], "place"), "mix-order")
    exponent = F.col("theta") * F.col("size") / F.col("mean")
    rate = (F.when(F.col("target") <= 0, 0.0).when(F.col("theta").isNull() | (exponent >= math.log(most)), float(most)).otherwise(F.exp(exponent)))
    groups = (
        ranked.groupBy(*_SOURCE, "size").agg(F.count("*").alias("n"), F.min("place").alias("first"))
        .join(targets, list(_SOURCE)).join(theta, list(_SOURCE), "left")
        .withColumn("units", F.when(F.col("size") > 0, F.round(rate * UNIT)).otherwise(0).cast("long"))
    )
    # One row per distinct size of a source: its length follows the longest text, not the corpus.
    before = F.sum(F.col("n") * F.col("units")).over(Window.partitionBy(*_SOURCE).orderBy("size")) - F.col("n") * F.col("units")
    groups = settle_table(groups.select(*_SOURCE, "size", "n", "first", "units", before.alias("before")), "mix-groups")
    copies = lambda start: F.shiftright(F.col("passed") + F.col("units") + start, UNIT_BITS) - F.shiftright(F.col("passed") + start, UNIT_BITS)
    # Any start of the systematic rounding is fair; each source takes the one of a fixed set that ends nearest to its target.
    starts = [k * UNIT // STARTS for k in range(STARTS)]
    # All documents of one size are neighbours: their copies together are those of one step over the group.
    together = lambda start: F.shiftright(F.col("before") + F.col("n") * F.col("units") + start, UNIT_BITS) - F.shiftright(F.col("before") + start, UNIT_BITS)
    tried = groups.groupBy(*_SOURCE).agg(F.array(*(F.sum(F.col("size") * together(F.lit(k))) for k in starts)).alias("taken")).join(targets, list(_SOURCE))
    misses = F.transform("taken", lambda t, k: F.struct(F.abs(F.coalesce(t, F.lit(0)) - F.col("target")).alias("miss"), F.element_at(F.array(*map(F.lit, starts)), k + 1).alias("start")))
    chosen = tried.select(*_SOURCE, "source_size", "target", F.array_min(misses).start.alias("start"))
    # Documents are dealt by source and size, never by source alone.
    placed = ranked.join(groups.join(chosen, list(_SOURCE)), [*_SOURCE, "size"], "left").withColumn("passed", F.col("before") + (F.col("place") - F.col("first")) * F.col("units"))
    return placed.select(
        "doc_id", "text_hash", F.when(~F.col("none"), F.col("source")).alias("source"), "size", "source_size", "target",
        F.coalesce(copies(F.col("start")), F.lit(0)).cast("long").alias("copies"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """``docs`` with every row as often as it has copies, all columns kept.

    Rows that agree in id, text and source are one document: the one whose columns have the least hash
    stands for all, with their copies added up."""
    copies = mix(docs, id_col, text_col, source_col, **how).groupBy("doc_id", "text_hash", "source").agg(F.sum("copies").alias("copies")).where("copies > 0")
    tag = "__mix"
    while any(c.startswith(tag) for c in docs.columns):
        tag += "_"
    names = [f"{tag}_{c}" for c in ("doc", "hash", "source")]
    marked = docs.select("*", F.col(id_col).cast("long").alias(names[0]), F.xxhash64(F.col(text_col).cast("string")).alias(names[1]), F.col(source_col).cast("string").alias(names[2]))
    plan = copies.select(F.struct(*(F.col(c).alias(n) for c, n in zip(("doc_id", "text_hash", "source"), names))).alias(f"{tag}_key"), F.col("copies").alias(f"{tag}_n"))
    hashed = F.xxhash64(*(f.name for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")))
    single = marked.groupBy(*names).agg(F.min_by(F.struct(*docs.columns), hashed).alias(f"{tag}_row"))
    joined = single.join(plan, F.struct(*names).eqNullSafe(F.col(f"{tag}_key")))
    return joined.withColumn(f"{tag}_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{tag}_n")))).select(f"{tag}_row.*")
