"""Exact rank statistics that never sort a whole group in one task.

Ranks are found by narrowing: a range of values is cut into cells, the cells are counted with a combined
aggregate, and only the cell that holds the wanted rank is cut again, until one value is left. Where every
value counts, ranges of a sorted table are added up apart and carried forward. Repeated values are counted
before they move, so a value shared by a third of the rows is one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from foresail.session import bounded, settle

_ONE = "_one"


def _constant_key(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(by)) if by else (df.withColumn(_ONE, F.lit(1)), [_ONE])


def _log_bucket(v: Column) -> Column:
    """Monotone bucket, 1/2048 wide in relative terms: at most ~60k buckets, and for currency
    with two decimals at most v/20 distinct values in each."""
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * 2048)


#: Cells that a range is cut into at a time; a window runs over so many rows per key at most.
CELLS = 4096


def _holding(cells: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of cells (``c`` values from ``lo`` to ``hi``) those that hold their key's rank ``r``, with the values before."""
    w = Window.partitionBy(*keys).orderBy(order)
    return (cells.withColumn("upto", F.col("base") + F.sum("c").over(w)).withColumn("base", F.col("upto") - F.col("c"))
            .filter((F.col("base") < F.col("r")) & (F.col("r") <= F.col("upto"))).drop("upto"))


def exact_median(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Median of ``value`` per ``by`` (mean of the two middle values for even counts); nulls and NaN do not count.

    Reads ``df`` twice. Values in a narrow range are cut finer and finer: at most five cuts tell doubles apart."""
    keyed, keys = _constant_key(df, by)
    rows = (keyed.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
            .select(*keys, F.col(value).alias("v")).withColumn("b", _log_bucket(F.col("v"))))
    n = F.sum("c").over(Window.partitionBy(*keys))
    cells = rows.groupBy(*keys, "b").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    middles = F.array_distinct(F.array(F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)))
    # one or two ranks per key: where that is small, the rows outside drop out before any shuffle
    both = cells.withColumn("n", n).withColumn("r", F.explode(middles)).withColumn("base", F.lit(0).cast("long")).drop("n")
    wanted = bounded(_holding(both, [*keys, "r"], "b"))
    open_ = wanted.filter("lo < hi")
    if not open_.isEmpty():
        values = settle(rows.join(open_.select(*keys, "b", "r"), [*keys, "b"]).groupBy(*keys, "r", "v").agg(F.count(F.lit(1)).alias("n")))
    found = wanted.filter("lo = hi").select(*keys, "lo")
    while not open_.isEmpty():
        inside = values.join(open_.select(*keys, "r", "base", "lo", "hi"), [*keys, "r"]).filter(F.col("v").between(F.col("lo"), F.col("hi")))
        # halves, lest the range of the largest doubles overflow; the smallest ones have no half
        part = F.try_divide(F.col("v") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2)
        share = F.coalesce(part, F.when(F.col("v") == F.col("lo"), 0.0).otherwise(1.0))
        cut = inside.withColumn("b", F.least(F.floor(share * CELLS), F.lit(CELLS - 1))).groupBy(*keys, "r", "base", "b").agg(
            F.sum("n").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        now = bounded(_holding(cut, [*keys, "r"], "b"))
        found = found.union(now.filter("lo = hi").select(*keys, "lo"))
        open_ = now.filter("lo < hi")
    return found.groupBy(*keys).agg(((F.min("lo") + F.max("lo")) / 2).alias("median")).select(*by, "median")


def roc_auc(scored: DataFrame, score: str, label: str, weight: str | None = None,
            by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve per ``by``; equal scores count half (mid-rank).

    Distinct scores are sorted in ranges of equal size, whatever their spread; each range adds up its own
    negatives, and those of the ranges before, one row per range and key, are carried into it."""
    keyed, keys = _constant_key(scored, by)
    units = F.lit(1) if weight is None else F.col(weight)
    per_score = settle(
        keyed.groupBy(*keys, F.col(score).alias("s"))
        .agg(F.sum(F.when(F.col(label) == 1, units).otherwise(0)).alias("pos"),
             F.sum(F.when(F.col(label) == 1, 0).otherwise(units)).alias("neg")))
    ranged = settle(per_score.repartitionByRange(*keys, "s").withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy(*keys, "_part").agg(F.sum("neg").alias("negs"))
    before = parts.withColumn("below", F.sum("negs").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("negs")).drop("negs")
    inside = Window.partitionBy(*keys, "_part").orderBy("s")
    return (
        ranged.withColumn("seen", F.sum("neg").over(inside)).join(bounded(before), [*keys, "_part"])
        .withColumn("beaten", F.col("below") + F.col("seen") - F.col("neg") / 2)
        .groupBy(*keys).agg(F.sum(F.col("pos") * F.col("beaten")).alias("u"),
                            F.sum("pos").alias("p"), F.sum("neg").alias("q"))
        .select(*by, F.when((F.col("p") > 0) & (F.col("q") > 0),
                            F.col("u") / (F.col("p").cast("double") * F.col("q"))).alias("roc_auc")))


def hash_split(df: DataFrame, ident: str, label: str, share: float) -> DataFrame:
    """Add ``is_test``: per label the first ceil(share x n) rows in md5(ident) order.

    Depends on the data alone, not on partitioning, and moves no rows: bucket counts (md5
    prefix) find the bucket holding each label's cut, the values of that one bucket find the
    cut itself, and every row is compared with it. Copies of one id stay on one side."""
    rows = df.withColumn("_md5", F.md5(F.col(ident)))
    # the cuts need two narrow columns twice; the rows themselves are read once, at the end
    slim = settle(rows.select(F.col(label).alias("_l"), "_md5"))
    prefix = F.substring("_md5", 1, 5)
    w = Window.partitionBy("_l")
    counted = (
        slim.groupBy("_l", prefix.alias("_p")).agg(F.count(F.lit(1)).alias("c"))
        .withColumn("upto", F.sum("c").over(w.orderBy("_p")))
        .withColumn("take", F.ceil(F.sum("c").over(w) * share))
        .withColumn("before", F.col("upto") - F.col("c"))
        .filter((F.col("before") < F.col("take")) & (F.col("take") <= F.col("upto")))
        .select("_l", "_p", "before", "take"))
    # labels are binary, so both broadcast tables have two rows
    edge = (slim.withColumn("_p", prefix)
            .join(F.broadcast(counted), ["_l", "_p"])
            .groupBy("_l", "before", "take", "_md5").agg(F.count(F.lit(1)).alias("c"))
            .withColumn("at", F.col("before") + F.sum("c").over(w.orderBy("_md5")))
            .filter(F.col("at") >= F.col("take"))
            .groupBy("_l").agg(F.min("_md5").alias("_cut")))
    return (rows.join(F.broadcast(edge), F.col(label) == F.col("_l"), "left")
            .withColumn("is_test", F.coalesce(F.col("_md5") <= F.col("_cut"), F.lit(False)))
            .drop("_md5", "_l", "_cut"))


def global_rank(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add ``name``: the row's place (from 0) in the whole table under ``order``, without a single-task window.

    Range partitions are sorted apart and settled; each partition's rows follow those of the
    partitions before it. Only the partitions' row counts, one row each, meet in one window. Rows equal
    under ``order`` get neighbouring places in no fixed order."""
    at, part, before = f"_{name}_at", f"_{name}_part", f"_{name}_before"
    placed = settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    placed = placed.withColumn(part, F.shiftright(at, 33))
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias(before))
    inside = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(starts), part).withColumn(name, F.col(before) + inside).drop(at, part, before)
