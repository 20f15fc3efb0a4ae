"""Exact top-k search in binary codes by incremental multi-index hashing.

A code is cut into segments. A code within distance d of a query agrees with it in some segment up to
d // segments bits, so probing every segment's table with all values up to radius s finds all codes up
to distance segments * (s + 1) - 1. Radii grow one step at a time, for all open queries at once; a query
is closed when its kth verified distance is covered by that bound, or all codes have been verified; codes farther
than the kth so far are dropped inside the probing join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from foresail.llm.common import settle_table

SEGMENTS, SEGMENT_BITS = 4, 16


def sign_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, code): bit i (from the lowest) is set if component i is above 0.

    A null component or one beyond the vector's end gives 0, a null vector gives the code 0. A vector of
    more than 64 components does not fit a code: the query fails."""
    bit = lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    vector = F.coalesce(F.col(vector_col).cast("array<float>"), F.array().cast("array<float>"))
    long = F.raise_error(F.lit(f"a vector has more than {SEGMENTS * SEGMENT_BITS} components")).cast("array<float>")
    parts = F.transform(F.when(F.size(vector) > SEGMENTS * SEGMENT_BITS, long).otherwise(vector), bit)
    code = F.aggregate(parts, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return vectors.select(F.col(id_col).cast("long").alias("id"), code.alias("code"))


def _segment(code: Column, number: int) -> Column:
    return F.shiftrightunsigned(code, SEGMENT_BITS * number).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1)).cast("int")


def _segments(rows: DataFrame, *keep: str) -> DataFrame:
    cut = F.array(*(F.struct(F.lit(k).alias("segment"), _segment(F.col("code"), k).alias("value")) for k in range(SEGMENTS)))
    return rows.select(*keep, "code", F.explode(cut).alias("s")).select(*keep, "code", "s.segment", "s.value")


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): the k rows of ``codes`` nearest to every query row, exactly.

    Both tables are (id, code). Ties go to the smaller id, null ids last; a query is not its own
    neighbor (rows of its id are left out), rows with equal ids count one by one. Fewer than k other
    rows give them all; no rows give none. Equal codes are one entry of the index, with their k + 1
    smallest ids, which is as many as any answer needs - however many rows share the code."""
    order = lambda *by: [c for b in by for c in (F.col(b).isNull(), F.col(b))]
    held = F.sort_array(F.collect_list(F.struct(F.col("id").isNull().alias("none"), "id")))
    # The smallest ids of a code are found in two steps: within parts of the rows of a code, then over its parts.
    parts = codes.groupBy("code", F.pmod(F.xxhash64("id"), F.lit(64)).alias("part"), "id").agg(F.count("*").alias("n"))
    ranked = parts.withColumn("r", F.row_number().over(Window.partitionBy("code", "part").orderBy(*order("id")))).where(F.col("r") <= k + 1)
    ids = ranked.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy(*order("id")))).where(F.col("r") <= k + 1)
    entries = settle_table(ids.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("n"), F.lit(k + 1).cast("long"))))).groupBy("code").agg(held.alias("ids")), "codes")
    total = entries.count()
    index = settle_table(_segments(entries.select("code", F.size("ids").alias("n")), "n"), "code-index")
    # bound: distance of the (k + 1)th row verified so far; one of them may be the query itself.
    asked = settle_table(queries.select("code").distinct().withColumn("bound", F.lit(SEGMENTS * SEGMENT_BITS)), "query-codes")
    tasks = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found, open_codes = None, asked
    for radius in range(SEGMENT_BITS + 1):
        # one text for the planner to fold: the values of a segment with ``radius`` bits
        masks = F.split(F.lit(",".join(str(m) for m in range(1 << SEGMENT_BITS) if m.bit_count() == radius)), ",").cast("array<int>")
        # few codes, each with thousands of probes: dealt out before they are multiplied
        probes = _segments(open_codes, "bound").repartition(tasks, "code", "segment").withColumn("mask", F.explode(masks)).select(
            F.col("code").alias("query"), "bound", "segment", F.col("value").bitwiseXOR(F.col("mask")).alias("value")).alias("p")
        distance = F.bit_count(F.col("query").bitwiseXOR(F.col("code"))).cast("int")
        hit = (F.col("p.segment") == F.col("i.segment")) & (F.col("p.value") == F.col("i.value")) & (distance <= F.col("bound"))
        # The planner sees a few query codes, not their thousands of probes: without the hint it would broadcast them.
        now = probes.hint("merge").join(index.alias("i"), hit).select("query", "code", "n", distance.alias("distance"))
        found = (now if found is None else found.union(now)).distinct()
        upto = F.sum("n").over(Window.partitionBy("query").orderBy("distance").rangeBetween(Window.unboundedPreceding, 0))
        each = Window.partitionBy("query")
        bounded = found.withColumn("upto", upto).withColumn("bound", F.coalesce(F.min(F.when(F.col("upto") > k, F.col("distance"))).over(each), F.lit(SEGMENTS * SEGMENT_BITS)))
        found = settle_table(bounded.withColumn("codes", F.count("*").over(each)).where(F.col("distance") <= F.col("bound")).drop("upto"), "found-codes")
        closed = found.where((F.col("bound") <= SEGMENTS * (radius + 1) - 1) | (F.col("codes") >= total)).select(F.col("query").alias("code")).distinct()
        reached = found.groupBy(F.col("query").alias("code")).agg(F.min("bound").alias("bound"))
        found = found.drop("bound", "codes")
        open_codes = settle_table(open_codes.join(closed, "code", "left_anti").drop("bound").join(reached, "code", "left").select(
            "code", F.coalesce("bound", F.lit(SEGMENTS * SEGMENT_BITS)).alias("bound")), "open-codes")
        if not open_codes.limit(1).count():
            break
    return _answers(found, entries, queries, k)


def _answers(found: DataFrame, entries: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Rank the rows of all codes found, per query row and without its own id."""
    near = found.join(entries, "code").select("query", "distance", F.explode("ids").alias("i")).select("query", "distance", "i.none", "i.id")
    asked = queries.select(F.col("id").alias("query_id"), F.col("code").alias("query")).distinct()
    rows = asked.join(near, "query").where(~F.col("query_id").eqNullSafe(F.col("id")))
    best = Window.partitionBy("query_id", "query").orderBy("distance", "none", "id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("neighbor_id"), "distance")
