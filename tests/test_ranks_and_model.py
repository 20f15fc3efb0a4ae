import hashlib
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from foresail.functions.ranks import exact_median, hash_split, roc_auc
from foresail.plans import conversion_model as M
from foresail.plans.boosting import best_round


@pytest.mark.parametrize("seed", range(3))
def test_exact_median_against_brute_force(spark, seed):
    rng = random.Random(seed)
    groups = {g: [rng.choice([rng.uniform(-5, 5), round(rng.uniform(0, 1e6), 2), 7.0, 0.0]) for _ in range(n)]
              for g, n in (("a", 1), ("b", 2), ("c", 101), ("d", 400))}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("a", None)], "g string, v double")
    got = {r.g: r["median"] for r in exact_median(df, "v", ["g"]).collect()}
    assert got == {g: pytest.approx(statistics.median(vs)) for g, vs in groups.items()}
    everything = [v for vs in groups.values() for v in vs]
    assert exact_median(df, "v").first()[0] == pytest.approx(statistics.median(everything))


def test_median_with_one_dominant_value(spark):
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, 250.0).otherwise(F.col("id") / 100.0).alias("v"))
    want = statistics.median([250.0 if i % 3 == 0 else i / 100 for i in range(30000)])
    assert exact_median(df, "v").first()[0] == pytest.approx(want)


def brute_auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("seed", range(3))
def test_auc_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.choice([rng.random(), round(rng.random(), 1)]), rng.random() < 0.4) for _ in range(300)]
    df = spark.createDataFrame([(s, int(y)) for s, y in pairs], "s double, y int")
    assert roc_auc(df, "s", "y").first()[0] == pytest.approx(brute_auc(pairs))
    weighted = df.groupBy("s", "y").agg(F.count(F.lit(1)).alias("w"))
    assert roc_auc(weighted, "s", "y", "w").first()[0] == pytest.approx(brute_auc(pairs))


def test_auc_of_one_class_is_null(spark):
    assert roc_auc(spark.createDataFrame([(0.5, 1)], "s double, y int"), "s", "y").first()[0] is None


@pytest.mark.parametrize("parts", [1, 7])
def test_split_takes_exactly_the_first_fifth(spark, parts):
    ids = [(f"L{i}", i % 3 == 0) for i in range(1001)]
    df = spark.createDataFrame([(i, int(y)) for i, y in ids], "id string, y int").repartition(parts)
    got = {r.id for r in hash_split(df, "id", "y", 0.2).filter("is_test").collect()}
    want = set()
    for label in (True, False):
        own = sorted((i for i, y in ids if y is label), key=lambda i: hashlib.md5(i.encode()).hexdigest())
        want |= set(own[:math.ceil(0.2 * len(own))])
    assert got == want


def test_metrics_of_a_known_table(spark):
    rows = [(0.9, 1)] * 3 + [(0.6, 0)] * 1 + [(0.5, 1)] * 2 + [(0.1, 0)] * 4
    got = M.classification_metrics(spark.createDataFrame(rows, "score double, converted int")).first()
    assert (got.tp, got.fp, got.fn, got.tn) == (3, 1, 2, 4)
    assert got.accuracy == 0.7 and got.precision == 0.75 and got.recall == 0.6 and got.f1 == pytest.approx(2 / 3)
    none = M.classification_metrics(spark.createDataFrame([(0.1, 1), (0.1, 0)], "score double, converted int")).first()
    assert (none.precision, none.recall, none.f1) == (0.0, 0.0, 0.0)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_median_of_values_in_a_narrow_range(spark, by):
    rng = random.Random(7)
    values = [1000 + rng.random() * 0.02 for _ in range(20_000)] + [1000.01] * 5000
    df = spark.createDataFrame([("a", v) for v in values] + [("b", v) for v in (1e308, -1e308, 5e-324, 0.0)], "g string, v double").repartition(6)
    got = exact_median(df, "v", by).collect()
    if by:
        assert {r.g: r["median"] for r in got} == {"a": statistics.median(values), "b": 5e-324 / 2}
    else:
        assert got[0]["median"] == statistics.median([*values, 1e308, -1e308, 5e-324, 0.0])


def test_median_windows_stay_small(spark, monkeypatch):
    """Whatever the values, a window sees cells, never values: few cells give the same median."""
    from foresail.functions import ranks
    monkeypatch.setattr(ranks, "CELLS", 3)
    values = [1.0 + k * 1e-9 for k in range(501)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert exact_median(df, "v").first()[0] == values[250]
    assert exact_median(spark.createDataFrame([(None,), (float("nan"),)], "v double"), "v").collect() == []


def test_sketched_median_is_within_its_error(spark):
    from foresail.operators.stats import revenue_stats
    rng = random.Random(8)
    rows = [("completed", g, rng.lognormvariate(mu, 2)) for g, mu, n in (("a", 1, 8000), ("b", 9, 3000), ("c", 0, 1)) for _ in range(n)]
    leads = spark.createDataFrame(rows, "current_stage string, destination string, trip_price double").repartition(7)
    exact = {r.destination: r for r in revenue_stats(leads, ["destination"]).collect()}
    for r in revenue_stats(leads, ["destination"], approximate=200).collect():
        prices = sorted(p for _, g, p in rows if g == r.destination)
        rank = prices.index(r.median_trip_value) + 1
        assert abs(rank - len(prices) / 2) <= len(prices) / 200 + 1
        assert {c: r[c] for c in r.asDict() if c not in ("median_trip_value", "std_trip_value", "average_trip_value")} == {
            c: exact[r.destination][c] for c in r.asDict() if c not in ("median_trip_value", "std_trip_value", "average_trip_value")}
    assert revenue_stats(leads, approximate=100).count() == 1


def test_auc_of_crowded_scores(spark):
    rng = random.Random(9)
    pairs = [("k", 1e-7 * rng.random() ** 4, int(rng.random() < 0.3)) for _ in range(3000)] + [("l", 0.5, k % 2) for k in range(40)]
    df = spark.createDataFrame(pairs, "g string, s double, y int").repartition(9)
    got = {r.g: r.roc_auc for r in roc_auc(df, "s", "y", by=["g"]).collect()}
    assert got["k"] == pytest.approx(brute_auc([(s, y) for g, s, y in pairs if g == "k"])) and got["l"] == 0.5


def test_codes_unknown_and_extension(make_leads):
    leads = make_leads([{"lead_source": s} for s in ("b", "a", None, "b")])
    codes = M.category_codes(leads, "lead_source")
    assert {r.category: r.code for r in codes.collect()} == {"Unknown": 0, "a": 1, "b": 2}
    later = make_leads([{"lead_source": s} for s in ("c", "a", None, "B")])
    assert {r.category for r in M.new_categories(later, "lead_source", codes).collect()} == {"c", "B"}
    assert {r.category: r.code for r in M.extend_codes(codes, later, "lead_source").collect()} == {
        "Unknown": 0, "a": 1, "b": 2, "B": 3, "c": 4}
    encoded = {r.lead_id: r.lead_source_code for r in M.encode_category(later, "lead_source", codes).collect()}
    assert encoded == {"L0": 0, "L1": 1, "L2": 0, "L3": 0}


def resolved(n):
    rng = random.Random(5)
    return [{"current_stage": "completed" if rng.random() < (0.8 if i % 2 else 0.2) else "lost",
             "destination": "X" if i % 2 else "Y", "lead_source": "W", "is_repeat_customer": i % 2, "duration_days": 7,
             "inquiry_date": f"2020-{i % 12 + 1:02d}-01"} for i in range(n)]


def test_training_needs_fifty_leads(make_leads):
    with pytest.raises(ValueError, match="at least 50"):
        M.train_conversion_model(make_leads(resolved(49)))


def test_trees_learn_and_survive_a_round_trip(spark, make_leads, tmp_path):
    from foresail.sources.artifacts import ArtifactStore
    leads = make_leads(resolved(400))
    model, cube = M.train_conversion_model(leads, rounds=5)
    assert cube.agg(F.sum("weight")).first()[0] == 400 and cube.count() < 100
    test = M.classification_metrics(model.score(cube), weight="weight", by=["is_test"]).filter("is_test").first()
    assert 0.6 < test.accuracy <= 1 and 0.6 < test.roc_auc <= 1
    store = ArtifactStore(spark, str(tmp_path))
    assert store.load_model("m") is None and store.load_table("rates") is None
    store.save_model("m", model)
    a = sorted(r.score for r in model.score(cube).collect())
    assert a == pytest.approx(sorted(r.score for r in store.load_model("m").score(cube).collect()))


def test_rounds_stop_after_ten_without_gain():
    dip = [5, 4, 4.1, 4.2, 3, *[3.5] * 9, 2.9, *[3.2] * 10, 1]
    assert best_round(dip, 10) == 15 and best_round(dip[:14], 10) == 5 and best_round([1], 10) == 1


def test_queries_train_all_rounds(monkeypatch):
    from foresail.plans import catalog
    seen = []
    monkeypatch.setattr(catalog, "_leads", lambda spark, sf: None)
    monkeypatch.setattr(M, "train_conversion_model", lambda leads, **more: seen.append(more))
    catalog._model(None, "")
    assert seen == [{}]


def test_lookup_tables_are_broadcast_only_when_small(spark):
    from foresail.session import bounded
    big, small = spark.range(50), spark.range(5)
    rows = spark.range(100)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for table, uses in ((small, True), (big, False)):
            joined = rows.join(bounded(table, rows=10), "id")
            text = joined._jdf.queryExecution().executedPlan().toString()
            assert ("BroadcastHashJoin" in text) is uses and joined.count() == table.count()
        wide = spark.range(5).withColumn("note", F.repeat(F.lit("x"), 1000))
        for size, uses in ((10_000, True), (4_000, False)):
            joined = rows.join(bounded(wide, size=size), "id")
            assert ("BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()) is uses and joined.count() == 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
