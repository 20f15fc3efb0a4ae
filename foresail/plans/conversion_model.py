"""Conversion classifier: category codes, split, boosted trees, scores and metrics.

All features are discrete, so the resolved leads collapse into distinct (features, label, split)
rows with a weight before training. The trees see exactly the same weighted data, but the rows
moved and cached grow with the number of combinations, not with the number of leads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from foresail.functions.expr import money, ratio, series_labels
from foresail.functions.ranks import global_rank, hash_split, roc_auc
from foresail.operators.leads import lead_features, resolved_leads
from foresail.plans.boosting import Tree, boost, margin_of
from foresail.schema import MIN_TRAINING_ROWS
from foresail.session import settle

UNKNOWN = "Unknown"
CATEGORIES = ("destination", "lead_source")
NUMBERS = ("duration_days", "is_repeat_customer", "inquiry_month", "inquiry_quarter", "is_peak_season")
FEATURES = tuple(f"{c}_code" for c in CATEGORIES) + NUMBERS


def _known(column: str):
    return F.coalesce(F.col(column), F.lit(UNKNOWN))


def category_codes(leads: DataFrame, column: str) -> DataFrame:
    """(category, code) in sorted order from 0. Ranks distinct values only."""
    distinct = leads.select(_known(column).alias("category")).distinct()
    return global_rank(distinct, [F.col("category")], "code").withColumn("code", F.col("code").cast("int"))


def new_categories(leads: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """Values of a column the dictionary does not know."""
    return (leads.select(_known(column).alias("category")).distinct()
            .join(codes.select("category"), "category", "left_anti"))


def extend_codes(codes: DataFrame, leads: DataFrame, column: str) -> DataFrame:
    """The dictionary with unseen values appended, in sorted order, after the known ones."""
    known = codes.agg(F.max("code")).first()[0]
    fresh = global_rank(new_categories(leads, column, codes), [F.col("category")], "place")
    return codes.select("category", "code").union(fresh.select("category", (F.col("place") + F.lit(0 if known is None else known + 1)).cast("int")))


def encode_category(rows: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """Add ``<column>_code``; values the dictionary does not know get 0. The dictionary grows
    with the number of categories: for single leads pass ``bounded(codes)``."""
    return (rows.withColumn("category", _known(column)).join(codes, "category", "left")
            .withColumn(f"{column}_code", F.coalesce("code", F.lit(0))).drop("category", "code"))


def stratified_split(resolved: DataFrame, share: float = 0.2) -> DataFrame:
    return hash_split(resolved, "lead_id", "converted", share)


def training_cube(leads: DataFrame, share: float = 0.2) -> DataFrame:
    """Distinct feature combinations of the resolved leads with label, split and weight."""
    split = lead_features(stratified_split(resolved_leads(leads), share))
    return (split.groupBy(*CATEGORIES, *NUMBERS, "converted", "is_test")
            .agg(F.count(F.lit(1)).cast("double").alias("weight")))


def _encoded(rows: DataFrame, codes: dict[str, DataFrame]) -> DataFrame:
    for column in CATEGORIES:
        rows = encode_category(rows, column, codes[column])
    return rows


class ConversionModel:
    """Grown trees with the category dictionaries they were trained on."""

    def __init__(self, trees: list[Tree], codes: dict[str, DataFrame], depth: int = 4):
        self.trees, self.codes, self.depth = trees, codes, depth

    def score(self, rows: DataFrame) -> DataFrame:
        """Add ``score``, the probability of conversion, to rows with the raw features."""
        margin = margin_of(self.trees, FEATURES, self.depth)
        return _encoded(rows, self.codes).withColumn("score", 1 / (1 + F.exp(-margin))).drop(*[f"{c}_code" for c in CATEGORIES])


def train_conversion_model(leads: DataFrame, rounds: int = 100, depth: int = 4, rate: float = 0.1,
                           share: float = 0.2, patience: int = 10) -> tuple[ConversionModel, DataFrame]:
    """Boosted trees, as many as suit the held-out part best; returns model and training cube."""
    cube = settle(training_cube(leads, share))
    size = cube.agg(F.sum("weight")).first()[0] or 0
    if size < MIN_TRAINING_ROWS:
        raise ValueError(f"{int(size)} resolved leads; at least {MIN_TRAINING_ROWS} are needed to train")
    codes = {c: settle(category_codes(cube, c)) for c in CATEGORIES}
    data = _encoded(cube, codes).select(*FEATURES, "converted", "weight", "is_test")
    # one partition per hundred thousand distinct rows: a small cube is added up without a shuffle
    data = settle(data.coalesce(1 + cube.count() // 100_000))
    trees, _ = boost(data, FEATURES, "converted", "weight", "is_test", rounds, depth, rate, patience)
    return ConversionModel(trees, codes, depth), cube


def classification_metrics(scored: DataFrame, score: str = "score", label: str = "converted",
                           weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1, ROC-AUC and confusion counts at threshold 0.5."""
    units = F.lit(1) if weight is None else F.col(weight)
    # rows with the same score and label become one; counts and AUC both read this table
    per_score = settle(scored.groupBy(*by, F.col(score).alias("s"), F.col(label).alias("y"))
                       .agg(F.sum(units).alias("w")))
    hit, yes = F.col("y") == 1, F.col("s") > 0.5

    def total(cond):
        return F.sum(F.when(cond, F.col("w")).otherwise(0)).cast("long")

    counts = per_score.groupBy(*by).agg(total(hit & yes).alias("tp"), total(~hit & yes).alias("fp"),
                                        total(hit & ~yes).alias("fn"), total(~hit & ~yes).alias("tn"))
    auc = roc_auc(per_score, "s", "y", "w", by)
    if by:
        both = counts.join(auc, list(by))
    else:
        names = [*counts.columns, "roc_auc"]
        both = counts.unionByName(auc, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in names])
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return both.withColumns({
        "samples": tp + fp + fn + tn, "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def expected_value_cube(open_leads: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Open leads collapsed to feature combinations with count and value."""
    dims = list(dict.fromkeys([*keys, *CATEGORIES, *NUMBERS]))
    return lead_features(open_leads).groupBy(*dims).agg(
        F.count(F.lit(1)).alias("leads"), F.sum(money(F.col("trip_price"))).alias("value"))


def expected_revenue(scored: DataFrame, keys: Sequence[str] = (), score: str = "score") -> DataFrame:
    """Per series: leads, value, mean probability and sum of price x probability of scored rows
    carrying ``leads`` and ``value``."""
    return (scored.withColumn("series_id", F.explode(series_labels(keys))).groupBy("series_id")
            .agg(F.sum("leads").alias("leads"), F.sum("value").cast("double").alias("open_value"),
                 (F.sum(F.col(score) * F.col("leads")) / F.sum("leads")).alias("mean_probability"),
                 F.sum(F.col("value").cast("double") * F.col(score)).alias("total")))
