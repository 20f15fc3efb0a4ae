"""Boosted trees against a dense version in numpy, and their early stop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foresail.plans import boosting


def _dense(x, y, w, held, rounds, depth, rate):
    """Trees by masks over all rows: (margins of all rows and held-out loss after each round)."""
    margin, out = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = (p - y) * w, p * (1 - p) * w
        nodes = [~held]
        every = [np.ones(len(y), bool)]
        step = np.zeros(len(y))
        for level in range(depth + 1):
            below, below_every = [], []
            for mine, all_mine in zip(nodes, every):
                G, H = g[mine].sum(), h[mine].sum()
                best, choice = 1e-6, None
                for f in range(x.shape[1] if level < depth else 0):
                    values = np.unique(x[mine, f])
                    for a, b in zip(values, values[1:]):
                        left = mine & (x[:, f] <= a)
                        gl, hl = g[left].sum(), h[left].sum()
                        if hl < 1 or H - hl < 1:
                            continue
                        gain = gl**2 / (hl + 1) + (G - gl)**2 / (H - hl + 1) - G**2 / (H + 1)
                        if gain > best * (1 + 1e-9):
                            best, choice = gain, (f, (a + b) / 2)
                if choice is None:
                    step[all_mine] = -G / (H + 1) * rate
                else:
                    low = x[:, choice[0]] <= choice[1]
                    below += [mine & low, mine & ~low]
                    below_every += [all_mine & low, all_mine & ~low]
            nodes, every = below, below_every
        margin = margin + step
        p = np.clip(1 / (1 + np.exp(-margin)), 1e-15, 1 - 1e-15)
        loss = -(np.where(y == 1, np.log(p), np.log(1 - p)) * w)[held].sum() / w[held].sum() if held.any() else None
        out.append((margin.copy(), loss))
    return out


def _rows(seed, n=300, noise=0.1):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, k, n) for k in (2, 5, 12)], axis=1).astype(float)
    odds = 1.5 * (x[:, 0] - 0.5) + np.where(x[:, 2] > 6, 1.0, -1.0) * (x[:, 1] - 2) + noise * rng.normal(size=n)
    return x, (rng.random(n) < 1 / (1 + np.exp(-odds))).astype(float), rng.integers(1, 9, n).astype(float), rng.random(n) < 0.25


def _frame(spark, x, y, w, held):
    return spark.createDataFrame([(*map(float, r), float(a), float(b), bool(c)) for r, a, b, c in zip(x, y, w, held)], "a double, b double, c double, y double, w double, held boolean")


@pytest.mark.parametrize("seed", [0, 1])
def test_trees_equal_a_dense_version(spark, monkeypatch, seed):
    monkeypatch.setattr(boosting, "KEEP", 2)  # margins are written between rounds too
    x, y, w, held = _rows(seed)
    data = _frame(spark, x, y, w, held)
    trees, losses = boosting.boost(data, ["a", "b", "c"], "y", "w", "held", 5, 3, 0.3, 10)
    expect = _dense(x, y, w, held, 5, 3, 0.3)
    assert losses == pytest.approx([loss for _, loss in expect], rel=1e-9)
    assert len(trees) == int(np.argmin([loss for _, loss in expect])) + 1
    margin = [r[0] for r in data.select(boosting.margin_of(trees, ["a", "b", "c"], 3)).collect()]
    assert margin == pytest.approx(list(expect[len(trees) - 1][0]), abs=1e-9)
    again = boosting.trees_of([dict_row for dict_row in spark.createDataFrame(boosting.tree_rows(trees), boosting.TREE_SCHEMA).collect()])
    assert again == trees


def test_partitioning_does_not_change_a_tree(spark):
    data = _frame(spark, *_rows(3))
    grow = lambda d: boosting.boost(d, ["a", "b", "c"], "y", "w", "held", 2, 4, 0.1, 10)
    assert grow(data.coalesce(1)) == grow(data.repartition(7, "c", "w"))


def test_rounds_end_ten_after_the_best(spark, monkeypatch):
    data = _frame(spark, *_rows(4, noise=3.0))
    grown = []
    real = boosting.Booster.add_round
    monkeypatch.setattr(boosting.Booster, "add_round", lambda self: (grown.append(1), real(self))[1])
    trees, losses = boosting.boost(data, ["a", "b", "c"], "y", "w", "held", 40, 3, 0.9, 3)
    assert len(trees) == boosting.best_round(losses, 3) < 37
    assert len(losses) == len(trees) + 3 and len(grown) <= len(losses) + 1  # every round once, none beyond the stop


def test_without_held_out_rows_all_rounds_stay(spark):
    data = _frame(spark, *_rows(5)).withColumn("held", F.lit(False))
    trees, losses = boosting.boost(data, ["a", "b", "c"], "y", "w", "held", 3, 2, 0.1, 1)
    assert len(trees) == 3 and losses == []


def test_rows_of_one_kind_give_leaves_alone(spark):
    data = spark.createDataFrame([(1.0, 1.0, 5.0, False), (1.0, 0.0, 3.0, False)], "a double, y double, w double, held boolean")
    trees, _ = boosting.boost(data, ["a"], "y", "w", "held", 1, 4, 0.1, 1)
    assert trees[0].splits == {} and trees[0].values[1] == pytest.approx(0.1 * 1.0 / 3.0)
    assert data.select(boosting.margin_of(trees, ["a"], 4)).first()[0] == trees[0].values[1]


def test_other_trees_run_the_same_generated_code(spark):
    data = _frame(spark, *_rows(6))
    one = boosting.Tree({1: (0, 0.5), 2: (2, 6.5)}, {3: 0.5, 4: 0.1, 5: -0.1})
    two = boosting.Tree({1: (1, 1.5), 3: (2, 3.5)}, {2: 0.2, 6: 0.3, 7: -0.2})
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")

    def code(tree):
        parts = debug.codegenStringSeq(data.select(boosting.node_of(tree, ["a", "b", "c"], 2).alias("node"))._jdf.queryExecution().executedPlan())
        assert parts.size()
        return [parts.apply(k)._2() for k in range(parts.size())]

    assert code(one) == code(two)
    got = data.select("a", "c", boosting.node_of(one, ["a", "b", "c"], 2).alias("node")).collect()
    assert all(r.node == (6 if r.a > 0.5 else 4 if r.c <= 6.5 else 5) for r in got)  # 3 is a leaf: 6 stands for it
