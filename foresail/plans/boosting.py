"""Boosted trees on weighted rows of whole-number features, grown level by level from combined sums.

A level is one aggregation: every row adds its gradient and hessian to the (node, feature, value) cells it
lies in, so what moves is as large as the features' values, not the rows. Splits are chosen from these
cells by second-order gain. Rounds are added to the trees there are: none is fitted twice, and the root
pass of a round also measures the held-out loss of the round before. Sums are decimal, so the trees do not
depend on how rows are partitioned."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from foresail.session import settle

# fixed values: second-order boosting with its usual settings
RIDGE, LEAST_HESSIAN, LEAST_GAIN = 1.0, 1.0, 1e-6
#: Margins are written once so many rounds; between, the newest trees are added to them as rows are read.
KEEP = 10

Sums = dict[tuple[int, int], dict[float, tuple[float, float]]]


@dataclass
class Tree:
    """Node 1 is the root, 2n and 2n + 1 are the children of n; a split sends values up to its cut to 2n."""

    splits: dict[int, tuple[int, float]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)


def _full(tree: Tree, depth: int) -> tuple[list[int], list[float], list[float]]:
    """(feature, cut) of all inner nodes and the values at full depth; a leaf above it sends everything left."""
    feature, cut, value = [], [], [0.0] * (1 << depth)
    for node in range(1 << depth):
        f, c = tree.splits.get(node, (0, math.inf))
        feature.append(f)
        cut.append(c)
    for node, v in tree.values.items():
        if node >= 2 << depth:
            continue
        at = node << (depth - node.bit_length() + 1)
        value[at - (1 << depth)] = v
    return feature, cut, value


def _array(values: Sequence[float]) -> str:
    """SQL text of an array; one text is one call to the session, whatever the number of trees."""
    return "array(" + ", ".join(str(v) if isinstance(v, int) else f"double('{v!r}')" for v in values) + ")"


def margin_of(trees: Sequence[Tree], features: Sequence[str], depth: int) -> Column:
    """Sum of the trees' values for a row."""
    if not trees:
        return F.lit(0.0)
    full = [_full(t, depth) for t in trees]
    forest = "array(" + ", ".join(f"struct({_array(f)} AS f, {_array(c)} AS c, {_array(v)} AS v)" for f, c, v in full) + ")"
    x = "array(" + ", ".join(f"double(`{c}`)" for c in features) + ")"
    down = f"aggregate(sequence(1, {depth}), 1, (node, level) -> 2 * node + if(x[tree.f[node]] <= tree.c[node], 0, 1))"
    return F.expr(f"transform(array({x}), x -> aggregate({forest}, double(0), (total, tree) -> total + tree.v[{down} - {1 << depth}]))[0]")


def node_of(tree: Tree, features: Sequence[str], level: int) -> Column:
    """The node at ``level`` (the root's is 0) that a row reaches; below a leaf, the leftmost one.

    The tree is data, not code: the passes of all rounds and levels run the same generated code, compiled once."""
    feature, cut, _ = _full(tree, level)
    x = "array(" + ", ".join(f"double(`{c}`)" for c in features) + ")"
    return F.expr(f"transform(array(struct({x} AS x, {_array(feature)} AS f, {_array(cut)} AS c)), r -> aggregate(sequence(1, {level + 1}), 1, "
                  f"(node, step) -> if(step > {level}, node, 2 * node + if(r.x[r.f[node]] <= r.c[node], 0, 1))))[0]")


def best_split(cells: dict[int, dict[float, tuple[float, float]]]) -> tuple[int, float] | None:
    """(feature, cut) of greatest gain from a node's (gradient, hessian) by feature and value; ties go to the first."""
    best, choice = LEAST_GAIN, None
    score = lambda g, h: g * g / (h + RIDGE)
    for f in sorted(cells):
        values = sorted(cells[f])
        g_all, h_all = (sum(cells[f][v][k] for v in values) for k in (0, 1))
        g = h = 0
        for v, after in zip(values, values[1:]):
            g, h = g + cells[f][v][0], h + cells[f][v][1]
            if h < LEAST_HESSIAN or h_all - h < LEAST_HESSIAN:
                continue
            gain = score(float(g), float(h)) + score(float(g_all - g), float(h_all - h)) - score(float(g_all), float(h_all))
            if gain > best * (1 + 1e-9):
                best, choice = gain, (f, (v + after) / 2)
    return choice


class Booster:
    """Trees grown on ``data`` (features, 0/1 ``label``, ``weight``, boolean ``held``), round by round."""

    def __init__(self, data: DataFrame, features: Sequence[str], label: str, weight: str, held: str, depth: int, rate: float):
        self.features, self.depth, self.rate = list(features), depth, rate
        self.trees: list[Tree] = []
        self.data = data.select(*features, F.col(label).cast("double").alias("_y"), F.col(weight).cast("double").alias("_w"), F.col(held).alias("_held"), F.lit(0.0).alias("_margin"))
        self.kept = 0

    def _cells(self, tree: Tree, level: int) -> tuple[Sums, dict[int, tuple[float, float]], float | None]:
        """Sums by (node, feature) and value, by node, and at the root the held-out loss of the trees so far, in one pass."""
        margin = F.col("_margin") + margin_of(self.trees[self.kept:], self.features, self.depth)
        rows = self.data if level == 0 else self.data.filter(~F.col("_held"))
        rows = rows.withColumn("_p", 1 / (1 + F.exp(-margin)))
        exact = lambda c: c.cast("decimal(30,12)")
        sure = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.when(F.col("_y") == 1, F.col("_p")).otherwise(1 - F.col("_p"))))
        cell = lambda f, c: F.struct(F.lit(f).alias("f"), c.cast("double").alias("v"))
        own = F.array(*[cell(f, F.col(c)) for f, c in enumerate(self.features)])
        rows = rows.select(
            F.when(F.col("_held"), 0).otherwise(node_of(tree, self.features, level)).alias("node"),
            F.explode(F.when(F.col("_held"), F.array(cell(-1, F.lit(0.0)))).otherwise(own)).alias("at"),
            exact(F.when(F.col("_held"), -F.log(sure)).otherwise(F.col("_p") - F.col("_y")) * F.col("_w")).alias("g"),
            exact(F.when(F.col("_held"), 1.0).otherwise(F.col("_p") * (1 - F.col("_p"))) * F.col("_w")).alias("h"))
        sums: Sums = defaultdict(dict)
        # one row per node, feature and value: bounded by the dictionaries, not by the rows
        for r in rows.groupBy("node", "at.f", "at.v").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            sums[r.node, r.f][r.v] = (r.g, r.h)
        held = sums.pop((0, -1), {}).get(0.0)
        nodes = {node: tuple(sum(c[k] for c in cells.values()) for k in (0, 1)) for (node, f), cells in sums.items() if f == 0}
        return sums, nodes, float(held[0] / held[1]) if held and held[1] else None

    def add_round(self) -> float | None:
        """Grow one more tree; gives the held-out loss before it, None where nothing is held out."""
        tree, loss = Tree(), None
        open_nodes = [1]
        for level in range(self.depth):
            sums, nodes, measured = self._cells(tree, level)
            loss = measured if level == 0 else loss
            following = []
            for node in open_nodes:
                split = best_split({f: cells for (n, f), cells in sums.items() if n == node})
                g, h = nodes.get(node, (0, 0))
                if split is None:
                    tree.values[node] = self._value(g, h)
                    continue
                tree.splits[node] = split
                below = sums[node, split[0]]
                gl, hl = (sum(c[k] for v, c in below.items() if v <= split[1]) for k in (0, 1))
                following += [(2 * node, gl, hl), (2 * node + 1, g - gl, h - hl)]
            open_nodes = [node for node, _, _ in following]
            if level == self.depth - 1:
                tree.values.update({node: self._value(g, h) for node, g, h in following})
            if not open_nodes:
                break
        self.trees.append(tree)
        if len(self.trees) - self.kept >= KEEP:
            grown = margin_of(self.trees[self.kept:], self.features, self.depth)
            self.data, self.kept = settle(self.data.withColumn("_margin", F.col("_margin") + grown)), len(self.trees)
        return loss

    def _value(self, g, h) -> float:
        return -float(g) / (float(h) + RIDGE) * self.rate

    def loss(self) -> float | None:
        """Held-out loss of all trees."""
        return self._cells(Tree(), 0)[2]


def boost(data: DataFrame, features: Sequence[str], label: str, weight: str, held: str, rounds: int, depth: int, rate: float, patience: int) -> tuple[list[Tree], list[float]]:
    """(trees up to the least held-out loss, losses after each round that was grown).

    Stops ``patience`` rounds after the best one. Without held-out rows all rounds are kept."""
    booster = Booster(data, features, label, weight, held, depth, rate)
    losses: list[float] = []
    for k in range(rounds):
        before = booster.add_round()
        if k and before is not None:
            losses.append(before)
            if best_round(losses, patience) + patience <= len(losses):
                break
    else:
        last = booster.loss()
        if last is not None:
            losses.append(last)
    return booster.trees[:best_round(losses, patience) if losses else rounds], losses


def best_round(losses: Sequence[float], patience: int) -> int:
    """Number of trees with the least held-out loss, up to the first ``patience`` rounds without a new least."""
    best = 0
    for k, loss in enumerate(losses):
        if loss < losses[best]:
            best = k
        elif k - best >= patience:
            break
    return best + 1


def tree_rows(trees: Sequence[Tree]) -> list[tuple[int, int, int | None, float | None, float | None]]:
    """(tree, node, feature, cut, value) of every split and leaf."""
    return [(k, node, *tree.splits.get(node, (None, None)), tree.values.get(node)) for k, tree in enumerate(trees) for node in sorted({*tree.splits, *tree.values})]


TREE_SCHEMA = "tree int, node int, feature int, cut double, value double"


def trees_of(rows: Sequence) -> list[Tree]:
    trees: dict[int, Tree] = defaultdict(Tree)
    for r in rows:
        if r.feature is not None:
            trees[r.tree].splits[r.node] = (r.feature, r.cut)
        else:
            trees[r.tree].values[r.node] = r.value
    return [trees[k] for k in sorted(trees)]
