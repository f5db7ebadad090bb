"""Extremely randomised trees, grown level by level for all trees at once.

A node draws some features and one random threshold for each, between the least and greatest value that its rows have, and takes
the split with the greatest fall of the Gini impurity. A level takes two aggregates over the rows: ranges, then class counts. Rows
are not moved: each task sends them down the trees known so far and adds up by node, so what is shuffled and what reaches the
driver follows trees, nodes and drawn features, not rows. Counts are whole numbers, so results don't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Tree:
    """Nodes as arrays; feature -1 is a leaf, an inner node's children are left and left + 1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    counts: list = field(default_factory=list)  # class counts of the training rows
    name: list[int] = field(default_factory=lambda: [1])  # 1 is the root, 2i and 2i + 1 are the children of i

    def places(self, x: np.ndarray) -> np.ndarray:
        """The node that each row ends in."""
        feature, threshold, left = np.array(self.feature), np.array(self.threshold), np.array(self.left)
        at = np.zeros(len(x), int)
        while True:
            rows = np.flatnonzero(feature[at] >= 0)
            if not len(rows):
                return at
            node = at[rows]
            at[rows] = left[node] + (x[rows, feature[node]] > threshold[node])


def draw(seed: int, tree: int, name: int, features: int, size: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """The features that a node tries at its turn-th draw and, for each, where in its range the threshold lies."""
    rng = np.random.default_rng([seed, tree, name])
    order, shares = rng.permutation(features), rng.random(features)
    return order[turn * size : (turn + 1) * size], shares[turn * size : (turn + 1) * size]


def impurity(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Gini impurity times weight; the last axis holds the classes."""
    held = counts * weights
    total = held.sum(-1)
    return total - (held**2).sum(-1) / np.where(total > 0, total, 1)


@dataclass(frozen=True)
class TreesModel:
    trees: list[Tree]
    weights: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.weights)))
        for tree in self.trees:
            held = np.array(tree.counts) * self.weights
            out += (held / held.sum(1, keepdims=True))[tree.places(x)]
        return out / len(self.trees)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds probability and prediction (double; the first of equal classes)."""

        @F.pandas_udf("probability array<double>, prediction double")
        def answer(raw: pd.Series) -> pd.DataFrame:
            likely = self.probabilities(np.array(raw.tolist(), float).reshape(len(raw), -1))
            return pd.DataFrame({"probability": list(likely), "prediction": likely.argmax(1).astype(float)})

        return df.withColumn("_a", answer(vector_to_array("raw"))).select("*", "_a.*").drop("_a")


@dataclass(frozen=True)
class ExtraTrees:
    """Columns: raw (vector), label (double from 0). Classes weigh alike whatever their counts; no bootstrap.

    depth: None grows until every node is pure or can't be split. tried: features a node draws, by default the root of their
    number; a node whose drawn features are all constant draws others, and is a leaf when none is left. A fitted model holds
    at most 2^(depth + 1) nodes a tree.
    """

    trees: int = 50
    depth: int | None = 10
    tried: int | None = None
    seed: int = 42

    def fit(self, train: DataFrame) -> TreesModel:
        rows = train.select(vector_to_array("raw").alias("x"), F.col("label").cast("int").alias("y")).persist()
        found = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
        if not found:
            raise ValueError("trees need training rows")
        classes = max(found) + 1
        totals = np.array([found.get(k, 0) for k in range(classes)])
        weights = np.where(totals > 0, totals.sum() / (len(found) * np.maximum(totals, 1)), 0.0)
        features = rows.select(F.size("x")).first()[0]
        size = self.tried or max(1, int(features**0.5))
        trees = [Tree(counts=[totals]) for _ in range(self.trees)]
        pure = lambda counts: (counts > 0).sum() < 2
        active = {} if pure(totals) or self.depth == 0 else {(t, 0): 0 for t in range(self.trees)}  # node: turn
        while active:
            drawn = {(t, node): draw(self.seed, t, trees[t].name[node], features, size, turn) for (t, node), turn in active.items()}
            ranges = self._ranges(rows, trees, {k: d[0] for k, d in drawn.items()})
            thresholds = {k: np.where(high > low, np.minimum(low + drawn[k][1] * (high - low), np.nextafter(high, low)), np.nan) for k, (low, high) in ranges.items()}
            split = {k: v for k, v in thresholds.items() if not np.isnan(v).all()}
            lefts = self._lefts(rows, trees, {k: (drawn[k][0], v) for k, v in split.items()}, classes) if split else {}
            after = {(t, n): turn + 1 for (t, n), turn in active.items() if (t, n) not in split and (turn + 1) * size < features}
            for (t, node), options in split.items():
                tree, own = trees[t], trees[t].counts[node]
                fall = impurity(own, weights) - impurity(lefts[t, node], weights) - impurity(own - lefts[t, node], weights)
                best = int(np.argmax(np.where(np.isnan(options), -np.inf, fall)))
                tree.feature[node], tree.threshold[node], tree.left[node] = int(drawn[t, node][0][best]), float(options[best]), len(tree.feature)
                for side, counts in enumerate((lefts[t, node][best], own - lefts[t, node][best])):
                    child, name = len(tree.feature), tree.name[node] * 2 + side
                    for column, value in ((tree.feature, -1), (tree.threshold, 0.0), (tree.left, -1), (tree.counts, counts), (tree.name, name)):
                        column.append(value)
                    if not pure(counts) and (self.depth is None or name.bit_length() <= self.depth):
                        after[t, child] = 0
            active = after
        rows.unpersist()
        return TreesModel(trees, weights)

    @staticmethod
    def _by_node(batches: Iterator[pd.DataFrame], trees: list[Tree], wanted: dict):
        """(tree, node, its rows x and classes y) of each batch, for nodes that are wanted."""
        nodes: dict[int, list[int]] = {}
        for t, node in wanted:
            nodes.setdefault(t, []).append(node)
        for batch in batches:
            if not len(batch):
                continue
            x, y = np.array(batch["x"].tolist(), float), batch["y"].to_numpy()
            for t, some in nodes.items():
                at = trees[t].places(x)
                order = np.argsort(at, kind="stable")
                starts, ends = np.searchsorted(at[order], some), np.searchsorted(at[order], some, side="right")
                for node, a, b in zip(some, starts, ends, strict=True):
                    if b > a:
                        yield t, node, x[order[a:b]], y[order[a:b]]

    def _ranges(self, rows: DataFrame, trees: list[Tree], drawn: dict) -> dict:
        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict = {}
            for t, node, x, _ in self._by_node(batches, trees, drawn):
                own = x[:, drawn[t, node]]
                low, high = held.get((t, node), (np.inf, -np.inf))
                held[t, node] = np.minimum(low, own.min(0)), np.maximum(high, own.max(0))
            cells = [(t, node, slot, a, b) for (t, node), (low, high) in held.items() for slot, (a, b) in enumerate(zip(low, high, strict=True))]
            yield pd.DataFrame(cells, columns=["tree", "node", "slot", "low", "high"])

        found = rows.mapInPandas(scan, "tree int, node int, slot int, low double, high double").groupBy("tree", "node", "slot").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
        out = {k: (np.full(len(d), np.nan), np.full(len(d), np.nan)) for k, d in drawn.items()}
        for r in found:
            out[r.tree, r.node][0][r.slot], out[r.tree, r.node][1][r.slot] = r.low, r.high
        return out

    def _lefts(self, rows: DataFrame, trees: list[Tree], split: dict, classes: int) -> dict:
        """Class counts at or below each threshold."""

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict = {}
            for t, node, x, y in self._by_node(batches, trees, split):
                features, thresholds = split[t, node]
                own = (x[:, features] <= thresholds).T.astype(np.int64) @ (y[:, None] == np.arange(classes)).astype(np.int64)
                held[t, node] = held.get((t, node), 0) + own
            cells = [(t, node, slot, k, int(n)) for (t, node), own in held.items() for slot, line in enumerate(own) for k, n in enumerate(line) if n]
            yield pd.DataFrame(cells, columns=["tree", "node", "slot", "y", "n"])

        found = rows.mapInPandas(scan, "tree int, node int, slot int, y int, n long").groupBy("tree", "node", "slot", "y").agg(F.sum("n").alias("n")).collect()
        out = {k: np.zeros((len(v[0]), classes), np.int64) for k, v in split.items()}
        for r in found:
            out[r.tree, r.node][r.slot, r.y] = r.n
        return out
