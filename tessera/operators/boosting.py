"""Gradient boosting over binned features: softmax over classes, a tree for each class and round, the best leaf split first.

Features become bins once. A leaf's best split comes from histograms of gradient, curvature and rows, which tasks add up for
their own rows and Spark by feature; the driver sees one candidate for each leaf and feature, never bins or rows. The best leaf is
split until the budget of leaves is used. As a leaf's children must be known before they can compete, one job scans the children of
all leaves that may still be split, for all classes: a round takes about as many jobs as its trees have levels, not leaves.
Gradients are added as whole numbers, so trees don't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.lineage import cut

_WIDTH = 1 << 15  # names of cells leave room for any bin
_PENDING = 1 << 20  # cells that a task holds before it adds them up
_SPLIT = "tree int, node int, feature int, gain double, bin int, g double, h double, n long"


@dataclass
class Tree:
    """Nodes as arrays; feature -1 is a leaf, an inner node's children are left and left + 1.

    Rows at or below a node's bin go left, higher and missing ones right."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [-1])
    left: list[int] = field(default_factory=lambda: [-1])
    name: list[int] = field(default_factory=lambda: [1])  # 1 is the root, 2i and 2i + 1 are the children of i
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int) -> None:
        self.feature[node], self.bin[node], self.left[node] = feature, at, len(self.feature)
        for side in range(2):
            for column, value in ((self.feature, -1), (self.bin, -1), (self.left, -1), (self.name, self.name[node] * 2 + side), (self.value, 0.0)):
                column.append(value)

    def places(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row of bins ends in."""
        feature, edge, left = np.array(self.feature), np.array(self.bin), np.array(self.left)
        at = np.zeros(len(bins), int)
        while True:
            rows = np.flatnonzero(feature[at] >= 0)
            if not len(rows):
                return at
            node = at[rows]
            at[rows] = left[node] + (bins[rows, feature[node]] > edge[node])

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.places(bins)]


def binned(x: np.ndarray, bounds: list[np.ndarray]) -> np.ndarray:
    """Bin b holds what is above bound b - 1 and at most bound b; missing values have one bin of their own, the last."""
    out = np.empty(x.shape, np.int16)
    for f, own in enumerate(bounds):
        out[:, f] = np.where(np.isnan(x[:, f]), len(own) + 1, np.searchsorted(own, x[:, f], side="left"))
    return out


class _Cells:
    """Sums by name, kept as sorted arrays; what comes in is added up once it is long enough."""

    def __init__(self):
        self.parts, self.size, self.kept = [], 0, 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.size += len(columns[0])
        if self.size - self.kept >= max(_PENDING, self.kept):
            self.parts = [self.merged()]
            self.size = self.kept = len(self.parts[0][0])

    def merged(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return (np.empty(0, np.int64),) * 4
        names, *values = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.argsort(names, kind="stable")
        names = names[order]
        first = np.flatnonzero(np.r_[True, np.diff(names) != 0]) if len(names) else np.empty(0, int)
        return (names[first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values))


def softmax(scores: np.ndarray) -> np.ndarray:
    raised = np.exp(scores - scores.max(1, keepdims=True))
    return raised / raised.sum(1, keepdims=True)


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), width)


@dataclass(frozen=True)
class BoostedModel:
    bounds: list[np.ndarray]
    prior: np.ndarray
    rounds: list[list[Tree]]

    def scores(self, x: np.ndarray) -> np.ndarray:
        bins, out = binned(x, self.bounds), np.tile(self.prior, (len(x), 1))
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                out[:, k] += tree.values(bins)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds probability and prediction (double; the first of equal classes)."""

        @F.pandas_udf("probability array<double>, prediction double")
        def answer(raw: pd.Series) -> pd.DataFrame:
            likely = softmax(self.scores(_matrix(raw, len(self.bounds))))
            return pd.DataFrame({"probability": list(likely), "prediction": likely.argmax(1).astype(float)})

        return df.withColumn("_a", answer(vector_to_array("raw"))).select("*", "_a.*").drop("_a")


@dataclass(frozen=True)
class Boosted:
    """Columns: raw (vector), label (double from 0); all rows weigh 1.

    leaves: the most leaves of a tree, None for as many as depth allows; depth: the most levels of splits, None for no limit.
    bins: at most this many bounds a feature (up to 32,000); a feature with fewer different values may have a bound at each.
    A split leaves least_rows rows and least_curvature of curvature on either side and gains something; equal gains take the
    earlier leaf, feature, bin. Scores start at the logarithms of the classes' shares. After `every` rounds scores are
    written, so that lineage and the trees that tasks go through don't grow with the rounds. No random draw is made.
    """

    rounds: int = 50
    leaves: int | None = 31
    depth: int | None = None
    rate: float = 0.1
    bins: int = 255
    least_rows: int = 20
    least_curvature: float = 1e-3
    l2: float = 0.0
    every: int = 16

    def fit(self, train: DataFrame) -> BoostedModel:
        if self.leaves is None and self.depth is None:
            raise ValueError("trees need a limit of leaves or of depth")
        rows = train.select(vector_to_array("raw").alias("x"), F.col("label").cast("int").alias("y"))
        found = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
        if not found:
            raise ValueError("boosting needs training rows")
        totals = np.array([found.get(k, 0) for k in range(max(found) + 1)])
        with np.errstate(divide="ignore"):
            prior = np.maximum(np.log(totals / totals.sum()), -50.0)
        bounds = self._bounds(rows)
        scale = float(2 ** min(40, 60 - int(totals.sum()).bit_length()))

        def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"bins": list(binned(_matrix(b["x"], len(bounds)), bounds)), "y": b["y"], "scores": list(np.tile(prior, (len(b), 1)))})

        schema = "bins array<smallint>, y int, scores array<double>"
        base, recent, done = rows.mapInPandas(start, schema).persist(), [], []
        for _ in range(self.rounds):
            if len(recent) == self.every:
                folded, held = list(recent), base

                def fold(batches: Iterator[pd.DataFrame], folded: list = folded) -> Iterator[pd.DataFrame]:
                    for b in batches:
                        yield b.assign(scores=list(_scores(b, folded, len(bounds), len(prior))))

                base, recent = cut(held.mapInPandas(fold, schema)).persist(), []
                held.unpersist()
            trees = self._round(base, recent, len(bounds), len(prior), scale)
            recent.append(trees)
            done.append(trees)
            if all(len(t.feature) == 1 for t in trees):
                break
        base.unpersist()
        return BoostedModel(bounds, prior, done)

    def _bounds(self, rows: DataFrame) -> list[np.ndarray]:
        """Quantiles of each feature's values that are there; tasks sketch, rows are not moved."""
        shares = [float(i / self.bins) for i in range(1, self.bins + 1)]
        each = rows.select(F.posexplode("x").alias("feature", "value"))
        there = F.when(~F.isnan("value"), F.col("value"))
        found = each.groupBy("feature").agg(F.percentile_approx(there, shares, F.lit(max(10_000, 10 * self.bins))).alias("bounds")).collect()
        return [np.unique(np.array(r.bounds or [], float)) for r in sorted(found, key=lambda r: r.feature)]

    def _round(self, base: DataFrame, recent: list, features: int, classes: int, scale: float) -> list[Tree]:
        """The round's trees. Trial trees hold every split that was looked at, grown ones those that the budget allows."""
        trials, known = [Tree() for _ in range(classes)], {}
        while True:
            fresh = {(k, n) for k, t in enumerate(trials) for n in range(len(t.feature)) if (k, n) not in known}
            if fresh:
                known |= self._best(base, recent, trials, fresh, features, classes, scale)
            grown = [self._grow(k, t, known) for k, t in enumerate(trials)]
            if all(waiting is None for _, waiting in grown):
                return [tree for tree, _ in grown]
            for k, (_, waiting) in enumerate(grown):
                for node in waiting or []:
                    if trials[k].feature[node] < 0:
                        trials[k].split(node, known[k, node][1], known[k, node][2])

    def _grow(self, k: int, trial: Tree, known: dict) -> tuple[Tree, list[int] | None]:
        """(tree, None) once the budget is used, or (_, leaves whose children must be known first), among them all that may win."""
        tree, open_leaves = Tree(), {0: 0}  # trial node: node
        tree.value[0] = self._value(known[k, 0])
        while True:
            able = [n for n in open_leaves if known[k, n][0] > 0 and (self.depth is None or trial.name[n].bit_length() <= self.depth)]
            budget = len(able) if self.leaves is None else self.leaves - len(open_leaves)
            ranked = sorted(able, key=lambda n: (-known[k, n][0], trial.name[n]))[: max(budget, 0)]
            if not ranked:
                return tree, None
            if trial.feature[ranked[0]] < 0:
                return tree, [n for n in ranked if trial.feature[n] < 0]
            best = ranked[0]
            node = open_leaves.pop(best)
            tree.split(node, trial.feature[best], trial.bin[best])
            for side in range(2):
                open_leaves[trial.left[best] + side] = tree.left[node] + side
                tree.value[tree.left[node] + side] = self._value(known[k, trial.left[best] + side])

    def _value(self, stats: tuple) -> float:
        g, h = stats[3], stats[4]
        return float(-g / (h + self.l2) * self.rate) if h + self.l2 > 0 else 0.0

    def _best(self, base: DataFrame, recent: list, trials: list[Tree], fresh: set, features: int, classes: int, scale: float) -> dict:
        """(gain, feature, bin, g, h, n) of each fresh leaf; gain 0 where no split is allowed."""
        wanted = [np.array(sorted(n for t, n in fresh if t == k), int) for k in range(classes)]
        before = np.concatenate([[0], np.cumsum([len(nodes) for nodes in wanted])])
        owner, own_node = np.repeat(np.arange(classes), np.diff(before)), np.concatenate(wanted)
        least_rows, least_curvature, l2 = self.least_rows, self.least_curvature, self.l2

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = _Cells()
            for b in batches:
                if not len(b):
                    continue
                bins, y = np.array(b["bins"].tolist(), np.int64).reshape(len(b), features), b["y"].to_numpy()
                likely = softmax(_scores(b, recent, features, classes))
                for k, nodes in enumerate(wanted):
                    if not len(nodes):
                        continue
                    at, p = trials[k].places(bins), likely[:, k]
                    rows = np.flatnonzero(np.isin(at, nodes))
                    g = np.rint((p - (y == k)) * scale).astype(np.int64)[rows]
                    h = np.rint(p * (1 - p) * (classes / max(classes - 1, 1)) * scale).astype(np.int64)[rows]
                    leaf = before[k] + np.searchsorted(nodes, at[rows])
                    step = max(1, _PENDING // max(len(rows), 1))
                    for low in range(0, features, step):
                        some = np.arange(low, min(low + step, features))
                        names = (leaf[:, None] * features + some) * _WIDTH + bins[np.ix_(rows, some)]
                        held.add(names.ravel(), *(np.repeat(v, len(some)) for v in (g, h, np.ones(len(g), np.int64))))
            names, *sums = held.merged()
            place, feature = names // _WIDTH // features, names // _WIDTH % features
            columns = (owner[place], own_node[place], feature, names % _WIDTH, *sums) if len(names) else ([],) * 7
            yield pd.DataFrame(dict(zip(("tree", "node", "feature", "bin", "g", "h", "n"), columns, strict=True)))

        def choose(cells: pd.DataFrame) -> pd.DataFrame:
            """The best bin of each leaf; sums run over all leaves at once, less what stood before the leaf."""
            cells = cells.sort_values(["tree", "node", "bin"])
            tree, node, edge = (cells[c].to_numpy() for c in ("tree", "node", "bin"))
            first = np.flatnonzero(np.r_[True, (np.diff(tree) != 0) | (np.diff(node) != 0)])
            size = np.diff(np.r_[first, len(cells)])
            below, whole = [], []
            for c in ("g", "h", "n"):
                v = cells[c].to_numpy(np.int64)
                run = np.cumsum(v)
                below.append(run - np.repeat(run[first] - v[first], size))
                whole.append(np.add.reduceat(v, first))
            (gs, hs, ns), (g, h, n) = below, [np.repeat(v, size) for v in whole]
            score = lambda a, b: (a / scale) ** 2 / np.maximum(b / scale + l2, 1e-12)
            gain = score(gs, hs) + score(g - gs, h - hs) - score(g, h)
            fits = (np.minimum(ns, n - ns) >= max(least_rows, 1)) & (np.minimum(hs, h - hs) / scale >= least_curvature)
            gain = np.where(fits, np.round(gain, 12), 0.0)
            at = np.lexsort((edge, -gain, np.repeat(np.arange(len(first)), size)))[first]
            out = {"tree": tree[at], "node": node[at], "feature": cells["feature"].iloc[0], "gain": gain[at], "bin": edge[at], "g": whole[0] / scale, "h": whole[1] / scale, "n": whole[2]}
            return pd.DataFrame(out)

        parts = base.mapInPandas(scan, "tree int, node int, feature int, bin int, g long, h long, n long")
        keys = ["tree", "node", "feature", "bin"]
        summed = parts.repartition("feature").groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])  # tasks have summed their own rows
        found: dict = {}
        for r in summed.groupBy("feature").applyInPandas(choose, _SPLIT).collect():
            own = (r.gain, r.feature, r.bin, r.g, r.h, r.n)
            old = found.get((r.tree, r.node))
            if old is None or (-own[0], own[1]) < (-old[0], old[1]):
                found[r.tree, r.node] = own
        return {key: found.get(key, (0.0, 0, 0, 0.0, 0.0, 0)) for key in fresh}


def _scores(batch: pd.DataFrame, rounds: list, features: int, classes: int) -> np.ndarray:
    scores = _matrix(batch["scores"], classes)
    if rounds and len(batch):
        bins = np.array(batch["bins"].tolist(), np.int64).reshape(len(batch), features)
        for trees in rounds:
            for k, tree in enumerate(trees):
                scores[:, k] += tree.values(bins)
    return scores
