"""Kernel machines on Spark: RBF kernels over landmarks, a machine for each pair of classes, sigmoid calibration.

Columns: raw (vector), label (double from 0), weight. Everything that is fitted (scale, landmarks, machines, sigmoids) comes from
the training rows alone, and features are scaled before the kernel sees them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rbf(x: np.ndarray, landmarks: np.ndarray, gamma: float) -> np.ndarray:
    """exp(-gamma |x - z|^2) of all rows of x and all landmarks."""
    squares = (x * x).sum(1)[:, None] - 2 * x @ landmarks.T + (landmarks * landmarks).sum(1)[None]
    return np.exp(-gamma * np.maximum(squares, 0))


@dataclass(frozen=True)
class KernelModel:
    """A fitted machine; its size follows landmarks and features, never rows."""

    mean: np.ndarray
    scale: np.ndarray
    landmarks: np.ndarray
    gamma: float
    classes: int
    machines: np.ndarray  # landmarks x pairs: weights of the kernel values
    intercepts: np.ndarray
    sigmoids: np.ndarray | None = None  # classes x 2: slope and shift

    def kernel(self, x: np.ndarray) -> np.ndarray:
        return rbf((x - self.mean) / self.scale, self.landmarks, self.gamma)

    def decisions(self, x: np.ndarray) -> np.ndarray:
        """For each class its votes among the pairs plus its summed margins, squeezed below a third of a vote."""
        margins = self.kernel(x) @ self.machines + self.intercepts
        votes, sums = np.zeros((len(x), self.classes)), np.zeros((len(x), self.classes))
        for at, (a, b) in enumerate(combinations(range(self.classes), 2)):
            votes[:, a] += margins[:, at] < 0
            votes[:, b] += margins[:, at] >= 0
            sums[:, a] -= margins[:, at]
            sums[:, b] += margins[:, at]
        return votes + sums / (3 * (np.abs(sums) + 1))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        raised = 1 / (1 + np.exp(np.clip(self.sigmoids[:, 0] * self.decisions(x) + self.sigmoids[:, 1], -700, 700)))
        total = raised.sum(1, keepdims=True)
        return np.where(total > 0, raised / np.where(total > 0, total, 1), 1 / self.classes)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds decisions, prediction (double) and, with sigmoids, probability; the class of equal values is the first."""

        @F.pandas_udf("decisions array<double>, prediction double, probability array<double>")
        def answer(raw: pd.Series) -> pd.DataFrame:
            x = np.array(raw.tolist(), float).reshape(len(raw), len(self.mean))
            found = self.decisions(x)
            likely = self.probabilities(x) if self.sigmoids is not None else None
            best = (found if likely is None else likely).argmax(1).astype(float)
            return pd.DataFrame({"decisions": list(found), "prediction": best, "probability": [None] * len(x) if likely is None else list(likely)})

        return df.withColumn("_a", answer(vector_to_array("raw"))).select("*", "_a.*").drop("_a")


@dataclass(frozen=True)
class RbfMachine:
    """gamma: a number, "scale" (one over features times the variance of scaled values) or "auto" (one over features).

    landmarks: the bound on landmarks, rows of different content with the least hashes. With as many as there are different
    rows the kernel is exact; with fewer it is Nystrom's approximation, and a model stays landmarks x features large.
    calibrated: probabilities by sigmoids that are fitted on decisions for rows which the deciding machine did not see.
    """

    c: float = 1.0
    gamma: float | str = "scale"
    landmarks: int = 512
    calibrated: bool = False
    folds: int = 5
    seed: int = 42

    def fit(self, train: DataFrame) -> KernelModel:
        train = train.persist()
        model = self._fit(train)
        if self.calibrated:
            fold = F.pmod(F.xxhash64(F.lit(self.seed), vector_to_array("raw")), F.lit(self.folds))  # equal rows share a fold
            unseen = None
            for i in range(self.folds):
                part = replace(self, calibrated=False)._fit(train.filter(fold != i), model.classes).transform(train.filter(fold == i)).select("label", "decisions")
                unseen = part if unseen is None else unseen.union(part)
            model = replace(model, sigmoids=sigmoids(unseen, model.classes))
        train.unpersist()
        return model

    def _fit(self, train: DataFrame, classes: int | None = None) -> KernelModel:
        moments = train.agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("raw")).alias("m"), F.max("label").alias("top")).select("m.*", "top").first()
        if moments["count"] == 0:
            raise ValueError("a machine needs training rows")
        n, mean = moments["count"], moments["mean"].toArray()
        spread = np.sqrt(moments["variance"].toArray() * (n - 1) / n)
        scale = np.where(spread > 0, spread, 1.0)
        varied = int((spread > 0).sum())  # scaled columns have variance 1, constant ones 0
        gamma = {"scale": 1 / varied if varied else 1.0, "auto": 1 / len(mean)}.get(self.gamma, self.gamma)

        name = F.xxhash64(F.lit(self.seed), vector_to_array("raw"))
        named = train.select("raw", name.alias("_name"))
        least = named.select("_name").distinct().orderBy("_name").limit(self.landmarks)
        chosen = named.join(F.broadcast(least), "_name", "left_semi").dropDuplicates(["_name"]).orderBy("_name").collect()
        marks = (np.array([r.raw.toArray() for r in chosen]) - mean) / scale
        values, vectors = np.linalg.eigh(rbf(marks, marks, gamma))
        kept = values > 1e-10 * values[-1]
        whitened = vectors[:, kept] / np.sqrt(values[kept])

        @F.pandas_udf("array<double>")
        def mapped(raw: pd.Series) -> pd.Series:
            x = np.array(raw.tolist(), float).reshape(len(raw), len(mean))
            return pd.Series(list(rbf((x - mean) / scale, marks, gamma) @ whitened))

        rows = train.select(mapped(vector_to_array("raw")).alias("f"), F.col("label").cast("int").alias("y"), "weight").persist()
        present = {r.y for r in rows.select("y").distinct().collect()}
        classes = classes or int(moments["top"]) + 1
        pairs = list(combinations(range(classes), 2))
        fitted = hinge_machines(rows, [p for p in pairs if set(p) <= present], whitened.shape[1], self.c)
        rows.unpersist()
        # A class alone in its pair always wins.
        lone = [np.append(np.zeros(whitened.shape[1]), -1.0 if a in present else 1.0) for a, _ in pairs]
        machines = np.array([fitted.get(p, lone[i]) for i, p in enumerate(pairs)]).reshape(len(pairs), -1)
        return KernelModel(mean, scale, marks, gamma, classes, whitened @ machines[:, :-1].T if pairs else np.zeros((len(marks), 0)), machines[:, -1])


def hinge(margin: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hinge loss with its corner rounded over 1 - width to 1 + width, its slope and its bend."""
    bent = np.abs(1 - margin) < width
    loss = np.where(bent, (1 + width - margin) ** 2 / (4 * width), np.maximum(1 - margin, 0))
    return loss, np.where(bent, (margin - 1 - width) / (2 * width), -(margin < 1).astype(float)), bent / (2 * width)


def hinge_machines(rows: DataFrame, pairs: list[tuple[int, int]], size: int, c: float, widths=(2.0, 0.3, 0.02), rounds: int = 40) -> dict:
    """Weights and intercept of each pair's machine, least in 1/2 |w|^2 + c * (weighted hinge losses); the second class is above 0.

    rows: f (array of doubles), y, weight. Newton steps over all rows and all pairs at once, on ever sharper corners, shortened
    where they don't lower the loss. The first corner reaches every row at its start, and the intercept's bend is kept above 0. A step is one aggregate: losses, slopes and bends, (size + 1)^2 numbers a pair whatever the rows.
    """
    ridge = np.append(np.ones(size), 1e-9)

    def measure(at: dict, width: float) -> dict:
        """(loss, slope, bend) of each pair at its point."""

        def scan(batches):
            sums: dict = {}
            for batch in batches:
                x = np.column_stack([np.array(batch["f"].tolist(), float).reshape(len(batch), size), np.ones(len(batch))])
                y, weight = batch["y"].to_numpy(), batch["weight"].to_numpy() * c
                for i, (a, b) in enumerate(pairs):
                    own = (y == a) | (y == b)
                    z, sign, w = x[own], np.where(y[own] == b, 1.0, -1.0), weight[own]
                    loss, slope, bend = hinge(sign * (z @ at[pairs[i]]), width)
                    sums[i] = sums.get(i, 0) + np.vstack([(z * (w * bend)[:, None]).T @ z, (w * slope * sign) @ z, np.append([w @ loss, w.sum()], np.zeros(size - 1))])
            yield pd.DataFrame([(i, j, line) for i, own in sums.items() for j, line in enumerate(own)], columns=["i", "j", "v"])

        found = rows.mapInPandas(scan, "i int, j int, v array<double>").groupBy("i", "j").agg(Summarizer.sum(array_to_vector("v")).alias("v")).collect()
        out = {p: np.zeros((size + 3, size + 1)) for p in pairs}
        for r in found:
            out[pairs[r.i]][r.j] = r.v.toArray()
        return {p: (s[-1, 0] + (ridge * at[p] ** 2).sum() / 2, s[-2] + ridge * at[p], s[:-2] + np.diag(np.append(ridge[:-1], 1e-4 * s[-1, 1] + ridge[-1]))) for p, s in out.items()}

    at = {p: np.zeros(size + 1) for p in pairs}
    for width in widths if pairs else ():
        small = 1e-6 if width == widths[-1] else 1e-3  # the wider corners only give a start
        here, step, going = measure(at, width), dict.fromkeys(pairs, 1.0), set(pairs)
        for _ in range(rounds):
            tried = {p: at[p] - step[p] * np.linalg.solve(here[p][2], here[p][1]) if p in going else at[p] for p in pairs}
            there, tried_at = measure(tried, width), dict(step)
            for p in list(going):
                gain = here[p][0] - there[p][0]
                if gain >= 0:
                    at[p], here[p], step[p] = tried[p], there[p], min(1.0, step[p] * 4)
                else:
                    step[p] /= 4
                if 0 <= gain <= small * tried_at[p] * (1 + abs(here[p][0])) or step[p] < 1e-5:
                    going.discard(p)
            if not going:
                break
    return at


def sigmoids(decided: DataFrame, classes: int, rounds: int = 50) -> np.ndarray:
    """Slope and shift of each class's sigmoid 1 / (1 + exp(slope * decision + shift)), by damped Newton steps.

    Each step is one aggregate over (label, decisions); targets lie within 0 and 1 by the classes' counts.
    """
    decided = decided.persist()
    counts = decided.agg(F.count("*").alias("n"), *[F.count(F.when(F.col("label") == k, 1)).alias(f"c{k}") for k in range(classes)]).first()
    at = np.array([[0.0, np.log((counts["n"] - counts[f"c{k}"] + 1) / (counts[f"c{k}"] + 1))] for k in range(classes)])

    def measure(points: np.ndarray) -> np.ndarray:
        cells = []
        for k in range(classes):
            own = counts[f"c{k}"]
            d = F.col("decisions")[k]
            z = d * float(points[k, 0]) + float(points[k, 1])
            target = F.when(F.col("label") == k, (own + 1.0) / (own + 2.0)).otherwise(1.0 / (counts["n"] - own + 2.0))
            p = 1 / (1 + F.exp(z))
            loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - (1 - target) * z  # -t log p - (1 - t) log(1 - p)
            slack = p * (1 - p)
            cells += [F.sum(c) for c in (loss, (target - p) * d, target - p, slack * d * d, slack * d, slack)]
        return np.array(decided.agg(*[c.alias(f"m{i}") for i, c in enumerate(cells)]).first(), float).reshape(classes, 6)

    found, step = measure(at), np.ones(classes)
    for _ in range(rounds):
        moves = np.stack([np.linalg.solve([[h[3] + 1e-12, h[4]], [h[4], h[5] + 1e-12]], h[1:3]) for h in found])
        tried = at - step[:, None] * moves
        fresh = measure(tried)
        better = fresh[:, 0] <= found[:, 0]
        change = np.abs(np.where(better[:, None], tried - at, 0)).max()
        at, found = np.where(better[:, None], tried, at), np.where(better[:, None], fresh, found)
        step = np.where(better, 1.0, step / 2)
        if better.all() and change < 1e-9 or (step < 1e-6).all():
            break
    decided.unpersist()
    return at
