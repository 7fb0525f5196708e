"""A small gradient-boosted tree classifier (logistic loss, quantile bins, shallow trees) with a calibrated threshold.

``fit`` and ``calibrated_threshold`` take rows in memory. ``fit_rows`` and ``threshold_of_rows`` do the same on a DataFrame of any
size (``x array<float>, y double, weight double``): a job per level of a tree adds up what its nodes' rows hold per feature and
bin, and the threshold comes from running sums. They add in whole units of 1 / ``ONE``, so the order of adding changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staylens.llm.common import materialised

ONE = 2.0 ** 20
RESCORED = 8  # trees, after which the rows' scores are written anew


def _units(c: Column) -> Column:
    return F.sum(F.round(c * ONE).cast("long"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Arrays of one length as a matrix in doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(column), -1)


@dataclass
class Tree:
    """A complete binary tree in heap order: inner nodes test ``x[feature] > cut``; the last level holds values."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), "i8")
        while len(self.feature) and at.max(initial=0) < len(self.feature):
            at = 2 * at + 1 + (x[np.arange(len(x)), self.feature[at]] > self.cut[at])
        return at - len(self.feature)


@dataclass
class BoostedTrees:
    """Weighted rows in, probabilities out. With one class only, every probability is that class's share."""

    trees: int = 40
    depth: int = 3
    rate: float = 0.3
    bins: int = 24
    ridge: float = 1.0
    base: float = 0.0
    fitted: list[Tree] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> BoostedTrees:
        share = float(np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 1e-6, 1 - 1e-6)) if len(y) else 1e-6
        self.base, self.fitted = float(np.log(share / (1 - share))), []
        if not len(y) or y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T)], axis=1)
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(x, binned, cuts, weight * (p - y), weight * p * (1 - p))
            self.fitted.append(tree)
            score += tree.value[tree.leaves(x)]
        return self

    def fit_rows(self, rows: DataFrame) -> BoostedTrees:
        """As ``fit``, on a DataFrame's rows; only sums per node, feature and bin come to the driver."""
        y, weight = F.col("y"), F.col("weight")
        seen = rows.agg(_units(weight * y).alias("right"), _units(weight).alias("all"), F.min(y).alias("low"), F.max(y).alias("high"),
                        F.max(F.size("x")).alias("width")).first()
        share = float(np.clip(seen["right"] / max(seen["all"], 1e-9), 1e-6, 1 - 1e-6)) if seen["all"] else 1e-6
        self.base, self.fitted = float(np.log(share / (1 - share))), []
        if seen["low"] == seen["high"]:
            return self
        levels = F.array(*[F.lit(float(q)) for q in np.linspace(0, 1, self.bins + 1)[:-1]])
        cuts = [np.unique(c) for c in rows.agg(*[F.percentile(F.col("x")[k], levels).alias(f"c{k}") for k in range(seen["width"])]).first()]
        scored, recent, inner = rows.select("x", "y", "weight", F.lit(self.base).alias("score")), [], 2 ** self.depth - 1
        for n in range(self.trees):
            if n % RESCORED == 0:
                scored, recent = materialised(_rescored(scored, recent)), []
            tree = Tree(np.zeros(inner, "i8"), np.full(inner, np.inf), np.zeros(inner + 1))
            for level in range(self.depth):
                for k, sums in enumerate(_level_sums(scored, recent, tree, level, cuts)):
                    node, total = 2 ** level - 1 + k, sums[:, 0].sum(axis=-1)
                    tree.feature[node], tree.cut[node], left = self._split([sums[:, f, :len(c) + 1] for f, c in enumerate(cuts)], cuts, total)
                    if level == self.depth - 1:
                        for side, (g, h) in enumerate((left, total - left)):
                            tree.value[2 * k + side] = -self.rate * g / (h + self.ridge)
            recent.append(tree)
            self.fitted.append(tree)
        return self

    def probability_rows(self, rows: DataFrame) -> DataFrame:
        """``p, y, weight`` of the rows."""
        own = rows.select("x", "y", "weight", F.lit(self.base).alias("score"))
        return _rescored(own, self.fitted).select((1 / (1 + F.exp(-F.col("score")))).alias("p"), "y", "weight")

    def _split(self, sums, cuts, total) -> tuple[int, float, np.ndarray]:
        """The best feature and cut of a node, and the sums of the rows it leaves on the left, from sums by feature and bin."""
        best, feature, cut, rest = 1e-6, 0, np.inf, total
        total_g, total_h = total
        for f, edges in enumerate(cuts):
            left_g, left_h = np.cumsum(sums[f], axis=1)[:, :len(edges)]
            gain = (left_g ** 2 / (left_h + self.ridge) + (total_g - left_g) ** 2 / (total_h - left_h + self.ridge)
                    - total_g ** 2 / (total_h + self.ridge))
            k = int(gain.argmax())
            if gain[k] > best:
                best, feature, cut, rest = float(gain[k]), f, edges[k], np.array([left_g[k], left_h[k]])
        return feature, cut, rest

    def _grow(self, x, binned, cuts, g, h) -> Tree:
        inner = 2 ** self.depth - 1
        feature, cut = np.zeros(inner, "i8"), np.full(inner, np.inf)
        rows = {0: np.arange(len(x))}
        for node in range(inner):
            own = rows.pop(node)
            sums = [np.stack([np.bincount(binned[own, f], v[own], len(edges) + 1) for v in (g, h)]) for f, edges in enumerate(cuts)]
            feature[node], cut[node], _ = self._split(sums, cuts, np.array([g[own].sum(), h[own].sum()]))
            right = x[own, feature[node]] > cut[node]
            rows[2 * node + 1], rows[2 * node + 2] = own[~right], own[right]
        value = np.array([-self.rate * g[rows[k]].sum() / (h[rows[k]].sum() + self.ridge) for k in range(inner, 2 * inner + 1)])
        return Tree(feature, cut, value)

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for tree in self.fitted:
            score += tree.value[tree.leaves(x)]
        return 1 / (1 + np.exp(-score))


def calibrated_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray, precision: float, least: int = 20) -> float:
    """The lowest threshold whose selections on rows kept out of training are right with the wished precision, given at
    least ``least`` right ones; infinity (nothing is selected) if there is none."""
    order = np.argsort(-p, kind="stable")
    right, all_ = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    last = np.append(p[order][1:] != p[order][:-1], True) if len(p) else np.zeros(0, bool)
    good = np.flatnonzero(last & (right >= precision * all_) & (right >= least))
    return float(p[order][good[-1]]) if len(good) else float("inf")


def _rescored(rows: DataFrame, trees: list[Tree]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b["x"])
                score = b["score"].to_numpy() + sum(t.value[t.leaves(x)] for t in trees)
                yield pa.RecordBatch.from_arrays([b["x"], b["y"], b["weight"], pa.array(score, pa.float64())], names=["x", "y", "weight", "score"])

    return rows.mapInArrow(run, "x array<float>, y double, weight double, score double")


def _level_sums(rows: DataFrame, trees: list[Tree], tree: Tree, level: int, cuts: list[np.ndarray]) -> np.ndarray:
    """By node of a level: the first and second derivatives of its rows, summed up per feature and bin."""
    nodes, most = 2 ** level, max(map(len, cuts)) + 1
    shape = (nodes, 2, len(cuts), most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(shape, "i8")
        for b in batches:
            if not b.num_rows:
                continue
            x, y, weight = _matrix(b["x"]), b["y"].to_numpy(), b["weight"].to_numpy()
            p = 1 / (1 + np.exp(-(b["score"].to_numpy() + sum(t.value[t.leaves(x)] for t in trees))))
            at = np.zeros(len(x), "i8")
            for _ in range(level):
                at = 2 * at + 1 + (x[np.arange(len(x)), tree.feature[at]] > tree.cut[at])
            at -= nodes - 1
            for k, v in enumerate((np.rint(weight * (p - y) * ONE), np.rint(weight * p * (1 - p) * ONE))):
                for f, edges in enumerate(cuts):
                    cell = at * most + np.searchsorted(edges, x[:, f], side="left")
                    sums[:, k, f] += np.bincount(cell, v, nodes * most).astype("i8").reshape(nodes, most)
        cells = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(sums.ravel()[cells])], names=["cell", "v"])

    out = np.zeros(shape)
    for r in rows.mapInArrow(run, "cell long, v long").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        out.ravel()[r["cell"]] = r["v"] / ONE
    return out


def threshold_of_rows(rows: DataFrame, precision: float, least: int = 20) -> float:
    """``calibrated_threshold`` of the rows ``p, y, weight``: running sums within ranges of p, after those of the ranges above."""
    sums = rows.groupBy("p").agg(_units(F.col("weight") * F.col("y")).alias("right"), _units(F.col("weight")).alias("all"))
    ranges = materialised(sums.repartitionByRange(F.desc("p")).withColumn("part", F.spark_partition_id()))
    before, right, all_ = [], 0, 0
    for r in sorted(ranges.groupBy("part").agg(F.sum("right").alias("right"), F.sum("all").alias("all")).collect(), key=lambda r: r["part"]):
        before.append((r["part"], right, all_))
        right, all_ = right + r["right"], all_ + r["all"]
    if not before:
        return float("inf")
    above = rows.sparkSession.createDataFrame(before, "part int, right_above long, all_above long")
    down = Window.partitionBy("part").orderBy(F.desc("p"))
    running = ranges.join(F.broadcast(above), "part").select(
        "p", (F.sum("right").over(down) + F.col("right_above")).alias("right"), (F.sum("all").over(down) + F.col("all_above")).alias("all"))
    last = running.filter((F.col("right") >= precision * F.col("all")) & (F.col("right") >= least * ONE)).agg(F.min("p")).first()[0]
    return float("inf") if last is None else last
