"""Bagged trees that vote on whether a request comes from a bot, and the verdict."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitlore.operators.reqfeatures import NAMES, Known, features

#: Labels are set by hand: at most so many are used for fitting, chosen by a hash of label_pos. Every tree is fitted in a task that has them all.
MOST_LABELLED = 100_000


@dataclass(frozen=True)
class Settings:
    """Trees, their depth, the share of columns each tree may use, rows a node must have to be split, and the seed."""

    trees: int = 200
    depth: int = 5
    columns: float = 0.6
    split: int = 5
    seed: int = 42


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """A row of rows for each label of a stored position: repeated and contradicting labels are examples of their own.

    Labels that are NULL or of positions that are not stored are left out.
    """
    known = labels.where(F.col("label").isNotNull()).select("label_pos", "position", "label")
    return known.join(rows, "position")


def training_rows(log: DataFrame, labels: DataFrame, known: Known = Known(), *, labelled_only: bool = False) -> DataFrame:
    """label_pos, position, label and the 38 numbers of every labelled row.

    The recent past of an address is that of the whole log. labelled_only=True lets it consist of the labelled rows alone, in
    the order of the labels, as older training runs had it.
    """
    if not labelled_only:
        return labelled(features(log, known), labels)
    rows = labelled(log, labels)
    own = features(rows.withColumn("position", F.col("label_pos").cast("long")), known).withColumnRenamed("position", "label_pos")
    return rows.select("label_pos", "position", "label").join(own, "label_pos")


@dataclass(frozen=True)
class Trees:
    """The nodes of all trees: column (-1 in a leaf), threshold, children by number, vote of a leaf; the roots of the trees."""

    columns: tuple[str, ...]
    column: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    vote: np.ndarray
    roots: np.ndarray

    @classmethod
    def grown(cls, columns: Sequence[str], trees: Sequence) -> Trees:
        """Trees from nested nodes (column, threshold, node up to it, node above it) and votes."""
        nodes: list[list] = []

        def add(node) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, -1, -1, 0.0])
            if isinstance(node, tuple):
                column, threshold, low, high = node
                nodes[at] = [list(columns).index(column), threshold, add(low), add(high), 0.0]
            else:
                nodes[at][4] = float(node)
            return at

        roots = [add(t) for t in trees]
        column, threshold, left, right, vote = (np.array(c) for c in zip(*nodes, strict=True))
        return cls(tuple(columns), column.astype(int), threshold, left.astype(int), right.astype(int), vote, np.array(roots))

    def share(self, x: np.ndarray) -> np.ndarray:
        """The share of trees that vote for a bot, for each row of x."""
        votes = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while (inner := self.column[at] >= 0).any():
                i = np.flatnonzero(inner)
                n = at[i]
                at[i] = np.where(x[rows[i], self.column[n]] <= self.threshold[n], self.left[n], self.right[n])
            votes += self.vote[at]
        return votes / max(len(self.roots), 1)


@dataclass(frozen=True)
class Forest:
    """Trees, and how much each column took off the impurity, in sum 1."""

    trees: Trees
    importance: np.ndarray


@dataclass(frozen=True)
class _Examples:
    """For each column the distinct values in ascending order and the number of each row's value; the labels."""

    values: list[np.ndarray]
    codes: list[np.ndarray]
    label: np.ndarray


def _best_split(examples: _Examples, rows: np.ndarray, weight: np.ndarray, columns: np.ndarray) -> tuple[float, int, float] | None:
    """Decrease of the weighted Gini impurity, column and threshold of the best split of some rows; None if no split decreases it.

    A threshold lies half way between two values that the rows have. Ties go to the first column and the lowest threshold.
    """
    w, y = weight[rows], weight[rows] * examples.label[rows]
    n, positive = w.sum(), y.sum()
    impure = 2 * positive * (n - positive) / n
    best = None
    for column in columns:
        codes, values = examples.codes[column][rows], examples.values[column]
        there, ones = np.bincount(codes, w, len(values)), np.bincount(codes, y, len(values))
        some = np.flatnonzero(there)
        if len(some) < 2:
            continue
        low, low_ones = np.cumsum(there[some])[:-1], np.cumsum(ones[some])[:-1]
        high, high_ones = n - low, positive - low_ones
        gain = impure - 2 * low_ones * (low - low_ones) / low - 2 * high_ones * (high - high_ones) / high
        at = int(gain.argmax())
        if gain[at] > 1e-9 and (best is None or gain[at] > best[0] + 1e-12):
            best = (float(gain[at]), int(column), float((values[some[at]] + values[some[at + 1]]) / 2))
    return best


def grow(examples: _Examples, settings: Settings, number: int) -> tuple[list[tuple], np.ndarray]:
    """The nodes of one tree (column, threshold, left, right, vote), the root first, and the decrease of impurity by column.

    Rows are drawn with replacement and columns without, by a generator of the tree's own.
    """
    rng, k, n = np.random.default_rng([settings.seed, number]), len(examples.values), len(examples.label)
    weight = np.bincount(rng.integers(0, n, n), minlength=n).astype(float)
    columns = np.sort(rng.choice(k, max(1, round(settings.columns * k)), replace=False))
    nodes: list[tuple] = []
    decrease = np.zeros(k)

    def add(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        w = weight[rows]
        share = float((w * examples.label[rows]).sum() / w.sum())
        nodes.append((-1, 0.0, -1, -1, float(share > 0.5)))
        found = _best_split(examples, rows, weight, columns) if depth < settings.depth and w.sum() >= settings.split else None
        if found is not None:
            gain, column, threshold = found
            decrease[column] += gain
            low = examples.values[column][examples.codes[column][rows]] <= threshold
            left, right = add(rows[low], depth + 1), add(rows[~low], depth + 1)
            nodes[at] = (column, threshold, left, right, 0.0)
        return at

    add(np.flatnonzero(weight), 0)
    return nodes, decrease


_NODES = "tree int, columns array<int>, thresholds array<double>, lefts array<int>, rights array<int>, votes array<double>, decrease array<double>"


def fit(examples: DataFrame, columns: Sequence[str] = NAMES, settings: Settings = Settings()) -> Forest:
    """A forest fitted on the columns and the boolean label of examples.

    The labelled rows, MOST_LABELLED at most, are collected and sent to the executors, which fit the trees; each tree has its
    own rows and its own columns. NULL and NaN count as 0.
    """
    spark = examples.sparkSession
    order = [F.xxhash64("label_pos"), "label_pos"] if "label_pos" in examples.columns else [F.xxhash64(*columns)]
    chosen = examples.where(F.col("label").isNotNull()).select(*columns, F.col("label").cast("double").alias("__y"), *(["label_pos"] if "label_pos" in examples.columns else []))
    rows = chosen.orderBy(*order).limit(MOST_LABELLED).drop("label_pos").toPandas()
    x, y = np.nan_to_num(rows[list(columns)].to_numpy(np.float64)), rows["__y"].to_numpy(np.float64)
    if not len(y):
        raise ValueError("no labelled rows to fit on")
    coded = [np.unique(x[:, i], return_inverse=True) for i in range(x.shape[1])]
    shared = spark.sparkContext.broadcast(_Examples([c[0] for c in coded], [c[1] for c in coded], y))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            grown = [grow(own, settings, t) for t in batch.column(0).to_pylist()]
            lists = [[list(c) for c in zip(*nodes, strict=True)] for nodes, _ in grown]
            kinds = (pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64())
            arrays = [pa.array([own_lists[i] for own_lists in lists], pa.list_(kind)) for i, kind in enumerate(kinds)]
            decrease = pa.array([d.tolist() for _, d in grown], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), *arrays, decrease], names=["tree", "columns", "thresholds", "lefts", "rights", "votes", "decrease"])

    tasks = min(settings.trees, 4 * spark.sparkContext.defaultParallelism)
    fitted = sorted(spark.range(0, settings.trees, 1, tasks).mapInArrow(run, _NODES).collect(), key=lambda r: r.tree)
    starts = np.cumsum([0, *(len(r.votes) for r in fitted)])
    flat = lambda name: np.concatenate([np.array(getattr(r, name)) for r in fitted])
    shift = np.repeat(starts[:-1], np.diff(starts))
    child = lambda name: np.where(flat(name) >= 0, flat(name) + shift, -1)
    trees = Trees(tuple(columns), flat("columns").astype(int), flat("thresholds"), child("lefts"), child("rights"), flat("votes"), starts[:-1])
    each = np.array([r.decrease for r in fitted])
    each = each / np.maximum(each.sum(axis=1, keepdims=True), 1e-12)
    return Forest(trees, each.mean(axis=0) / max(each.mean(axis=0).sum(), 1e-12))


def save(model: Forest, path: str) -> None:
    """A forest as one Parquet file of nodes and one of columns."""
    spark, t = SparkSession.active(), model.trees
    roots = set(t.roots.tolist())
    nodes = [(i, int(c), float(h), int(a), int(b), float(v), i in roots) for i, (c, h, a, b, v) in enumerate(zip(t.column, t.threshold, t.left, t.right, t.vote, strict=True))]
    spark.createDataFrame(nodes, "node int, column int, threshold double, low int, high int, vote double, root boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    columns = [(i, c, float(x)) for i, (c, x) in enumerate(zip(t.columns, model.importance, strict=True))]
    spark.createDataFrame(columns, "number int, name string, importance double").coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")


def load(path: str) -> Forest:
    spark = SparkSession.active()
    nodes = spark.read.parquet(f"{path}/nodes").toPandas().sort_values("node")
    columns = spark.read.parquet(f"{path}/columns").toPandas().sort_values("number")
    own = [nodes[c].to_numpy() for c in ("column", "threshold", "low", "high", "vote")]
    return Forest(Trees(tuple(columns["name"]), *own, np.flatnonzero(nodes["root"].to_numpy())), columns["importance"].to_numpy())


def scored(rows: DataFrame, trees: Trees) -> DataFrame:
    """rows of features with `score`, the share of trees that vote for a bot (hard votes, not averaged leaf shares)."""
    shared = rows.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf(T.DoubleType())
    def vote(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        own = shared.value
        for columns in batches:
            yield pd.Series(own.share(np.nan_to_num(np.column_stack([c.to_numpy(np.float64) for c in columns]))))

    return rows.withColumn("score", vote(*(F.col(c) for c in trees.columns)))


def verdict(score: Column, *, human_max: float = 0.25, bot_min: float = 0.75, inverted: bool = False) -> Column:
    """bot from bot_min on, human up to human_max, uncertain between. inverted swaps the two names, as some deployments had it."""
    names = ("human", "bot") if inverted else ("bot", "human")
    return F.when(score >= bot_min, names[0]).when(score <= human_max, names[1]).otherwise("uncertain")


def importance(spark: SparkSession, model: Forest) -> DataFrame:
    """feature, importance: one row per column of the model."""
    return spark.createDataFrame([(c, float(v)) for c, v in zip(model.trees.columns, model.importance, strict=True)], "feature string, importance double")
