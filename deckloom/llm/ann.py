"""Nearest neighbours by low-dimensional stable projections and kd-trees.

Unit vectors are projected by a few Gaussian directions: the squared projected
distance of a pair is its squared distance times a chi-square variable.  A
bounded sample fits the top of a kd-tree over projections; every row is routed
to its cell, and each block of a cell has a kd-tree of its own.  A query first
searches one block of its home cell, which bounds its distances, and then every
cell that its bound allows.  Within a block, points come by projected distance
and are verified on the original vectors until the chi-square test holds: a
point as near as the worst neighbour so far would, with the wanted confidence,
have come already.

Rows of equal vectors are searched once and expanded at the end, so large
groups of copies cost one point.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckloom.llm.store import materialise, reread


@dataclass(frozen=True)
class Projections:
    directions: int = 12  # even
    confidence: float = 0.96
    block: int = 8192  # rows a task searches
    queries: int = 8192  # queries a task answers
    most_cells: int = 4096
    sample: int = 32_768
    leaf: int = 64
    seed: int = 11

    def matrix(self, dimension: int) -> np.ndarray:
        return np.random.default_rng(self.seed).normal(size=(dimension, self.directions))

    def limit(self) -> float:
        """The chi-square quantile of the stopping test."""

        def above(x: float) -> float:
            term, total = 1.0, 1.0
            for i in range(1, self.directions // 2):
                term *= x / 2 / i
                total += term
            return math.exp(-x / 2) * total

        low, high = 0.0, 50.0 + 10 * self.directions
        for _ in range(80):
            middle = (low + high) / 2
            low, high = (middle, high) if above(middle) > 1 - self.confidence else (low, middle)
        return high


def _vectors(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 1))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of the vector x with each row of y, in double precision."""
    return np.einsum("ij,j->i", y, x) / (math.sqrt(float(x @ x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))


def _splits(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """A kd-tree's inner nodes in heap order: widest direction, median."""
    out: list[tuple[int, float]] = []
    level = [np.arange(len(points))]
    for _ in range(depth):
        below = []
        for rows in level:
            own = points[rows]
            d = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if len(rows) else 0
            cut = float(np.median(own[:, d])) if len(rows) else 0.0
            out.append((d, cut))
            below += [rows[own[:, d] < cut], rows[own[:, d] >= cut]] if len(rows) else [rows, rows]
        level = below
    return out


def _cells(points: np.ndarray, splits: list[tuple[int, float]]) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    if not splits:
        return node
    d, cut = np.array([s[0] for s in splits]), np.array([s[1] for s in splits])
    while len(node) and node[0] < len(splits):
        node = 2 * node + 1 + (points[np.arange(len(points)), d[node]] >= cut[node])
    return node - len(splits)


class _Block:
    """The kd-tree of a block's projections, and its vectors by leaf."""

    def __init__(self, vectors: np.ndarray, reps: np.ndarray, model: Projections):
        self.model, points = model, _units(vectors) @ model.matrix(vectors.shape[1])
        leaves, todo = [], [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            if len(rows) <= model.leaf:
                leaves.append(rows)
                continue
            own = points[rows]
            d = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            half = np.argpartition(own[:, d], len(rows) // 2)
            todo += [rows[half[: len(rows) // 2]], rows[half[len(rows) // 2 :]]]
        self.order = np.concatenate(leaves)
        self.ends = np.concatenate([[0], np.cumsum([len(x) for x in leaves])])
        self.low = np.stack([points[x].min(axis=0) for x in leaves])
        self.high = np.stack([points[x].max(axis=0) for x in leaves])
        self.vectors, self.points, self.reps = vectors[self.order], points[self.order], reps[self.order]

    def search(self, vector: np.ndarray, k: int, worst: float = math.inf) -> tuple[np.ndarray, np.ndarray]:
        """Places (in the block's order) and cosines of up to k neighbours,
        best first, ties to the smaller representative; ``worst`` is a squared
        distance known to hold k neighbours."""
        limit, m = self.model.limit(), self.model.matrix(len(vector))
        point = (_units(vector[None]) @ m)[0]
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        near = (gap * gap).sum(axis=1)
        turn = np.argsort(near, kind="stable")
        found, scores = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, 2
        while at < len(turn) and near[turn[at]] <= limit * worst:
            leaves = turn[at : at + step]
            leaves = leaves[near[leaves] <= limit * worst]
            rows = np.concatenate([np.arange(self.ends[x], self.ends[x + 1]) for x in leaves])
            apart = self.points[rows] - point
            rows = rows[(apart * apart).sum(axis=1) <= limit * worst]
            found = np.concatenate([found, rows])
            scores = np.concatenate([scores, cosines(vector, self.vectors[rows])])
            best = np.lexsort((self.reps[found], -scores))[:k]
            found, scores = found[best], scores[best]
            if len(found) == k:
                worst = min(worst, max(2 - 2 * scores[-1], 0) * (1 + 1e-9) + 1e-12)
            at, step = at + step, min(step * 2, 32)
        return found, scores


def _usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, without null or non-finite
    components, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


NEIGHBOURS = "query_id long, rank int, vec_id long, score double"


def nearest(
    rows: DataFrame,
    queries: Column,
    *,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = 5,
    model: Projections | None = None,
) -> DataFrame:
    """The ``k`` nearest rows by cosine of each row that ``queries`` selects.

    Returns query_id, rank, vec_id, score; fewer than k where there are fewer
    candidates.  Rows whose vector is null, zero, or holds null or non-finite
    components take no part, nor do null ids or vectors of another length than
    the commonest (the shorter if two are).  Rows alike in id and vector count
    once; a query's own id is no candidate.  An empty table gives no rows;
    other columns are ignored.
    """
    model = model or Projections()
    spark = rows.sparkSession
    kind = rows.schema[vector].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"  # moved as stored, computed in double
    rows = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast(kind).alias("v"), queries.alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & _usable(F.col("v")))
    shapes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    shape = shapes.orderBy(F.desc("n"), "d").limit(1).collect()
    if not shape:
        return spark.createDataFrame([], NEIGHBOURS)
    dimension = shape[0]["d"]
    rows = rows.where(F.size("v") == dimension).withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(1), "v")})
    points = rows.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.first("v").alias("v"), F.max("asks").alias("asks"))
    points = materialise(points, "points")
    sample = _vectors(points.orderBy("k1", "k2").limit(model.sample).select("v").toArrow()["v"])
    n = points.count()
    depth = max(0, math.ceil(math.log2(max(1, min(n / model.block, model.most_cells)))))
    splits = _splits(_units(sample) @ model.matrix(dimension), depth)
    subs = max(1, -(-n // (model.block << depth)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = _units(_vectors(batch.column("v"))) @ model.matrix(dimension) if batch.num_rows else np.zeros((0, model.directions))
            spot = pa.FixedSizeListArray.from_arrays(pa.array(spots.ravel()), model.directions).cast(pa.list_(pa.float64()))
            yield pa.record_batch([*batch.columns, pa.array(_cells(spots, splits).astype(np.int32)), spot], [*batch.schema.names, "cell", "spot"])

    kept = f"k1 long, k2 long, rep long, v {kind}, asks boolean"
    index = points.select("k1", "k2", "rep", "v", "asks").mapInArrow(route, f"{kept}, cell int, spot array<double>")
    index = materialise(index.withColumn("sub", F.pmod("k2", F.lit(subs)).cast("int")), "index")
    edges = [f(F.col("spot")[i]).alias(f"{name}{i}") for name, f in (("l", F.min), ("h", F.max)) for i in range(model.directions)]
    boxes = index.groupBy("cell").agg(*edges).orderBy("cell").collect()  # at most as many as cells
    names = np.array([b["cell"] for b in boxes])
    low, high = (np.array([[b[f"{s}{i}"] for i in range(model.directions)] for b in boxes]) for s in "lh")

    asked = index.where("asks").select("k1", "k2", "v", "cell", F.pmod("k2", F.lit(subs)).cast("int").alias("sub"))
    part = F.pmod(F.xxhash64("k1"), F.col("parts")).cast("int")

    def dealt(asking: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The blocks that ``asking`` names, copied for every ``queries`` of
        them that a block has, and ``asking`` dealt to these copies."""
        parts = asking.groupBy("cell", "sub").agg(F.ceil(F.count("*") / model.queries).cast("int").alias("parts"))
        parts = materialise(parts, "parts")
        blocks = reread(index).select("cell", "sub", "rep", "k1", "k2", "v").join(reread(parts), ["cell", "sub"])
        blocks = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        return blocks, asking.join(parts, ["cell", "sub"]).withColumn("part", part).drop("parts")

    def home(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if right.num_rows:
            block = _Block(_vectors(left["v"]), left["rep"].to_numpy(), model)
            for k1, k2, v in zip(right["k1"].to_pylist(), right["k2"].to_pylist(), _vectors(right["v"]), strict=True):
                _, scores = block.search(v, k + 1)
                out.append((k1, k2, max(2 - 2 * scores[-1], 0) * (1 + 1e-9) + 1e-12 if len(scores) > k else math.inf))
        cols = zip(*out, strict=True) if out else ((), (), ())
        return pa.table([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.float64()], strict=True)], ["k1", "k2", "worst"])

    blocks, asking = dealt(asked)
    first = blocks.groupBy("cell", "sub", "part").cogroup(asking.groupBy("cell", "sub", "part"))
    bounds = materialise(first.applyInArrow(home, "k1 long, k2 long, worst double"), "bounds")

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = model.limit()
        for batch in batches:
            spots = _units(_vectors(batch.column("v"))) @ model.matrix(dimension) if batch.num_rows else np.zeros((0, model.directions))
            worst = batch.column("worst").to_numpy()
            cells = []
            for spot, w in zip(spots, worst, strict=True):
                gap = np.maximum(np.maximum(low - spot, spot - high), 0)
                cells.append(names[(gap * gap).sum(axis=1) <= limit * w].astype(np.int32))
            yield pa.record_batch([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

    todo = asked.select("k1", "k2", "v").join(bounds, ["k1", "k2"]).select("k1", "k2", "v", "worst")
    todo = todo.mapInArrow(allowed, f"k1 long, k2 long, v {kind}, worst double, cells array<int>")
    todo = materialise(todo.withColumn("cell", F.explode("cells")).drop("cells"), "todo")
    todo = todo.withColumn("sub", F.explode(F.sequence(F.lit(0), F.lit(subs - 1))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if right.num_rows and left.num_rows:
            block = _Block(_vectors(left["v"]), left["rep"].to_numpy(), model)
            c1, c2 = left["k1"].to_numpy()[block.order], left["k2"].to_numpy()[block.order]
            asking = zip(right["k1"].to_pylist(), right["k2"].to_pylist(), _vectors(right["v"]), right["worst"].to_pylist(), strict=True)
            for k1, k2, v, worst in asking:
                at, scores = block.search(v, k + 1, worst)
                out += [(k1, k2, int(c1[i]), int(c2[i]), int(block.reps[i]), float(x)) for i, x in zip(at, scores, strict=True)]
        cols = zip(*out, strict=True) if out else [()] * 6
        types = [*[pa.int64()] * 5, pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["k1", "k2", "c1", "c2", "rep", "score"])

    blocks, asking = dealt(todo)
    hits = blocks.groupBy("cell", "sub", "part").cogroup(asking.groupBy("cell", "sub", "part"))
    hits = hits.applyInArrow(search, "k1 long, k2 long, c1 long, c2 long, rep long, score double")
    best = Window.partitionBy("k1", "k2").orderBy(F.desc("score"), "rep")
    hits = hits.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).drop("place", "rep")
    ids = Window.partitionBy("k1", "k2").orderBy("id")
    distinct = rows.select("k1", "k2", "id", "asks").distinct()
    members = distinct.withColumn("place", F.row_number().over(ids)).where(F.col("place") <= k + 1)
    members = members.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.col("id").alias("vec_id"))
    askers = distinct.where("asks").select("k1", "k2", F.col("id").alias("query_id"))
    offered = hits.join(members, ["c1", "c2"]).drop("c1", "c2")
    pairs = askers.join(offered, ["k1", "k2"]).where("vec_id != query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
