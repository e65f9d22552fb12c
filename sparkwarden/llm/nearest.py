"""Approximate nearest neighbours: stable projections, kd-tree, incremental verification until a chi-square test holds.

Vectors are projected to ``LOW`` dimensions with normal random directions.  For a vector at distance d the squared projected distance
divided by d squared follows a chi-square law with ``LOW`` degrees of freedom.  Candidates are met in the order of
projected distance and verified on the original vectors.  If the next projected distance is x and the k-th best distance
so far is d, a closer vector would have come before x with a probability of at least ``chi2(x**2 / d**2)``; the search ends when that reaches
``SURE``.

The tree's upper levels are fitted on at most ``SAMPLE`` vectors in a seeded hash order; every vector is indexed in one of their cells.  Cells
are dealt out in blocks of bounded size, each with a lower tree of its own.  A query first searches its own cell.  With the distance
found there the same test, on the boxes of cells, says which others it visits.  Boxes (at most ``CELLS``) are broadcast.

Equal vectors are indexed once with their k + 1 smallest ids, all that any result can hold, and equal queries are searched once; so a vector
that a third of all rows share costs as much as any other.  Vectors that are null, zero, or hold null or non-finite components take no
part; nor do those of another dimension than most (the larger of equally frequent ones).  Rows that repeat an id are one candidate per vector.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkwarden.llm.common import Scratch, widened

LOW = 8
SURE = 0.98
SAMPLE = 20_000
CELLS, CELL_ROWS = 1024, 4096
BLOCK, QUERIES = 8192, 4096
LEAF = 32
SEED = 5


def directions(dimension: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(SEED)).standard_normal((dimension, LOW))


def chi2(x):
    """Distribution function of the chi-square law with ``LOW`` (even) degrees of freedom."""
    h = np.minimum(np.asarray(x, float) / 2, 700)
    return 1 - np.exp(-h) * sum(h**i / math.factorial(i) for i in range(LOW // 2))


def upper_tree(points: np.ndarray, depth: int) -> np.ndarray:
    """(dimension, threshold) of each node in heap order, split at the median of the widest dimension."""
    nodes = np.zeros((2**depth - 1, 2))
    members = {0: np.arange(len(points))}
    for node in range(len(nodes)):
        rows = members.pop(node)
        p = points[rows]
        if len(rows):
            nodes[node] = (dim := int(np.ptp(p, axis=0).argmax())), float(np.median(p[:, dim]))
        right = p[:, int(nodes[node, 0])] > nodes[node, 1]
        members[2 * node + 1], members[2 * node + 2] = rows[~right], rows[right]
    return nodes


def cell_of(points: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    for _ in range(int(math.log2(len(nodes) + 1))):
        right = points[np.arange(len(points)), nodes[at, 0].astype(int)] > nodes[at, 1]
        at = 2 * at + 1 + right
    return at - len(nodes)


def box_distance(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.sqrt((np.maximum(0, np.maximum(low - point, point - high)) ** 2).sum(axis=1))


class LowerTree:
    """Leaves of a kd-tree over projected points, with their boxes."""

    def __init__(self, points: np.ndarray):
        self.leaves: list[np.ndarray] = []
        todo = [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF:
                self.leaves.append(rows)
                continue
            p = points[rows]
            order = np.argsort(p[:, np.ptp(p, axis=0).argmax()], kind="stable")
            half = len(rows) // 2
            todo += [rows[order[:half]], rows[order[half:]]]
        self.low = np.stack([points[r].min(axis=0) for r in self.leaves])
        self.high = np.stack([points[r].max(axis=0) for r in self.leaves])

    def search(self, query: np.ndarray, projected: np.ndarray, vectors: np.ndarray, ids: list, k: int, bound: float) -> list[tuple[float, int]]:
        """The k nearest (distance, id) met before the test holds; ``bound`` is a k-th distance known from elsewhere."""
        reach = box_distance(projected, self.low, self.high)
        best: list[tuple[float, int]] = []
        for leaf in np.argsort(reach, kind="stable"):
            if bound < np.inf and (bound == 0 and reach[leaf] > 0 or bound > 0 and chi2((reach[leaf] / bound) ** 2) >= SURE):
                break
            rows = self.leaves[leaf]
            d = np.sqrt(((vectors[rows] - query) ** 2).sum(axis=1))
            near = np.flatnonzero(d <= bound)
            if len(near):
                best = sorted([*best, *((float(d[i]), int(x)) for i in near for x in ids[rows[i]])])[:k]
                if len(best) == k:
                    bound = min(bound, best[-1][0])
        return best


def _usable(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(id_column).isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(~bad & F.exists(v, lambda x: x != 0)).select(
        F.col(id_column).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double")).alias("vector"))


def search(df: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): each query's k nearest rows of ``df`` but itself, by Euclidean distance, ties to the smaller id."""
    scratch = Scratch(df.sparkSession)
    rows = scratch.save(_usable(df, id_column, vector), "rows")
    top = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dimension = top["d"] if top else 1
    matrix = directions(dimension)
    rows = rows.where(F.size("vector") == dimension)
    asked = _usable(queries, id_column, vector).where(F.size("vector") == dimension).distinct()
    turn = Window.partitionBy("vector").orderBy("id")
    # rows may repeat; a vector's ids count once
    few = rows.distinct().withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= k + 1)
    unique = scratch.save(few.groupBy("vector").agg(F.array_sort(F.collect_set("id")).alias("ids")).withColumn("key", F.xxhash64("vector")), "unique")
    n = unique.count()
    depth = max(0, min(int(math.log2(CELLS)), math.ceil(math.log2(max(1, n / CELL_ROWS)))))
    sample = unique.orderBy(F.xxhash64(F.lit(SEED), "vector"), "key").limit(SAMPLE).select("vector").toArrow()
    points = np.array(sample.column("vector").to_pylist(), float).reshape(-1, dimension) @ matrix
    nodes = upper_tree(points, depth)

    def place(frame: DataFrame) -> DataFrame:
        fields = frame.columns

        def run(batches):
            for b in batches:
                v = b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
                p = v @ matrix
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell_of(p, nodes)), pa.array(list(p), pa.list_(pa.float64()))], [*fields, "cell", "low"])

        return frame.mapInArrow(run, widened(frame, cell="long", low="array<double>"))

    index = scratch.save(place(unique), "index")
    boxes = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[f(F.get("low", F.lit(i))).alias(f"{name}{i}") for name, f in (("a", F.min), ("b", F.max)) for i in range(LOW)])
    boxes = boxes.toPandas().sort_values("cell")  # at most CELLS rows
    low, high = boxes[[f"a{i}" for i in range(LOW)]].to_numpy(float), boxes[[f"b{i}" for i in range(LOW)]].to_numpy(float)
    cells = boxes["cell"].to_numpy()
    blocks = {int(c): max(1, math.ceil(x / BLOCK)) for c, x in zip(cells, boxes["n"], strict=True)}
    placed = scratch.save(place(asked.select("vector").distinct().withColumn("query", F.xxhash64(F.lit(1), "vector"))), "queries")

    def visit(pairs: DataFrame) -> DataFrame:
        """(query, vector, distance, id) found for ``pairs`` (query, vector, low, bound, cell)."""
        counts = pairs.groupBy("cell").count().collect()  # at most CELLS rows
        parts = {r["cell"]: max(1, math.ceil(r["count"] / QUERIES)) for r in counts}
        if not parts:
            parts = {-1: 1}
        sizes = df.sparkSession.createDataFrame([(int(c), blocks.get(int(c), 1), int(p)) for c, p in parts.items()], "cell long, blocks int, parts int")
        sizes = F.broadcast(sizes)
        left = index.join(sizes, "cell").withColumn("block", F.pmod("key", "blocks").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        right = pairs.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64(F.lit(2), "query"), "parts").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        group = ["cell", "block", "part"]

        def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            out: dict[str, list] = {"query": [], "distance": [], "id": []}
            if len(a) and len(b):
                a = a.sort_values("key")
                tree = LowerTree(np.stack(a["low"].to_numpy()))
                vectors, ids = np.stack(a["vector"].to_numpy()), a["ids"].tolist()
                for q, v, p, bound in zip(b["query"], b["vector"], b["low"], b["bound"], strict=True):
                    for d, x in tree.search(v, p, vectors, ids, k + 1, bound):
                        out["query"].append(q)
                        out["distance"].append(d)
                        out["id"].append(x)
            return pd.DataFrame(out)

        return left.select(*group, "key", "ids", "vector", "low").groupBy(*group).cogroup(right.select(*group, "query", "vector", "low", "bound").groupBy(*group)).applyInPandas(work, "query long, distance double, id long")

    near = Window.partitionBy("query").orderBy("distance", "id")
    first = scratch.save(visit(placed.withColumn("bound", F.lit(float("inf")))), "first")
    bound = first.withColumn("rank", F.row_number().over(near)).where(F.col("rank") == k + 1).select("query", F.col("distance").alias("bound"))

    def others(batches):
        for b in batches:
            keep, to = [], []
            for i, (home, p, d) in enumerate(zip(b.column("cell").to_pylist(), b.column("low").to_pylist(), b.column("bound").to_pylist(), strict=True)):
                reach = box_distance(np.array(p), low, high)
                go = (cells != home) & ((chi2((reach / d) ** 2) < SURE) if 0 < d < np.inf else (reach <= d))
                keep += [i] * int(go.sum())
                to += cells[go].tolist()
            picked = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(picked.column(c) for c in ("query", "vector", "low", "bound")), pa.array(to, pa.int64())], ["query", "vector", "low", "bound", "cell"])

    more = placed.join(bound, "query", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    pairs = scratch.save(more.mapInArrow(others, "query long, vector array<double>, low array<double>, bound double, cell long"), "pairs")
    found = first.unionByName(visit(pairs)).withColumn("turn", F.row_number().over(near)).where(F.col("turn") <= k + 1)
    each = asked.select(F.col("id").alias("query_id"), F.xxhash64(F.lit(1), "vector").alias("query"))
    last = Window.partitionBy("query_id", "query").orderBy("distance", "id")
    return each.join(found, "query").where("query_id <> id").withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "id", F.col("distance").alias("score"))
