"""Hard-negative mining with lists shared by clusters of anchors (MAXIMUS): one order per cluster, walked until certified.

Vectors become integers, ``floor(scale * x)``; a row's score is its exact integer inner product with the anchor.  An anchor's
positives are its best rows of the same label.  For each positive the hard negatives are the best rows of other labels whose
score lies between ``low`` and ``high`` percent of the positive's.

1. *Clusters.*  Anchors are clustered by direction (spherical k-means, fitted on at most ``SAMPLE`` anchors in a seeded hash order;
   every anchor is assigned).  A cluster knows its centroid c and the widest angle r between c and a member.
2. *Shared lists.*  The score of member u and row i is at most ``|u| |i| cos(max(0, angle(i, c) - r))``.  The factor without ``|u|`` is the
   row's bound, the same for all members, so a cluster's list is all rows by falling bound, ordered once: a histogram of
   bounds (``BINS`` per cluster) cuts it into segments that grow fourfold.
3. *Walk.*  In rounds, every anchor that is not certified yet meets the next segment of its cluster's list.  A segment is dealt out
   in blocks of about ``BLOCK`` rows and ``ANCHORS`` anchors, which a task walks in list order in steps; it keeps the best rows per anchor
   only.  An anchor is certified, and leaves, once ``|u|`` times the next bound is below all it still looks for: the k-th
   score found, or the lowest score that its window admits.  Nothing else ends a walk, so results are exact.

Positives are walked first; their scores set the windows of the negatives' walk.  A label, vector or bound that a third of all rows share
spreads over blocks, as rows are dealt by the hash of their id.

Rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part.  Rows equal in id, label and vector
count once; rows that share an id are never each other's partners.  Vectors of different length do not meet.  Anchors without a positive, and
positives without a negative in the window (all with a negative score), give no row.  Scores must fit in 64 bits.  Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from sparkwarden.llm.common import Scratch

SAMPLE = 8192
MEMBERS, CLUSTERS = 512, 64  # one cluster per so many anchors, at most so many
BINS = 2048
FIRST = 16_384  # rows of the first segment
BLOCK, ANCHORS, STEP = 4096, 2048, 1024
SEED = 12
_LEAST = -(2**63) + 1
_SLACK = 1e-7  # covers the rounding of angles


def _pack(vector: list[int]) -> bytes:
    """The integers in the narrowest of 2, 4 and 8 bytes that holds them all."""
    v = np.array(vector, np.int64)
    widest = max(-int(v.min()) - 1, int(v.max()))
    return v.astype(np.int16 if widest < 2**15 else np.int32 if widest < 2**31 else np.int64).tobytes()


def _unpack(packed: list[bytes], d: int) -> np.ndarray:
    types = {2 * d: np.int16, 4 * d: np.int32, 8 * d: np.int64}
    if len({len(p) for p in packed}) == 1:
        return np.frombuffer(b"".join(packed), types[len(packed[0])]).reshape(-1, d).astype(np.int64)
    return np.array([np.frombuffer(p, types[len(p)]) for p in packed], np.int64).reshape(-1, d)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products; in floating point as long as every partial sum is an integer that it holds."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a.astype(float)).max()) * float(np.abs(b.astype(float)).max()) * a.shape[1] < 2.0**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(float)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def fit_centroids(points: np.ndarray, count: int, steps: int = 8) -> np.ndarray:
    """Spherical k-means from far-apart seeds."""
    u = _unit(points)
    chosen, nearest = [0], u @ u[0]
    for _ in range(1, min(count, len(u))):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, u @ u[chosen[-1]])
    c = u[chosen]
    for _ in range(steps):
        own = (u @ c.T).argmax(axis=1)
        c = _unit(np.stack([u[own == k].sum(axis=0) if (own == k).any() else c[k] for k in range(len(c))]))
    return c


class Lists:
    """The shared orders: centroids by dimension, widest member angles, and the segment of every (cluster, bin)."""

    def __init__(self, centroids: dict[int, np.ndarray]):
        self.centroids = centroids
        self.offset, n = {}, 0
        for d in sorted(centroids):
            self.offset[d] = n
            n += len(centroids[d])
        self.count = n
        self.reach = np.zeros(n)
        self.top = 1.0
        self.segment = np.zeros((n, BINS), np.int16)
        self.rows: list[np.ndarray] = []  # per segment: rows of each cluster
        self.edges: list[np.ndarray] = []  # per segment: highest bound of each cluster

    def angles(self, vectors: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(_unit(vectors) @ self.centroids[vectors.shape[1]].T, -1, 1))

    def bounds(self, vectors: np.ndarray) -> np.ndarray:
        """rows x clusters of the dimension: the row's bound in each list."""
        at = self.offset[vectors.shape[1]]
        reach = self.reach[at: at + len(self.centroids[vectors.shape[1]])]
        norm = np.linalg.norm(vectors.astype(float), axis=1)[:, None]
        return norm * (np.cos(np.maximum(0, self.angles(vectors) - reach)) + _SLACK)

    def bins(self, bounds: np.ndarray) -> np.ndarray:
        return np.clip(((bounds / self.top + 1) / 2 * BINS).astype(np.int64), 0, BINS - 1)

    def cut(self, counts: np.ndarray) -> None:
        """Segments from the clusters' histograms of bounds."""
        falling = counts[:, ::-1]
        before = np.cumsum(falling, axis=1) - falling
        level = np.where(before < FIRST, 0, np.ceil(np.log(np.maximum(before, 1) / FIRST + 1e-12) / np.log(4) + 1e-9)).astype(np.int16)
        self.segment = np.maximum(level, 0)[:, ::-1].copy()
        edge = (np.arange(1, BINS + 1) / BINS * 2 - 1) * self.top * (1 + _SLACK)
        for s in range(int(self.segment.max()) + 1 if counts.size else 0):
            here = (self.segment == s) & (counts > 0)
            self.rows.append(np.where(here, counts, 0).sum(axis=1))
            self.edges.append(np.where(here, edge, -np.inf).max(axis=1))


def _by_dimension(batch: pa.RecordBatch):
    """(dimension, places in the batch, vectors) of each dimension."""
    d = batch.column("d").to_numpy()
    for k in np.unique(d).tolist():
        at = np.flatnonzero(d == k)
        yield k, at, _unpack(batch.column("packed").take(pa.array(at)).to_pylist(), k)


def _prepared(df: DataFrame, is_anchor: Column, id_column: str, label: str, vector: str, scale: float) -> DataFrame:
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    code = F.col(label).cast("long") if isinstance(df.schema[label].dataType, IntegralType) else F.xxhash64(label)
    whole = df.where(F.col(id_column).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(~bad).select(
        F.col(id_column).cast("long").alias("id"), code.alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
        F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("q"))

    def pack(batches):
        for b in batches:
            q = b.column("q").to_pylist()
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "label", "anchor")), pa.array([len(x) for x in q], pa.int32()), pa.array([_pack(x) for x in q], pa.binary())], ["id", "label", "anchor", "d", "packed"])

    return whole.mapInArrow(pack, "id long, label long, anchor boolean, d int, packed binary").distinct()


def _shared_lists(rows: DataFrame, clusters: int | None, scratch: Scratch) -> tuple[Lists, DataFrame]:
    """The lists and the anchors with their clusters."""
    anchors = rows.where("anchor")
    n = anchors.groupBy("d").count().collect()  # one row per length of vectors
    share = SAMPLE / max(1, sum(r["count"] for r in n))
    centroids = {}
    for r in n:
        take = max(1, int(r["count"] * min(1.0, share)))
        k = clusters or max(1, min(CLUSTERS, r["count"] // MEMBERS))
        drawn = anchors.where(F.col("d") == r["d"]).orderBy(F.xxhash64(F.lit(SEED), "id", "packed"), "id").limit(take).select("packed").toArrow()
        centroids[r["d"]] = fit_centroids(_unpack(drawn.column(0).to_pylist(), r["d"]), k)
    lists = Lists(centroids)

    def assign(batches):
        for b in batches:
            cluster, angle, norm = np.zeros(len(b), np.int64), np.zeros(len(b)), np.zeros(len(b))
            for d, at, v in _by_dimension(b):
                turn = lists.angles(v)
                best = turn.argmin(axis=1)
                cluster[at], angle[at], norm[at] = best + lists.offset[d], turn[np.arange(len(at)), best], np.linalg.norm(v.astype(float), axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cluster), pa.array(angle), pa.array(norm)], [*b.schema.names, "cluster", "angle", "norm"])

    placed = scratch.save(anchors.withColumn("mark", F.xxhash64("label", "packed")).select("id", "label", "d", "packed", "mark").mapInArrow(
        assign, "id long, label long, d int, packed binary, mark long, cluster long, angle double, norm double"), "anchors")
    for r in placed.groupBy("cluster").agg(F.max("angle").alias("reach")).collect():  # one row per cluster
        lists.reach[r["cluster"]] = r["reach"]

    def longest(batches):
        for b in batches:
            norms = [float(np.linalg.norm(v.astype(float), axis=1).max()) for _, _, v in _by_dimension(b)]
            yield pa.RecordBatch.from_arrays([pa.array(norms, pa.float64())], ["norm"])

    lists.top = (rows.select("d", "packed").mapInArrow(longest, "norm double").agg(F.max("norm")).first()[0] or 1.0) * (1 + 2 * _SLACK)

    def histogram(batches):
        counts = np.zeros((lists.count, BINS), np.int64)
        for b in batches:
            for d, _, v in _by_dimension(b):
                if d in lists.offset:
                    bins = lists.bins(lists.bounds(v))
                    for k in range(bins.shape[1]):
                        counts[lists.offset[d] + k] += np.bincount(bins[:, k], minlength=BINS)
        cluster, place = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(place), pa.array(counts[cluster, place])], ["cluster", "bin", "n"])

    counts = np.zeros((lists.count, BINS), np.int64)
    table = rows.select("d", "packed").mapInArrow(histogram, "cluster long, bin long, n long").groupBy("cluster", "bin").agg(F.sum("n").alias("n")).toArrow()
    counts[table.column("cluster").to_numpy(), table.column("bin").to_numpy()] = table.column("n").to_numpy()  # clusters x BINS
    lists.cut(counts)
    return lists, placed


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by score, ties to the smaller id."""
    if len(score) > 4 * k:
        kept = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        # of rows equal to the last score only the smallest ids can stay
        if len(kept) > 4 * k:
            tied = kept[score[kept] == score[kept].min()]
            more = kept[score[kept] > score[kept].min()]
            kept = np.concatenate((more, tied[np.argpartition(ids[tied], k - 1)[:k]] if len(tied) > k else tied))
        return kept[np.lexsort((ids[kept], -score[kept]))][:k]
    return np.lexsort((ids, -score))[:k]


def walk_block(rows: pd.DataFrame, members: pd.DataFrame, k: int, same: bool) -> pd.DataFrame:
    """The k best rows of a block for each slot of each member, in list order and by steps; see the module."""
    out: dict[str, list] = {"anchor": [], "mark": [], "slot": [], "id": [], "score": []}
    if len(rows) and len(members):
        d = int(rows["d"].iloc[0])
        rows = rows.sort_values(["bound", "id"], ascending=[False, True])
        bound, ids, label = rows["bound"].to_numpy(), rows["id"].to_numpy(), rows["label"].to_numpy()
        v, u = _unpack(rows["packed"].tolist(), d), _unpack(members["packed"].tolist(), d)
        norm, own, mine = members["norm"].to_numpy(), members["label"].to_numpy(), members["id"].to_numpy()
        slots = [[(int(s["slot"]), int(s["low"]), int(s["high"])) for s in each] for each in members["slots"]]
        held = [[(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(s) for s in slots]
        low = [[x[1] for x in s] for s in slots]
        need, highest = np.array([min(x) for x in low], float), np.array([max(x[2] for x in s) for s in slots])
        for at in range(0, len(ids), STEP):
            going = np.flatnonzero(need <= norm * bound[at] + _SLACK)
            if not len(going):
                break
            part = slice(at, at + STEP)
            found = scores(u[going], v[part])
            fits = ((own[going][:, None] == label[part]) == same) & (mine[going][:, None] != ids[part]) & (found <= highest[going][:, None])
            fits &= found >= np.array([min(low[g]) for g in going.tolist()])[:, None]
            for row in np.flatnonzero(fits.any(axis=1)).tolist():
                g, pick = int(going[row]), np.flatnonzero(fits[row])
                value, name = found[row][pick], ids[part][pick]
                for s, (_, _, high) in enumerate(slots[g]):
                    into = (value >= low[g][s]) & (value <= high)
                    if into.any():
                        value_s, name_s = np.concatenate((held[g][s][0], value[into])), np.concatenate((held[g][s][1], name[into]))
                        best = _best(value_s, name_s, k)
                        held[g][s] = value_s[best], name_s[best]
                        if len(best) == k:
                            low[g][s] = max(low[g][s], int(value_s[best[-1]]))
                need[g] = min(low[g])
        marks = members["mark"].to_numpy()
        for g, each in enumerate(slots):
            for (slot, _, _), (value, name) in zip(each, held[g], strict=True):
                out["anchor"] += [mine[g]] * len(name)
                out["mark"] += [marks[g]] * len(name)
                out["slot"] += [slot] * len(name)
                out["id"] += name.tolist()
                out["score"] += value.tolist()
    return pd.DataFrame(out)


_FOUND = "anchor long, mark long, slot int, id long, score long"


def _walk(rows: DataFrame, anchors: DataFrame, lists: Lists, k: int, same: bool, scratch: Scratch) -> DataFrame:
    """(anchor, mark, slot, id, score, rank): the k best rows of each slot of ``anchors`` (id, mark, label, d, packed, norm, cluster, slots)."""
    spark = rows.sparkSession
    best = Window.partitionBy("anchor", "mark", "slot").orderBy(F.desc("score"), "id")
    found = spark.createDataFrame([], _FOUND + ", rank int")
    for s in range(len(lists.rows)):
        edges = spark.createDataFrame([(c, float(e)) for c, e in enumerate(lists.edges[s].tolist())], "cluster long, edge double")
        going = anchors.join(F.broadcast(edges), "cluster").where(F.array_min("slots.low") <= F.col("norm") * F.col("edge") + _SLACK)
        counts = {r["cluster"]: r["count"] for r in going.groupBy("cluster").count().collect()}  # one row per cluster
        if not counts:
            # bounds fall and needs rise, but a cluster may have no row in this segment
            if all(e == -np.inf for e in lists.edges[s].tolist()):
                continue
            break
        parts, blocks = np.zeros(lists.count, int), np.zeros(lists.count, int)
        for c, n in counts.items():
            parts[c], blocks[c] = math.ceil(n / ANCHORS), math.ceil(int(lists.rows[s][c]) / BLOCK)
        sizes = F.broadcast(spark.createDataFrame([(c, int(parts[c]), int(blocks[c])) for c in counts], "cluster long, parts int, blocks int"))

        def enlist(batches, s=s, live=parts > 0):
            for b in batches:
                for d, at, v in _by_dimension(b):
                    if d not in lists.offset:
                        continue
                    bounds = lists.bounds(v)
                    clusters = np.arange(bounds.shape[1]) + lists.offset[d]
                    row, col = np.nonzero((lists.segment[clusters[None, :], lists.bins(bounds)] == s) & live[clusters])
                    took = b.take(pa.array(at[row]))
                    yield pa.RecordBatch.from_arrays([*took.columns, pa.array(clusters[col]), pa.array(bounds[row, col])], [*took.schema.names, "cluster", "bound"])

        listed = rows.select("id", "label", "d", "packed").mapInArrow(enlist, "id long, label long, d int, packed binary, cluster long, bound double").join(sizes, "cluster")
        left = listed.withColumn("block", F.pmod(F.xxhash64("id", "packed"), "blocks").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        met = going.join(sizes, "cluster").withColumn("part", F.pmod(F.xxhash64("id", "mark"), "parts").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        group = ["cluster", "block", "part"]
        here = left.select(*group, "id", "label", "d", "packed", "bound").groupBy(*group).cogroup(
            met.select(*group, "id", "mark", "label", "packed", "norm", "slots").groupBy(*group)).applyInPandas(lambda a, b: walk_block(a, b, k, same), _FOUND)
        found = scratch.save(found.drop("rank").union(here).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "found")
        if s + 1 < len(lists.rows):
            # a full slot only looks for rows no worse than its last
            full = found.where(F.col("rank") == k).select(F.col("anchor").alias("id"), "mark", "slot", F.col("score").alias("last"))
            each = anchors.select("id", "mark", F.inline("slots")).join(full, ["id", "mark", "slot"], "left").groupBy("id", "mark").agg(
                F.collect_list(F.struct("slot", F.greatest("low", F.coalesce("last", F.lit(_LEAST))).alias("low"), "high")).alias("slots"))
            anchors = scratch.save(anchors.drop("slots").join(each, ["id", "mark"]), "walking")
    return found


def mine(df: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, id_column: str = "vec_id", label: str = "label",
         vector: str = "embedding", scale: float = 256, clusters: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows where ``is_anchor`` holds; see the module."""
    scratch = Scratch(df.sparkSession)
    rows = scratch.save(_prepared(df, is_anchor, id_column, label, vector, scale), "rows")
    lists, anchors = _shared_lists(rows, clusters, scratch)
    slot = lambda number, least, most: F.struct(number.cast("int").alias("slot"), least.cast("long").alias("low"), most.cast("long").alias("high"))
    every = F.array(slot(F.lit(0), F.lit(_LEAST), F.lit(2**63 - 1)))
    best = _walk(rows, anchors.withColumn("slots", every), lists, positives, True, scratch).select(
        F.col("anchor").alias("id"), "mark", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    # percents of a score without overflow: whole hundreds first
    p = F.col("positive_score")
    least = F.expr(f"{low} * (positive_score div 100) + ({low} * (positive_score % 100) + 99) div 100")
    most = F.expr(f"{high} * (positive_score div 100) + ({high} * (positive_score % 100)) div 100")
    windows = best.where(p >= 0).withColumn("s", slot(F.col("rank"), least, most)).where("s.low <= s.high").groupBy("id", "mark").agg(F.collect_list("s").alias("slots"))
    hard = _walk(rows, scratch.save(anchors.join(windows, ["id", "mark"]), "windows"), lists, negatives, False, scratch)
    found = hard.select(F.col("anchor").alias("id"), "mark", F.col("slot").alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(best.withColumnRenamed("rank", "place"), ["id", "mark", "place"]).select(
        F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
