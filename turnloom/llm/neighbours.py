"""Approximate nearest neighbours by low-dimensional stable projections and a kd-tree.

Largest inner product becomes least distance by one more coordinate, sqrt(R^2 - |x|^2) with R the
greatest length; queries are scaled to length R. Vectors are projected to DIMS Gaussian coordinates:
for points at distance r, the squared projected distance over r^2 has a chi-square distribution with
DIMS degrees of freedom. So once a query's k-th best verified distance is d, a nearer vector lies
beyond projected distance d * sqrt(quantile(CONFIDENCE)) with probability 1 - CONFIDENCE at most:
the search walks the kd-tree's leaves by projected distance, verifies whole leaves with exact
inner products in double precision, and stops at the first leaf beyond that.

The tree's upper levels are fitted on at most SAMPLE projected vectors (those with the least key hashes)
and cut space into cells; every vector is indexed in its cell, cells of over BLOCK vectors are cut into
blocks, and each block builds its own lower levels. A first round searches each query's own cell; its k-th
distances then say which other cells a second round must visit. The queries that visit a cell go to it in
parts of about QUERY_BLOCK, so no task holds more, and a block is sent as often as its cell has parts.

Projections and distances are those of vectors scaled by a power of two, so that no finite component
overflows a square; scores are those of the vectors as given (infinite where they exceed a double, and
least of all where infinities cancel out).

Equal vectors are searched once: of each, the k + 1 smallest ids stand for all, as no other can be
among the k nearest.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part, as
queries or candidates; null ids neither; vectors are compared with those of their own length only;
equal scores go to smaller ids; of rows with one id, every distinct vector counts and the best
score is returned once; fewer candidates than k give fewer rows; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shared_dir

DIMS = 10
CONFIDENCE = 0.97
SAMPLE, CELL_SAMPLES = 100_000, 16
CELL, BLOCK, LEAF = 4096, 8192, 256
QUERY_BLOCK = 8192
SEED = 20_240_101


def chi_square_quantile(p: float, k: int) -> float:
    """By bisection on the series of the regularized lower gamma function."""
    from math import exp, lgamma, log

    def below(x: float) -> float:
        a, h = k / 2, x / 2
        if h <= 0:
            return 0.0
        term = total = 1 / a
        n = 1
        while term > total * 1e-15:
            term *= h / (a + n)
            total += term
            n += 1
        return total * exp(-h + a * log(h) - lgamma(a))

    low, high = 0.0, 10.0 * k + 100
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def projection(width: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((width + 1, DIMS))


def projected(vectors: np.ndarray, radius2: float) -> np.ndarray:
    """Stable projections of vectors with their added coordinate."""
    rest = np.sqrt(np.maximum(radius2 - np.einsum("ij,ij->i", vectors, vectors), 0))
    return np.concatenate([vectors, rest[:, None]], axis=1) @ projection(vectors.shape[1])


class Cells:
    """The tree's upper levels: median cuts of a sample along its widest axis."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.axis, self.at, self.child = [], [], []
        self.low, self.high = [], []
        self.count = 0
        bound = np.full(DIMS, np.inf)
        self.root = self.grow(points, max(1, leaves), -bound, bound)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def grow(self, points: np.ndarray, leaves: int, low: np.ndarray, high: np.ndarray) -> int:
        if leaves > 1 and len(points) >= 2:
            axis = int(np.ptp(points, axis=0).argmax())
            cut = float(np.median(points[:, axis]))
            left = points[:, axis] <= cut
            if 0 < left.sum() < len(points):
                node = len(self.axis)
                self.axis.append(axis)
                self.at.append(cut)
                self.child.append(None)
                to, fro = high.copy(), low.copy()
                to[axis] = fro[axis] = cut
                self.child[node] = (self.grow(points[left], (leaves + 1) // 2, low, to), self.grow(points[~left], leaves // 2, fro, high))
                return node
        self.low.append(low)
        self.high.append(high)
        self.count += 1
        return -self.count

    def of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        work = [(self.root, np.arange(len(points)))]
        while work:
            node, rows = work.pop()
            if node < 0:
                out[rows] = -node - 1
            elif len(rows):
                left = points[rows, self.axis[node]] <= self.at[node]
                work += [(self.child[node][0], rows[left]), (self.child[node][1], rows[~left])]
        return out

    def distances2(self, points: np.ndarray) -> np.ndarray:
        """Squared distances of points to all cells' boxes."""
        return box_distances2(points, self.low, self.high)


def box_distances2(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        x = points[:, d, None]
        gap = np.maximum(np.maximum(low[None, :, d] - x, x - high[None, :, d]), 0)
        out += gap * gap
    return out


def leaves_of(points: np.ndarray, most: int = LEAF) -> list[np.ndarray]:
    """The lower levels: rows of each leaf."""
    out, work = [], [np.arange(len(points))]
    while work:
        rows = work.pop()
        if len(rows) <= most:
            out.append(rows)
            continue
        axis = int(np.ptp(points[rows], axis=0).argmax())
        order = np.argsort(points[rows, axis], kind="stable")
        work += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return out


def spots_of(queries: np.ndarray) -> np.ndarray:
    """Projections of queries scaled to length 1."""
    unit = queries / np.abs(queries).max(axis=1, keepdims=True)
    unit /= np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None]
    return np.concatenate([unit, np.zeros((len(queries), 1))], axis=1) @ projection(queries.shape[1])


def reach2(queries: np.ndarray, limit: np.ndarray, radius2: float, power: int) -> np.ndarray:
    """The squared projected distance within which a vector of a score over the limit lies with probability CONFIDENCE.

    The squared distance of a score is 2 R^2 - 2 R score / |q|, where the score is that of scaled vectors.
    """
    greatest = np.abs(queries).max(axis=1)
    length = np.sqrt(np.einsum("ij,ij->i", queries / greatest[:, None], queries / greatest[:, None]))
    scaled = np.ldexp(limit / greatest, -power) / length
    return np.maximum(2 * radius2 - 2 * np.sqrt(radius2) * scaled, 0) * chi_square_quantile(CONFIDENCE, DIMS)


def search_block(queries: np.ndarray, limits: np.ndarray, keys: np.ndarray, vectors: np.ndarray, k: int, radius2: float, power: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the rows of up to k best vectors of a block with score >= its limit, and their scores."""
    points = projected(np.ldexp(vectors, -power), radius2)
    spots = spots_of(queries) * np.sqrt(radius2)
    leaves = leaves_of(points)
    gaps = box_distances2(spots, np.array([points[r].min(axis=0) for r in leaves]), np.array([points[r].max(axis=0) for r in leaves]))
    order = np.argsort(gaps, axis=1, kind="stable")
    best_score = np.full((len(queries), k), -np.inf)
    best_row = np.full((len(queries), k), -1)
    limit = limits.copy()
    active = np.ones(len(queries), bool)
    for step in range(len(leaves)):
        now = order[:, step]
        active &= gaps[np.arange(len(queries)), now] <= reach2(queries, limit, radius2, power)
        if not active.any():
            break
        for leaf in np.unique(now[active]):
            who = np.flatnonzero(active & (now == leaf))
            rows = leaves[leaf]
            with np.errstate(over="ignore", invalid="ignore"):
                scores = np.nan_to_num(queries[who] @ vectors[rows].T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
            all_scores = np.concatenate([best_score[who], scores], axis=1)
            all_rows = np.concatenate([best_row[who], np.broadcast_to(rows, scores.shape)], axis=1)
            names = np.where(all_rows >= 0, keys[np.maximum(all_rows, 0)], np.iinfo(np.int64).max)
            top = np.lexsort((names, -all_scores), axis=1)[:, :k] if len(rows) < 4 * k else None
            if top is None:
                some = np.argpartition(-all_scores, k - 1, axis=1)
                edge = np.take_along_axis(all_scores, some[:, k - 1 : k], axis=1)
                # Ties with the k-th are settled by key.
                rank = np.where(all_scores > edge, 0, np.where(all_scores == edge, 1, 2))
                top = np.lexsort((np.where(rank == 1, names, 0), rank), axis=1)[:, :k]
            best_score[who] = np.take_along_axis(all_scores, top, axis=1)
            best_row[who] = np.take_along_axis(all_rows, top, axis=1)
            limit[who] = np.maximum(limit[who], best_score[who].min(axis=1))
    out = []
    for i in range(len(queries)):
        ok = (best_row[i] >= 0) & (best_score[i] >= limits[i])
        out.append((best_row[i][ok], best_score[i][ok]))
    return out


def valid(rows: DataFrame) -> DataFrame:
    """(vec_id, v) of vectors that take part, in double precision."""
    v = F.col("embedding").cast("array<double>")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(fine & F.exists("v", lambda x: x != 0))


def search(rows: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """For each row of (vec_id, embedding) whose id is divisible by `every`: its k nearest others."""
    spark = rows.sparkSession
    folder = shared_dir(spark)
    # Sums in any order give the same groups as the vector itself does.
    w = Window.partitionBy("v").orderBy("vec_id")
    ranked = valid(rows).distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1)
    groups = ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    groups = materialize(groups.select(F.size("v").alias("width"), F.col("ids")[0].alias("key"), "v", "ids"), "groups", folder)
    asked = valid(rows).where(F.col("vec_id") % every == 0).distinct()
    asked = asked.join(groups.select("v", "key"), "v").select(F.col("vec_id").alias("query_id"), "key", F.size("v").alias("width"))
    asked = materialize(asked, "asked", folder)
    greatest = F.aggregate("v", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))
    lengths = groups.groupBy("width").agg(F.count("*").alias("n"), F.max(greatest).alias("greatest")).collect()  # a row for each length
    found = None
    for r in sorted(lengths):
        power = int(np.frexp(r.greatest)[1])
        own = search_width(groups.where(F.col("width") == r.width), asked.where(F.col("width") == r.width), r.width, r.n, power, k, f"{folder}/{r.width}")
        found = own if found is None else found.unionByName(own)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # The same id may stand for several vectors, and a query for one of them.
    pairs = asked.join(found.withColumnRenamed("q", "key"), "key").where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def matrix(array: pa.Array, width: int) -> np.ndarray:
    return np.asarray(array.flatten()).reshape(-1, width).astype(float)


def search_width(groups: DataFrame, asked: DataFrame, width: int, n: int, power: int, k: int, folder: str) -> DataFrame:
    """(q, vec_id, score): for each asked key its k + 1 best ids at least, among vectors of one length."""
    spark = groups.sparkSession

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.ldexp(matrix(batch.column(0), width), -power)
            yield pa.RecordBatch.from_arrays([pa.array(np.einsum("ij,ij->i", v, v))], names=["r2"])

    radius2 = groups.select("v").mapInArrow(squares, "r2 double").agg(F.max("r2")).first()[0]

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = projected(np.ldexp(matrix(batch.column(0), width), -power), radius2)
            yield pa.RecordBatch.from_arrays([pa.array(list(points), pa.list_(pa.float64()))], names=["point"])

    sample = groups.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("v").mapInArrow(drawn, "point array<double>").toArrow()["point"].combine_chunks()
    points = np.asarray(sample.flatten()).reshape(-1, DIMS)
    cells = spark.sparkContext.broadcast(Cells(points, min(max(1, n // CELL), max(1, len(points) // CELL_SAMPLES))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = cells.value.of(projected(np.ldexp(matrix(batch.column(1), width), -power), radius2))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own)], names=["key", "v", "ids", "cell"])

    index = materialize(groups.select("key", "v", "ids").mapInArrow(place, "key long, v array<double>, ids array<long>, cell long"), "index", folder)
    # As many rows as cells: SAMPLE / CELL_SAMPLES at most.
    sizes = F.broadcast(materialize(index.groupBy("cell").agg(F.expr(f"(count(*) + {BLOCK - 1}) div {BLOCK}").alias("salts")), "sizes", folder))
    filled = [r.cell for r in sizes.select("cell").collect()]
    queries = materialize(groups.join(asked.select("key").distinct(), "key", "left_semi").select(F.col("key").alias("q"), F.col("v").alias("qv")), "queries", folder)
    blocks = index.join(sizes, "cell").withColumn("salt", F.pmod(F.xxhash64("key"), F.col("salts"))).drop("salts")

    def visits(rows: DataFrame, first: bool) -> DataFrame:
        """(q, qv, floor, cell): the nearest cell, or all others within reach of the k-th score."""

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            there = np.zeros(cells.value.count, bool)
            there[filled] = True
            for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
                v = matrix(batch.column(1), width)
                gaps = cells.value.distances2(spots_of(v) * np.sqrt(radius2))
                gaps[:, ~there] = np.inf
                home = gaps.argmin(axis=1)
                if first:
                    to, limit = [[int(c)] for c in home], np.full(len(v), -np.inf)
                else:
                    limit = batch.column(2).to_numpy(zero_copy_only=False)
                    near = (gaps <= reach2(v, limit, radius2, power)[:, None]) & there[None, :]
                    near[np.arange(len(v)), home] = False
                    to = [np.flatnonzero(x).tolist() for x in near]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(limit), pa.array(to, pa.list_(pa.int64()))], names=["q", "qv", "floor", "cells"])

        rows = rows.mapInArrow(step, "q long, qv array<double>, floor double, cells array<long>")
        return rows.withColumn("cell", F.explode("cells")).drop("cells")

    def searched(asked_: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"q": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(asked_) or not len(block):
            return empty
        vectors, keys = np.stack(block["v"].to_numpy()), block["key"].to_numpy()
        ids = block["ids"].to_numpy()
        q, out = asked_["q"].to_numpy(), []
        for i, (rows, scores) in enumerate(search_block(np.stack(asked_["qv"].to_numpy()), asked_["floor"].to_numpy(), keys, vectors, k + 1, radius2, power)):
            pairs = sorted((-s, int(x)) for r, s in zip(rows.tolist(), scores.tolist(), strict=True) for x in ids[r])[: k + 1]
            out += [(q[i], x, -s) for s, x in pairs]
        return pd.DataFrame(out, columns=["q", "vec_id", "score"]) if out else empty

    def run(rows: DataFrame, name: str) -> DataFrame:
        rows = materialize(rows, name, folder)
        parts = rows.groupBy("cell").agg(F.expr(f"(count(*) + {QUERY_BLOCK - 1}) div {QUERY_BLOCK}").alias("parts"))
        parts = F.broadcast(materialize(parts, f"{name}_parts", folder))  # a row for each cell, as above
        rows = rows.join(parts, "cell").join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts")))
        rows = rows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
        sent = blocks.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        task = ["cell", "salt", "part"]
        renamed = lambda x, names: x.select(*(F.col(c).alias(c) for c in (*task, *names)))  # noqa: E731  both come from some of the same tables
        found = renamed(rows, ["q", "qv", "floor"]).groupBy(task).cogroup(renamed(sent, ["key", "v", "ids"]).groupBy(task))
        return found.applyInPandas(searched, "q long, vec_id long, score double")

    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    best = lambda found: found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    near = materialize(best(run(visits(queries, True), "visits")), "near", folder)
    kth = near.groupBy("q").agg(F.when(F.count("*") > k, F.min("score")).alias("kth"))
    again = queries.join(kth, "q", "left").select("q", "qv", F.coalesce("kth", F.lit(float("-inf"))).alias("kth"))
    far = run(visits(again, False), "visits_far")
    return best(near.drop("n").unionByName(far).dropDuplicates(["q", "vec_id", "score"])).select("q", "vec_id", "score")
