"""Nearest neighbours through a few stable projections and kd-trees.

Vectors are projected on `DIMS` Gaussian directions. The squared projected distance over the squared true distance then
follows a chi-square law with `DIMS` degrees of freedom, so neighbours are met in order of projected distance, verified on the
original vectors, and the search stops once the next projected distance is so large that, with probability `SURE`, no nearer
vector can lie behind it.

The projected space is split by medians of a bounded sample (`SAMPLE` rows) into regions of about `REGION` vectors; all vectors
are indexed, one kd-tree a region. Round one searches the query's own region; its k-th distance gives the radius at which the
stopping test holds, and round two visits only the other regions whose box reaches into that radius.

Equal vectors are one entry with their k + 1 smallest ids, so a vector that a third of all rows share costs one entry.
Vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids; a repeated (id, vector) counts
once. Vectors of different lengths are searched apart. Fewer candidates than k: all of them. Further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table, take_columns

K, EVERY = 10, 100
DIMS, SURE = 8, 0.99
SAMPLE, REGION, BUCKET = 8192, 8192, 48
QUERIES_AT_ONCE = 20_000


def chi_square_bound(p: float, m: int) -> float:
    """Quantile of the chi-square law with an even number of degrees of freedom."""
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def directions(size: int) -> np.ndarray:
    return np.random.default_rng(size).standard_normal((size, DIMS))


class Tree:
    """kd-tree over projected points; yields buckets of row numbers by growing distance to a query."""

    def __init__(self, points: np.ndarray) -> None:
        self.points, self.nodes = points, []
        self.build(np.arange(len(points)))

    def build(self, rows: np.ndarray) -> int:
        here, own = len(self.nodes), self.points[rows]
        low, high = own.min(0), own.max(0)
        self.nodes.append((low, high, rows, None))
        if len(rows) > BUCKET and (high > low).any():
            order = np.argsort(own[:, int(np.argmax(high - low))], kind="stable")
            half = len(rows) // 2
            self.nodes[here] = (low, high, None, (self.build(rows[order[:half]]), self.build(rows[order[half:]])))
        return here

    def far(self, node: int, q: np.ndarray) -> float:
        low, high = self.nodes[node][:2]
        gap = np.maximum(0, np.maximum(low - q, q - high))
        return float(gap @ gap)

    def buckets(self, q: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        heap = [(self.far(0, q), 0)]
        while heap:
            gap, node = heapq.heappop(heap)
            rows, halves = self.nodes[node][2:]
            if halves is None:
                yield gap, rows
            else:
                for child in halves:
                    heapq.heappush(heap, (self.far(child, q), child))


def search(tree: Tree, vectors: np.ndarray, copies: np.ndarray, q: np.ndarray, qp: np.ndarray, k: int, limit: float,
           stop: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and squared distances of the entries found; limit: squared distance known to hold k rows already."""
    found, dist, kth = [], [], limit
    for gap, rows in tree.buckets(qp):
        if gap > kth * stop:
            break
        d = ((vectors[rows] - q) ** 2).sum(1)
        near = d <= kth
        if near.any():
            found.append(rows[near])
            dist.append(d[near])
            all_rows, all_d = np.concatenate(found), np.concatenate(dist)
            order = np.argsort(all_d, kind="stable")
            have = np.cumsum(copies[all_rows[order]])
            at = int(np.searchsorted(have, k))
            if at < len(order):
                kth = min(kth, float(all_d[order[at]]))
                keep = all_d <= kth
                found, dist = [all_rows[keep]], [all_d[keep]]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(found), np.concatenate(dist)


def split_regions(points: np.ndarray, regions: int) -> list[tuple[int, float, int, int]]:
    """Median splits (axis, value, left, right); negative children are regions -1, -2, ..."""
    nodes: list[tuple[int, float, int, int]] = []
    count = 0

    def grow(rows: np.ndarray, parts: int) -> int:
        nonlocal count
        spread = points[rows].max(0) - points[rows].min(0) if len(rows) else np.zeros(DIMS)
        if parts <= 1 or not spread.any():
            count += 1
            return -count
        here, axis = len(nodes), int(np.argmax(spread))
        nodes.append((0, 0.0, 0, 0))
        values = points[rows, axis]
        cut = float(np.quantile(values, (parts // 2) / parts))
        cut = cut if (values > cut).any() else float(values.min())
        left = grow(rows[values <= cut], parts // 2)
        right = grow(rows[values > cut], parts - parts // 2)
        nodes[here] = (axis, cut, left, right)
        return here

    grow(np.arange(len(points)), regions)
    return nodes


def region_of(points: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    at = np.zeros(len(points), np.int64) if nodes else np.full(len(points), -1)
    while (at >= 0).any():
        for n in np.unique(at[at >= 0]).tolist():
            axis, cut, left, right = nodes[n]
            rows = np.flatnonzero(at == n)
            at[rows] = np.where(points[rows, axis] <= cut, left, right)
    return -at - 1


def nearest(vectors: DataFrame, size: int, k: int, every: int) -> DataFrame:
    """Search among the usable rows (vec_id, embedding) of one vector length."""
    spark = vectors.sparkSession
    w = Window.partitionBy("embedding").orderBy("vec_id")
    entries = (vectors.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1)
               .groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
               .withColumn("rep", F.get("ids", F.lit(0))))
    entries = stage(entries, "nn-entries")
    asked = (vectors.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding")
             .join(entries.select("embedding", "rep"), "embedding").select("query_id", "rep"))
    asked = stage(asked, "nn-queries")
    look = directions(size)
    some = entries.select("embedding").orderBy(F.xxhash64("embedding")).limit(SAMPLE).toPandas()
    nodes = split_regions(np.array(some["embedding"].tolist(), float).reshape(-1, size) @ look,
                          -(-entries.count() // REGION))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                p = np.stack(f["embedding"].to_numpy()).astype(float) @ look
                yield f.assign(region=region_of(p, nodes), p=list(p))

    index = stage(entries.mapInPandas(place, "embedding array<float>, ids array<long>, rep long, region long, p array<double>"),
                  "nn-index")
    boxes = index.groupBy("region").agg(*[f(F.get("p", F.lit(i))).alias(f"{n}{i}") for i in range(DIMS)
                                          for n, f in (("lo", F.min), ("hi", F.max))]).toPandas()  # a row a region
    low, high = (boxes[[f"{n}{i}" for i in range(DIMS)]].to_numpy(float) for n in ("lo", "hi"))
    names, stop = boxes["region"].to_numpy(), chi_square_bound(SURE, DIMS)
    parts = max(1, -(-asked.count() // QUERIES_AT_ONCE))
    queries = stage(index.join(asked.select("rep").distinct(), "rep", "left_semi"), "nn-asked")

    def visit(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            v = np.stack(left["embedding"].to_numpy()).astype(float)
            tree = Tree(np.stack(left["p"].to_numpy()))
            ids = left["ids"].to_numpy()
            copies = np.array([len(x) for x in ids])
            for r in right.itertuples():
                rows, d = search(tree, v, copies, np.asarray(r.embedding, float), np.asarray(r.p), k + 1, r.radius, stop)
                order = np.argsort(d, kind="stable")
                rows, d = rows[order], d[order]
                out += [(r.rep, int(x), float(math.sqrt(e))) for row, e in zip(rows, d, strict=True) for x in ids[row]]
        return pd.DataFrame(out, columns=["rep", "vec_id", "score"])

    part = F.pmod(F.xxhash64("rep"), F.lit(parts)).cast("int").alias("part")
    spread = index.select("region", "embedding", "ids", "p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def round_(asks: DataFrame) -> DataFrame:
        found = (spread.groupBy("region", "part").cogroup(asks.groupBy("region", "part"))
                 .applyInPandas(visit, "rep long, vec_id long, score double"))
        w = Window.partitionBy("rep").orderBy("score", "vec_id")
        return stage(found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1).drop("n"), "nn-found")

    own = round_(queries.select("region", "rep", "embedding", "p", part, F.lit(float("inf")).alias("radius")))
    reach = own.groupBy("rep").agg(F.when(F.count("*") > k, F.max("score")).otherwise(F.lit(float("inf"))).alias("kth"))

    def others(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                q = np.asarray(r.p)
                gap = (np.maximum(0, np.maximum(low - q, q - high)) ** 2).sum(1)
                go = names[(gap <= r.kth * r.kth * stop * (1 + 1e-9)) & (names != r.region)]
                if len(go):
                    yield pd.DataFrame({"region": go, "rep": r.rep, "embedding": [r.embedding] * len(go),
                                        "p": [r.p] * len(go), "radius": r.kth * r.kth * (1 + 1e-9)})

    asks = (queries.select("region", "rep", "embedding", "p").join(reach, "rep")
            .mapInPandas(others, "region long, rep long, embedding array<float>, p array<double>, radius double"))
    far = round_(asks.select("region", "rep", "embedding", "p", part, "radius"))
    ranked = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (asked.join(own.unionByName(far), "rep").where("vec_id <> query_id")
            .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def neighbours(rows: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose vec_id is divisible by `every`."""
    usable = (take_columns(rows, "vec_id", "embedding").where("vec_id is not null and embedding is not null")
              .where("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
              .where("exists(embedding, x -> x <> 0)").withColumn("embedding", F.col("embedding").cast("array<float>"))
              .distinct())
    usable = stage(usable, "nn-rows")
    sizes = [r[0] for r in usable.select(F.size("embedding")).distinct().collect()]  # a row a vector length
    out = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for size in sizes:
        out = out.unionByName(nearest(usable.where(F.size("embedding") == size), size, k, every))
    return out


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))
