"""Exact top-k inner products through an impact-ordered index read score at a time.

Vectors become integer vectors; equal ones are one entry with its k + 1 smallest ids, so a vector that a third of all rows
share costs one entry. Entries lie in blocks of `BLOCK`. In a block, every (component, sign) has posting segments: the entries
whose magnitude falls in one quantised impact level. Levels shrink by `RATIO` from the block's largest magnitude down to 1.

A batch of queries reads the segments of all components by descending impact and adds weight times impact to its
accumulators. What an entry's vector keeps outside of the levels read so far has a known length r, so its score lies within
|query| * r of the accumulator (Cauchy-Schwarz). A query's threshold is a k-th best score already reached: at first over a
bounded sample of vectors, then over the blocks read. Reading stops only when nearly all entries are proven to lie below the
threshold; all others are scored again in exact integers. Rounding of the accumulators is part of r.

Blocks are dealt to shards and queries to parts; one task holds one shard and one part, and returns k + 1 rows a query.

Vectors that are null or hold null or non-finite components take no part, nor do null ids; components beyond 2^28 count as
2^28. A repeated (id, vector) counts once; an id with several vectors asks once with each of them. Vectors of different
lengths are searched apart. Fewer candidates than k: all of them. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table, take_columns

K, EVERY, SCALE = 20, 20, 64
LIMIT = float(1 << 28)
BLOCK, BATCH, RATIO = 4096, 256, 0.85
SHARD, PART = 65_536, 16_384  # entries of a shard and queries of a part at most (about)
SAMPLE = 4096  # vectors that give the first thresholds; any sample gives the same result
CHECK_FROM, FEW = 0.5, 0.02  # share of the postings read before the first proof; share of pairs worth scoring again
PAIRS = 50_000  # pairs scored again at once
SALTS = 16


def integers(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id and floor(scale * component) as little-endian 32-bit integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]].astype(np.float64)
            with np.errstate(over="ignore"):
                data = np.clip(np.floor(scale * values), -LIMIT, LIMIT).astype("<i4").tobytes()
            at = (ends - ends[0]) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())],
                names=["vec_id", "x"])

    usable = (take_columns(rows, "vec_id", "embedding").where("vec_id is not null and embedding is not null")
              .where("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"))
    return usable.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(
        run, "vec_id long, x binary")


def entries_of(rows: DataFrame, keep: int) -> DataFrame:
    """Distinct vectors: no, x, ids (the `keep` smallest). Ids are cut within salted parts of a vector first."""
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))
    for by in (["x", "salt"], ["x"]):
        w = Window.partitionBy(*by).orderBy("vec_id")
        rows = rows.withColumn("salt", salt).withColumn("n", F.row_number().over(w)).where(F.col("n") <= keep).drop("n")
    return (rows.groupBy("x").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
            .select(F.monotonically_increasing_id().alias("no"), "x", "ids"))


def matrix(values: list[bytes], size: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<i4").reshape(len(values), size)


class Block:
    """Posting segments of some entries by descending quantised impact, and what lies outside of the levels read."""

    def __init__(self, x: np.ndarray, ids: list[np.ndarray]) -> None:
        self.x = x
        self.copies = np.array([len(i) for i in ids], np.int64)
        self.ids, self.first = np.concatenate(ids), np.cumsum(self.copies) - self.copies
        size, top = np.abs(x), int(np.abs(x).max(initial=0))
        edges = [top + 1]
        while edges[-1] > 1:
            edges.append(max(1, min(edges[-1] - 1, int(edges[-1] * RATIO))))
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        slack = norm * (x.shape[1] + 8) * 1.2e-7
        rest = x.astype(np.float64)
        self.levels: list[tuple[list[tuple[int, float, np.ndarray]], float, np.ndarray]] = []
        posted, total = 0, max(1, int((x != 0).sum()))
        for high, low in zip(edges, edges[1:]):
            impact, segments = (low + high - 1) / 2, []
            for j in range(x.shape[1]):
                here = (size[:, j] >= low) & (size[:, j] < high)
                for sign in (1, -1):
                    rows = np.flatnonzero(here & (x[:, j] * sign > 0))
                    if len(rows):
                        segments.append((j, sign * impact, rows))
                        rest[rows, j] -= sign * impact
                        posted += len(rows)
            outside = (np.sqrt((rest ** 2).sum(1)) * (1 + 1e-9) + slack).astype(np.float64)
            self.levels.append((segments, posted / total, outside))

    def possible(self, queries: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (entry, query) that are not proven to lie below the query's threshold."""
        weights = np.ascontiguousarray(queries.T, np.float32)
        length = np.sqrt((queries.astype(np.float64) ** 2).sum(1))
        sums = np.zeros((len(self.x), len(queries)), np.float32)
        maybe = np.ones(sums.shape, bool)
        for segments, share, outside in self.levels:
            for j, impact, rows in segments:
                sums[rows] += weights[j] * np.float32(impact)
            if share >= CHECK_FROM:
                maybe = sums + outside[:, None] * length >= least
                if maybe.mean() <= FEW:
                    break
        return np.nonzero(maybe)

    def best(self, queries: np.ndarray, least: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the best `keep` ids of every query here with at least its threshold, best first."""
        entry, query = self.possible(queries, least)
        score = np.empty(len(entry), np.int64)
        for lo in range(0, len(entry), PAIRS):
            part = slice(lo, lo + PAIRS)
            score[part] = (self.x[entry[part]].astype(np.int64) * queries[query[part]]).sum(1)
        good = score >= least[query]
        entry, query, score = entry[good], query[good], score[good]
        n = self.copies[entry]
        at = np.repeat(self.first[entry] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return top(np.repeat(query, n), self.ids[at], np.repeat(score, n), keep)


def top(query: np.ndarray, ids: np.ndarray, score: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return query[place < keep], ids[place < keep], score[place < keep]


def search(size: int, keep: int):
    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            blocks = [Block(matrix(list(b["x"]), size), [np.asarray(i, np.int64) for i in b["ids"]])
                      for b in (left[at:at + BLOCK] for at in range(0, len(left), BLOCK))]
            for lo in range(0, len(right), BATCH):
                asks = right[lo:lo + BATCH]
                x, least = matrix(list(asks["x"]), size), asks["least"].to_numpy(np.float64).copy()
                found = [np.zeros(0, np.int64)] * 3
                for block in blocks:
                    found = top(*(np.concatenate(p) for p in zip(found, block.best(x, least, keep), strict=True)), keep)
                    query, count = np.unique(found[0], return_counts=True)
                    last = np.cumsum(count) - 1
                    full = count == keep
                    least[query[full]] = np.maximum(least[query[full]], found[2][last[full]])
                out.append(pd.DataFrame({"no": asks["no"].to_numpy()[found[0]], "vec_id": found[1], "score": found[2]}))
        return pd.concat(out) if out else pd.DataFrame({"no": [], "vec_id": [], "score": []}).astype("int64")
    return cell


def thresholds(asked: DataFrame, sample: list, size: int, keep: int) -> DataFrame:
    """Adds `least`: the score of a query's `keep`-th best id in the sample, -infinity if the sample is smaller."""
    x = matrix([bytes(r["x"]) for r in sample], size).astype(np.float64)
    copies = np.array([len(r["ids"]) for r in sample], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH):
                batch = whole.slice(lo, BATCH)
                scores = matrix(batch.column(1).to_pylist(), size).astype(np.float64) @ x.T
                order = np.argsort(-scores, axis=1)
                reached = np.cumsum(copies[order], axis=1)
                at = (reached < keep).sum(1)
                enough = at < len(copies)
                picked = order[np.arange(len(at)), np.where(enough, at, 0)]
                # rounding of large products can only lower the threshold
                value = scores[np.arange(len(at)), picked]
                value -= np.abs(value) * 1e-9
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(np.where(enough, value, -np.inf))], names=["no", "x", "least"])

    return asked.mapInArrow(run, "no long, x binary, least double")


def search_entries(entries: DataFrame, asked: DataFrame, size: int, keep: int) -> DataFrame:
    """no, vec_id, score: the best `keep` ids of every asked entry, its own ids included. All vectors have `size` components."""
    spark = entries.sparkSession
    sample = entries.select("x", "ids").orderBy(F.xxhash64("no")).limit(SAMPLE).collect()
    rows, tasks = entries.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(-(-rows // SHARD), min(tasks, -(-rows // BLOCK)), 1)
    parts = max(1, -(-asked.count() // PART))
    queries = stage(thresholds(asked.select("no", "x"), sample, size, keep), "topk-queries")
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = entries.select("x", "ids", F.pmod(F.xxhash64("no"), F.lit(shards)).cast("int").alias("shard"), number(parts).alias("part"))
    right = queries.select("no", "x", "least", F.pmod(F.xxhash64("no"), F.lit(parts)).cast("int").alias("part"),
                           number(shards).alias("shard"))
    found = (left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part"))
             .applyInPandas(search(size, keep), "no long, vec_id long, score long"))
    w = Window.partitionBy("no").orderBy(F.desc("score"), "vec_id")
    return stage(found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= keep).drop("n"), "topk-found")


def top_inner_products(rows: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products for each row whose vec_id is divisible by `every`."""
    usable = stage(integers(rows, scale).distinct(), "topk-rows")
    entries = stage(entries_of(usable, k + 1), "topk-entries")
    asked = stage(usable.where(F.col("vec_id") % every == 0).join(entries.select("no", "x"), "x")
                  .select(F.col("vec_id").alias("query_id"), "no"), "topk-asked")
    wanted = stage(entries.join(asked.select("no").distinct(), "no", "left_semi").select("no", "x"), "topk-wanted")
    ranked = Window.partitionBy("query_id", "no").orderBy(F.desc("score"), "vec_id")
    out = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for (size,) in entries.select(F.octet_length("x")).distinct().collect():  # a row a vector length
        one = F.octet_length("x") == size
        found = search_entries(entries.where(one), wanted.where(one), size // 4, k + 1)
        out = out.unionByName(asked.join(found, "no").where("vec_id <> query_id")
                              .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
                              .select("query_id", "rank", "vec_id", "score"))
    return out


def op13_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
