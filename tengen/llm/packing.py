"""Packing by non-negative least squares over shallow length combinations.

Every document is cut into whole windows and one remainder shorter than the window. Combinations of two or three
remainder lengths that fill the window exactly are the columns of a least-squares problem against the histogram of
remainders; its non-negative solution, rounded, says how often each combination is used. Remainders left over by rounding
are laid end to end, longest first, and cut at window borders, so only the last sequence of all is padded.

The histogram and the combinations are bounded by the window, not by the data. A remainder finds its slot by its rank
among equal lengths, counted per (length, part of the table), so that a length shared by a third of all rows is ranked by
many tasks; leftovers find their place by arithmetic on that rank.

Null text counts as empty (one end id); repeated rows are packed each on their own; further columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import row_totals, stage, table, take_columns, texts_of, trim
from .subwords import encoder

VOCABULARY, END, WINDOW = "byte_bpe_50k.json", 0, 1024
ROWS_PER_BATCH = 1000
STEPS = 400
PIECES = 700_000  # kept by a worker's encoder here


def combinations(lengths: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Sums of two or three of the given lengths that fill the window."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    out = []
    for a in sorted(lengths.tolist()):
        if 2 * a <= window and have[window - a]:
            out.append((a, window - a))
        b = np.arange(a, (window - a) // 2 + 1)
        b = b[have[b]]
        b = b[(window - a - b >= b) & have[window - a - b]]
        out += [(a, x, window - a - x) for x in b.tolist()]
    return out


def solve_counts(histogram: np.ndarray, columns: list[tuple[int, ...]], steps: int = STEPS) -> np.ndarray:
    """Non-negative x that minimises |A x - histogram|, by accelerated projected gradient steps."""
    rows = np.concatenate([np.array(c) for c in columns])
    cols = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    size, n = len(histogram), len(columns)
    forward = lambda x: np.bincount(rows, x[cols], size)
    back = lambda r: np.bincount(cols, r[rows], n)
    v = np.ones(n)
    for _ in range(20):  # largest eigenvalue, for the step
        v = back(forward(v))
        bound = float(np.linalg.norm(v))
        v /= bound
    x, y, t = np.zeros(n), np.zeros(n), 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(forward(y) - histogram) / (1.05 * bound))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def plan(histogram: np.ndarray, window: int) -> tuple[list[tuple[int, int, int, int, int]], int, dict[int, tuple[int, int]]]:
    """Slots (length, first rank, behind last rank, first sequence, offset), sequences used, and for each length with
    leftovers (first rank left, start in the leftover stream)."""
    left = histogram.astype(np.int64).copy()
    taken = np.zeros_like(left)
    slots, sequence = [], 0
    columns = combinations(np.flatnonzero(left), window)
    if columns:
        x = solve_counts(histogram.astype(float), columns)
        for k in np.argsort(-x, kind="stable").tolist():
            if x[k] < 0.5:
                break
            use = np.bincount(columns[k], minlength=len(left))
            need = np.flatnonzero(use)
            times = min(int(x[k] + 0.5), int((left[need] // use[need]).min()))
            if times <= 0:
                continue
            offset = 0
            for length in columns[k]:
                slots.append((length, int(taken[length]), int(taken[length]) + times, sequence, offset))
                taken[length] += times
                left[length] -= times
                offset += length
            sequence += times
    stream, rest = 0, {}
    for length in np.flatnonzero(left)[::-1].tolist():
        rest[length] = (int(taken[length]), stream)
        stream += length * int(left[length])
    return slots, sequence, rest


def tokenised(docs: DataFrame, path: str, window: int, end: int, kept: int = PIECES) -> DataFrame:
    """row, part, doc_id, doc_tokens, crcs of the whole windows, ids of the remainder."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, tail, step = encoder(path), np.array([end], np.uint32).tobytes(), 4 * window
        tool.limit = kept
        trim()
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS_PER_BATCH):
                batch = whole.slice(lo, ROWS_PER_BATCH)
                data = [x + tail for x in tool.ids(texts_of(batch.column(1)))]
                crcs = [[zlib.crc32(x[a:a + step]) for a in range(0, len(x) - step + 1, step)] for x in data]
                rests = [x[len(x) // step * step:] for x in data]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(x) // 4 for x in data], pa.int64()),
                     pa.array(crcs, pa.list_(pa.int64())), pa.array(rests, pa.binary())],
                    names=["doc_id", "doc_tokens", "crcs", "rest"])

    rows = take_columns(docs, "doc_id", "text").mapInArrow(
        run, "doc_id long, doc_tokens long, crcs array<long>, rest binary")
    return stage(rows.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()),
                 "pack")


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None, end: int = END, kept: int = PIECES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. kept: pieces of text whose ids a
    worker keeps (memory only)."""
    spark = docs.sparkSession
    rows = tokenised(docs, vocabulary or public_tokenizers.path(VOCABULARY), window, end, kept)
    head = rows.select("part", "row", "doc_id", "doc_tokens", (F.col("doc_tokens") % window).cast("int").alias("rem"),
                       (F.col("doc_tokens") / window).cast("long").alias("full"))

    counts = head.groupBy("rem").count().collect()  # at most one row for each length below the window
    histogram = np.zeros(window, np.int64)
    for r in counts:
        histogram[r["rem"]] = r["count"]
    histogram[0] = 0
    slots, used, rest = plan(histogram, window)

    # whole windows: one sequence each, numbered through
    before = row_totals(head, "part", "full", "before")
    local = F.sum("full").over(Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    numbered = (head.select("part", "row", "full").withColumn("in_part", F.coalesce(local, F.lit(0)))
                .join(before, "part").select("row", (F.col("before") + F.col("in_part")).alias("first")))
    total = head.agg(F.sum("full")).first()[0] or 0
    wholes = (rows.where("size(crcs) > 0").select("row", "doc_id", "doc_tokens", F.posexplode("crcs").alias("k", "ids_crc32"))
              .join(numbered, "row")
              .select("doc_id", (F.col("k") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"),
                      "ids_crc32", "doc_tokens", (F.col("first") + F.col("k")).alias("sequence_id"),
                      F.lit(0).cast("long").alias("offset")))

    # remainders: rank among equal lengths = rows in smaller parts + rank in the own part
    some = head.where("rem > 0").withColumn("cell", F.col("rem").cast("long") * (1 << 32) + F.col("part"))
    cells = some.groupBy("rem", "part", "cell").count()
    w = Window.partitionBy("rem").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("cell", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("ahead"))
    ranked = (some.withColumn("r", F.row_number().over(Window.partitionBy("rem", "part").orderBy("row")) - 1)
              .join(cells, "cell").select("row", "rem", (F.col("ahead") + F.col("r")).alias("rank")))
    slot_rows = spark.createDataFrame(slots or [(0, 0, 0, 0, 0)], "rem int, lo long, hi long, seq long, off long")
    left_rows = spark.createDataFrame([(k, *v) for k, v in rest.items()] or [(0, 0, 0)],
                                      "rem int, from_rank long, stream long")
    fitted = (ranked.join(F.broadcast(slot_rows), "rem").where("rank >= lo and rank < hi")
              .select("row", F.lit(0).alias("cut_at"), F.col("rem").alias("n"),
                      (F.col("seq") + F.col("rank") - F.col("lo") + total).alias("sequence_id"),
                      F.col("off").alias("offset")))
    over = (ranked.join(F.broadcast(left_rows), "rem").where("rank >= from_rank")
            .withColumn("at", F.col("stream") + (F.col("rank") - F.col("from_rank")) * F.col("rem"))
            .withColumn("room", F.lit(window) - F.col("at") % window))
    cut = over.select("row", "at", F.explode(F.expr(
        "filter(array(struct(0 as cut_at, least(rem, room) as n), struct(room as cut_at, rem - room as n)), x -> x.n > 0)"
    )).alias("p")).select(
        "row", F.col("p.cut_at").cast("int").alias("cut_at"), F.col("p.n").cast("int").alias("n"),
        ((F.col("at") + F.col("p.cut_at")) / window).cast("long").alias("k"),
        ((F.col("at") + F.col("p.cut_at")) % window).alias("offset"))
    cut = cut.select("row", "cut_at", "n", (F.col("k") + total + used).alias("sequence_id"), "offset")
    pieces = (fitted.unionByName(cut).join(rows.select("row", "doc_id", "doc_tokens", "rest"), "row")
              .select("doc_id", ((F.col("doc_tokens") / window).cast("long") * window + F.col("cut_at")).alias("start"),
                      F.col("n").cast("long").alias("length"),
                      F.crc32(F.expr("substring(rest, 4 * cut_at + 1, 4 * n)")).alias("ids_crc32"),
                      "doc_tokens", "sequence_id", F.col("offset").cast("long").alias("offset")))
    return wholes.unionByName(pieces)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
