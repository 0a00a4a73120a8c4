"""Shared parts of the training-data operators: tables, staging, vectorised text helpers, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import unicodedata
import zipfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import discard, stage

__all__ = ["stage", "discard", "table", "ship", "row_totals", "components", "decode", "char_classes", "pieces", "texts_of", "take_columns"]

_shipped: set[str] = set()
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started from (once per application), and send them
    smaller batches than the default: texts are long, and both sides hold a batch whole."""
    if spark.conf.get(BATCH_KEY) == "10000":
        spark.conf.set(BATCH_KEY, "2000")
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), f"{os.path.basename(root)}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def take_columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that further columns of the caller cannot clash with working names."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def row_totals(df: DataFrame, part: str, value: str, out: str) -> DataFrame:
    """Offset of each part: the sum of `value` over all smaller parts. One row per part goes through one task."""
    sums = df.groupBy(part).agg(F.sum(value).alias("_sum"))
    w = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(part, F.coalesce(F.sum("_sum").over(w), F.lit(0)).cast("long").alias(out))


def components(edges: DataFrame, label: str = "links") -> DataFrame:
    """Connected components of `edges` (a, b): rows (node, component), component the smallest node reached.

    Alternating stars: every node hangs its greater neighbours on its smallest neighbour, then its smaller ones,
    until nothing changes. Every round is keyed by node, sums map-side first, and is written to the shared folder.
    """
    def sign(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
              label)
    mark = sign(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = stage(big.where("u <> v").distinct(), label)
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(least, "u")
        small = (small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        small = stage(small, label)
        discard(e, big)
        before, mark = mark, sign(small)  # counts and hash sums of the (distinct) edges: cheaper than comparing them
        if mark == before:
            break
        e = small
    roots = small.select(F.col("v").alias("node")).distinct()
    out = stage(small.select(F.col("u").alias("node"), F.col("v").alias("component"))
                .unionByName(roots.select("node", F.col("node").alias("component"))), label)
    discard(small)
    return out


# ---- vectorised text ----------------------------------------------------------------------------------------

LETTER, NUMBER, OTHER, SPACE, WHITE = range(5)
#: fixed values: the characters that regular expressions count as white space
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of each code point: letter, number, other, the blank, other white space."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[[ord(c) for c in WHITE_SPACE]] = WHITE
    out[32] = SPACE
    return out


def decode(data: bytes) -> np.ndarray:
    """Code points of UTF-8 bytes."""
    return np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches cut to so many rows, which bounds what a Python worker holds at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def trim() -> None:
    """Return freed memory of this worker to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def texts_of(column: pa.Array) -> list[str]:
    """Texts of an Arrow column, null as empty."""
    return [t or "" for t in column.to_pylist()]
