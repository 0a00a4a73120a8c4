"""Token ids in ORC files: integer run-length encoded, with row indexes and Bloom filters on document ids.

Documents are dealt by ranges of doc_id, so every file holds one ascending range and the stripe and row-group statistics on
doc_id prune whole files, stripes and groups of rows; the Bloom filter answers point reads. Each row carries its ids and
its place within the file; the totals of the files (one row a file) turn that into a place in the whole stream.

Null text is encoded as empty (only the end id is written); null doc_ids come first; rows with equal doc_ids keep one row
each, in file order; further columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_dir
from .common import row_totals, table, take_columns, texts_of
from .subwords import encoder

VOCABULARY, END = "word_bpe_49k.json", 1
STRIPE_BYTES, ROW_GROUP = 16 << 20, 1000
ROWS_PER_BATCH = 1000


def write_ids(docs: DataFrame, path: str, vocabulary: str | None = None, end: int = END,
              files: int | None = None) -> None:
    """Write (doc_id, file_no, at, ids) as ORC. at: ids before this row in its file."""
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, at, file_no = encoder(vocabulary), 0, TaskContext.get().partitionId()
        tail = np.array([end], np.uint32).tobytes()
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS_PER_BATCH):
                batch = whole.slice(lo, ROWS_PER_BATCH)
                ids = [np.frombuffer(x + tail, np.int32) for x in tool.ids(texts_of(batch.column(1)))]
                ends = np.cumsum([len(x) for x in ids])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)),
                                                 pa.array(np.concatenate(ids)))
                starts = at + np.concatenate([[0], ends[:-1]])
                at += int(ends[-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(len(ids), file_no, np.int32)), pa.array(starts, pa.int64()),
                     lists], names=["doc_id", "file_no", "at", "ids"])

    rows = take_columns(docs, "doc_id", "text").repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id")
    (rows.mapInArrow(run, "doc_id long, file_no int, at long, ids array<int>").write.mode("overwrite")
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .option("orc.create.index", "true").option("orc.row.index.stride", str(ROW_GROUP))
     .option("orc.stripe.size", str(STRIPE_BYTES)).option("compression", "zstd").orc(path))


def read_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows of the files; with doc_ids, only theirs (pruned by statistics and Bloom filters)."""
    rows = spark.read.schema("doc_id long, file_no int, at long, ids array<int>").orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of stored rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            values, ends = ids.values.to_numpy(zero_copy_only=False).astype(np.uint32), ids.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(ends), pa.int64()),
                 pa.array(crc, pa.int64())], names=["doc_id", "file_no", "at", "n_tokens", "ids_crc32"])

    out = rows.mapInArrow(run, "doc_id long, file_no int, at long, n_tokens long, ids_crc32 long")
    # the size of a list is read from its lengths alone
    offsets = row_totals(rows.select("file_no", F.size("ids").cast("long").alias("n")), "file_no", "n", "before")
    return out.join(offsets, "file_no").select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op10_orc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{work_dir(spark)}/{spark.sparkContext.applicationId}/orc_ids/{uuid.uuid4().hex[:12]}"
    write_ids(table(spark, sf_dir, "documents"), path)
    return digest(read_ids(spark, path))
