"""A corpus pipeline: language ID, near duplicates, decontamination, secret scan, packing.

Every stage works on all rows its predecessor kept, is written as Parquet to the shared folder and read back for the
next one. All but the last return the columns of `documents`:

* language_id: documents in no language the model is sure of go;
* near_duplicates: of each group of linked documents (word shingles of five, Jaccard 0.8 at least) the one with the smallest id stays, one row of it; documents without
  words link with nothing and stay; a null doc_id stays; rows that share an id but not their text are documents of their own;
* decontamination: documents that hold a benchmark item go;
* secret_scan: every document stays, secrets in its text are masked and n_chars follows;
* packing: one row for each piece of a packed sequence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tengen.llm import decontam, language, near_join, packing, secrets
from tengen.llm.common import ship, stage, table

WORDS, PERCENT = 5, 80  # near duplicates of the stage; op4 has limits of its own
KEPT_PIECES = 300_000  # encoded pieces a worker keeps beside what the other stages leave in it
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL expresses neither the models nor the tokenizer; the stages are tested against brute-force versions
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return language.accepted(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    copies = stage(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "pipeline-copies")
    # rows that share their id are told apart by their text; repeated ids are rare
    some = docs.join(copies, "doc_id", "left_semi").withColumn("_row", F.xxhash64("doc_id", "text"))
    alone = docs.where("doc_id is not null").join(copies, "doc_id", "left_anti").withColumn("_row", F.col("doc_id"))
    rows = alone.unionByName(some)
    found = near_join.near_components(rows.select(F.col("_row").alias("doc_id"), "text"), WORDS, PERCENT)
    found = found.select(F.col("doc_id").alias("_row"), "component_id").distinct()
    named = found.join(some.select("_row", "doc_id").distinct(), "_row", "left").withColumn("doc_id", F.coalesce("doc_id", "_row"))
    keep = stage(named.groupBy("component_id").agg(F.min_by("_row", F.struct("doc_id", "_row")).alias("_row")).select("_row"), "pipeline-keep")
    one = some.join(keep, "_row", "left_semi").groupBy("_row", "doc_id", "text").agg(
        F.min(F.struct("lang", "source", "n_chars")).alias("d")).select("doc_id", "text", "d.*")
    return (alone.join(keep, "_row", "left_semi").select(*COLUMNS).unionByName(one.select(*COLUMNS))
            .unionByName(docs.where("doc_id is null")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    masked = secrets.redact(docs.withColumn("_old", F.col("text")))
    changed = ~F.col("text").eqNullSafe(F.col("_old"))
    return masked.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
                             ).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs.select(*COLUMNS), kept=KEPT_PIECES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("secret_scan", secret_scan), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
