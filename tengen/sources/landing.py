"""Folders of landed response bodies, as a table and as a stream.

`<root>/kind=<kind>/day=<yyyy-mm-dd>/<name>.json` holds one response; `<name>.failed` holds the error of a request that failed. The
name is the request's key: its parts joined by '-', e.g. an event, a group and a chunk. Conditions on kind and day read their
folders only; a body is read whole and as it is, so an unreadable one is a row with a status and not a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

COLUMNS = "value string, kind string, day string"


def _rows(raw: DataFrame) -> DataFrame:
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    key = F.url_decode(F.regexp_replace(name, r"\.(json|failed)$", ""))
    failed = name.endswith(".failed")
    return raw.select("kind", "day", key.alias("key"), F.when(failed, F.col("value")).otherwise("").alias("fetch_error"),
                      F.when(failed, "").otherwise(F.col("value")).alias("payload"),
                      F.col("_metadata.file_modification_time").alias("landed_at"))


def payloads(spark: SparkSession, root: str) -> DataFrame:
    """kind, day, key, fetch_error, payload, landed_at of every landed response."""
    return _rows(spark.read.schema(StructType.fromDDL(COLUMNS)).option("basePath", root).text(root, wholetext=True))


def payload_stream(spark: SparkSession, root: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same rows as they land; the query's checkpoint knows which files it has read."""
    reader = spark.readStream.schema(StructType.fromDDL(COLUMNS)).option("basePath", root)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return _rows(reader.text(root, wholetext=True))


def key_part(key: str, at: int):
    """A part of the request's key, from 0; null where there is none."""
    return F.get(F.split(key, "-"), F.lit(at))
