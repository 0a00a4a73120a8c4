"""Session settings and the shared working folder."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_own_dirs: dict[str, str] = {}


def build_session(app_name: str = "tengen", master: str | None = None,
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are tuned for.

    On a cluster the master and the checkpoint folder come from spark-submit;
    shuffle partitions start high there and AQE coalesces them.
    """
    b = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # joins whose runtime partitions are all small skip the sort
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.parquet.filterPushdown", "true")
        .config("spark.sql.parquet.compression.codec", "zstd")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The shared folder for staged tables.

    Taken from spark.checkpoint.dir. Only a local master may fall back to a
    fresh temporary folder: on a cluster executors would not see it.
    """
    shared = spark.conf.get(CHECKPOINT_KEY, None)
    if shared:
        return shared.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors can reach")
    app = sc.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="run-", dir=os.environ.get("TMPDIR", "/tmp"))
    return _own_dirs[app]


def stage(df: DataFrame, label: str, laid_out: tuple[str, int] | None = None) -> DataFrame:
    """Write a result to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and gives the following
    joins real sizes to plan with. laid_out (column, buckets): rows that lie together
    by that column, or as good as, stay so: the table is bucketed by it.
    """
    spark = df.sparkSession
    name = f"{label}-{uuid.uuid4().hex[:12]}"
    path = f"{work_dir(spark)}/{spark.sparkContext.applicationId}/stage/{name}"
    if laid_out:
        column, buckets = laid_out
        table = "stage_" + "".join(c if c.isalnum() else "_" for c in name)
        df.write.mode("errorifexists").bucketBy(buckets, column).option("path", path).option("compression", "zstd") \
            .format("parquet").saveAsTable(table)
        out = spark.table(table)
    else:
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Remove the files of staged results that nothing reads any more; other frames are left alone."""
    found = [(df.sparkSession, path) for df in frames if (path := getattr(df, "__dict__", {}).get("_staged_at"))]
    for spark, path in found:
        remove(spark, path)
    if found:
        let_go(found[0][0])


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def let_go(spark: SparkSession) -> None:
    """Spark removes the shuffle files of finished steps when the driver collects its garbage, which may be long after; so it is
    asked to."""
    gc.collect()
    spark._jvm.System.gc()
