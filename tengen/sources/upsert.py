"""Stored-table maintenance: latest-per-key merges, replacements, work lists, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import text
from .store import Store, Version

DAY_MS = 86_400_000
NOTICE_TTL_DAYS = 14


def latest_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Last write wins, as an aggregate: partial results combine before the shuffle,
    so one key with very many versions does not land in a single task."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("v")) \
        .select(*keys, "v.*").select(*df.columns)


def latest_events(versions: DataFrame) -> DataFrame:
    """Stored and newly loaded event versions to one row per event."""
    return latest_by_key(versions, ["event_id"],
                         [F.col("updated_at"), F.col("ingest_seq")]).drop("ingest_seq")


def latest_groups(versions: DataFrame) -> DataFrame:
    rows = versions.withColumn("pnumber", F.coalesce(F.col("pnumber"), F.lit(0))) \
        .withColumn("team_type", F.coalesce(F.col("team_type"), F.lit("0"))) \
        .withColumn("group_name", text("group_name"))
    return latest_by_key(rows, ["group_id"], [F.col("updated_at"), F.col("ingest_seq")]).drop("ingest_seq")


def _replace(old: DataFrame, batch: DataFrame, owner: str, keys: list[str], order: list[Column],
             touched: DataFrame | None = None, part: str | None = None) -> DataFrame:
    """Drop every old row of an owner in the batch, add the batch (last duplicate wins).

    part: the column of an owner's parts, by which old rows may be laid out. Owners then meet the parts, and old rows, which
    don't move, are dropped by part; rows without a part meet their owner directly.
    """
    owners = (batch if touched is None else touched).select(owner).distinct()
    new = latest_by_key(batch, keys, order).select(*old.columns)
    if part is None:
        return old.join(owners, owner, "left_anti").unionByName(new)
    gone = old.select(owner, part).distinct().join(owners, owner, "left_semi").repartition(part)
    kept = old.filter(F.col(part).isNotNull()).join(gone, [owner, part], "left_anti")
    loose = old.filter(F.col(part).isNull()).join(owners, owner, "left_anti")
    return kept.unionByName(loose).select(owner, *[c for c in old.columns if c != owner]).unionByName(new)


def replace_participants(old: DataFrame, batch: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """batch carries ingest_seq; events lists re-indexed events that may have no rows left."""
    return _replace(old, batch, "event_id", ["event_id", "group_id", "participant_id"],
                    [F.col("ingest_seq")], events, part="group_id")


def replace_matches(old: DataFrame, batch: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    return _replace(old, batch, "group_id", ["group_id", "bout", "p1_id", "p2_id"],
                    [F.col("ingest_seq")], groups)


def index_status_upsert(participants: DataFrame, failures: DataFrame, at_ms: int) -> DataFrame:
    """Fresh index status: counts for indexed events, the error for failed ones."""
    ok = participants.groupBy("event_id", "group_id").agg(F.count(F.lit(1)).alias("n")) \
        .groupBy("event_id").agg(F.count(F.lit(1)).cast("int").alias("group_count"),
                                 F.sum("n").cast("int").alias("participant_count"))
    bad = failures.select("event_id", text("last_error").alias("last_error"))
    return ok.join(bad, "event_id", "full_outer").select(
        "event_id", F.lit(at_ms).cast("bigint").alias("indexed_at"),
        F.when(F.col("last_error").isNull(), F.col("group_count")).otherwise(0).alias("group_count"),
        F.when(F.col("last_error").isNull(), F.col("participant_count")).otherwise(0).alias("participant_count"),
        text("last_error").alias("last_error"))


def notice_upsert(old: DataFrame, fetched: DataFrame, at_ms: int) -> DataFrame:
    """Fetched notices (event_id, notice_text, last_error); a failure keeps the old text."""
    new = fetched.select("event_id", F.col("notice_text").alias("new_text"), text("last_error").alias("new_error"))
    failed = text("new_error") != ""
    touched = F.col("new_error").isNotNull()
    return old.join(new, "event_id", "full_outer").select(
        "event_id",
        F.when(touched & ~failed, text("new_text")).otherwise(text("notice_text")).alias("notice_text"),
        F.when(touched, F.lit(at_ms).cast("bigint")).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(touched, F.col("new_error")).otherwise(text("last_error")).alias("last_error"))


def rank_size_enrich(candidates: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rank and group size from the index, else from a freshly landed participant list."""
    seen = fresh.groupBy("group_id", "participant_id").agg(F.max("rank").alias("fresh_rank"), F.count(F.lit(1)).alias("n"))
    size = seen.groupBy("group_id").agg(F.sum("n").alias("fresh_size"))
    place = seen.drop("n")
    z = F.lit(0)
    known = F.coalesce(F.nullif(F.col("group_size"), z), F.nullif(F.col("indexed_group_size"), z), z)
    return candidates.join(size, "group_id", "left").join(place, ["group_id", "participant_id"], "left") \
        .withColumn("group_size", F.coalesce(F.nullif(known, z), F.col("fresh_size"), z).cast("int")) \
        .withColumn("rank", F.coalesce(F.nullif(F.col("rank"), z), F.col("fresh_rank"), z).cast("int")) \
        .drop("fresh_size", "fresh_rank", "indexed_group_size")


def notice_freshness(events: DataFrame, notices: DataFrame, as_of_ms: int) -> DataFrame:
    """Whether each event's stored notice may be used or has to be fetched again."""
    n = notices.select("event_id", "updated_at", "last_error")
    fresh = (F.coalesce(F.col("updated_at"), F.lit(0)) > 0) \
        & (F.lit(as_of_ms) - F.col("updated_at") < NOTICE_TTL_DAYS * DAY_MS) & (text("last_error") == "")
    return events.select("event_id").join(n, "event_id", "left").select(
        "event_id", F.coalesce(fresh, F.lit(False)).alias("usable"),
        F.when(F.col("updated_at").isNull(), "missing").when(text("last_error") != "", "failed")
        .when(fresh, "fresh").otherwise("stale").alias("state"))


def match_freshness(wanted: DataFrame, status: DataFrame) -> DataFrame:
    """wanted(group_id, rounds) against stored status: usable or to be fetched."""
    s = status.select("group_id", F.col("rounds").alias("stored_rounds"), "last_error")
    usable = F.col("stored_rounds").isNotNull() & (text("last_error") == "") \
        & (F.col("stored_rounds") >= F.col("rounds"))
    return wanted.select("group_id", "rounds").join(s, "group_id", "left") \
        .select("group_id", "rounds", "stored_rounds", usable.alias("usable"))


def replace_stored(store: Store, table: str, schema: StructType, batch: DataFrame, owner: str, keys: list[str],
                   order: list[Column], buckets: int = 256) -> int:
    """Replace all rows of the owners in `batch` in a stored table; all other rows stay. keys, order: last duplicate wins.

    Only the touched buckets are read and written anew; readers see them from the next version of the store on. If another
    writer changed one of them meanwhile, the replacement is worked out again. Returns the version that holds it.
    """
    def work(base: Version) -> dict:
        touched = store.touched(batch, owner, buckets)
        if not touched:
            return {}
        rows = _replace(store.read(table, schema, base, touched), batch, owner, keys, order)
        return {table: (buckets, store.write(table, rows, owner, buckets, touched))}
    return store.commit(work)
