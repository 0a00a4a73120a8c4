"""Landed payloads to table rows: JSON(P) envelopes, defaults, alternates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import float_or_zero, int_or_zero, parse_int
from ..functions.text import WS, first_text, text, trim_ws

_EVENT_ROW = "struct<event_id:string,title:string,min_time:string,max_time:string,provincename:string," \
             "city_name:string,cname:string,play_num:string>"
_PLAYER_ROW = "struct<participantid:string,id:string,pid:string,participantname:string,name:string," \
              "teamname:string,othername:string,short:string,vicsum:string,faisum:string," \
              "deusum:string,integral:string,compositor:string>"
_GAME_ROW = "struct<seatnum:string,p1id:string,p2id:string,p1:string,p2:string,p1_teamname:string," \
            "p2_teamname:string,p1_result:string,p2_result:string,p1_score:string,p2_score:string>"


def jsonp_body(payload) -> Column:
    """The JSON text inside cb( … ); — a bare ')' at the end is dropped too."""
    t = trim_ws(payload)
    t = F.regexp_replace(t, r"\A[^(]+\(", "")
    t = F.regexp_replace(t, rf"\);{WS}*\z", "")
    return F.regexp_replace(t, rf"\){WS}*\z", "")


def with_envelope(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Add status (ready, wait, error), msg and the raw data part of each payload."""
    env = F.from_json(jsonp_body(payload), "error int, msg string, datArr string")
    df = df.withColumn("_env", env)
    data = F.col("_env.datArr")
    status = F.when(data == "wait", "wait") \
        .when(F.col("_env.error").isNull() | (F.col("_env.error") != 0), "error").otherwise("ready")
    return df.withColumn("status", status) \
        .withColumn("msg", F.when(status == "error", first_text(F.col("_env.msg"), F.lit("API error"))).otherwise("")) \
        .withColumn("data", F.when(status == "ready", data)).drop("_env", payload)


def _rows(df: DataFrame, row_type: str, *keep: str) -> DataFrame:
    """Rows of all ready payloads. One parse: a 'wait' text in place of the data reads as null.

    explode_outer keeps the optimizer from adding a filter that parses a second time;
    empty payloads fall away with the rows that lack an id.
    """
    env = F.from_json(jsonp_body("payload"), f"error int, datArr struct<rows:array<{row_type}>>")
    return df.select(*keep, env.alias("env")) \
        .select(*keep, F.explode_outer(F.when(F.col("env.error") == 0, F.col("env.datArr.rows"))).alias("r"))


def jsonp_rows(df: DataFrame) -> DataFrame:
    """One row per payload: its state and how many rows it carries."""
    n = F.from_json("data", "struct<rows:array<string>>")["rows"]
    return with_envelope(df).withColumn(
        "row_count", F.when(F.col("data").isNull() | n.isNull(), 0).otherwise(F.size(n))).drop("data")


def norm_events(pages: DataFrame, loaded_at_ms: int) -> DataFrame:
    """Event-list pages to event rows."""
    body = F.from_json("payload", f"struct<datArr:struct<rows:array<{_EVENT_ROW}>>>")
    whole = F.col("payload").isNotNull() & F.expr("try_parse_json(payload) is not null")
    r = pages.filter((F.col("fetch_error") == "") & whole).select(F.explode(body["datArr"]["rows"]).alias("r"))
    return r.select(
        text("r.event_id").alias("event_id"), text("r.title").alias("title"),
        text("r.min_time").alias("min_time"), text("r.provincename").alias("provincename"),
        text("r.city_name").alias("city_name"), text("r.cname").alias("cname"),
        int_or_zero("r.play_num").alias("play_num"), F.lit(loaded_at_ms).cast("bigint").alias("updated_at"))


def norm_participants(payloads: DataFrame) -> DataFrame:
    """Participant payloads (event_id, group_id, payload) to rows; rows without id or name drop out."""
    return _rows(payloads, _PLAYER_ROW, "event_id", "group_id").select(
        "event_id", "group_id",
        first_text("r.participantid", "r.id", "r.pid").alias("participant_id"),
        first_text("r.participantname", "r.name").alias("participant_name"),
        first_text("r.teamname", "r.othername").alias("org"), text("r.short").alias("short_no"),
        int_or_zero("r.vicsum").alias("win"), int_or_zero("r.faisum").alias("lose"),
        int_or_zero("r.deusum").alias("draw"), text("r.integral").alias("score"),
        float_or_zero("r.integral").alias("score_value"), int_or_zero("r.compositor").alias("rank"),
    ).filter((F.col("participant_id") != "") & (F.col("participant_name") != ""))


def norm_matches(payloads: DataFrame) -> DataFrame:
    """Round payloads (group_id, bout, payload) to games; a missing side drops the row."""
    return _rows(payloads, _GAME_ROW, "group_id", "bout").select(
        "group_id", "bout", int_or_zero("r.seatnum").alias("seat"),
        text("r.p1id").alias("p1_id"), text("r.p2id").alias("p2_id"),
        text("r.p1").alias("p1_name"), text("r.p2").alias("p2_name"),
        text("r.p1_teamname").alias("p1_org"), text("r.p2_teamname").alias("p2_org"),
        text("r.p1_result").alias("p1_result"), text("r.p2_result").alias("p2_result"),
        float_or_zero("r.p1_score").alias("p1_score"), float_or_zero("r.p2_score").alias("p2_score"),
    ).filter((F.col("p1_id") != "") & (F.col("p2_id") != ""))


def announced_rounds(payloads: DataFrame) -> DataFrame:
    """Rounds of a group by its first round's payloads: group_id, total_rounds, inferred.

    Where none is announced, the number of players on the first round's list decides: 5 up to 8 players, 7 up to 32, else 9.
    """
    env = F.from_json(jsonp_body("payload"), "datArr struct<total_bout:string,rows:array<string>>")
    first = payloads.filter(F.col("bout") == 1).select("group_id", env["datArr"].alias("d"))
    players = 2 * F.sum(F.coalesce(F.array_size("d.rows"), F.lit(0)))
    told = F.max(parse_int("d.total_bout"))
    return first.groupBy("group_id").agg(told.alias("told"), players.alias("players")).select(
        "group_id", F.when(F.col("told") > 0, F.col("told")).when(F.col("players") <= 8, 5).when(F.col("players") <= 32, 7).otherwise(9)
        .cast("int").alias("total_rounds"), (F.coalesce("told", F.lit(0)) <= 0).alias("inferred"))


def event_page_status(pages: DataFrame) -> DataFrame:
    """Every landed page of an event list: loaded, empty (the service answered with an error) or failed (not fetched or not
    readable), why, and how many events it holds."""
    env = F.from_json("payload", "struct<error:int,msg:string,datArr:struct<rows:array<string>>,_bad:string>",
                      {"columnNameOfCorruptRecord": "_bad"})
    p = pages.select("page", "fetch_error", env.alias("e"))
    bad = F.col("e").isNull() | F.col("e._bad").isNotNull()
    failed = (F.col("fetch_error") != "") | bad
    refused = F.coalesce(F.col("e.error"), F.lit(0)) != 0
    return p.select(
        "page", F.when(failed, "failed").when(refused, "empty").otherwise("loaded").alias("status"),
        F.when(F.col("fetch_error") != "", F.col("fetch_error")).when(bad, "invalid JSON")
        .when(refused, first_text("e.msg", F.lit("API error"))).otherwise("").alias("error"),
        F.when(failed, 0).otherwise(F.coalesce(F.array_size("e.datArr.rows"), F.lit(0))).alias("events"))


def ingest_run_report(pages: DataFrame, index_status: DataFrame) -> DataFrame:
    """Counters of a crawl and an index run; the sample holds the first 12 failed pages."""
    seen = event_page_status(pages)
    bad = F.col("status") == "failed"
    failed = seen.filter(bad).select("page", F.concat_ws(":", F.col("page").cast("string"), "error").alias("t")) \
        .orderBy("page").limit(12) \
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda s: s["t"]), ", ")
             .alias("failed_sample"))
    crawl = seen.agg(F.count_if(~bad).alias("pages_loaded"), F.count_if(bad).alias("pages_failed"),
                     F.coalesce(F.sum("events"), F.lit(0)).cast("bigint").alias("events_stored"))
    ok = F.col("last_error") == ""
    index = index_status.agg(
        F.count_if(ok).alias("events_indexed"), F.count_if(~ok).alias("events_failed"),
        F.coalesce(F.sum(F.when(ok, F.col("group_count"))), F.lit(0)).alias("groups_indexed"),
        F.coalesce(F.sum(F.when(ok, F.col("participant_count"))), F.lit(0)).alias("participants_indexed"))
    rows = crawl.unionByName(index, allowMissingColumns=True).unionByName(failed, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])
