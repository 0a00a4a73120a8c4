"""Running tournaments: status, progress, standings, rank distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import DAY_MS, HOUR_MS, china_time_ms
from ..functions.numbers import float_or_zero, is_played, parse_int, round_half_up
from ..functions.text import date10, first_text, text
from ..session import stage
from .search import ALL

# fixed values: labels and sort codes of the event states
STATUS_LABELS = {"live": "进行中", "upcoming": "即将开始", "today-ended": "今日结束", "recent-ended": "近期结束"}
STATUS_ORDER = {"live": 0, "upcoming": 1, "today-ended": 2, "recent-ended": 3}
LIVE_PAST_DAYS, LIVE_FUTURE_DAYS = 2, 7


def _as_map(d: dict, key: Column, default) -> Column:
    out = None
    for k, v in d.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(default)


def _once(values: dict[str, Column], use) -> Column:
    """use(values), with each value worked out once however often it is used."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), use), F.lit(0))


def event_status(min_time, max_time, now_ms) -> Column:
    now = F.col(now_ms) if isinstance(now_ms, str) else now_ms
    times = {"start": china_time_ms(min_time), "end": china_time_ms(first_text(max_time, min_time))}
    return _once(times, lambda t: F.when((t["start"] <= now) & (now <= t["end"]), "live").when(now < t["start"], "upcoming")
                 .when(now - t["end"] <= 8 * HOUR_MS, "today-ended").when(now - t["end"] <= 2 * DAY_MS, "recent-ended")
                 .otherwise("old"))


def status_label(status) -> Column:
    return _as_map(STATUS_LABELS, F.col(status), "可查询")


def status_order(status) -> Column:
    return _as_map(STATUS_ORDER, F.col(status), 9)


def is_live_group(bt, et, state, now_ms) -> Column:
    now = F.col(now_ms) if isinstance(now_ms, str) else now_ms
    times = {"begin": china_time_ms(bt), "end": china_time_ms(et)}
    return _once(times, lambda t: F.when(t["begin"].isNotNull() & t["end"].isNotNull(), (t["begin"] <= now) & (now <= t["end"]))
                 .when(t["begin"].isNotNull(), (t["begin"] <= now) & (now - t["begin"] < 3 * DAY_MS))
                 .otherwise(text(state) == "0"))


def live_candidates(events: DataFrame, province=None, date_from: Column | str | None = None,
                    date_to: Column | str | None = None, limit: int | None = None) -> DataFrame:
    """Events whose days overlap the range; by default 2 days back to 7 days ahead of now_ms."""
    # the calendar day is taken in UTC+8
    today = F.date_add(F.lit("1970-01-01").cast("date"),
                       F.floor((F.col("now_ms") + 8 * HOUR_MS) / DAY_MS).cast("int"))

    def bound(v, days):
        if v is None:
            return F.date_format(F.date_add(today, days), "yyyy-MM-dd")
        return F.lit(v) if isinstance(v, str) else v
    low, high = bound(date_from, -LIVE_PAST_DAYS), bound(date_to, LIVE_FUTURE_DAYS)
    e = events if province in (None, "", ALL) else events.filter(F.col("provincename") == province)
    out = e.withColumn("start_date", date10("min_time")) \
        .withColumn("end_date", date10(first_text("max_time", "min_time"))) \
        .filter((F.col("end_date") >= low) & (F.col("start_date") <= high))
    return out.orderBy(F.desc("min_time"), "event_id").limit(limit) if limit else out


def live_event_groups(groups: DataFrame) -> DataFrame:
    return groups.select("event_id", "group_id", text("group_name").alias("group_name"),
                         F.coalesce("pnumber", F.lit(0)).alias("pnumber"),
                         text("groupstate").alias("group_state"), text("bt").alias("begins_at"),
                         text("et").alias("ends_at"),
                         is_live_group("bt", "et", "groupstate", "now_ms").alias("live"))


def group_menu_order(groups: DataFrame) -> DataFrame:
    """Live groups first, then names in Chinese collation; place numbers the groups of an event."""
    order = [F.desc("live"), F.collate("group_name", "zh"), F.col("group_id")]
    return live_event_groups(groups).withColumn("place", F.row_number().over(Window.partitionBy("event_id").orderBy(*order))) \
        .orderBy(*order)


def event_live_rollup(events: DataFrame, groups: DataFrame) -> DataFrame:
    """Per event: counts, state, begin and end; old events drop out, events without groups too."""
    g = groups.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("group_count"),
        F.count_if(is_live_group("bt", "et", "groupstate", "now_ms")).alias("live_group_count"),
        F.min(F.nullif("bt", F.lit(""))).alias("first_bt"), F.max(F.nullif("et", F.lit(""))).alias("last_et"))
    e = events.join(g, "event_id").withColumn(
        "status", F.when(F.col("live_group_count") > 0, "live")
        .otherwise(event_status("min_time", "max_time", "now_ms")))
    return e.filter(F.col("status") != "old").select(
        "event_id", "title", date10("min_time").alias("date"), F.col("provincename").alias("province"),
        F.col("city_name").alias("city"), F.col("cname").alias("organizer"), "group_count",
        "live_group_count", "status", status_label("status").alias("status_label"),
        status_order("status").alias("status_order"), first_text("first_bt", "min_time").alias("begins_at"),
        first_text("last_et", "max_time").alias("ends_at"))


def chance_text(probability) -> Column:
    """A probability as percent with one decimal at most, halves up."""
    tenths = F.floor(F.coalesce(F.col(probability), F.lit(0.0)) * 1000 + 0.5)
    whole = F.floor(tenths / 10).cast("string")
    return F.concat(whole, F.when(tenths % 10 != 0, F.concat(F.lit("."), (tenths % 10).cast("string"))).otherwise(""), F.lit("%"))


def live_order(rollup: DataFrame) -> DataFrame:
    return rollup.orderBy("status_order", F.desc("date"), F.desc("event_id"))


def round_progress(matches: DataFrame, announced: DataFrame) -> DataFrame:
    """Rounds in all, completed and known per group. announced(group_id, total_rounds) may lack groups.

    The stored games are evidence too: a group has at least as many rounds as its games show, whatever was announced.
    Rounds collapse to one row per (group, round) before anything looks at a whole group.
    """
    per = matches.groupBy("group_id", "bout").agg(F.bool_and(is_played()).alias("done"))
    known = per.groupBy("group_id").agg(
        F.coalesce(F.max(F.when(F.col("done"), F.col("bout"))), F.lit(0)).alias("completed_rounds"),
        F.max("bout").alias("known_pairing_rounds"))
    given = announced.select("group_id", F.col("total_rounds").alias("given"))
    return known.join(given, "group_id", "left").select(
        "group_id", F.greatest("known_pairing_rounds", F.coalesce("given", F.lit(0))).cast("int").alias("total_rounds"),
        "completed_rounds", "known_pairing_rounds")


def seat_list(participants: DataFrame) -> DataFrame:
    """Players of each group with their current score as a number."""
    return participants.select("group_id", "participant_id", F.col("participant_name").alias("name"), "org",
                               "short_no", float_or_zero("score").alias("score"), "win", "lose", "draw",
                               F.col("rank").alias("cloud_rank"))


def directed_pairs(matches: DataFrame) -> DataFrame:
    return matches.select("group_id", F.explode(F.array(
        F.struct(F.col("p1_id").alias("me"), F.col("p2_id").alias("opp")),
        F.struct(F.col("p2_id").alias("me"), F.col("p1_id").alias("opp")))).alias("s")) \
        .select("group_id", "s.me", "s.opp")


def _meetings(games: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct (me, opp) pairs with the opponent's row of known(group_id, opp, …).

    Rematches go, as far as a task sees them, before anything is shuffled; tables laid out by group are not shuffled at all.
    """
    return directed_pairs(games).distinct().join(known.hint("merge"), ["group_id", "opp"])


def opponent_edges(players: DataFrame, matches: DataFrame) -> DataFrame:
    """Pairs that have met in a played game, both on the player list; rematches count once."""
    ids = players.select("group_id", "participant_id")
    return matches.filter(is_played()).select(
        "group_id", F.least("p1_id", "p2_id").alias("a_id"), F.greatest("p1_id", "p2_id").alias("b_id")) \
        .distinct() \
        .join(ids.withColumnRenamed("participant_id", "a_id"), ["group_id", "a_id"], "left_semi") \
        .join(ids.withColumnRenamed("participant_id", "b_id"), ["group_id", "b_id"], "left_semi") \
        .select("group_id", "a_id", "b_id")


def score_rank(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rank by total, then score; ties share a rank.

    Seats are counted per distinct (total, score) first, map-side, and only those few rows are summed from the top; so equal
    totals, or one group with a third of all rows, never meet in one task.
    """
    cells = rows.groupBy(*keys, "total_score", "score").agg(F.count(F.lit(1)).alias("n"))
    above = Window.partitionBy(*keys).orderBy(F.desc("total_score"), F.desc("score")) \
        .rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("rank", F.coalesce(F.sum("n").over(above), F.lit(0)) + 1).drop("n")
    return rows.join(cells.hint("merge"), [*keys, "total_score", "score"]).withColumn("rank", F.col("rank").cast("bigint"))


def standing_rank(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rank, and a display order in which ties go by short number, name and id.

    The display order is dealt by ranges of the whole order, so a group of equal totals spreads over many tasks; each range
    numbers its own rows, and the counts of the ranges before it are added.
    """
    short = F.coalesce(F.nullif(parse_int("short_no"), F.lit(0)), F.lit(9999))
    order = [F.desc("total_score"), F.desc("score"), short, F.collate("name", "zh"), F.col("participant_id")]
    ranked = score_rank(rows, keys)
    slices = stage(ranked.repartitionByRange(*keys, *order).withColumn("slice", F.spark_partition_id()), "display")
    sizes = slices.groupBy(*keys, "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy(*keys, "slice").orderBy(*order))
    return slices.withColumn("own", own).join(sizes, [*keys, "slice"]) \
        .withColumn("display_order", (F.col("ahead") + F.col("own")).cast("bigint")).drop("slice", "own", "ahead")


def _totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows: score, opponent_score, formula_rounds. Adds the rounded scores."""
    top = rows.groupBy(*keys).agg(F.greatest(F.lit(1.0), F.max("score")).alias("top_score"))
    total = F.col("score") + (F.col("opponent_score") * 2 / F.col("top_score") - F.col("formula_rounds"))
    return rows.join(top.hint("merge"), keys).withColumn("total_score", round_half_up(total, 5)) \
        .withColumn("score", round_half_up("score", 2)) \
        .withColumn("opponent_score", round_half_up("opponent_score", 2)).drop("top_score", "formula_rounds")


def _kept(rows: DataFrame, label: str, buckets: int | None) -> DataFrame:
    """Rows that are read twice further on, stored: tables that lie by group meet without an exchange whose result could be used again."""
    return stage(rows, label, ("group_id", buckets) if buckets else None)


def standings(players: DataFrame, matches: DataFrame, progress: DataFrame, display: bool = True, buckets: int | None = None) -> DataFrame:
    """Current table of each group with opponent scores and ranks; the display order costs a sort of all rows of its own."""
    played = matches.filter(is_played())
    opp = players.select("group_id", F.col("participant_id").alias("opp"), F.col("score").alias("opp_score"))
    sums = _meetings(played, opp).groupBy("group_id", F.col("me").alias("participant_id")) \
        .agg(F.sum("opp_score").alias("opponent_score"))
    r = progress.select("group_id", F.greatest("completed_rounds", F.lit(1)).alias("formula_rounds"))
    rows = players.join(sums, ["group_id", "participant_id"], "left").join(r, "group_id", "left") \
        .na.fill(0.0, ["opponent_score"]).na.fill(1, ["formula_rounds"])
    totals = _kept(_totals(_kept(rows, "scored", buckets), ["group_id"]), "totals", buckets)
    return (standing_rank if display else score_rank)(totals, ["group_id"])


def scenario_rank_distribution(players: DataFrame, matches: DataFrame, progress: DataFrame,
                               scenarios: DataFrame, top: int = 5, buckets: int | None = None) -> DataFrame:
    """Rank probabilities over given outcomes of the published, undecided games.

    scenarios(scenario_id, group_id, bout, p1_id, p2_id, p1_wins). Opponent sets do
    not depend on the scenario, so the stored scores are summed once per player and
    only the small score changes are joined per scenario. Files of repeating ids are far
    smaller than their rows, so no join takes them for small enough to pass through the
    driver. With buckets, tables that lie by group stay there.
    """
    keys = ["scenario_id", "group_id"]
    p = progress.select("group_id", "total_rounds")
    s = scenarios.join(p.select("group_id").hint("merge"), "group_id", "left_semi")
    gain = s.groupBy(*keys, F.when(F.col("p1_wins"), F.col("p1_id")).otherwise(F.col("p2_id")).alias("participant_id")) \
        .agg(F.sum(F.lit(2.0)).alias("gain"))
    runs = s.select(*keys).distinct()
    groups = runs.groupBy("group_id").agg(F.count(F.lit(1)).alias("simulations"))

    games = matches.join(groups.select("group_id").hint("merge"), "group_id", "left_semi")
    seats = players.join(groups.hint("merge"), "group_id", "left_semi") \
        .select("group_id", "participant_id", "name", "short_no", "score")
    known = seats.select("group_id", F.col("participant_id").alias("opp"), F.col("score").alias("opp_score"))
    # played or published: both make opponents
    pairs = _kept(_meetings(games, known), "meetings", buckets)
    base = pairs.groupBy("group_id", F.col("me").alias("participant_id")).agg(F.sum("opp_score").alias("base_opp"))
    moved = gain.select(*keys, F.col("participant_id").alias("opp"), "gain") \
        .join(pairs.select("group_id", "me", "opp").hint("merge"), ["group_id", "opp"]) \
        .groupBy(*keys, F.col("me").alias("participant_id")).agg(F.sum("gain").alias("opp_gain"))

    rows = seats.join(base.hint("merge"), ["group_id", "participant_id"], "left").join(runs.hint("merge"), "group_id") \
        .join(gain.hint("merge"), [*keys, "participant_id"], "left").join(moved.hint("merge"), [*keys, "participant_id"], "left") \
        .join(p.hint("merge"), "group_id") \
        .select(*keys, "participant_id", "name", "short_no",
                (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("score"),
                (F.coalesce("base_opp", F.lit(0.0)) + F.coalesce("opp_gain", F.lit(0.0))).alias("opponent_score"),
                F.greatest("total_rounds", F.lit(1)).alias("formula_rounds"))
    ranked = score_rank(_kept(_totals(_kept(rows, "scored", buckets), keys), "totals", buckets), keys)
    counts = ranked.groupBy("group_id", "participant_id", "rank").agg(F.count(F.lit(1)).alias("count")) \
        .join(groups.hint("merge"), "group_id").withColumn("probability", F.col("count") / F.col("simulations"))
    w = Window.partitionBy("group_id", "participant_id").orderBy(F.desc("probability"), "rank")
    return counts.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)


