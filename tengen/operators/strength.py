"""Strength of every player from the trailing window, after the rating graph."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.levels import level_label
from ..functions.numbers import clamp, record_score
from ..functions.text import WS, text
from ..session import stage
from . import rating as R
from .games import games_of_groups

# fixed values
RECENT_N = 80
HIGH_BASE, LOW_BASE = 29.7, 27.8
WITH_GAMES, WITHOUT_GAMES = 1.15, 0.75
NO_ROWS = "近180天内没有找到该棋手的索引记录"
NO_SAMPLE = "近180天内缺少可用棋力样本"
NO_GAMES = "未取得对局明细，主要依据组别与胜负估算"
MANY_ORGS = "同名棋手可能来自多个机构，建议结合省份或机构判断"

ROW_KEY = ["event_id", "group_id", "participant_id"]


def namesake_split(rows: DataFrame, province: str | None = None) -> DataFrame:
    """Flag rows that look like another, weaker player of the same name.

    Counts are first brought down to (name, province); only that small table is
    looked at per name.
    """
    if province:
        return rows.withColumn("removed", F.lit(False))
    p = rows.withColumn("provincename", text("provincename"))
    pv = p.groupBy("participant_name", "provincename").agg(
        F.count(F.lit(1)).alias("n"), F.count("base").alias("rated"),
        F.count_if(F.col("base") >= HIGH_BASE).alias("high"), F.count_if(F.col("base") <= LOW_BASE).alias("low"))
    w = Window.partitionBy("participant_name")
    split = (F.sum("n").over(w) > 1) & (F.sum("rated").over(w) > 1) & (F.sum("high").over(w) >= 2) \
        & (F.sum("low").over(w) > 0) & (F.sum(F.when(F.col("provincename") != "", 1).otherwise(0)).over(w) >= 2)
    flags = pv.select("participant_name", "provincename", split.alias("split"),
                      ((F.col("high") > 0) & (F.col("provincename") != "")).alias("high_province"))
    return p.join(flags, ["participant_name", "provincename"]).withColumn(
        "removed", F.coalesce(F.col("split") & (F.col("base") <= LOW_BASE) & ~F.col("high_province"), F.lit(False))) \
        .drop("split", "high_province").select(*rows.columns, "removed")


def removed_rows(split: DataFrame) -> DataFrame:
    """The rows that the split dropped: all minus kept, by key."""
    kept = split.filter(~F.col("removed"))
    return split.join(kept.select(*ROW_KEY), ROW_KEY, "left_anti")


def recent_n_per_player(rows: DataFrame, n: int = RECENT_N) -> DataFrame:
    """Newest n rows per name; Spark limits each partition to n before the shuffle."""
    w = Window.partitionBy("participant_name").orderBy(F.desc("min_time"), *ROW_KEY)
    return rows.withColumn("recency", F.row_number().over(w)).filter(F.col("recency") <= n)


def target_rows(rows: DataFrame, province=None, recent_n: int | None = None) -> DataFrame:
    """All kept entries; with recent_n, only the newest ones of each name."""
    kept = namesake_split(rows, province).filter(~F.col("removed"))
    return kept if recent_n is None else recent_n_per_player(kept, recent_n)


def strength_entries(targets: DataFrame, rated: DataFrame, own: DataFrame) -> DataFrame:
    """Usable target rows with weight and rating (before and after the skill anchor).

    The anchor is summed per name map-side and joined back, so a name with many entries needs no window.
    """
    r = rated.select("group_id", "participant_id", F.col("rating").alias("node_rating"))
    o = own.select("group_id", "participant_id", "own_games")
    e = targets.filter(F.col("base").isNotNull() & (F.col("time_weight") > 0)) \
        .join(r, ["group_id", "participant_id"], "left").join(o, ["group_id", "participant_id"], "left") \
        .withColumn("own_games", F.coalesce("own_games", F.lit(0)))
    quality = F.when(F.col("own_games") > 0, F.lit(WITH_GAMES)).otherwise(F.lit(WITHOUT_GAMES))
    rating = F.coalesce("node_rating", "base")
    e = e.withColumn("weight", F.greatest(F.lit(1), F.col("rounds")) * F.col("time_weight")
                     * F.col("event_weight") * quality) \
        .withColumn("first_rating", F.when(F.col("is_age_group"), F.least(rating, F.lit(R.AGE_CAP))).otherwise(rating)) \
        .withColumn("record_score", record_score())
    anchors = e.filter(~F.col("is_age_group")).groupBy("participant_name").agg(
        (F.sum(F.col("first_rating") * F.col("weight")) / F.sum("weight")).alias("anchor"))
    e = e.join(anchors, "participant_name", "left")
    raised = F.greatest("first_rating", F.least(F.lit(R.AGE_CAP), F.col("anchor") - 0.05))
    return e.withColumn("rating", F.when(
        F.col("anchor").isNotNull() & F.col("is_age_group") & (F.col("record_score") >= 0.5), raised)
        .otherwise(F.col("first_rating")))


def with_elite_bonus(per_name: DataFrame) -> DataFrame:
    """Raise strong youth players; never lowers the value."""
    eligible = (F.col("rounds") >= 20) & (F.col("strong_events") >= 2) & (F.col("weak_skill_events") == 0)
    by_skill = F.col("five_dan_proofs") > 0
    by_age = (F.col("skill_events") == 0) & (F.col("strong_events") >= 3)
    strong = F.col("strong_points") / F.col("strong_rounds")
    bonus = F.when(by_skill, 0.28).otherwise(0.43) + clamp(strong - 0.75, 0, 0.18)
    cap = F.when(by_skill, 31.18).otherwise(31.12)
    raised = F.greatest("l_mean", F.least(cap, F.col("l_mean") + bonus))
    return per_name.withColumn("l_elite", F.when(eligible & (by_skill | by_age), raised).otherwise(F.col("l_mean")))


def name_totals(entries: DataFrame) -> DataFrame:
    """Sums per player that all later steps need, in one aggregation."""
    age, score, n = F.col("is_age_group"), F.col("record_score"), F.col("rounds")
    strong = age & (score >= 0.75) & (n >= 7)
    proof = ~age & F.coalesce(F.col("group_name").rlike(f"5{WS}*段"), F.lit(False)) & (score >= 0.5) & (n >= 5)
    five = F.col("is_open") | (F.col("rating") >= 30.1) | F.coalesce(F.col("org").rlike(f"5{WS}*段"), F.lit(False))
    return with_elite_bonus(entries.groupBy("participant_name").agg(
        F.count(F.lit(1)).alias("events"), F.sum("rounds").alias("rounds"), F.sum("own_games").alias("match_games"),
        (F.sum(F.col("rating") * F.col("weight")) / F.sum("weight")).alias("l_mean"),
        F.count_if(~age).alias("skill_events"), F.count_if(strong).alias("strong_events"),
        F.count_if(~age & (score < 0.5)).alias("weak_skill_events"), F.count_if(proof).alias("five_dan_proofs"),
        F.sum(F.when(strong, n)).alias("strong_rounds"), F.sum(F.when(strong, score * n)).alias("strong_points"),
        F.count_if(five).alias("five_dan_evidence")))


class StrengthRun:
    """One estimation over a window: shared steps are stored once, results read them."""

    def __init__(self, participants, events, matches, as_of: str, province=None, recent_n: int | None = None,
                 passes: int = R.PASSES, name: str | None = None):
        if name is not None:
            # ratings move within groups only, so one player needs no other group than their own
            groups = participants.filter(F.col("participant_name") == name).select("group_id").distinct()
            participants = participants.join(groups, "group_id", "left_semi")
            matches = matches.join(groups, "group_id", "left_semi")
        self.participants, self.events, self.matches, self.name = participants, events, matches, name
        self.as_of, self.province, self.recent_n, self.passes = as_of, province, recent_n, passes

    @cached_property
    def rows(self) -> DataFrame:
        return stage(R.window_rows(self.participants, self.events, self.as_of, self.province), "window")

    @cached_property
    def games(self) -> DataFrame:
        return games_of_groups(self.matches, self.rows)

    @cached_property
    def nodes(self) -> DataFrame:
        return R.rating_nodes(self.rows)

    @cached_property
    def edges(self) -> DataFrame:
        return stage(R.rating_edges(self.nodes, self.games), "games")

    @cached_property
    def rated(self) -> DataFrame:
        return R.rating_iterate(self.nodes, self.edges, self.passes)

    @cached_property
    def split(self) -> DataFrame:
        return namesake_split(self.wanted, self.province)

    @cached_property
    def wanted(self) -> DataFrame:
        return self.rows if self.name is None else self.rows.filter(F.col("participant_name") == self.name)

    @cached_property
    def targets(self) -> DataFrame:
        return stage(target_rows(self.wanted, self.province, self.recent_n), "targets")

    @cached_property
    def own(self) -> DataFrame:
        return R.own_matches(self.targets, self.nodes, self.games)

    @cached_property
    def entries(self) -> DataFrame:
        return stage(strength_entries(self.targets, self.rated, self.own), "entries")

    def strength(self) -> DataFrame:
        return player_strength(self.targets, self.entries, self.nodes, self.edges, self.games)

    def sets(self) -> DataFrame:
        return strength_sets(self.split, self.targets, self.entries, self.nodes, self.games, self.province)


def player_strength(targets: DataFrame, entries: DataFrame, nodes: DataFrame, edges: DataFrame,
                    matches: DataFrame) -> DataFrame:
    """The final value of each player with confidence, range and evidence counts."""
    opponents = R.opponent_names(entries, nodes, matches)
    sizes = nodes.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_nodes")) \
        .join(edges.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_games")), "group_id", "left")
    graph = targets.select("participant_name", "group_id").distinct().join(sizes, "group_id") \
        .groupBy("participant_name").agg(F.sum("n_nodes").alias("graph_players"),
                                         F.sum(F.coalesce("n_games", F.lit(0))).alias("graph_games"))
    l = F.when((F.col("l_elite") >= 29.85) & (F.col("l_elite") < 30) & (F.col("five_dan_evidence") > 0)
               & (F.col("rounds") >= 12), F.lit(30.02)).otherwise(F.col("l_elite"))
    out = name_totals(entries).withColumn("l", l) \
        .withColumn("confidence", F.when((F.col("match_games") >= 14) & (F.col("events") >= 2), "高")
                    .when((F.col("match_games") >= 5) | (F.col("rounds") >= 8), "中").otherwise("低")) \
        .withColumn("uncertainty", F.when(F.col("confidence") == "高", 0.45)
                    .when(F.col("confidence") == "中", 0.75).otherwise(1.15))
    return out.join(opponents, "participant_name", "left").join(graph, "participant_name", "left") \
        .na.fill(0, ["opponents", "graph_players", "graph_games"]).select(
            F.col("participant_name").alias("name"), "l", level_label("l").alias("label"), "confidence",
            clamp(F.col("l") - F.col("uncertainty"), 0.5, 33.99).alias("low"),
            clamp(F.col("l") + F.col("uncertainty"), 0.5, 33.99).alias("high"),
            level_label(F.col("l") - F.col("uncertainty")).alias("low_label"),
            level_label(F.col("l") + F.col("uncertainty")).alias("high_label"),
            "events", "rounds", "match_games", "opponents", "graph_players", "graph_games")


def _distinct_list(rows: DataFrame, column: str, label: str) -> DataFrame:
    """Sorted distinct non-empty values per name; duplicates go before anything is collected."""
    return rows.select("participant_name", text(column).alias("v")).filter(F.col("v") != "").distinct() \
        .groupBy("participant_name").agg(F.array_sort(F.collect_set("v")).alias(label))


def strength_sets(split: DataFrame, targets: DataFrame, entries: DataFrame, nodes: DataFrame,
                  matches: DataFrame, province=None) -> DataFrame:
    """Organisations, provinces, group and opponent counts, and warnings per player."""
    rated = targets.filter(F.col("base").isNotNull())
    games = entries.groupBy("participant_name").agg(F.sum("own_games").alias("match_games"))
    groups = rated.select("participant_name", text("group_name").alias("g")).distinct() \
        .groupBy("participant_name").agg(F.count(F.lit(1)).alias("groups"))
    kept = split.groupBy("participant_name").agg(
        F.count_if(~F.col("removed")).alias("kept"), F.count_if(F.col("removed")).alias("dropped"))
    used = targets.groupBy("participant_name").agg(F.count(F.lit(1)).alias("target_rows"))
    out = games.join(_distinct_list(rated, "org", "orgs"), "participant_name", "left") \
        .join(_distinct_list(rated, "provincename", "provinces"), "participant_name", "left") \
        .join(groups, "participant_name", "left").join(kept, "participant_name").join(used, "participant_name") \
        .join(R.opponent_names(entries, nodes, matches), "participant_name", "left")
    many = F.lit(not province) & (F.size(F.coalesce("orgs", F.array().cast("array<string>"))) >= 4)
    warnings = F.array_compact(F.array(
        F.when(F.col("match_games") == 0, F.lit(NO_GAMES)), F.when(many, F.lit(MANY_ORGS)),
        F.when(F.col("kept") > F.col("target_rows"), F.concat(
            F.lit("同名记录较多，已优先采用最近 "), F.col("target_rows").cast("string"), F.lit(" 场比赛估算"))),
        F.when(F.col("dropped") > 0, F.concat(
            F.lit("已排除 "), F.col("dropped").cast("string"), F.lit(" 场疑似同名但级别/地区不一致的记录")))))
    return out.select(F.col("participant_name").alias("name"), "orgs", "provinces", "groups",
                      F.coalesce("opponents", F.lit(0)).alias("opponents"), warnings.alias("warnings"))


def unavailable_reason(participants: DataFrame, targets: DataFrame, entries: DataFrame) -> DataFrame:
    """Players without a value: nothing in the window, or nothing usable in it."""
    names = participants.select("participant_name").distinct()
    used = entries.select("participant_name").distinct()
    seen = targets.groupBy("participant_name").agg(F.count(F.lit(1)).alias("rows"))
    groups = _distinct_list(targets.filter(F.col("base").isNotNull()), "group_name", "groups")
    return names.join(used, "participant_name", "left_anti").join(seen, "participant_name", "left") \
        .join(groups, "participant_name", "left").select(
            F.col("participant_name").alias("name"),
            F.when(F.col("rows").isNull(), NO_ROWS).otherwise(NO_SAMPLE).alias("reason"),
            F.coalesce("groups", F.array().cast("array<string>")).alias("groups"))


def top_basis_events(entries: DataFrame, k: int = 5) -> DataFrame:
    """The k entries shown as the basis of a value."""
    w = Window.partitionBy("participant_name").orderBy(
        F.desc(F.substring("min_time", 1, 10)), F.desc("weight"), *ROW_KEY)
    return entries.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
