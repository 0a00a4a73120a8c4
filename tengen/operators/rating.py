"""Rating of every seat from results and the opponent graph of its group."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.levels import GRAPH, name_features, with_entry_features, with_event_features
from ..functions.numbers import outcome_points
from ..functions.text import text
from ..schema import ENTRY_VIEW, EVENT_VIEW
from ..session import stage
from .games import player_games
from .search import scope_filter, with_events

# fixed values of the rating model
WINDOW_DAYS = 180
PASSES = 8
PRIOR, AGE_PRIOR = 5.0, 3.5
AGE_CAP, CAP, FLOOR = 31.05, 33.5, 1.0
SPAN = 1.15


def window_start(as_of: str, days: int = WINDOW_DAYS) -> str:
    return (date.fromisoformat(as_of) - timedelta(days=days)).isoformat()


def window_rows(participants, events, as_of: str, province=None) -> DataFrame:
    """Entries of the trailing window with their rating features, for all players."""
    return entry_features(participants, events, as_of, GRAPH, province=province,
                          date_from=window_start(as_of), date_to=as_of + " 23:59:59")


def entry_features(participants, events, as_of: str, model, **scope) -> DataFrame:
    """Entries of a scope with features; name and event features are worked out before the joins."""
    names = name_features(participants, model)
    e = with_event_features(scope_filter(events, **scope).select(*EVENT_VIEW), as_of, model)
    rows = with_events(participants.select("event_id", *ENTRY_VIEW), e)
    return with_entry_features(rows.join(names, "group_name", "left"), model)


def rating_nodes(rows: DataFrame) -> DataFrame:
    """Seats that enter the graph."""
    return rows.filter(F.col("base").isNotNull() & (F.col("time_weight") > 0)).select(
        "group_id", "participant_id", "participant_name", "base", "is_age_group",
        F.when(F.col("is_age_group"), F.lit(AGE_PRIOR)).otherwise(F.lit(PRIOR)).alias("prior"),
        F.when(F.col("is_age_group"), F.lit(AGE_CAP)).otherwise(F.lit(CAP)).alias("cap"),
        (F.col("time_weight") * F.col("event_weight")).alias("node_weight"))


def valid_games(matches: DataFrame) -> DataFrame:
    return matches.filter((text("group_id") != "") & (text("p1_id") != "") & (text("p2_id") != ""))


def rating_edges(nodes: DataFrame, matches: DataFrame) -> DataFrame:
    """Games between two rated seats, one row each."""
    one = nodes.select("group_id", F.col("participant_id").alias("p1_id"), F.col("node_weight").alias("w1"))
    two = nodes.select("group_id", F.col("participant_id").alias("p2_id"), F.col("node_weight").alias("w2"))
    return valid_games(matches).select("group_id", "bout", "p1_id", "p2_id", "p1_result", "p2_result") \
        .join(one, ["group_id", "p1_id"]).join(two, ["group_id", "p2_id"]) \
        .withColumn("weight", F.least("w1", "w2")).filter(F.col("weight") > 0) \
        .select("group_id", "bout", "p1_id", "p2_id", outcome_points("p1_result").alias("p1_points"),
                outcome_points("p2_result").alias("p2_points"), "weight")


def rating_iterate(nodes: DataFrame, edges: DataFrame, passes: int = PASSES) -> DataFrame:
    """Synchronous passes: each rating moves towards its opponents' last ratings and results.

    Everything that does not change between passes (prior, result bonus, total
    weight) is summed once. A pass then joins the opponents' ratings to the edge
    list and adds them up per player. All keys are (group, player), never the
    group alone, so a huge group is spread over all tasks. The previous rating is
    referenced once per pass, so the plan grows linearly.
    """
    def side(me, opp, points):
        return F.struct(F.col(me).alias("participant_id"), F.col(opp).alias("opp_id"), F.col(points).alias("points"))
    directed = edges.select("group_id", "weight", F.explode(F.array(
        side("p1_id", "p2_id", "p1_points"), side("p2_id", "p1_id", "p2_points"))).alias("s")) \
        .select("group_id", "s.*", "weight")
    # one edge per ordered pair: rematches add up
    pairs = stage(directed.groupBy("group_id", "opp_id", "participant_id").agg(
        F.sum("weight").alias("weight"),
        F.sum(F.col("weight") * (F.col("points") - 0.5) * 2 * SPAN).alias("bonus")), "edges")
    gains = pairs.groupBy("group_id", "participant_id").agg(
        F.sum("weight").alias("games_weight"), F.sum("bonus").alias("bonus"))
    zero = F.lit(0.0)
    fixed = stage(nodes.join(gains, ["group_id", "participant_id"], "left").select(
        "group_id", "participant_id", "participant_name", "base", "is_age_group", "cap",
        (F.col("base") * F.col("prior") + F.coalesce("bonus", zero)).alias("fixed_sum"),
        (F.col("prior") + F.coalesce("games_weight", zero)).alias("total_weight")), "nodes")

    links = pairs.select("group_id", "opp_id", "participant_id", "weight")
    rated = fixed.select("group_id", F.col("participant_id").alias("opp_id"), F.col("base").alias("rating"))
    out = fixed.withColumn("rating", F.col("base"))
    for _ in range(passes):
        pull = links.join(rated, ["group_id", "opp_id"]).groupBy("group_id", "participant_id") \
            .agg(F.sum(F.col("weight") * F.col("rating")).alias("pull"))
        out = fixed.join(pull, ["group_id", "participant_id"], "left").withColumn(
            "rating", F.greatest(F.lit(FLOOR), F.least(F.col("cap"), (
                F.col("fixed_sum") + F.coalesce("pull", zero)) / F.col("total_weight"))))
        rated = out.select("group_id", F.col("participant_id").alias("opp_id"), "rating")
    return out.select("group_id", "participant_id", "participant_name", "base", "is_age_group", "rating")


def group_max_rounds(participants: DataFrame) -> DataFrame:
    n = F.coalesce("win", F.lit(0)) + F.coalesce("lose", F.lit(0)) + F.coalesce("draw", F.lit(0))
    return participants.groupBy("group_id").agg(F.max(n).alias("rounds")).filter(F.col("rounds") > 0)


def own_matches(rows: DataFrame, nodes: DataFrame, matches: DataFrame) -> DataFrame:
    """Per target row: number of own games and of distinct rated opponents by name."""
    games = _own_games(rows, nodes, matches)
    return rows.select("event_id", "group_id", "participant_id", "participant_name").join(
        games.groupBy("group_id", "participant_id").agg(
            F.count(F.lit(1)).alias("own_games"), F.count_distinct("opp_name").alias("opponents")),
        ["group_id", "participant_id"], "left").na.fill(0, ["own_games", "opponents"])


def _own_games(rows: DataFrame, nodes: DataFrame, matches: DataFrame) -> DataFrame:
    mine = rows.select("group_id", "participant_id", "participant_name")
    names = nodes.select("group_id", F.col("participant_id").alias("opp_id"),
                         F.nullif(F.col("participant_name"), F.lit("")).alias("opp_name"))
    games = player_games(valid_games(matches)).select("group_id", F.col("me_id").alias("participant_id"), "opp_id")
    return games.join(mine, ["group_id", "participant_id"]).join(names, ["group_id", "opp_id"], "left")


def opponent_names(rows: DataFrame, nodes: DataFrame, matches: DataFrame) -> DataFrame:
    """Distinct rated opponents per player over the given rows."""
    return _own_games(rows, nodes, matches).groupBy("participant_name") \
        .agg(F.count_distinct("opp_name").alias("opponents"))
