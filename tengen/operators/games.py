"""Games seen from each player: schedules, head-to-head, opponent records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import outcome, outcome_points, rounds
from ..functions.text import date10, text, trim_ws
from ..schema import EVENT_VIEW
from .search import DETAIL_BASE, entries_view, h2h_candidates, scope_filter


def player_games(matches: DataFrame) -> DataFrame:
    """Two rows per game, one for each side, from a single scan."""
    def side(me: str, opp: str):
        return F.struct(*[F.col(f"{who}_{c}").alias(f"{role}_{c}")
                          for role, who in (("me", me), ("opp", opp))
                          for c in ("id", "name", "org", "result", "score")])
    return matches.select("group_id", "bout", "p1_id", "p2_id",
                          F.explode(F.array(side("p1", "p2"), side("p2", "p1"))).alias("s")) \
        .select("group_id", "bout", "p1_id", "p2_id", "s.*")


def games_of_groups(matches: DataFrame, rows: DataFrame) -> DataFrame:
    """Only the games of the groups that occur in rows, before anything costly is done to them. The groups move to the games."""
    return matches.join(rows.select("group_id").distinct().repartition("group_id"), "group_id", "left_semi")


def first_game_per_bout(matches: DataFrame) -> DataFrame:
    """One game per player and round; the limit runs before the shuffle as well."""
    w = Window.partitionBy("group_id", "me_id", "bout").orderBy("p1_id", "p2_id")
    return player_games(matches).withColumn("_n", F.row_number().over(w)) \
        .filter(F.col("_n") == 1).drop("_n")


def outcome_codes(matches: DataFrame) -> DataFrame:
    return player_games(matches).select(
        "group_id", "bout", "p1_id", "p2_id", "me_id", "opp_id",
        outcome("me_result").alias("outcome"), outcome_points("me_result").alias("points"))


def player_schedule(entries: DataFrame, matches: DataFrame) -> DataFrame:
    """Rounds 1..n of every entry with its game, or an empty opponent."""
    spine = entries.select("event_id", "group_id", "participant_id", "participant_name",
                           rounds().alias("rounds")).filter(F.col("rounds") >= 1) \
        .withColumn("bout", F.explode(F.sequence(F.lit(1), F.col("rounds"))))
    g = first_game_per_bout(matches).select(
        "group_id", F.col("me_id").alias("participant_id"), "bout",
        F.col("opp_name").alias("opponent"), F.col("opp_org").alias("opponent_org"),
        outcome("me_result").alias("result"), F.coalesce("me_score", F.lit(0.0)).alias("score"),
        F.coalesce("opp_score", F.lit(0.0)).alias("opp_score"), F.col("opp_id").alias("opponent_id"))
    return spine.join(g, ["group_id", "participant_id", "bout"], "left").select(
        "event_id", "group_id", "participant_id", "participant_name", "rounds", "bout", "opponent",
        "opponent_id", "opponent_org", "result", "score", "opp_score")


def _game_columns(a: str, b: str) -> list:
    return [
        "group_id", "group_name", "event_id", "title", date10("min_time").alias("date"),
        F.col("provincename").alias("province"), F.col("city_name").alias("city"),
        F.col("cname").alias("organizer"),
        F.concat(F.lit(DETAIL_BASE), F.col("event_id"), F.lit(".html#groupID="), F.col("group_id")).alias("detail_url"),
        "bout", F.col(a + "_id").alias("player_a_id"), F.col(a + "_name").alias("player_a"),
        F.col("me_org").alias("player_a_org"), F.col(b + "_id").alias("player_b_id"),
        F.col(b + "_name").alias("player_b"), F.col("opp_org").alias("player_b_org"),
        outcome("me_result").alias("result"), F.coalesce("me_score", F.lit(0.0)).alias("score"),
        F.coalesce("opp_score", F.lit(0.0)).alias("opp_score")]


def requested_h2h_games(candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """Games between the two seats of each candidate row, seen from player A."""
    c = candidates.filter(F.greatest("player_a_rounds", "player_b_rounds") > 0)
    g = player_games(matches).select("group_id", "bout", F.col("me_id").alias("player_a_id"),
                                     F.col("opp_id").alias("player_b_id"), "me_org", "opp_org",
                                     "me_result", "me_score", "opp_score")
    return c.join(g, ["group_id", "player_a_id", "player_b_id"]) \
        .select(*_game_columns("player_a", "player_b"))


def h2h_games(matches: DataFrame, participants: DataFrame, events: DataFrame, province=None,
              date_from=None, date_to=None) -> DataFrame:
    """Every game between two different names, with the lesser name as player A.

    Starts from the games (one row each) instead of pairing up the seats of a group. An event's columns go to its groups first,
    so games meet them by group and don't move once more.
    """
    p = participants.select("event_id", "group_id", "group_name", "participant_id", "participant_name",
                            rounds().alias("rounds"))
    one = p.select("event_id", "group_id", "group_name", F.col("participant_id").alias("p1_id"),
                   F.col("participant_name").alias("n1"), F.col("rounds").alias("r1"))
    two = p.select("event_id", "group_id", F.col("participant_id").alias("p2_id"),
                   F.col("participant_name").alias("n2"), F.col("rounds").alias("r2"))
    e = entries_view(p, scope_filter(events, province, date_from, date_to).select(*EVENT_VIEW))
    g = matches.drop("event_id", "p1_name", "p2_name").join(one, ["group_id", "p1_id"]) \
        .join(two, ["group_id", "event_id", "p2_id"]) \
        .filter((F.col("n1") != F.col("n2")) & (F.greatest("r1", "r2") > 0)).join(e, ["group_id", "event_id"])
    first = F.col("n1") < F.col("n2")

    def pick(x, y):
        return F.when(first, F.col(x)).otherwise(F.col(y))
    g = g.select("group_id", "group_name", *EVENT_VIEW, "bout",
                 pick("p1_id", "p2_id").alias("a_id"), pick("n1", "n2").alias("a_name"),
                 pick("p2_id", "p1_id").alias("b_id"), pick("n2", "n1").alias("b_name"),
                 pick("p1_org", "p2_org").alias("me_org"), pick("p2_org", "p1_org").alias("opp_org"),
                 pick("p1_result", "p2_result").alias("me_result"),
                 pick("p1_score", "p2_score").alias("me_score"), pick("p2_score", "p1_score").alias("opp_score"))
    return g.select(*_game_columns("a", "b"))


def h2h_summary(participants, events, matches, requests, province=None, date_from=None, date_to=None,
                limit=None) -> DataFrame:
    """Record of each requested pair from player A's side; pairs that never met count zero."""
    c = h2h_candidates(participants, events, requests, province, date_from, date_to, limit)
    met = c.groupBy(F.col("player_a_name").alias("player_a"), F.col("player_b_name").alias("player_b")).agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(F.greatest("player_a_rounds", "player_b_rounds") > 0).alias("checked_groups"))
    s = requested_h2h_games(c, matches).groupBy("player_a", "player_b").agg(
        F.count(F.lit(1)).alias("games"), F.count_if(F.col("result") == "win").alias("win"),
        F.count_if(F.col("result") == "lose").alias("lose"),
        F.count_if(F.col("result") == "draw").alias("draw"))
    counts = ["candidates", "checked_groups", "games", "win", "lose", "draw"]
    return requests.filter(F.col("player_a") != F.col("player_b")).distinct() \
        .join(met, ["player_a", "player_b"], "left").join(s, ["player_a", "player_b"], "left") \
        .na.fill(0, counts) \
        .withColumn("win_rate", F.when(F.col("games") > 0, (F.col("win") + 0.5 * F.col("draw")) / F.col("games"))
                    .otherwise(F.lit(0.0)))


def opponent_record(schedule: DataFrame) -> DataFrame:
    """Record of a player against each opponent name over the given entries."""
    return schedule.withColumn("opponent", trim_ws("opponent")).filter(text("opponent") != "") \
        .groupBy("participant_name", "opponent").agg(
            F.count(F.lit(1)).alias("games"), F.count_if(F.col("result") == "win").alias("win"),
            F.count_if(F.col("result") == "lose").alias("lose"),
            F.count_if(F.col("result") == "draw").alias("draw"))


def h2h_adjustment(schedule: DataFrame, record: DataFrame) -> DataFrame:
    """Per entry: correction from opponents met at least twice.

    An opponent's whole record counts once for every game of the entry.
    """
    met = record.filter(F.col("games") >= 2).select("participant_name", "opponent", "games", "win", "draw")
    rel = F.least(F.lit(1.0), F.col("games") / 4) * F.col("games")
    gain = (F.col("win") + 0.5 * F.col("draw")) / F.col("games") - 0.5
    return schedule.withColumn("opponent", trim_ws("opponent")).filter(text("opponent") != "") \
        .join(met, ["participant_name", "opponent"]) \
        .groupBy("event_id", "group_id", "participant_id").agg(
            F.sum(gain * rel).alias("s"), F.sum(rel).alias("w"), F.sum("games").alias("h2h_games"),
            F.count_distinct("opponent").alias("h2h_opponents")) \
        .select("event_id", "group_id", "participant_id",
                F.greatest(F.lit(-0.8), F.least(F.lit(0.8), 1.6 * (F.col("s") / F.col("w")))).alias("h2h_adj"),
                "h2h_games", "h2h_opponents")
