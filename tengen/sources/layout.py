"""Seats and games laid out for joins without a shuffle.

Both tables are bucketed and sorted by (group, player): seats by their own player, games once for each of the two players who
played them. Joins and windows on (group, player) then read matching buckets in place. The player is part of the key, so a group
with a third of all rows spreads over all buckets; bucket counts must be equal for the tables to match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import outcome, rounds
from ..operators.games import player_games
from ..session import let_go

SEAT_KEY, SIDE_KEY = ["group_id", "participant_id"], ["group_id", "me_id"]


def write_bucketed(df: DataFrame, name: str, path: str, keys: list[str], buckets: int, gather: bool = True, sort: bool = False) -> None:
    """A bucketed table at a path of its own, one file a bucket. Rows of a bucket are brought together first, unless they lie
    together already; zstd keeps the repeating names and texts small."""
    w = (df.repartition(buckets, *keys) if gather else df).write.mode("overwrite").bucketBy(buckets, *keys)
    (w.sortBy(*keys) if sort else w).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)


def write_layout(participants: DataFrame, matches: DataFrame, path: str, prefix: str, buckets: int) -> None:
    """What a schedule shows of seats and games moves to the buckets once; its shuffle files go when it is stored."""
    seats = participants.select("event_id", *SEAT_KEY, "participant_name", "win", "lose", "draw")
    write_bucketed(seats, f"{prefix}_seats", f"{path}/seats", SEAT_KEY, buckets, sort=True)
    write_bucketed(player_games(matches).drop("me_name", "me_org"), f"{prefix}_sides", f"{path}/sides", SIDE_KEY, buckets, sort=True)
    let_go(participants.sparkSession)


def read_layout(spark: SparkSession, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Seats, and games as each player saw them."""
    return spark.table(f"{prefix}_seats"), spark.table(f"{prefix}_sides")


def schedule(seats: DataFrame, sides: DataFrame) -> DataFrame:
    """Rounds 1..n of every seat with its game, or an empty opponent, without moving a row of either table.

    A player's games, one a round, become a map by round where they lie; the seat's rounds look themselves up in it.
    """
    game = F.struct(F.col("opp_name").alias("opponent"), F.col("opp_id").alias("opponent_id"), F.col("opp_org").alias("opponent_org"),
                    outcome("me_result").alias("result"), F.coalesce("me_score", F.lit(0.0)).alias("score"),
                    F.coalesce("opp_score", F.lit(0.0)).alias("opp_score"))
    first = sides.groupBy(*SIDE_KEY, "bout").agg(F.min_by(game, F.struct("p1_id", "p2_id")).alias("game"))
    games = first.groupBy("group_id", F.col("me_id").alias("participant_id")).agg(
        F.map_from_entries(F.collect_list(F.struct("bout", "game"))).alias("games"))
    entries = seats.select("event_id", *SEAT_KEY, "participant_name", rounds().alias("rounds")).filter("rounds >= 1")
    out = entries.join(games, SEAT_KEY, "left").withColumn("bout", F.explode(F.sequence(F.lit(1), "rounds"))) \
        .withColumn("game", F.try_element_at("games", F.col("bout")))
    return out.select("event_id", *SEAT_KEY, "participant_name", "rounds", "bout", "game.*")
