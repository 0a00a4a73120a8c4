"""Group tables that follow a stream of game results, change by change.

A stateful aggregate keeps, for every (group, player), the distinct versions of the player's games in RocksDB. A correction
takes the place of the version it corrects, however late; an older version changes nothing. A player with deliveries in a
micro-batch comes out with totals, opponents and rounds.

A micro-batch appends those players to a versioned store, works out the tables of the groups that changed alone, and appends them
too, with the rows that differ from before, all in one commit that carries the batch number. State is spread by player, so a group
with a third of all games is many keys. With `ttl_ms`, a stateful operator in Python keeps the latest versions instead, at a
call or two between the JVM and Python for every key: state of players whose games haven't changed for so long is dropped, for
events that are over; corrections must come before that.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.numbers import is_played
from ..operators import live
from ..session import let_go, remove, stage, work_dir
from ..sources.store import Store, Version
from . import live_records

PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STREAM, BUCKETS = "games", 16
RECORD = "group_id string, participant_id string, win bigint, lose bigint, draw bigint, score double, opponents array<string>, " \
         "bouts array<struct<bout:int,played:boolean>>"
RECORDS = f"{RECORD}, batch bigint"
_GAMES = "games array<struct<bout:int,p1:string,p2:string,opp:string,result:string,score:double,played:boolean,at:bigint,seq:bigint>>"
_TABLE = "group_id string, participant_id string, name string, org string, short_no string, win int, lose int, draw int, cloud_rank int, " \
         "score double, opponent_score double, total_score double, rank bigint"
STANDINGS = f"{_TABLE}, batch bigint"


def sides(games: DataFrame) -> DataFrame:
    """Two rows a game version, one as each player sees it."""
    def side(me: str, opp: str):
        return F.struct(F.col(f"{me}_id").alias("participant_id"), F.col(f"{opp}_id").alias("opp"), F.col(f"{me}_result").alias("result"),
                        F.col(f"{me}_score").alias("score"))
    return games.select("group_id", "bout", "p1_id", "p2_id", is_played().alias("played"), F.col("updated_at").alias("at"),
                        F.col("ingest_seq").cast("bigint").alias("seq"), F.explode(F.array(side("p1", "p2"), side("p2", "p1"))).alias("s")) \
        .select("group_id", "s.participant_id", "bout", "p1_id", "p2_id", "played", "at", "seq", "s.opp", "s.result", "s.score")


def _processor(ttl_ms: int | None) -> StatefulProcessor:
    schema = _GAMES

    class Player(StatefulProcessor):  # local, so that workers get it by value
        def init(self, handle) -> None:
            self.state = handle.getValueState("games", schema, ttl_ms)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
            known = self.state.get()
            games = {(g[0], g[1], g[2]): tuple(g) for g in (known[0] if known else [])}
            changed = False
            for r in rows:
                k = (r.bout, r.p1_id, r.p2_id)
                old = games.get(k)
                if old is None or (r["at"], r.seq) > (old[7], old[8]):
                    games[k] = (*k, r.opp, r.result, r.score, r.played, r["at"], r.seq)
                    changed = True
            if not changed:
                return
            ordered = [games[k] for k in sorted(games)]
            self.state.update((ordered,))  # plain tuples: the state client rebuilds nested values
            played = [g for g in ordered if g[6]]
            yield Row(group_id=key[0], participant_id=key[1], win=sum(g[4] == "1" for g in played), lose=sum(g[4] == "2" for g in played),
                      draw=sum(g[4] not in ("1", "2") for g in played), score=float(sum(g[5] for g in played)),
                      opponents=sorted({g[3] for g in played}), bouts=[Row(bout=g[0], played=g[6]) for g in ordered])

        def close(self) -> None:
            pass

    return Player()


def _records(held: DataFrame) -> DataFrame:
    """Totals, opponents and rounds of each player from the versions of the games: group_id, participant_id, versions. A version
    names the opponent and which side the player took, not both players.

    The last version of a game stands behind its others in the order of the array; of equal times and numbers the greatest row counts.
    """
    def game(v):
        return F.struct(v["bout"], v["p1_id"], v["p2_id"])

    def newest(versions):
        return F.filter(versions, lambda v, i: (i == F.size(versions) - 1) | ~game(v).eqNullSafe(game(F.get(versions, i + 1))))
    me = F.col("participant_id")

    def whole(v):
        return F.struct(v["bout"].alias("bout"), F.when(v["first"], me).otherwise(v["opp"]).alias("p1_id"),
                        F.when(v["first"], v["opp"]).otherwise(me).alias("p2_id"), *[v[c].alias(c) for c in ("at", "seq", "opp", "result", "score", "played")])
    versions = F.array_sort(F.transform("versions", whole))
    games = F.get(F.transform(F.array(versions), newest), F.lit(0))  # sorted once, not for every element
    rows = held.select("group_id", "participant_id", games.alias("games")).withColumn("played", F.filter("games", lambda g: g["played"]))

    def count(*results: str):
        return F.size(F.filter("played", lambda g: F.coalesce(g["result"], F.lit("")).isin(*results))).cast("bigint")
    return rows.select(
        "group_id", "participant_id", count("1").alias("win"), count("2").alias("lose"),
        (F.size("played").cast("bigint") - count("1", "2")).alias("draw"),
        F.aggregate("played", F.lit(0.0), lambda s, g: s + g["score"]).alias("score"),
        F.array_sort(F.array_distinct(F.transform("played", lambda g: g["opp"]))).alias("opponents"),
        F.transform("games", lambda g: F.struct(g["bout"].alias("bout"), g["played"].alias("played"))).alias("bouts"))


def changed_players(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """One row for every player with deliveries in a micro-batch; with ttl_ms, for those whose games they changed."""
    if not ttl_ms:
        first = (F.col("p1_id").eqNullSafe(F.col("participant_id"))).alias("first")
        version = F.struct("bout", "opp", first, "at", "seq", "result", "score", "played")
        return _records(sides(stream).groupBy("group_id", "participant_id").agg(F.collect_set(version).alias("versions")))
    return sides(stream).groupBy("group_id", "participant_id").transformWithState(
        statefulProcessor=_processor(ttl_ms), outputStructType=RECORD, outputMode="Update", timeMode="ProcessingTime")


def latest_players(records: DataFrame) -> DataFrame:
    value = F.struct(*[c for c in records.columns if c not in ("group_id", "participant_id", "batch")])
    return records.groupBy("group_id", "participant_id").agg(F.max_by(value, "batch").alias("v")).select("group_id", "participant_id", "v.*")


def tables(records: DataFrame, participants: DataFrame) -> DataFrame:
    """Standings of the groups that have records: scores, opponents' scores and rounds come from the records."""
    scores = records.select("group_id", "participant_id", F.col("score").alias("streamed"))
    groups = records.select("group_id").distinct()
    seats = live.seat_list(participants).join(groups, "group_id", "left_semi").join(scores, ["group_id", "participant_id"], "left") \
        .withColumn("score", F.coalesce("streamed", F.lit(0.0))).drop("streamed")
    known = seats.select("group_id", F.col("participant_id").alias("opp"), F.col("score").alias("opp_score"))
    met = records.select("group_id", "participant_id", F.explode("opponents").alias("opp")).join(known, ["group_id", "opp"]) \
        .groupBy("group_id", "participant_id").agg(F.sum("opp_score").alias("opponent_score"))
    rounds = records.select("group_id", F.explode("bouts").alias("b")).groupBy("group_id", "b.bout").agg(F.bool_and("b.played").alias("done")) \
        .groupBy("group_id").agg(F.greatest(F.coalesce(F.max(F.when(F.col("done"), F.col("bout"))), F.lit(0)), F.lit(1)).alias("formula_rounds"))
    rows = seats.join(met, ["group_id", "participant_id"], "left").join(rounds, "group_id").na.fill(0.0, ["opponent_score"])
    return live.score_rank(live._totals(rows, ["group_id"]), ["group_id"])


def newest_tables(rows: DataFrame) -> DataFrame:
    """Each group's last table; the batch numbers of a group combine before the shuffle."""
    last = rows.groupBy("group_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["group_id", "batch"], "left_semi")


def apply(store: Store, changed: DataFrame, number: int, participants: DataFrame, stream: str = STREAM) -> int:
    """Commit one micro-batch: players that changed, tables of their groups, and the rows of those that are new."""
    done: list[bool] = []

    def work(base: Version) -> dict:
        done.append(True)
        names = [c.split()[0] for c in _TABLE.split(", ")]
        # the one evaluation of the stateful plan
        players = store.write("records", changed.withColumn("batch", F.lit(number).cast("bigint")), "group_id", BUCKETS, replace=False, gather=False)
        if not players.written:
            return {}
        fresh = store.spark.read.schema(RECORDS).parquet(*[
            f"{store.path}/data/records/{players.folder}/bucket={b}" for b in sorted(players.written)])
        old = store.read("records", RECORDS, base, players.written)
        groups = fresh.select("group_id").distinct()
        if "records" in base.tables:  # deliveries may repeat what is known
            known = latest_players(old.join(fresh.select("group_id", "participant_id"), ["group_id", "participant_id"], "left_semi"))
            groups = stage(fresh.drop("batch").exceptAll(known).select("group_id").distinct(), "changed-groups")
        now = latest_players(old.unionByName(fresh).join(groups, "group_id", "left_semi"))
        rows = tables(now, participants).select(*[F.col(c).cast(t) for c, t in (p.split() for p in _TABLE.split(", "))])
        table = store.write("standings", rows.withColumn("batch", F.lit(number).cast("bigint")), "group_id", BUCKETS, replace=False,
                            gather=False)
        made = store.spark.read.schema(STANDINGS).parquet(*[
            f"{store.path}/data/standings/{table.folder}/bucket={b}" for b in sorted(table.written)]) if table.written else None
        out = {"records": (BUCKETS, players)}
        if made is not None:
            moved = made.select(*names)
            if "standings" in base.tables:  # else every row is new
                before = newest_tables(store.read("standings", STANDINGS, base, players.written).join(groups, "group_id", "left_semi"))
                moved = moved.exceptAll(before.select(*names))
            moved = moved.withColumn("batch", F.lit(number).cast("bigint"))
            out |= {"standings": (BUCKETS, table), "changes": (BUCKETS, store.write("changes", moved, "group_id", BUCKETS, replace=False))}
        return out

    version = store.commit(work, (stream, number))
    let_go(store.spark)
    if not done:  # a repeated batch: its state still has to be made
        changed.write.format("noop").mode("overwrite").save()
    return version


def compact(store: Store, most: int = 8) -> int:
    """Fold buckets with many folders: the last record of each player, the last table of each group. Changes stay as they are."""
    def work(base: Version) -> dict:
        out = {}
        for name, schema, last in (("records", RECORDS, None), ("standings", STANDINGS, newest_tables)):
            folders = base.folders(name) if name in base.tables else {}
            many = {b for b, f in folders.items() if len(f) > most}
            if many:
                rows = store.read(name, schema, base, many)
                if last is None:
                    top = rows.groupBy("group_id", "participant_id").agg(F.max("batch").alias("batch"))
                    rows = rows.join(top, ["group_id", "participant_id", "batch"], "left_semi")
                else:
                    rows = last(rows)
                out[name] = (BUCKETS, store.write(name, rows, "group_id", BUCKETS, many))
        return out
    return store.commit(work)


def current(store: Store, at: Version | None = None) -> DataFrame:
    """All group tables as of a version."""
    return newest_tables(store.read("standings", STANDINGS, at)).drop("batch")


def start(stream: DataFrame, store: Store, checkpoint: str, participants: DataFrame, ttl_ms: int | None = None):
    spark: SparkSession = stream.sparkSession
    before = spark.conf.get(PROVIDER_KEY, None)
    spark.conf.set(PROVIDER_KEY, ROCKS_DB)  # a query keeps the settings it was started with
    try:
        return changed_players(stream, ttl_ms).writeStream.outputMode("update") \
            .foreachBatch(lambda batch, number: apply(store, batch, number, participants) and None) \
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER_KEY)
        else:
            spark.conf.set(PROVIDER_KEY, before)


def run_fixture(fx, files_per_trigger: int | None = None) -> Store:
    """The store after all deliveries of game versions, wrong, late and repeated ones among them."""
    spark = fx.spark
    root = f"{work_dir(spark)}/{spark.sparkContext.applicationId}/stream/{uuid.uuid4().hex[:12]}"
    schema = live_records.land_fixture(fx, root).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    store = Store(spark, f"{root}/store")
    start(reader.parquet(f"{root}/landing"), store, f"{root}/checkpoint", fx.participants).awaitTermination()
    for folder in ("landing", "checkpoint"):  # the store has all that was delivered
        remove(spark, f"{root}/{folder}")
    return store
