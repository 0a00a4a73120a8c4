"""Rows laid out by group stay where they lie; rows without a group are kept."""

import re

import pytest
from pyspark.sql import functions as F

from tengen.operators import games, promotion, rules, search
from tengen.session import stage
from tengen.sources import upsert


def moved(df, column):
    """Exchanges that move rows of a stored table with this column, straight from the scan."""
    out, exchange, loose = [], None, False
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        if "Exchange" in line:
            exchange, loose = line, False
        elif re.search(r"Join|Aggregate|Union", line):
            exchange = None
        elif "isnull(group_id" in line:
            loose = True
        elif "FileScan" in line and exchange and not loose and re.search(rf"[\[,]{column}#", line):
            out.append(exchange)
    return out


@pytest.fixture
def no_broadcast(spark):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_entries_do_not_move_to_events(fx, no_broadcast):
    assert moved(search.promotion_candidates(fx.participants, fx.events, fx.groups), "org") == []
    assert moved(upsert.replace_participants(fx.participants, fx.participants.withColumn("ingest_seq", F.lit(1))), "org") == []


def test_games_do_not_move_to_groups(fx, no_broadcast):
    rows = stage(fx.participants.filter("win > 1").select("group_id"), "some")
    assert moved(games.games_of_groups(fx.matches, rows), "p1_org") == []


SEATS = [("e1", "g1", "a"), ("e1", None, "b"), ("e2", "g2", "c"), (None, "g3", "d"), ("e3", None, "x"), ("e3", "g1", "y"), ("e1", "g1", "a")]


def test_entries_without_a_group_meet_their_event(spark):
    p = spark.createDataFrame(SEATS, "event_id string, group_id string, org string")
    e = spark.createDataFrame([("e1", "t"), ("e1", "u"), ("e3", "v"), (None, "w")], "event_id string, title string")
    got = search.with_events(p, e)
    want = p.join(e, "event_id").select(*got.columns)
    assert got.count() == want.count() == 8 and got.exceptAll(want).count() == 0


def test_replacement_drops_rows_without_a_group(spark):
    cols = "event_id string, group_id string, participant_id string"
    old = spark.createDataFrame(SEATS, cols)
    batch = spark.createDataFrame([("e1", "g9", "n", 1), ("e1", "g9", "n", 2)], cols + ", ingest_seq int")
    got = sorted(map(tuple, upsert.replace_participants(old, batch).na.fill("").collect()))
    assert got == [("", "g3", "d"), ("e1", "g9", "n"), ("e2", "g2", "c"), ("e3", "", "x"), ("e3", "g1", "y")]


def test_rules_by_group_like_rules_by_entry(fx):
    levels = rules.level_names(fx.participants)
    seats = fx.participants.join(levels.select("group_name"), "group_name", "left_semi")
    c = search.promotion_candidates(fx.participants, fx.events, fx.groups, levels=levels)
    args = (rules.rule_groups(fx.participants, levels), fx.notices, fx.confirmed_rules, fx.groups, fx.confirmed_events)
    one = promotion.decide(promotion.levelled(c, levels, fx.events), *args)
    two = promotion.decide(promotion.levelled(c, levels, fx.events, seats), *args, seats, 4)
    assert set(one.columns) == set(two.columns) and one.count() == two.count() > 0
    assert one.exceptAll(two.select(*one.columns)).count() == 0


def test_stored_rows_keep_their_buckets(fx, no_broadcast):
    found = stage(fx.matches.repartition(4, "group_id"), "laid-out", ("group_id", 4))
    assert found.count() == fx.matches.count()
    assert "Exchange" not in found.groupBy("group_id", "bout").count()._jdf.queryExecution().executedPlan().toString()


def test_streamed_games_are_discarded_once_stored(fx):
    import os

    from tengen.session import discard
    from tengen.streaming import live_records
    games_ = live_records.run_games(fx, buckets=4)
    found = stage(games_, "streamed", ("group_id", 4))
    discard(games_)
    assert not os.path.exists(games_._staged_at.removeprefix("file:")) and found.count() == fx.matches.count()
