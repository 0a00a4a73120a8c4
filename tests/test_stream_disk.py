"""Streams move deliveries and stored rows as little as they can, and drop what nothing reads any more."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tengen.sources import layout
from tengen.sources.store import Store
from tengen.streaming import change_log, live_records, standings_state


@pytest.fixture
def no_broadcast(spark):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hash")


def left(root):
    return sorted(p.name for p in Path(root).iterdir())


ROWS = [("matches", "g", 2000, 1, ["a", "b", "a"]), ("matches", "g", 1000, 1, ["c"]), ("matches", "g", 2000, 1, ["d"]), ("matches", None, 1, 1, ["e"]),
        ("matches", "h", None, 1, ["f"]), ("matches", "i", 5, 1, []), ("matches", "i", 4, 9, ["a"]), ("matches", "k", 7, 1, [None, "a"])]


def deliveries(spark):
    row = lambda x: None if x is None else '{"bout":1,"p1_id":"%s","p2_id":"z","p1_score":1.5}' % x
    return spark.createDataFrame([(t, o, at, seq, [row(x) for x in rows]) for t, o, at, seq, rows in ROWS], change_log.ENVELOPE)


def test_newest_deliveries_move_once(spark, no_broadcast, tmp_path):
    t = change_log.TABLES["matches"]
    assert exchanges(change_log.spread(deliveries(spark), t)) == 1
    store = Store(spark, str(tmp_path / "store"))
    change_log.apply(store, deliveries(spark), 0)
    found = change_log.view(store, "matches")
    assert exchanges(found) == 1
    # rows of equal marks count together; deliveries without an owner or a time don't
    assert sorted((r.group_id, r.p1_id) for r in found.collect()) == [("g", "a"), ("g", "b"), ("g", "d"), ("k", "a")]


def test_landings_go_once_they_are_stored(fx, monkeypatch):
    roots = []
    for module in (change_log, live_records):
        landed = module.land_fixture
        monkeypatch.setattr(module, "land_fixture", lambda f, root, landed=landed: roots.append(root) or landed(f, root))
    store = change_log.run_fixture(fx)
    assert change_log.view(store, "groups").count() > 0
    standings_state.run_fixture(fx)
    games = live_records.run_games(fx)
    assert games.count() == fx.matches.count() and len(roots) == 3
    folders = [left(r.removeprefix("file:")) for r in roots]
    assert not any("landing" in f for f in folders) and "checkpoint" not in folders[1]


def test_layout_holds_what_a_schedule_shows(fx, spark, tmp_path):
    prefix = "narrow_layout"
    layout.write_layout(fx.participants, fx.matches, str(tmp_path), prefix, 4)
    seats, sides = layout.read_layout(spark, prefix)
    assert not {"me_name", "me_org"} & set(sides.columns) and "org" not in seats.columns
    assert sum(n.endswith(".parquet") for n in os.listdir(tmp_path / "sides")) == 4


def test_state_names_a_side_not_both_players(spark):
    """Games of equal rounds, one of a player against themselves; the round list follows round and players."""
    rows = [("g", 1, "a", "b", "1", "2", 2.0, 0.0, 5, 1), ("g", 1, "b", "a", "1", "2", 2.0, 0.0, 5, 1), ("g", 2, "a", "a", "3", "3", 1.0, 1.0, 5, 1),
            ("g", 2, None, "a", "", "", 0.0, 0.0, 5, 1)]
    games = spark.createDataFrame(rows, "group_id string, bout int, p1_id string, p2_id string, p1_result string, p2_result string, "
                                        "p1_score double, p2_score double, updated_at long, ingest_seq int")
    found = standings_state.changed_players(games)
    assert "p1_id, p1_id#" not in found._jdf.queryExecution().optimizedPlan().toString()
    a = found.filter("participant_id = 'a'").first()
    assert (a.win, a.lose, a.draw, a.score, a.opponents) == (1, 1, 1, 3.0, ["a", "b"]) and [tuple(b) for b in a.bouts] == [
        (1, True), (1, True), (2, False), (2, True)]
    assert found.agg(F.count("*")).first()[0] == 3


def test_replaced_games_parse_their_payloads_once(spark):
    from tengen.plans.queries import REGISTRY

    plan = REGISTRY["replace_matches"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "from_json" not in plan and "Exchange hash" not in plan
