"""Tables laid out by group, and steps whose cost must not outgrow their input."""

from pyspark.sql import functions as F


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hash")


def test_tables_are_stored_without_moving_games(fx):
    assert exchanges(fx._seats()) == 2  # lines and orders, once each
    assert exchanges(fx._matches()) == 0
    assert exchanges(fx._participants()) == 0
    assert exchanges(fx._query("fx_payload_matches")) == 0 and exchanges(fx._query("fx_payload_participants")) == 0


def test_laid_out_tables_join_in_place(fx):
    from tengen.operators import games, live
    progress = live.round_progress(fx.matches, fx.matches.select("group_id", F.lit(9).alias("total_rounds")).limit(0))
    assert exchanges(games.player_schedule(fx.participants, fx.matches)) == 0
    assert exchanges(live.round_progress(fx.matches, fx.groups.select("group_id", F.lit(9).alias("total_rounds")))) == 0
    assert exchanges(games.h2h_games(fx.matches, fx.participants, fx.events)) <= 1  # events meet groups
    assert progress.columns == ["group_id", "total_rounds", "completed_rounds", "known_pairing_rounds"]


def test_own_seats_and_games_like_the_plain_sql(fx):
    for name in ("seat", "matches", "participants"):
        plain, stored = fx._query(f"fx_{name}"), fx.table(name)
        assert stored.columns == plain.columns and stored.count() == plain.count()
        assert stored.exceptAll(plain).isEmpty()


def test_totals_of_scopes_like_their_pairs(spark):
    from tengen.operators import search
    events = spark.createDataFrame(
        [(f"e{i}", "t", f"1997-{i % 12 + 1:02d}-{i % 28 + 1:02d}" + (" 09:00:00" if i % 2 else ""), ["四川省", "河北省", ""][i % 3],
          "c", "o", i % 5) for i in range(200)] + [("bad", "t", "soon", "四川省", "c", "o", 3), ("none", "t", None, None, "c", "o", 3)],
        "event_id string, title string, min_time string, provincename string, city_name string, cname string, play_num int")
    ends = ["", "1997-02-03", "1997-02-03 09:00:00", "1997-06-30", "1997-06-30 23:59:59", "1996-01-01"]
    scopes = spark.createDataFrame([(f"s{i}-{j}-{p}", p, a, b) for i, a in enumerate(ends) for j, b in enumerate(ends)
                                    for p in ("", "四川省")] + [("n", None, None, None)],
                                   "scope_id string, province string, date_from string, date_to string")
    pairs = search.events_in_scopes(events, scopes).groupBy("scope_id").agg(
        F.count(F.lit(1)).alias("events"), F.min("min_time").alias("first_time"), F.max("min_time").alias("last_time"))
    totals = search.events_in_scopes(events, scopes, totals=True)
    assert "BroadcastExchange" not in totals._jdf.queryExecution().executedPlan().toString()
    assert sorted(totals.collect()) == sorted(pairs.collect()) and totals.count() > 30


def test_trim_of_every_white_space(column):
    from tengen.functions.text import WS, trim_ws
    odd = [" 　x y ﻿\n", "", None, " \t\r\n\x0b\f", "x", "᠎ x", "     組 "]
    odd += [f"{chr(c)}a{chr(c)}" for c in [*range(1, 0x40), *range(0x2000, 0x2070), 0x85, 0xA0]]
    want = column([(v,) for v in odd], "v string", F.regexp_replace(F.coalesce("v", F.lit("")), rf"^{WS}+|{WS}+\z", ""))
    assert column([(v,) for v in odd], "v string", trim_ws("v")) == want


def test_landings_have_as_many_files_as_buckets(fx, monkeypatch, tmp_path):
    from tengen.streaming import change_log
    monkeypatch.setattr(fx, "buckets", lambda: 3, raising=False)
    change_log.land_fixture(fx, str(tmp_path))
    assert len([p for p in (tmp_path / "landing").iterdir() if p.name.endswith(".parquet")]) == 9
