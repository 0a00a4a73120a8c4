"""Semantics that are easy to lose; one small case each."""

from pyspark.sql import functions as F

from tengen.functions import dates as D
from tengen.functions import levels as L
from tengen.functions import numbers as N
from tengen.functions import ranks as K
from tengen.functions import text as X
from tengen.operators import games, live, search
from tengen.sources import landed, markup


def test_raw_upper_bound_loses_last_day(spark):
    e = spark.createDataFrame([("1", "2024-05-01 09:00:00", 3)], "event_id string, min_time string, play_num int")
    assert search.scope_filter(e, date_to="2024-05-01").count() == 0
    assert search.scope_filter(e, date_to=D.at_day_end("2024-05-01")).count() == 1


def test_like_wildcard_and_case(spark):
    rows = [("SQLITEXbusy",), ("network TimeOut",), ("no groups found",), ("http 500",), ("",)]
    df = spark.createDataFrame([("e", 5, "1999-01-01", "e", 9, m) for m, in rows],
                               "event_id string, updated_at int, min_time string, ie_event_id string, "
                               "ie_indexed_at int, ie_last_error string")
    got = [r[0] for r in df.select(search.needs_index("2000-01-01")).collect()]
    assert got == [True, True, False, True, False]


def test_empty_result_is_a_draw_but_not_played(column):
    rows = [("", "", 0.0, 0.0), ("", "", 0.0, 1.0), ("2", "", 0.0, 0.0)]
    s = "p1_result string, p2_result string, p1_score double, p2_score double"
    assert column(rows, s, N.outcome("p1_result")) == ["draw", "draw", "lose"]
    assert column(rows, s, N.is_played()) == [False, True, True]


def test_round_half_up(column):
    assert column([(-2.5,), (2.5,), (0.285,)], "x double", N.round_half_up("x", 0)) == [-2.0, 3.0, 0.0]
    assert column([(0.285,)], "x double", N.round_half_up("x", 2)) == [0.28]


def test_prefix_numbers(column):
    assert column([("12abc",), ("",), (" 7",), ("x1",), (None,)], "x string", N.parse_int("x")) == [12, None, 7, None, None]
    assert column([("1.5分",), (".5",), ("-",)], "x string", N.parse_float("x")) == [1.5, 0.5, None]


def test_dollar_does_not_match_before_newline(column):
    assert column([("3段",), ("3段\n",), ("3 段",), ("x3段",)], "x string", K.dan_of_label("x")) == [3, 0, 3, 0]


def test_plus_survives_decoding(column):
    assert column([("a+b%20c",), ("50%",), ("%FF",)], "x string", X.uri_decode("x")) == ["a+b c", "50%", "%FF"]


def test_first_text_skips_empty(column):
    assert column([("", "b"), ("a", "b"), (None, "")], "x string, y string", X.first_text("x", "y")) == ["b", "a", ""]


def test_china_time(column):
    rows = [("1970-01-01 08:00:00",), ("1970-01-02",), ("1970-01-01T09:30",), ("2024-02-30 00:00:00.123",), ("soon",), ("",)]
    assert column(rows, "x string", D.china_time_ms("x")) == [0, 57_600_000, 5_400_000, 1_709_222_400_000, None, None]


def test_label_float_tier(column):
    assert column([(25.34,)], "x double", L.level_label("x")) == ["弱1级"]


def test_time_weight_edges(column):
    rows = [("2000-06-30",), ("2000-07-01",), ("2000-05-01",), ("2000-04-30",), ("2000-01-02",), ("2000-01-01",), ("",)]
    assert column(rows, "x string", L.time_weight("x", "2000-06-30")) == [1.0, 0.0, 1.0, 0.7, 0.45, 0.0, 0.0]
    assert column(rows[:2], "x string", L.time_weight("x", "2000-06-30", L.QUICK)) == [1.0, 1.0]


def test_ladder_steps(column):
    rows = [("level", 5, "level", 1), ("level", 5, "dan", 1), ("level", 4, "dan", 1), ("dan", 1, "dan", 3), ("dan", 1, "level", 1)]
    s = "k string, c int, tk string, tc int"
    ladder = F.array(F.lit(5), F.lit(2), F.lit(1))
    assert column(rows, s, K.level_step("k", "c", "tk", "tc", ladder)) == [2, 3, None, 2, None]
    assert column(rows[:1] + rows[3:4], s, K.target_by_steps("k", "c", F.lit(3), ladder)) == ["1段", "4段"]


def test_rematch_counts_once_and_last_played_round(spark):
    m = spark.createDataFrame([("g", 1, "a", "b", "1", "2", 2.0, 0.0), ("g", 2, "b", "a", "1", "2", 2.0, 0.0),
                               ("g", 3, "a", "c", "", "", 0.0, 0.0), ("g", 4, "c", "b", "3", "3", 1.0, 1.0)],
                              "group_id string, bout int, p1_id string, p2_id string, p1_result string, p2_result string, "
                              "p1_score double, p2_score double")
    p = spark.createDataFrame([("g", x, x, "o", str(i), s, 0, 0, 0, 0) for i, (x, s) in enumerate([("a", 2.0), ("b", 3.0), ("c", 1.0)])],
                              "group_id string, participant_id string, name string, org string, short_no string, score double, "
                              "win int, lose int, draw int, cloud_rank int")
    prog = live.round_progress(m, spark.createDataFrame([], "group_id string, total_rounds int"))
    assert prog.collect()[0].asDict() == {"group_id": "g", "total_rounds": 4, "completed_rounds": 4, "known_pairing_rounds": 4}
    t = {r["participant_id"]: r for r in live.standings(p, m, prog).collect()}
    assert {k: v["opponent_score"] for k, v in t.items()} == {"a": 3.0, "b": 3.0, "c": 3.0}
    assert t["a"]["total_score"] == 0.0 and [t[k]["rank"] for k in "bac"] == [1, 2, 3]


def test_anchor_rows(spark):
    html = ('<a data-groupid="7" data-group-name="A&amp;amp;B" data-groupname="x">1</a><a data-groupid=8>2</a>'
            '<a data-groupid="7" data-groupname="again">3</a>')
    pages = spark.createDataFrame([("e", html), ("f", "<p>none</p>")], "event_id string, html string")
    got = {(r["event_id"], r["group_id"]): (r["group_name"], r["error"]) for r in markup.extract_anchor_groups(pages).collect()}
    assert got == {("e", "7"): ("x", ""), ("f", None): (None, "no groups found")}


def test_payload_states(spark):
    rows = [('cb({"error":0,"datArr":{"rows":[{"id":5,"name":"x"}]}});',), ('cb({"error":0,"datArr":"wait"})',),
            ('cb({"error":2,"msg":"no","datArr":null})',), ("not json",)]
    df = spark.createDataFrame([("e", "g", *r) for r in rows], "event_id string, group_id string, payload string")
    got = [(r["status"], r["msg"], r["row_count"]) for r in landed.jsonp_rows(df).collect()]
    assert got == [("ready", "", 1), ("wait", "", 0), ("error", "no", 0), ("error", "API error", 0)]
    assert [r["participant_id"] for r in landed.norm_participants(df).collect()] == ["5"]


def test_repeat_opponent_counts_per_game(spark):
    s = spark.createDataFrame([("e", "g", "1", "me", 1, "o", "win"), ("e", "g", "1", "me", 2, "o", "win")],
                              "event_id string, group_id string, participant_id string, participant_name string, bout int, "
                              "opponent string, result string")
    row = games.h2h_adjustment(s, games.opponent_record(s)).collect()[0]
    assert (row["h2h_games"], row["h2h_opponents"], row["h2h_adj"]) == (4, 1, 0.8)


def test_scope_holds_for_decided_and_published_promotions(fx):
    from pyspark.sql import functions as F

    from tengen.operators import promotion
    from tengen.plans.queries import _decided
    decided, evidence = _decided(fx), fx.evidence
    every = promotion.promotion_history(decided, evidence)
    name = every.groupBy("name").count().orderBy(F.desc("count"), "name").first()["name"]
    one = promotion.promotion_history(decided, evidence, name=name)
    assert one.count() == every.filter(F.col("name") == name).count() > 0
    assert one.filter(F.col("name") != name).count() == 0
    early = promotion.promotion_history(decided, evidence, date_to="1995-12-31")
    assert early.filter(F.col("date") > "1995-12-31").count() == 0
