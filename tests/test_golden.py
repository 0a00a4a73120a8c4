"""Hand-derived examples for levels, labels, quotas and rule texts."""

import pytest
from pyspark.sql import functions as F

from tengen.functions import levels as L
from tengen.functions import numbers as N
from tengen.functions import ranks as K
from tengen.functions import text as X
from tengen.operators import promotion, rules

GROUP_L = {"5级组": 21, "1-2级组": 24.5, "3~5级组": 22, "定段组": 25.3, "1段组": 26, "3段-4段组": 28, "3-5段组": 30,
           "9段组": None, "26级组": None, "低段组": 27.5, "高段组": 30, "公开组": 30.15, "启蒙组": None, "U10组": None,
           "甲组": None, "定2段组": 27, "2级升1段组": 24, "一级组": None, "3段": 28, "": None, None: None,
           "　 3 段组": 28}
LEVEL = {"5级组": ("level", 5), "1-2级组": None, "3~5级组": None, "定段组": ("level", 1), "1段组": ("dan", 1),
         "3段-4段组": None, "3-5段组": None, "9段组": None, "26级组": ("level", 26), "低段组": None, "启蒙组": None,
         "定2段组": ("dan", 1), "定1段组": ("level", 1), "2级升1段组": ("level", 2), "一级组": ("level", 1), "3段": None,
         "3 段 组": ("dan", 3), "6段一级组": ("level", 1), "5级3段组": None}
AGE = [("U8组", "全国少儿围棋锦标赛", 30.10), ("u10组", "省赛", None), ("甲组", "市围棋公开赛", 29.75),
       ("一年级甲组", "区赛", 28.40), ("初中组", "", 28.85), ("少儿A组", "四川省", 30.20), ("8岁组", "校内赛", 24.25),
       ("公开组", "市赛", None)]
LABEL = [(0.7, None), (1.0, "弱25级"), (21.0, "弱5级"), (25.3, "弱1级"), (25.34, "弱1级"), (26.67, "强1段"),
         (30.02, "弱5段"), (33.99, "强8段"), (40.0, "强8段"), (None, None)]


def test_group_level(column):
    rows = [(k,) for k in GROUP_L]
    got = column(rows, "group_name string", lambda d: L.with_group_level(d, "v"))
    assert dict(zip(GROUP_L, got)) == GROUP_L


def test_candidate_level(column):
    rows = [(k,) for k in LEVEL]
    got = column(rows, "group_name string", lambda d: K.with_candidate_level(d).select(F.col("lv").alias("v")))
    assert {k: tuple(v) if v else None for k, v in zip(LEVEL, got)} == LEVEL


def test_age_level(column):
    got = column([(a, b, "") for a, b, _ in AGE], "group_name string, title string, cname string",
                 lambda d: L.with_age_adjustment(d, "a").withColumn("v", L.event_tier("title", "cname") + F.col("a")))
    assert [None if v is None else round(v, 6) for v in got] == [c for _, _, c in AGE]


def test_level_label(column):
    assert column([(a,) for a, _ in LABEL], "x double", L.level_label("x")) == [b for _, b in LABEL]


@pytest.mark.parametrize("size,pct,mode,places", [(32, 15, "ceil", 5), (10, 15, "round", 2), (30, 15, "round", 5),
                                                  (3, 10, "round", 1), (7, 30, "floor", 2)])
def test_quota(column, size, pct, mode, places):
    assert column([(size, float(pct), mode)], "s int, p double, m string", N.quota("s", "p", "m")) == [places]


RANKED = "升段办法：1段组前30%晋升2段；2段组前3名升为3段；3段组第1名升5段。4段组冠军晋升1个段位"
LEVELS = "5级组前50%晋升2级，全胜晋升1级。2级组前50%升1级；1级组胜5盘升1段"
# notice, group, text, percent, top_n, wins, top_n_target, target, full_win_target
RULES = [
    (LEVELS, "5级组", "5级组前50%晋升2级，全胜晋升1级", 50, None, None, None, "2级", "1级"),
    (LEVELS, "2级组", "2级组前50%升1级", 50, None, None, None, "1级", None),
    (LEVELS, "1级组", "1级组胜5盘升1段", None, None, 5, None, "1段", None),
    (LEVELS, "1段组", None, None, None, None, None, None, None),
    (RANKED, "1段组", "1段组前30%晋升2段", 30, None, None, None, "2段", None),
    (RANKED, "2段组", "2段组前3名升为3段", None, 3, None, "3段", "3段", None),
    (RANKED, "3段组", "3段组第1名升5段", None, 1, None, "5段", "5段", None),
    (RANKED, "4段组", "4段组冠军晋升1个段位", None, 1, None, None, "5段", None),
    (RANKED.replace("冠军晋升", "冠军升"), "4段组", None, None, None, None, None, None, None),
    ("定段组7胜升1段", "定段组", "定段组7胜升1段", None, None, 7, None, "1段", None),
    ("%E5%8D%87%E6%AE%B5：5段组全胜晋升6段", "5段组", "5段组全胜晋升6段", None, None, None, None, "6段", "6段"),
    ("升段：5段组全胜晋升6段", "2级升1段组", None, None, None, None, None, None, None),
    ("4级组3级组前2名升1级，2级组前3名升1段", "4级组", "4级组3级组前2名升1级，", None, 2, None, "1级", "1级", None),
    # the full-win pattern is greedy and ends at the last step count
    ("5级组全胜晋升2个级别，第二名升一个级别", "5级组", "5级组全胜晋升2个级别，第二名升一个级别", None, 2, None, "2级", "1级", "2级"),
]


def test_notice_rules(spark):
    notices = spark.createDataFrame([(str(i), r[0]) for i, r in enumerate(RULES)], "event_id string, notice_text string")
    people = spark.createDataFrame([(str(i), r[1]) for i, r in enumerate(RULES)], "event_id string, group_name string")
    ladders = spark.createDataFrame([(str(i), [5, 2, 1]) for i in range(len(RULES))], "event_id string, ladder array<int>")
    got = {r["event_id"]: r["notice_rule"] for r in
           rules.notice_rules(rules.rule_groups(people), notices, ladders).collect()}
    for i, (_, group, text, *want) in enumerate(RULES):
        rule = got.get(str(i))
        if text is None:
            assert rule is None, group
        else:
            assert [rule["text"], rule["percent"], rule["top_n"], rule["wins"], rule["top_n_target"], rule["target"],
                    rule["full_win_target"]] == [text, *want], group


@pytest.mark.parametrize("targets,kept", [(["1级", "1段", "3段", "2段", "3段", "4段"], ["1级", "1段", "3段", "4段"]),
                                          (["2段", "2段", "5级", "1段"], ["2段", "5级"])])
def test_monotone_sequence(spark, targets, kept):
    rows = [("n", f"2020-01-{i + 1:02d}", f"e{i}", t, "t", "g", 0, "1", "p", "x") for i, t in enumerate(targets)]
    df = spark.createDataFrame(rows, "name string, date string, event_id string, promoted_to string, title string, "
                                     "group_name string, external int, group_id string, participant_id string, min_time string")
    got = promotion.monotone_sequence(df).orderBy("date").collect()
    assert [r["promoted_to"] for r in got] == kept


def test_clean_text(column):
    html = "<style>a{}</style><p>A&amp;B&nbsp;&lt;x&gt;</p><script>y('<p>')</script> 　 C+D%20E "
    assert column([(html,)], "h string", X.notice_text("h")) == ["A&B <x> C+D E"]
    assert column([("100%",)], "h string", X.uri_decode("h")) == ["100%"]
