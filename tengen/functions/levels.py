"""Playing-strength Columns on the L scale: 25级 = 1 … 1级 = 25, 1段 = 26 … 8段 = 33."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .dates import as_date
from .numbers import clamp, rounds
from .text import WS, col, date10, event_text, text, trim_ws

# ---- fixed values -----------------------------------------------------------

NOT_RATED = "启蒙|吃子|入门|幼儿|棋趣"
AGE_NOT_RATED = "启蒙|吃子|入门"
FIXED_DAN_L = 25.3
LOW_DAN_L = 27.5
HIGH_DAN_L = 30.0


@dataclass(frozen=True)
class Model:
    """One estimator's constants."""

    open_l: float
    age_gate: str
    tiers: tuple
    tier_default: float
    grades: tuple
    high_grade: float
    middle_school: float
    letters: tuple
    ages: tuple
    age_above: float
    win_rate_factor: float
    skill_offset: float
    open_gain: float
    open_loss: float
    open_floor: float | None
    time_steps: tuple
    future_weight: float | None
    event_weights: tuple


GRAPH = Model(
    open_l=30.15,
    age_gate=(r"[一二三四五六]年级|低年级|高年级|小学.*组|儿童.*组|少儿.*组|初中|中学生?组|U\d+|\d+"
              + WS + "*岁|[甲乙丙丁ABCDＡＢＣＤ]组"),
    tiers=(("全国|国际", 29.85), ("省", 29.35), ("市", 28.85), ("区|县", 27.5),
           ("学校|班级|校内", 24.0)),
    tier_default=27.5,
    grades=(("一", 0.0), ("二", 0.25), ("三", 0.5), ("四", 0.75), ("五", 1.0), ("六", 1.25)),
    high_grade=0.9,
    middle_school=1.35,
    letters=(("甲组", 0.9), ("乙组", 0.55), ("丙组", 0.2), ("丁组", 0.0),
             ("[AＡ]组", 0.85), ("[BＢ]组", 0.45), ("[CＣ]组", 0.15), ("[DＤ]组", 0.0)),
    ages=((7, 0.0), (9, 0.25), (11, 0.6), (13, 1.0)),
    age_above=1.35,
    win_rate_factor=1.5,
    skill_offset=0.35,
    open_gain=0.75,
    open_loss=0.6,
    open_floor=29.2,
    time_steps=((60, 1.0), (120, 0.7), (180, 0.45)),
    future_weight=None,
    event_weights=(("全国|国际|中国围棋协会", 1.45),
                   ("省级|省赛|省锦标|全省|省围棋|省青少年", 1.30),
                   ("市级|市锦标|全市|市围棋", 1.15)),
)

QUICK = Model(
    open_l=30.2,
    age_gate=(r"[一二三四五六]年级|低年级|高年级|小学生?组|初中|中学生?组|U\d+|\d+" + WS
              + "*岁|[甲乙丙丁]组"),
    tiers=(("全国|国际", 31.0), ("省", 30.0), ("市", 30.0), ("区|县", 28.0),
           ("学校|班级|校内", 24.5)),
    tier_default=28.0,
    grades=(("一", 0.0), ("二", 0.3), ("三", 0.6), ("四", 0.9), ("五", 1.2), ("六", 1.5)),
    high_grade=1.0,
    middle_school=1.5,
    letters=(("甲组", 1.0), ("乙组", 0.6), ("丙组", 0.2), ("丁组", 0.0)),
    ages=((7, 0.0), (9, 0.3), (11, 0.7), (13, 1.1)),
    age_above=1.5,
    win_rate_factor=2.0,
    skill_offset=0.5,
    open_gain=1.0,
    open_loss=0.75,
    open_floor=None,
    time_steps=((90, 1.0), (180, 0.4)),
    future_weight=1.0,
    event_weights=(("全国|国际|中国围棋协会", 1.6),
                   ("省级|省赛|省锦标|全省|省围棋", 1.4),
                   ("市级|市锦标|全市|市围棋", 1.2)),
)

LOW_GRADE = 0.2


# ---- Columns ----------------------------------------------------------------


def _number(src: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(src, pattern, group).try_cast("double")


def _ladder(pairs, test, default: Column) -> Column:
    """First matching rule wins."""
    out = None
    for key, value in pairs:
        out = F.when(test(key), F.lit(float(value))) if out is None \
            else out.when(test(key), F.lit(float(value)))
    return out.otherwise(default)


def is_open_group(group_name) -> Column:
    return F.contains(text(group_name), F.lit("公开"))


def with_group_level(df: DataFrame, out: str = "group_l", model: Model = GRAPH) -> DataFrame:
    """L of a skill group from group_name, null when the name carries no level.

    Parts are computed once as columns; one nested expression would repeat each
    regex for every branch that looks at it.
    """
    band = rf"(\d+){WS}*[~\-－—至到]{WS}*(\d+){WS}*级"
    g = F.col("_g")
    level = (
        F.when(g.rlike(NOT_RATED), F.lit(None).cast("double"))
        .when(F.contains(g, F.lit("定段")), F.lit(FIXED_DAN_L))
        .when(F.col("_low").isNotNull(), ((26 - F.col("_low")) + (26 - F.col("_high"))) / 2)
        .when(F.col("_kyu").between(1, 25), 26 - F.col("_kyu"))
        .when(F.col("_dan").between(1, 8), 25 + F.col("_dan"))
        .when(F.contains(g, F.lit("低段")), F.lit(LOW_DAN_L))
        .when(F.contains(g, F.lit("高段")), F.lit(HIGH_DAN_L))
        .when(is_open_group(g), F.lit(model.open_l))
    )
    return df.withColumn("_g", trim_ws("group_name")).withColumns({
        "_low": _number(g, band, 1), "_high": _number(g, band, 2),
        "_kyu": _number(g, rf"(\d+){WS}*级"), "_dan": _number(g, rf"(\d+){WS}*段")}) \
        .withColumn(out, level).drop("_g", "_low", "_high", "_kyu", "_dan")


def event_tier(title, organizer, model: Model = GRAPH) -> Column:
    """Base L of age groups at an event, by its reach."""
    return _ladder(model.tiers, event_text(title, organizer).rlike, F.lit(model.tier_default))


def with_age_adjustment(df: DataFrame, out: str = "age_adj", model: Model = GRAPH) -> DataFrame:
    """What an age or school-grade group_name adds to its event's tier, null for other groups."""
    g = F.col("_g")
    grade = _ladder([(k + "年级", v) for k, v in model.grades],
                    lambda k: F.contains(g, F.lit(k)), F.lit(0.0))
    by_grade = F.when(g.rlike("初中|中学生"), F.lit(model.middle_school)) \
        .when(F.contains(g, F.lit("高年级")), F.lit(model.high_grade)) \
        .when(F.contains(g, F.lit("低年级")), F.lit(LOW_GRADE)).otherwise(grade)
    # a division letter counts only while no grade has set a value; a letter worth 0 is no value
    letter = _ladder([kv for kv in model.letters if kv[1]], g.rlike, F.lit(0.0))
    age = F.coalesce(_number(g, r"(?i)U(\d+)"), _number(g, rf"(\d+){WS}*岁"))
    by_age = _ladder(model.ages, lambda limit: F.col("_age") <= limit, F.lit(model.age_above))
    adj = F.when(F.col("_age").isNotNull(), by_age).when(F.col("_grade") == 0, letter).otherwise(F.col("_grade"))
    return df.withColumn("_g", trim_ws("group_name")).withColumns({"_age": age, "_grade": by_grade}) \
        .withColumn(out, F.when(g.rlike(model.age_gate) & ~g.rlike(AGE_NOT_RATED), adj)) \
        .drop("_g", "_age", "_grade")


def name_features(entries: DataFrame, model: Model = GRAPH) -> DataFrame:
    """skill_l and age_adj of every distinct group_name.

    Names repeat for every seat, so the text rules run on the distinct names only.
    The table is stored: its real size then decides whether a join may broadcast it.
    """
    names = entries.select("group_name").distinct()
    return stage(with_age_adjustment(with_group_level(names, "skill_l", model), "age_adj", model), "names")


def win_rate_adj(win, lose, draw, model: Model = GRAPH) -> Column:
    n = rounds(win, lose, draw)
    rate = (F.coalesce(col(win), F.lit(0)) + 0.5 * F.coalesce(col(draw), F.lit(0))) / n
    return F.when(n == 0, F.lit(0.0)).otherwise(model.win_rate_factor * (rate - 0.5))


def time_weight(time_text, as_of, model: Model = GRAPH) -> Column:
    """Weight by age in days at as_of (a 'YYYY-MM-DD' text or a date Column)."""
    end = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    days = F.datediff(end, as_date(time_text))
    steps = F.when(days.isNull(), F.lit(0.0))
    steps = steps.when(days < 0, F.lit(model.future_weight or 0.0))
    for limit, w in model.time_steps:
        steps = steps.when(days <= limit, F.lit(w))
    return steps.otherwise(F.lit(0.0))


def event_weight(title, organizer, model: Model = GRAPH) -> Column:
    return _ladder(model.event_weights, event_text(title, organizer).rlike, F.lit(1.0))


def level_label(value) -> Column:
    v = clamp(value, 0.5, 33.99)
    base = F.floor(v)
    frac = v - base
    tier = F.when(frac < 0.34, "弱").when(frac < 0.67, "普通").otherwise("强")
    return F.when(base.between(1, 25), F.concat(tier, (26 - base).cast("string"), F.lit("级"))) \
        .when(base.between(26, 33), F.concat(tier, (base - 25).cast("string"), F.lit("段")))


def with_event_features(events: DataFrame, as_of: str, model: Model = GRAPH) -> DataFrame:
    """Weights and tier of each event, worked out on the small side before any join."""
    return events.withColumns({
        "tier": event_tier("title", "cname", model), "time_weight": time_weight("min_time", as_of, model),
        "event_weight": event_weight("title", "cname", model)})


def with_entry_features(entries: DataFrame, model: Model = GRAPH) -> DataFrame:
    """Add group L, base and flags to entries joined with name and event features.

    base is null where the entry cannot be used.
    """
    df = entries.withColumns({
        "group_l": F.coalesce(F.col("skill_l"), F.col("tier") + F.col("age_adj")), "rounds": rounds(),
        "is_age_group": F.col("skill_l").isNull() & F.col("age_adj").isNotNull(),
        "is_open": F.col("skill_l").isNotNull() & is_open_group("group_name"),
        "wr_adj": win_rate_adj("win", "lose", "draw", model)})
    adj = F.when(F.col("is_open") & (F.col("wr_adj") > 0), F.col("wr_adj") * model.open_gain) \
        .when(F.col("is_open") & (F.col("wr_adj") < 0), F.col("wr_adj") * model.open_loss) \
        .otherwise(F.col("wr_adj"))
    df = df.withColumn("wr_adj", adj)
    base = F.col("group_l") + F.when(F.col("is_age_group"), F.lit(0.0)) \
        .otherwise(F.lit(model.skill_offset)) + F.col("wr_adj")
    df = df.withColumn("base", F.when((F.col("rounds") > 0) & F.col("group_l").isNotNull(), base))
    if model.open_floor is not None:
        df = df.withColumn("base", F.when(F.col("is_open") & F.col("base").isNotNull(), F.greatest(
            "base", F.lit(model.open_floor))).otherwise(F.col("base")))
    return df.drop("skill_l", "age_adj", "tier")
