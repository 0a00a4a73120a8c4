"""Promotion Columns: candidate level, ladders, steps, targets, event flags, rule texts."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import chinese_number, step_count
from .text import WS, col, event_text, strip_ws, text

# ---- fixed values -----------------------------------------------------------

MIXED_A = r"\d+[段级]?[-—－~～至到]\d+[段级]"
MIXED_B = r"\d+[段级][-—－~～至到]\d+[段级]?"
MENTION = r"(\d*[1-9]\d*)([段级])"
UPGRADE = r"^(\d+)级升\d+段.*组"
FIXED = r"^定(\d+)段.*组"

PROVINCES = ("四川省", "河北省")
RANK_EVENT = "段级位赛|段位赛"
RANK_EVENT_BAR = "公开赛|网赛|公益|争霸赛|邀请赛|联赛"
RANK_EVENT_HOST = "省|围棋协会|棋院|段位赛|段级位赛|级位赛"
PUBLIC_TITLE = "公开赛|冠军赛|大奖赛|争霸赛"
PUBLIC_HOST = "围棋(?:爱好者)?协会|棋类协会|棋院|智力运动中心|体育局"
CASUAL = "公益|慈善|网赛|网络赛|线上|邀请赛|交流赛|联谊"
INFERABLE = "段级位赛|段位赛|级位赛|定级|定段"

STRICT_WORDS = r"升段|升级|晋升|升为|升至|升\d+[段级]|申请\d+级"
LOOSE_WORDS = STRICT_WORDS + "|段位|级位"
NARROW_CUES = r"%|晋升|升为|升至|申请|前\d+名|第\d+名|\d+胜"
NEXT_GROUP = rf"(\d+{WS}*[段级]组)"

FULL_WIN = r"(?:全胜|\d+连胜)[^。；;]*(?:跳升|晋升|升)"
RAISE = r"(?:晋升|升)"
TO_LABEL = r"(?:为|至)?(\d+)(段|级)"
STEPS = r"([一二两三\d]+)个"
RE_FULL_TARGET = FULL_WIN + TO_LABEL
RE_FULL_STEPS = FULL_WIN + STEPS + "级别"
RE_TOP_TARGET = r"(?:第(\d+)名|前(\d+)名)[^。；;]*" + RAISE + TO_LABEL
RE_TOP_STEPS = (r"(?:各组)?(?:第(\d+)名|第([一二三四五六七八九十]+)名|第一)[^。；;]*" + RAISE + STEPS
                + "(?:级别|段位)")
RE_TARGET = RAISE + TO_LABEL
RE_APPLY = r"申请(\d+)(级)"
RE_PERCENT = r"(?:前|按|按照)?(\d+(?:\.\d+)?)%"
RE_TOP = r"前(\d+)名"
RE_WINS_A = r"胜(\d+)盘"
RE_WINS_B = r"(\d+)胜"
RE_STEPS = RAISE + STEPS + "(?:级别|段位)"
RE_ONE = r"(?:晋升|升)(?:为)?(?:1|一)个(?:级别|段位)|(?:晋升|升)(?:1|一)个"

# ---- levels -----------------------------------------------------------------


def with_candidate_level(df: DataFrame) -> DataFrame:
    """Add lv, struct(kind, current) of the level a group_name starts from, null when unclear."""
    g = F.col("_g")
    n = {k: F.col(k) for k in ("_fixed", "_up", "_count", "_n", "_lead_dan", "_lead_kyu")}
    single = (n["_count"] == 1)
    mixed = g.rlike(MIXED_A) | g.rlike(MIXED_B) | (n["_count"] > 1)
    usable = F.contains(g, F.lit("组"))
    rule = (
        F.when(~usable, 0).when(n["_fixed"] == 1, 1).when(n["_fixed"].between(2, 6), 2)
        .when(n["_up"].isNotNull(), 3).when(mixed, 0)
        .when(single & (F.col("_unit") == "段") & n["_n"].between(1, 5), 4)
        .when(single & (F.col("_unit") == "级"), 5)
        .when(n["_lead_dan"].between(1, 5), 6).when(n["_lead_kyu"].isNotNull(), 7)
        .when(g.rlike("一级组|定段组"), 1).otherwise(0))
    r = F.col("_rule")
    current = F.when(r == 1, F.lit(1)).when(r == 2, n["_fixed"] - 1).when(r == 3, n["_up"]) \
        .when(r.isin(4, 5), n["_n"]).when(r == 6, n["_lead_dan"]).when(r == 7, n["_lead_kyu"])
    kind = F.when(r.isin(2, 4, 6), "dan").otherwise("level")

    def number(pattern):
        return F.regexp_extract(g, pattern, 1).try_cast("int")
    return df.withColumn("_g", strip_ws("group_name")).withColumns({
        "_fixed": number(FIXED), "_up": number(UPGRADE), "_count": F.regexp_count(g, F.lit(MENTION)),
        "_n": number(MENTION), "_unit": F.regexp_extract(g, MENTION, 2),
        "_lead_dan": number(r"^(\d+)段.*组"), "_lead_kyu": number(r"^(\d+)级.*组")}) \
        .withColumn("_rule", rule) \
        .withColumn("lv", F.when(r > 0, F.struct(kind.alias("kind"), current.alias("current")))) \
        .drop("_g", "_unit", "_rule", *n)


def level_text(kind, current) -> Column:
    return F.concat(col(current).cast("string"),
                    F.when(col(kind) == "dan", "段").otherwise("级"))


def ladder_index(ladder, level) -> Column:
    """Zero-based place of a level in the event's ladder, null when absent."""
    pos = F.array_position(col(ladder), col(level).cast("int"))
    return F.when(pos > 0, pos - 1)


def level_step(kind, current, to_kind, to_current, ladder) -> Column:
    k, tk = col(kind), col(to_kind)
    here, there = ladder_index(ladder, current), ladder_index(ladder, to_current)
    return (
        F.when((k == "dan") & (tk == "dan"), (col(to_current) - col(current)).cast("bigint"))
        .when((k == "level") & (tk == "level"), there - here)
        .when((k == "level") & (tk == "dan"),
              (F.size(col(ladder)) - here) + (col(to_current) - 1))
    )


def target_by_steps(kind, current, steps, ladder) -> Column:
    n = col(steps)
    place = ladder_index(ladder, current) + n
    size = F.size(col(ladder))
    up = F.when(place < size, F.concat(
        F.get(col(ladder), place.cast("int")).cast("string"), F.lit("级"))) \
        .when(place >= size, F.concat((place - size + 1).cast("string"), F.lit("段")))
    return F.when(n > 0, F.when(col(kind) == "dan", F.concat(
        (col(current) + n).cast("string"), F.lit("段"))).otherwise(up))


def dan_of_label(label) -> Column:
    """Dan number of a label such as 3段, 0 for anything else."""
    return F.coalesce(F.regexp_extract(text(label), rf"^(\d+){WS}*段\z", 1).try_cast("int"), F.lit(0))


# ---- event flags ------------------------------------------------------------


def _about(title, organizer, city) -> Column:
    return event_text(title, organizer, city)


def is_rank_event(province, title, organizer, city) -> Column:
    t = _about(title, organizer, city)
    return col(province).isin(*PROVINCES) & F.contains(t, F.lit("围棋")) & t.rlike(RANK_EVENT) \
        & ~t.rlike(RANK_EVENT_BAR) & t.rlike(RANK_EVENT_HOST)


def is_backed_public_event(province, title, organizer, city) -> Column:
    t = _about(title, organizer, city)
    return col(province).isin(*PROVINCES) & F.contains(t, F.lit("围棋")) \
        & text(title).rlike(PUBLIC_TITLE) & t.rlike(PUBLIC_HOST)


def is_casual_event(title, organizer, city) -> Column:
    return _about(title, organizer, city).rlike(CASUAL)


def is_inferable_event(province, title, organizer, city) -> Column:
    """Before the check for an explicit rule: a rank event by name or a backed public one."""
    return _about(title, organizer, city).rlike(INFERABLE) \
        | is_backed_public_event(province, title, organizer, city)


# ---- rule texts -------------------------------------------------------------


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once and hand it to body; keeps nested text expressions small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def notice_fragments(notice) -> Column:
    """Rule-bearing fragments of a clean notice, in order.

    The loose vocabulary counts only when no fragment uses the strict one.
    """
    def choose(loose):
        return bind(F.filter(loose, lambda f: f.rlike(STRICT_WORDS)),
                    lambda strict: F.when(F.size(strict) > 0, strict).otherwise(loose))
    parts = F.split(strip_ws(notice), "[。；;]")
    return bind(F.filter(parts, lambda f: f.rlike(LOOSE_WORDS)), choose)


def group_labels(group_name, kind, current) -> Column:
    """The names under which a notice may mention the group."""
    g = strip_ws(group_name)
    fixed = F.regexp_extract(g, r"^定(\d+)段", 1)
    labels = F.when(fixed != "", F.array(g, F.concat(F.lit("定"), fixed, F.lit("段组")),
                                         F.concat(F.lit("定"), fixed, F.lit("段")))) \
        .otherwise(F.array(g, F.concat(level_text(kind, current), F.lit("组"))))
    return F.array_distinct(F.filter(labels, lambda x: x != ""))


def matching_fragments(fragments, labels) -> Column:
    return F.filter(col(fragments), lambda f: F.exists(col(labels), lambda x: F.contains(f, x)))


def narrow_fragment(fragment, labels) -> Column:
    """From the earliest label up to the next group named after a rule cue."""
    f = col(fragment)
    found = F.filter(
        F.transform(col(labels), lambda x: F.struct(
            F.position(x, f).alias("at"), (-F.length(x)).alias("neg_len"), x.alias("label"))),
        lambda s: s["at"] > 0)

    def cut(label, parts):
        ends = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)) \
            .otherwise(F.array().cast("array<int>"))
        heads = F.transform(ends, lambda k: F.concat(label, F.array_join(F.slice(parts, F.lit(1), k), "")))
        return F.coalesce(F.get(F.filter(heads, lambda h: h.rlike(NARROW_CUES)), F.lit(0)),
                          F.concat(label, F.array_join(parts, "")))

    def from_label(first):
        tail = F.substring(f, first["at"] + F.length(first["label"]), F.length(f))
        return bind(F.split(F.regexp_replace(tail, NEXT_GROUP, "\u0001$1"), "\u0001"),
                    lambda parts: cut(first["label"], parts))
    return F.coalesce(bind(F.array_min(found), from_label), f)


def _label(src: Column, pattern: str, at: int = 1) -> Column:
    n = F.regexp_extract(src, pattern, at).try_cast("bigint")
    return F.when(n.isNotNull(), F.concat(n.cast("string"), F.regexp_extract(src, pattern, at + 1)))


def _positive(src: Column, pattern: str) -> Column:
    """First number of the pattern; zero counts as missing."""
    n = F.regexp_extract(src, pattern, 1).try_cast("double")
    return F.when(n != 0, n)


def with_rule_fields(df: DataFrame) -> DataFrame:
    """Add the rule stated by a narrowed fragment (columns fragment, kind, current, ladder)."""
    t = F.col("fragment")

    def part(pattern, i):
        return F.regexp_extract(t, pattern, i)

    df = df.withColumns({
        "_tt_n": F.coalesce(part(RE_TOP_TARGET, 1).try_cast("double"), part(RE_TOP_TARGET, 2).try_cast("double")),
        "_tt_to": part(RE_TOP_TARGET, 3).try_cast("bigint"), "_tt_unit": part(RE_TOP_TARGET, 4),
        "_ts_all": part(RE_TOP_STEPS, 0), "_ts_n": part(RE_TOP_STEPS, 1).try_cast("bigint"),
        "_ts_cn": part(RE_TOP_STEPS, 2), "_ts_up": part(RE_TOP_STEPS, 3),
        "_steps": part(RE_STEPS, 1), "_full_steps": part(RE_FULL_STEPS, 1),
        "_top": _positive(t, RE_TOP), "percent": _positive(t, RE_PERCENT),
        "wins": F.when(t.rlike(RE_WINS_A), _positive(t, RE_WINS_A)).otherwise(_positive(t, RE_WINS_B)),
        "_target": F.coalesce(_label(t, RE_TARGET), _label(t, RE_APPLY)),
        "_full_target": _label(t, RE_FULL_TARGET)})
    rank = F.when(F.contains("_ts_all", F.lit("第一")), F.lit(1).cast("bigint")) \
        .when(F.col("_ts_n") > 0, F.col("_ts_n")).otherwise(chinese_number("_ts_cn"))
    df = df.withColumns({
        "_has_tt": F.coalesce((F.col("_tt_n") > 0) & (F.col("_tt_to") > 0), F.lit(False)),
        "_ts_rank": rank, "_ts_up": step_count("_ts_up"), "_full_steps": step_count("_full_steps"),
        "_steps": F.coalesce(step_count("_steps"), F.when(t.rlike(RE_ONE), F.lit(1).cast("bigint")))})
    df = df.withColumn("_has_ts", F.coalesce(
        (F.col("_ts_all") != "") & (F.col("_ts_rank") > 0) & (F.col("_ts_up") > 0), F.lit(False)))

    def steps_to(n):
        return target_by_steps("kind", "current", n, "ladder")
    top_n = F.coalesce(F.when(F.col("_has_tt"), F.col("_tt_n")),
                       F.when(F.col("_has_ts"), F.col("_ts_rank").cast("double")), F.col("_top"))
    df = df.withColumns({
        "top_n": F.coalesce(top_n, F.when(F.contains(t, F.lit("冠军")), F.lit(1.0))),
        "top_n_target": F.coalesce(
            F.when(F.col("_has_tt"), F.concat(F.col("_tt_to").cast("string"), F.col("_tt_unit"))),
            F.when(F.col("_has_ts"), steps_to("_ts_up"))),
        "target": F.coalesce(F.col("_target"), steps_to("_steps")),
        "full_win_target": F.coalesce(F.col("_full_target"), steps_to("_full_steps"))})
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def has_rule(rule) -> Column:
    """Any field of a rule struct is set (zero counts as missing)."""
    r = col(rule)
    return F.coalesce(
        (F.coalesce(r["percent"], F.lit(0)) > 0) | (F.coalesce(r["top_n"], F.lit(0)) > 0)
        | (F.coalesce(r["wins"], F.lit(0)) > 0) | (text(r["target"]) != "")
        | (text(r["full_win_target"]) != "") | (text(r["top_n_target"]) != ""), F.lit(False))


