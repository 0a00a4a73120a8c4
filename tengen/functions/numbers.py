"""Number Columns: prefix parsing, half-up rounding, clamps, records."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, col, text


def parse_int(c) -> Column:
    """Leading integer of a text, null when there is none."""
    return F.regexp_extract(text(c), rf"^{WS}*([+-]?\d+)", 1).try_cast("bigint")


def parse_float(c) -> Column:
    """Leading decimal number of a text, null when there is none."""
    return F.regexp_extract(
        text(c), rf"^{WS}*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def int_or_zero(c) -> Column:
    return F.coalesce(parse_int(c), F.lit(0)).cast("int")


def float_or_zero(c) -> Column:
    return F.coalesce(parse_float(c), F.lit(0.0))


def round_half_up(c, digits: int) -> Column:
    """Ties go towards +infinity, unlike Spark's round()."""
    p = float(10 ** digits)
    return F.floor(col(c) * p + 0.5) / p


def clamp(c, low, high) -> Column:
    lo = F.lit(float(low)) if not isinstance(low, Column) else low
    hi = F.lit(float(high)) if not isinstance(high, Column) else high
    # least and greatest skip nulls, so a null has to be kept by hand
    return F.when(col(c).isNotNull(), F.greatest(lo, F.least(hi, col(c))))


def rounds(win="win", lose="lose", draw="draw") -> Column:
    z = F.lit(0)
    return F.coalesce(col(win), z) + F.coalesce(col(lose), z) + F.coalesce(col(draw), z)


def record_score(win="win", lose="lose", draw="draw") -> Column:
    n = rounds(win, lose, draw)
    return F.when(n > 0, (F.coalesce(col(win), F.lit(0)) + 0.5 * F.coalesce(col(draw), F.lit(0))) / n) \
        .otherwise(F.lit(0.0))


def plain_number(c) -> Column:
    """Number as text without a trailing '.0'."""
    v = col(c).cast("double")
    return F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))


def quota(size, percent, rounding) -> Column:
    """Places from a percentage: at least one."""
    raw = col(size) * col(percent) / 100
    mode = F.coalesce(col(rounding), F.lit("ceil"))
    n = F.when(mode == "round", F.floor(raw + 0.5)).when(mode == "floor", F.floor(raw)) \
        .otherwise(F.ceil(raw))
    return F.greatest(F.lit(1).cast("bigint"), n.cast("bigint"))


def rounding_label(rounding) -> Column:
    mode = F.coalesce(col(rounding), F.lit("ceil"))
    return F.when(mode == "round", "按比例四舍五入").when(mode == "floor", "按比例向下取整") \
        .otherwise("按比例向上取整")


# fixed values: numerals used in rule texts
NUMERALS = {"一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7,
            "八": 8, "九": 9, "十": 10}


def chinese_number(c) -> Column:
    m = F.create_map(*[F.lit(x) for kv in NUMERALS.items() for x in kv])
    return F.try_element_at(m, text(c)).cast("bigint")


def step_count(c) -> Column:
    n = parse_int(c)
    return F.when(n > 0, n).otherwise(chinese_number(c))


def outcome(result) -> Column:
    return F.when(col(result) == "1", "win").when(col(result) == "2", "lose").otherwise("draw")


def outcome_points(result) -> Column:
    return F.when(col(result) == "1", 1.0).when(col(result) == "2", 0.0).otherwise(0.5)


def is_result_code(c) -> Column:
    return F.coalesce(col(c).isin("1", "2", "3"), F.lit(False))


def is_played(p1_result="p1_result", p2_result="p2_result", p1_score="p1_score",
              p2_score="p2_score") -> Column:
    z = F.lit(0.0)
    return is_result_code(p1_result) | is_result_code(p2_result) \
        | (F.coalesce(col(p1_score), z) > 0) | (F.coalesce(col(p2_score), z) > 0)
