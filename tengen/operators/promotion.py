"""Promotion history of every player."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranks as K
from ..functions.dates import at_day_end
from ..functions.numbers import rounds
from ..functions.text import date10, date_only, record_text, shorten, text
from ..session import stage
from . import rules
from .search import ALL, DETAIL_BASE, entries_view

KEY = ["event_id", "group_id", "participant_id"]
ARGS = ("provincename", "title", "cname", "city_name")


def levelled(candidates: DataFrame, levels: DataFrame, events: DataFrame, seats: DataFrame | None = None) -> DataFrame:
    """Entries whose group states one clear level (levels as of rules.level_names), with event flags.

    The keyword tests run once per event, not once per entry. seats(event_id, group_id): every entry's group; with it flags go to
    the groups, and entries (each of which needs a group then) meet them by group.
    """
    flags = event_flags(events).drop("title")
    c = candidates.join(levels, "group_name")
    return c.join(flags, "event_id") if seats is None else c.join(entries_view(seats, flags), ["event_id", "group_id"])


def event_flags(events: DataFrame) -> DataFrame:
    """Keyword classes of an event that gate rules and inference."""
    return events.select(
        "event_id", "title", K.is_rank_event(*ARGS).alias("rank_event"),
        K.is_backed_public_event(*ARGS).alias("backed_public_event"),
        K.is_casual_event("title", "cname", "city_name").alias("casual_event"),
        (~K.is_casual_event("title", "cname", "city_name") & K.is_inferable_event(*ARGS)).alias("inferable_event"))


def _record_ok(step: Column) -> Column:
    """Record strong enough to accept a later, higher group as evidence."""
    n, win, lose = rounds(), F.coalesce("win", F.lit(0)), F.coalesce("lose", F.lit(0))
    rate = (win + 0.5 * F.coalesce("draw", F.lit(0))) / n
    placed = (F.col("rank") > 0) & (F.col("group_size") > 0) & (F.col("rank") <= F.ceil(F.col("group_size") * 0.35))
    strong = (n >= 5) & ((rate >= 0.75) | placed)
    return F.coalesce(strong | ((step == 1) & (n >= 5) & (win > lose) & (rate >= 2 / 3)), F.lit(False))


def next_decisive_entry(undecided: DataFrame, candidates: DataFrame) -> DataFrame:
    """For each undecided entry the first later entry of the player with a defined step.

    A step from a dan is defined towards any dan; from a level, towards a dan or a
    level of the event's ladder. So every entry asks for the next use of a few
    "marks" (dan, or one level). Per player and mark, all entries first collapse to
    one row per time; the look-ahead then runs over distinct times only, whatever
    the number of entries a name has. No pairs of entries are formed.
    """
    def mark(kind, current):
        return F.when(kind == "dan", F.lit("dan")).otherwise(current.cast("string"))

    later = candidates.filter(~F.col("casual_event")).groupBy(
        "participant_name", mark(F.col("lv.kind"), F.col("lv.current")).alias("mark"), "min_time").agg(
            F.min(F.struct("event_id", "group_id", "participant_id", F.col("lv.kind").alias("kind"),
                           F.col("lv.current").alias("current"))).alias("entry"))
    in_ladder = K.ladder_index("ladder", F.col("lv.current")).isNotNull()
    marks = F.when(F.col("lv.kind") == "dan", F.array(F.lit("dan"))) \
        .when(in_ladder, F.concat(F.array(F.lit("dan")), F.transform("ladder", lambda n: n.cast("string")))) \
        .otherwise(F.array().cast("array<string>"))
    asked = undecided.select(*KEY, "participant_name", "min_time", F.explode(marks).alias("mark"))
    times = asked.select("participant_name", "mark", "min_time").distinct()
    timeline = later.unionByName(times, allowMissingColumns=True) \
        .groupBy("participant_name", "mark", "min_time").agg(F.first("entry", ignorenulls=True).alias("entry"))
    ahead = Window.partitionBy("participant_name", "mark").orderBy(F.desc("min_time")) \
        .rowsBetween(Window.unboundedPreceding, -1)
    nxt = timeline.withColumn("hit", F.when(F.col("entry").isNotNull(), F.struct(
        F.col("min_time").alias("at"), F.col("entry")))) \
        .withColumn("hit", F.last("hit", ignorenulls=True).over(ahead)) \
        .filter(F.col("hit").isNotNull()).select("participant_name", "mark", "min_time", "hit")
    return asked.join(nxt, ["participant_name", "mark", "min_time"]).groupBy(*KEY) \
        .agg(F.min("hit").alias("hit")) \
        .select(*KEY, F.col("hit.at").alias("later_time"), F.col("hit.entry.event_id").alias("later_event_id"),
                F.col("hit.entry.group_id").alias("later_group_id"),
                F.col("hit.entry.kind").alias("later_kind"), F.col("hit.entry.current").alias("later_current"))


def later_group_inference(decided: DataFrame) -> DataFrame:
    """Promotions shown by the player's next decisive entry, for entries without one by rule.

    decided: all levelled entries with lv, ladder, rule and decision.
    """
    open_rows = decided.filter(~F.coalesce(F.col("decision.promoted"), F.lit(False))) \
        .filter(~F.col("casual_event") & (F.col("inferable_event") | K.has_rule("rule")))
    hit = next_decisive_entry(open_rows, decided)
    step = K.level_step(F.col("lv.kind"), F.col("lv.current"), F.col("later_kind"), F.col("later_current"), "ladder")
    return open_rows.join(hit, KEY).withColumn("step", step).withColumn(
        "inferred", F.col("step").between(1, 2) & _record_ok(F.col("step"))) \
        .withColumn("inferred_target", F.when(F.col("inferred"), K.level_text("later_kind", "later_current")))


def decide(candidates: DataFrame, groups: DataFrame, notices, confirmed, event_groups,
           confirmed_public: DataFrame | None = None, seats: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """Entries (groups as of rules.rule_groups) with ladder, chosen rule and decision, stored: three later steps read them.

    With seats (as of rules.with_rule) entries are worked out where they lie; with buckets they are stored so, by group.
    """
    ladders = rules.level_ladder(event_groups)
    rows = rules.with_rule(candidates, groups, notices, confirmed, ladders, confirmed_public, seats)
    if seats is None:
        rows = rows.join(ladders, "event_id", "left")
    return stage(rules.promotion_decision(rows), "decided", *([("group_id", buckets)] if buckets else []))


_OUT = ["name", "event_id", "title", "date", "province", "city", "organizer", "group_name", "rank",
        "group_size", "win", "lose", "draw", "score", "promoted_to", "confidence", "basis", "rule_text",
        "source", "detail_url", "group_id", "participant_id", "min_time", "external"]


def _item(df: DataFrame, promoted_to, confidence, basis, rule_text, source) -> DataFrame:
    return df.select(
        F.col("participant_name").alias("name"), "event_id", "title", date10("min_time").alias("date"),
        F.col("provincename").alias("province"), F.col("city_name").alias("city"), F.col("cname").alias("organizer"),
        "group_name", "rank", "group_size", "win", "lose", "draw", "score", promoted_to.alias("promoted_to"),
        F.lit(confidence).alias("confidence"), basis.alias("basis"), rule_text.alias("rule_text"),
        source.alias("source"),
        F.concat(F.lit(DETAIL_BASE), F.col("event_id"), F.lit(".html#groupID="), F.col("group_id")).alias("detail_url"),
        "group_id", "participant_id", "min_time", F.lit(0).alias("external"))


def external_evidence(evidence: DataFrame, name=None, province=None, date_from=None, date_to=None) -> DataFrame:
    """Published promotion lists in the shape of history items."""
    e = evidence
    if name is not None:
        e = e.filter(F.col("name") == name)
    if province and province != ALL:
        e = e.filter(F.col("province") == province)
    low, high = date_only(F.lit(date_from or "")), date_only(F.lit(date_to or ""))
    e = e.filter((F.col("date") >= F.when(low == "", "0000-01-01").otherwise(low))
                 & (F.col("date") <= F.when(high == "", "9999-12-31").otherwise(high)))
    none = F.lit(None).cast("int")
    return e.select(
        "name", "event_id", "title", "date", "province", "city", "organizer", "group_name",
        F.lit(0).alias("rank"), F.lit(0).alias("group_size"), none.alias("win"), none.alias("lose"),
        none.alias("draw"), F.lit("").alias("score"), "promoted_to", F.lit("高").alias("confidence"),
        F.lit("").alias("basis"), F.lit("").alias("rule_text"), "source",
        (text("detail_url") if "detail_url" in evidence.columns else F.lit("")).alias("detail_url"),
        F.lit("").alias("group_id"), F.lit("").alias("participant_id"), F.col("date").alias("min_time"),
        F.lit(1).alias("external"))


def evidence_union(decided: DataFrame, evidence: DataFrame, **scope) -> DataFrame:
    """Promotions by rule, by later entries and by published lists."""
    by_rule = _item(decided.filter("decision.promoted"), F.col("decision.target"), "高", F.col("decision.basis"),
                    F.col("rule.text"), F.coalesce("rule.source", F.lit("notice")))
    later = _item(later_group_inference(decided).filter("inferred"), F.col("inferred_target"), "中",
                  F.lit(""), F.lit(""), F.lit("subsequent-group"))
    return by_rule.unionByName(later).unionByName(external_evidence(evidence, **scope)).select(*_OUT)


def _arrival() -> list[Column]:
    return [F.col("external"), F.desc("min_time"), F.col("event_id"), F.col("group_id"), F.col("participant_id")]


def dedupe_first(items: DataFrame) -> DataFrame:
    """First of equal (name, date, title, group, target); limited to one before the shuffle."""
    w = Window.partitionBy("name", "date", "title", "group_name", "promoted_to").orderBy(*_arrival())
    return items.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == 1).drop("_n")


def monotone_sequence(items: DataFrame) -> DataFrame:
    """Keep a dan promotion only above every earlier one; other promotions always stay.

    Only the first item of each (name, dan) can survive, so items collapse to those
    by aggregation and the running maximum sees at most one row per dan.
    """
    rows = items.withColumn("dan", K.dan_of_label("promoted_to"))
    place = F.struct("date", "event_id", "external", "group_id", "participant_id", "promoted_to", "title", "group_name")
    rest = [c for c in items.columns if c != "name"]
    firsts = rows.filter(F.col("dan") > 0).groupBy("name", "dan").agg(
        F.min(place).alias("place"), F.min_by(F.struct(*rest), place).alias("item"))
    before = Window.partitionBy("name").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    kept = firsts.withColumn("best", F.coalesce(F.max("dan").over(before), F.lit(0))) \
        .filter(F.col("dan") > F.col("best")).select("name", "item.*").select(*items.columns)
    return kept.unionByName(rows.filter(F.col("dan") == 0).select(*items.columns))


def promotion_history(decided: DataFrame, evidence: DataFrame, name=None, province=None, date_from=None,
                      date_to=None) -> DataFrame:
    """Every promotion of every player (or one), after removal of repeats and steps back.

    decided: levelled entries, from decide(). The scope holds for decided and for published promotions alike; entries outside
    it still serve as later evidence.
    """
    if name is not None:
        decided = decided.filter(F.col("participant_name") == name)
    items = evidence_union(decided, evidence, name=name, province=province, date_from=date_from,
                           date_to=at_day_end(date_to))
    own = F.lit(True)
    if province and province != ALL:
        own = own & (F.col("province") == province)
    if date_from:
        own = own & (F.col("min_time") >= date_from)
    if date_to:
        own = own & (F.col("min_time") <= at_day_end(date_to))
    items = items.filter((F.col("external") == 1) | own)
    out = monotone_sequence(dedupe_first(items)).drop("min_time", "external")
    return out if name is None else out.orderBy(F.desc("date"), "event_id")


def promotion_summary(scanned: DataFrame, history: DataFrame) -> DataFrame:
    """Promotions found and entries scanned per player."""
    n = scanned.groupBy(F.col("participant_name").alias("name")).agg(F.count(F.lit(1)).alias("scanned"))
    c = history.groupBy("name").agg(F.count(F.lit(1)).alias("count"))
    return n.join(c, "name", "full_outer").na.fill(0, ["scanned", "count"])


def display_fields(history: DataFrame) -> DataFrame:
    """Short title, place and record texts of a history item."""
    place = F.when((F.col("rank") > 0) & (F.col("group_size") > 0), F.concat(
        F.lit("第"), F.col("rank").cast("string"), F.lit("名 / "), F.col("group_size").cast("string"), F.lit("人"))) \
        .when(F.col("rank") > 0, F.concat(F.lit("第"), F.col("rank").cast("string"), F.lit("名"))).otherwise("名次待确认")
    record = F.when(rounds() > 0, record_text("win", "lose", "draw")).otherwise("")
    return history.select("name", "event_id", "group_id", "participant_id", "promoted_to",
                          shorten("title", 28).alias("short_title"), place.alias("place"), record.alias("record"),
                          text("date").alias("date"))
