"""Promotion rules: from notice texts, confirmed events and association standards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ranks as K
from ..functions.numbers import plain_number, quota, rounding_label, rounds
from ..functions.text import WS, notice_text, strip_ws, text
from ..session import stage

# ---- fixed values: association standards ------------------------------------
# province, source, rounding, rounds needed
ASSOCIATIONS = [
    ("四川省", "http://www.scwqxh.com/go-a327.htm", "ceil", 7),
    ("河北省", "https://sport.hebei.gov.cn/m/view.php?aid=8392", "round", 7),
]
# province, kind, level, percent, target, target after winning every game
STANDARDS = [
    ("四川省", "dan", 4, 15, "5段", None),
    ("四川省", "dan", 3, 20, "4段", None),
    ("四川省", "dan", 2, 25, "3段", "4段"),
    ("四川省", "dan", 1, 30, "2段", "3段"),
    ("四川省", "level", 1, 35, "1段", "2段"),
    ("四川省", "level", 2, 50, "1级", "1段"),
    ("四川省", "level", 5, 50, "2级", "1级"),
    ("河北省", "dan", 4, 15, "5段", None),
    ("河北省", "dan", 3, 30, "4段", None),
    ("河北省", "dan", 2, 50, "3段", None),
    ("河北省", "dan", 1, 65, "2段", None),
    ("河北省", "level", 1, 75, "1段", None),
    ("河北省", "level", 2, 75, "1级", None),
    ("河北省", "level", 3, 80, "2级", None),
    ("河北省", "level", 4, 80, "3级", None),
    ("河北省", "level", 5, 85, "4级", None),
    ("河北省", "level", 6, 85, "5级", None),
    ("河北省", "level", 7, 90, "6级", None),
]
RULE_FIELDS = ["text", "percent", "top_n", "wins", "top_n_target", "target", "full_win_target",
               "rounding", "min_rounds", "source"]


def rule_dims(spark: SparkSession) -> DataFrame:
    """The association standards as a dimension (a fixed handful of rows)."""
    host = {p: (src, rnd, n) for p, src, rnd, n in ASSOCIATIONS}
    rows = [(p, kind, level, float(pct), target, full, f"{p}围棋段级位赛通用晋升标准（来源：{host[p][0]}）",
             host[p][1], host[p][2]) for p, kind, level, pct, target, full in STANDARDS]
    return spark.createDataFrame(rows, "province string, kind string, level int, percent double, target string, "
                                       "full_win_target string, text string, rounding string, min_rounds int")


def rule_coverage(participants: DataFrame, events: DataFrame) -> DataFrame:
    """The standards with the events and entries each of them could apply to."""
    seats = participants.join(level_names(participants), "group_name") \
        .groupBy("event_id", "lv.kind", "lv.current").agg(F.count(F.lit(1)).alias("entries"))
    per = seats.join(events.select("event_id", F.col("provincename").alias("province")), "event_id") \
        .groupBy("province", "kind", F.col("current").alias("level")) \
        .agg(F.count_distinct("event_id").alias("events"), F.sum("entries").alias("entries"))
    dims = rule_dims(participants.sparkSession)
    return F.broadcast(dims).join(per, ["province", "kind", "level"], "left").na.fill(0, ["events", "entries"])


def level_ladder(event_groups: DataFrame) -> DataFrame:
    """Distinct N级组 numbers of an event from weak to strong, null when fewer than two."""
    n = F.regexp_extract(text("group_name"), rf"(\d+){WS}*级组", 1).try_cast("int")
    return event_groups.select("event_id", n.alias("n")).distinct().groupBy("event_id") \
        .agg(F.sort_array(F.collect_set("n"), asc=False).alias("ladder")) \
        .withColumn("ladder", F.when(F.size("ladder") >= 2, F.col("ladder")))


def notice_fragments(notices: DataFrame) -> DataFrame:
    """One row per event with its rule-bearing fragments as an array."""
    return notices.select("event_id", K.notice_fragments(notice_text("notice_text")).alias("fragments")) \
        .filter(F.size("fragments") > 0)


def fragment_rows(notices: DataFrame) -> DataFrame:
    return notice_fragments(notices).select("event_id", F.posexplode("fragments").alias("pos", "fragment"))


def level_names(participants: DataFrame) -> DataFrame:
    """Distinct group names that state one clear level, stored (names repeat for every seat)."""
    return stage(K.with_candidate_level(participants.select("group_name").distinct()), "levels") \
        .filter(F.col("lv").isNotNull())


def rule_groups(participants: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """Distinct (event, group name) with a level: rules are mined once for each, not per player."""
    levels = level_names(participants) if levels is None else levels
    return participants.select("event_id", "group_name").distinct().join(levels, "group_name") \
        .select("event_id", "group_name", "lv.kind", "lv.current")


def group_fragments(groups: DataFrame, notices: DataFrame) -> DataFrame:
    """Fragments that name the group, each narrowed to the group's own part.

    A group keeps its event's fragments in an array, so this is a many-to-one
    join and never all pairs of fragments and groups.
    """
    labels = K.group_labels("group_name", "kind", "current")
    return groups.join(notice_fragments(notices), "event_id").withColumn("labels", labels) \
        .withColumn("matched", K.matching_fragments("fragments", "labels")) \
        .filter(F.size("matched") > 0) \
        .select("event_id", "group_name", "kind", "current", "labels",
                F.posexplode("matched").alias("pos", "matched_text")) \
        .withColumn("fragment", K.narrow_fragment("matched_text", "labels")).drop("labels")


def indexed_matches(groups: DataFrame, notices: DataFrame) -> DataFrame:
    """The pairs of group_fragments (event_id, group_name, pos, fragment) through an index of label heads.

    Fragments are cut into their distinct runs of one and two characters, once; a label meets those that begin as it does and is
    looked for in these alone. The work follows the length of the texts and the pairs that share a head, not labels times
    fragments.
    """
    fragments = stage(fragment_rows(notices), "fragments")
    head = lambda c: F.substring(c, 1, 2)
    labels = groups.select("event_id", "group_name", F.explode(K.group_labels("group_name", "kind", "current")).alias("label")) \
        .withColumn("head", head(F.col("label")))
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length("fragment") - n + 1, F.lit(1))),
                                 lambda i: F.substring(F.col("fragment"), i, F.lit(n)))
    index = fragments.select("event_id", F.col("pos").alias("at"), F.explode(F.array_distinct(F.concat(runs(1), runs(2)))).alias("head"))
    # a text's runs are far more than its bytes in the file, by which Spark would send them through the driver
    pairs = index.hint("merge").join(labels.hint("merge"), ["event_id", "head"]) \
        .join(fragments.withColumnRenamed("pos", "at").hint("merge"), ["event_id", "at"]) \
        .filter(F.contains("fragment", F.col("label"))).select("event_id", "group_name", "at", "fragment").distinct()
    order = Window.partitionBy("event_id", "group_name").orderBy("at")
    return pairs.withColumn("pos", (F.row_number().over(order) - 1).cast("int")).drop("at")


def fragment_fields(groups: DataFrame, notices: DataFrame, ladders: DataFrame) -> DataFrame:
    """Every narrowed fragment with the fields it states."""
    rows = K.with_rule_fields(group_fragments(groups, notices).join(ladders, "event_id", "left"))
    return rows.select("event_id", "group_name", "kind", "current", "pos", "fragment", "percent", "top_n", "wins",
                       "top_n_target", "target", "full_win_target")


def _rule(**fields) -> list:
    kinds = {"percent": "double", "top_n": "double", "wins": "double", "min_rounds": "int"}
    return [fields[n].cast(kinds.get(n, "string")).alias(n) if n in fields
            else F.lit(None).cast(kinds.get(n, "string")).alias(n) for n in RULE_FIELDS]


def notice_rules(groups: DataFrame, notices: DataFrame, ladders: DataFrame) -> DataFrame:
    """The rule of each group: its first fragment with a target or a raise word, else the first."""
    rows = fragment_fields(groups, notices, ladders)
    good = (text("target") != "") | (text("full_win_target") != "") | F.col("fragment").rlike("晋升|升|申请")
    rule = F.struct(*_rule(text=F.col("fragment"), source=F.lit("notice"),
                           **{n: F.col(n) for n in ("percent", "top_n", "wins", "top_n_target", "target",
                                                    "full_win_target")}))
    return rows.groupBy("event_id", "group_name").agg(
        F.min_by(rule, F.struct(F.when(good, 0).otherwise(1).alias("o"), F.col("pos"))).alias("notice_rule"))


def confirmed_rules(confirmed: DataFrame) -> DataFrame:
    """Rules confirmed for one group of one event (event_id, group_name, text, full_win_target)."""
    return confirmed.select("event_id", F.col("group_name").alias("plain_group"), F.struct(*_rule(
        text=F.col("text"), full_win_target=F.col("full_win_target"), source=F.lit("user-confirmed-rule")
    )).alias("confirmed_rule"))


def _listed(confirmed_public: DataFrame) -> DataFrame:
    return confirmed_public.select("event_id", F.lit(True).alias("_confirmed")).distinct()


def association_rules(candidates: DataFrame, confirmed_public: DataFrame | None = None, listed: bool = False) -> DataFrame:
    """Add the association's standard for the entry's level where its event qualifies.

    candidates carry lv and the event flags (promotion.levelled). confirmed_public(event_id): public events for which an
    association confirmed its standard; listed: candidates carry that as _confirmed already.
    """
    dims = rule_dims(candidates.sparkSession)
    rule = F.struct(*_rule(text=F.col("text"), percent=F.col("percent"), target=F.col("target"),
                           full_win_target=F.col("full_win_target"), rounding=F.col("rounding"),
                           min_rounds=F.col("min_rounds"), source=F.lit("association-general-rule")))
    dims = dims.select(F.col("province").alias("provincename"), F.col("kind").alias("rule_kind"),
                       F.col("level").alias("rule_level"), rule.alias("standard"))
    c = candidates.withColumn("rule_kind", F.col("lv.kind")).withColumn("rule_level", F.col("lv.current"))
    if confirmed_public is None:
        c = c.withColumn("_confirmed", F.lit(False))
    else:
        c = (c if listed else c.join(_listed(confirmed_public), "event_id", "left")).withColumn("_confirmed", F.coalesce("_confirmed", F.lit(False)))
    allowed = F.col("rank_event") | (F.col("backed_public_event") & F.col("_confirmed")
                                     & (F.col("lv.kind") == "dan") & (F.col("lv.current") >= 3))
    return c.join(F.broadcast(dims), ["provincename", "rule_kind", "rule_level"], "left") \
        .withColumn("association_rule", F.when(allowed, F.col("standard"))) \
        .drop("standard", "rule_kind", "rule_level", "_confirmed")


def with_rule(candidates: DataFrame, groups: DataFrame, notices: DataFrame, confirmed: DataFrame,
              ladders: DataFrame, confirmed_public: DataFrame | None = None, seats: DataFrame | None = None) -> DataFrame:
    """Choose per entry (groups as of rule_groups): notice rule, else confirmed rule, else association standard.

    seats(event_id, group_id, group_name): the groups of all entries. With it, what an event or a group states goes to the groups
    once, and entries (each of which needs a group then) meet it by group and keep their event's ladder, too.
    """
    mined = notice_rules(groups, notices, ladders)
    known = confirmed_rules(confirmed)

    def stated(rows: DataFrame) -> DataFrame:
        return rows.withColumn("plain_group", strip_ws("group_name")).join(mined, ["event_id", "group_name"], "left") \
            .join(known, ["event_id", "plain_group"], "left").drop("plain_group")
    if seats is None:
        c = stated(association_rules(candidates, confirmed_public))
    else:
        at = ["event_id", "group_id", "group_name"]
        per = stated(seats.select(*at).distinct()).join(ladders, "event_id", "left")
        if confirmed_public is not None:
            per = per.join(_listed(confirmed_public), "event_id", "left")
        c = association_rules(candidates.join(per.repartition("group_id"), at), confirmed_public, listed=True)
    return c.withColumn("rule", F.coalesce("notice_rule", "confirmed_rule", "association_rule")) \
        .drop("notice_rule", "confirmed_rule", "association_rule")


def promotion_decision(rows: DataFrame) -> DataFrame:
    """Add decision(promoted, target, basis); null where there is no rule.

    Unknown ranks and sizes are 0 and skip the branches that need them.
    """
    r = F.col("rule")
    n, win = rounds(), F.coalesce(F.col("win"), F.lit(0))
    rank, size = F.col("rank"), F.col("group_size")
    name = text("group_name")
    top, wins, pct = r["top_n"], r["wins"], r["percent"]
    rows = rows.withColumns({
        "_full": (text(r["full_win_target"]) != "") & (n > 0) & (win == n),
        "_top_target": (text(r["top_n_target"]) != "") & (top > 0) & (rank > 0) & (rank <= top),
        "_percent": (pct > 0) & (rank > 0) & (size > 0), "_top": (top > 0) & (rank > 0),
        "_places": quota(size, pct, r["rounding"])})
    full, by_top_target, by_percent, by_top, places = (
        F.col(c) for c in ("_full", "_top_target", "_percent", "_top", "_places"))
    target = F.when(full, r["full_win_target"]).when(by_top_target, r["top_n_target"]).otherwise(r["target"])
    promoted = F.when(full, True).when(by_top_target, True).when(by_percent, rank <= places) \
        .when(by_top, rank <= top).when(wins > 0, win >= wins).otherwise(False)
    t = F.lit
    basis = F.when(full, F.concat(t("规程写明全胜特殊晋升；选手"), win.cast("string"), t("胜全胜"))) \
        .when(by_top_target, F.concat(t("规程写明"), name, t("前"), plain_number(top), t("名晋升至"), F.col("_target"),
                                      t("；选手第"), rank.cast("string"), t("名"))) \
        .when(by_percent, F.concat(t("规程写明"), name, t("前"), plain_number(pct), t("%晋升；本组"),
                                   size.cast("string"), t("人，"), rounding_label(r["rounding"]), t("为"),
                                   places.cast("string"), t("个名额，选手第"), rank.cast("string"), t("名"))) \
        .when(by_top, F.concat(t("规程写明"), name, t("前"), plain_number(top), t("名晋升；选手第"),
                               rank.cast("string"), t("名"))) \
        .otherwise(F.concat(t("规程写明达到"), plain_number(wins), t("胜晋升；选手"), win.cast("string"), t("胜"),
                            F.coalesce("lose", t(0)).cast("string"), t("负"),
                            F.when(F.coalesce("draw", t(0)) > 0, F.concat(F.col("draw").cast("string"), t("和")))
                            .otherwise("")))
    enough = (F.coalesce(r["min_rounds"], t(0)) == 0) | (n >= r["min_rounds"])
    rows = rows.withColumn("_target", target) \
        .withColumn("_yes", F.coalesce(enough & promoted & (text("_target") != ""), t(False)))
    yes = F.col("_yes")
    return rows.withColumn("decision", F.when(r.isNotNull(), F.struct(
        yes.alias("promoted"), F.when(yes, F.col("_target")).alias("target"), F.when(yes, basis).alias("basis")))) \
        .drop("_full", "_top_target", "_percent", "_top", "_places", "_target", "_yes")
