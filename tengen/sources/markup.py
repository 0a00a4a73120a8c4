"""Rows out of HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import parse_int
from ..functions.text import decode_entities, text

GROUP_ANCHOR = r"(?i)<a\b[^>]*data-groupid=[\"']?\d+[\"']?[^>]*>"
LINK_ANCHOR = r"(?i)<a\b[^>]*href=[\"'][^\"']*[\"'][^>]*>"
DATA_ATTR = r"(?i)data-([a-z0-9_-]+)=[\"']([^\"']*)[\"']"
HREF_ATTR = r"(?i)\b(href)=[\"']([^\"']*)[\"']"
# fixed values: entities decoded in attribute values, in this order
ATTR_ENTITIES = [("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]


def anchor_attrs(tag: Column, attr_pattern: str) -> Column:
    """Map of a tag's attributes: dashes removed from names, the last of equal names wins."""
    names = F.regexp_extract_all(tag, F.lit(attr_pattern), 1)
    values = F.regexp_extract_all(tag, F.lit(attr_pattern), 2)
    pairs = F.zip_with(names, values, lambda k, v: F.struct(
        F.replace(k, F.lit("-"), F.lit("")).alias("key"), decode_entities(v, ATTR_ENTITIES).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(
        F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def extract_anchors(pages: DataFrame, page_key: str, anchor=GROUP_ANCHOR, attr=DATA_ATTR,
                    key: str = "groupid") -> DataFrame:
    """One row per anchor with a non-empty key attribute; the first of equal keys on a page stays."""
    tags = F.regexp_extract_all(text("html"), F.lit(anchor), 0)
    rows = pages.select(page_key, F.posexplode(tags).alias("pos", "tag")) \
        .withColumn("attrs", anchor_attrs(F.col("tag"), attr)) \
        .withColumn("key", F.try_element_at("attrs", F.lit(key))).filter(text("key") != "")
    return rows.groupBy(page_key, "key").agg(F.min(F.col("pos")).alias("pos"),
                                             F.min_by("attrs", "pos").alias("attrs"))


def extract_anchor_groups(pages: DataFrame) -> DataFrame:
    """Groups announced on event pages; a page without any is an error row."""
    found = extract_anchors(pages, "event_id").select(
        "event_id", F.col("key").alias("group_id"), F.col("pos"),
        text(F.try_element_at("attrs", F.lit("groupname"))).alias("group_name"),
        text(F.try_element_at("attrs", F.lit("team"))).alias("team_type"),
        text(F.try_element_at("attrs", F.lit("pnumber"))).alias("pnumber"))
    return pages.select("event_id").join(found, "event_id", "left") \
        .withColumn("error", F.when(F.col("group_id").isNull(), "no groups found").otherwise(""))


def live_groups(pages: DataFrame) -> DataFrame:
    """Groups of event pages with all that a running group's anchor tells: names, size, begin, end and state."""
    def attr(name: str) -> Column:
        return text(F.try_element_at("attrs", F.lit(name)))
    return extract_anchors(pages, "event_id").select(
        "event_id", F.col("key").alias("group_id"), attr("groupname").alias("group_name"),
        F.coalesce(parse_int(attr("pnumber")), F.lit(0)).cast("int").alias("pnumber"), attr("bt").alias("bt"), attr("et").alias("et"),
        attr("groupstate").alias("groupstate"))
