"""Exact set-similarity join on word shingles with skipping by set relations.

A document's set holds the distinct shingles of its words. Rows with equal sets form one class; only one row of a class is
joined. Sets are ordered by one order of all shingles (often-seen ones last, then by hash), so two linked sets share a
shingle among the first few of each. Index lists hold, by shingle, the sets that have it there, with size and position.

1. Answers of similar sets: in each list every set is first compared with a few single sets of its list. Linked sets share one
   answer from then on, their component, and are never compared with each other again.
2. Block skipping: lists that still hold several components are cut into blocks by size band and position. A probe skips a
   block when sizes, positions or a shared component rule all of it out; inside the rest it meets only sets of other
   components that pass the size and position bounds. Blocks are salted so that none grows with the list.

Every pair that could join two components is verified on whole sets, so no link between different texts is lost; links
within a component are not listed. Sets are hashed to 64 bits a shingle.

Null and empty texts have an empty set and link with nothing; fewer words than a shingle form one shingle. Rows with equal
doc_id count as one document, a null doc_id takes no part (null component). Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, discard, pieces, stage, table, take_columns
from .subwords import release

SHINGLE, PERCENT = 4, 85
SLICE = 1 << 19  # bytes of text hashed at once
OFTEN, OFTEN_MAX = 16, 500_000  # shingles in more documents go last in the order; at most so many are broadcast
BLOCK = 64
COUNTED = 3_000_000  # shingles of a task counted at once
ROUNDS = 2  # comparisons with one set of each list before all components of a list are compared
BROADCAST_IDS = 1_000_000  # ids of candidate documents; beyond, they are joined by a shuffle
WHOLE_STAGE = "spark.sql.codegen.wholeStage"
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[1]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[2]
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def byte_values() -> tuple[np.ndarray, np.ndarray]:
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    return mix(np.arange(1, 257, dtype=np.uint64) * _MIX[0]), blank


@lru_cache(2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64."""
    p, inverse = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
    out = []
    for base in (p, inverse):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of lower-cased bytes."""
    raw = np.frombuffer(data, np.uint8)
    values, blank = byte_values()
    gap = blank[raw]
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    size = 1 << max(19, len(raw).bit_length())
    up, down = powers(size)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[raw] * up[:len(raw)], dtype=np.uint64)])
    return starts, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MIX[3])


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-cased texts, one after the other, and where each text begins among them."""
    hashes, edge, at = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    while at < len(texts):
        sizes = np.cumsum([len(t) + 1 for t in texts[at:at + 4096]])
        upto = at + max(1, int(np.searchsorted(sizes, SLICE)))
        starts, words = word_hashes(b"\n".join(texts[at:upto]))
        edge.append(edge[-1][-1] + np.searchsorted(starts, sizes[:upto - at]))
        hashes.append(words)
        at = upto
    return np.concatenate(hashes), np.concatenate(edge)


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes (as signed longs) of each text."""
    at = 0
    while at < len(texts):
        sizes = np.cumsum([len(t) + 1 for t in texts[at:at + 4096]])
        upto = at + max(1, int(np.searchsorted(sizes, SLICE)))
        some = texts[at:upto]
        starts, words = word_hashes(b"\n".join(some).lower())
        begin = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(t) + 1 for t in some])]))
        run = np.zeros(max(0, len(words) - k + 1), np.uint64)
        for j in range(k):
            run += words[j:len(words) - k + 1 + j] * (_MIX[j % 4] + np.uint64(2 * j))
        run = mix(run)
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(run[a:b - k + 1].view(np.int64))
            elif b > a:
                short = np.uint64(b - a)
                for w in words[a:b]:
                    short = mix(np.array([short], np.uint64) * _MIX[3] + w)[0]
                yield np.array([short], np.uint64).view(np.int64)
            else:
                yield np.zeros(0, np.int64)
        at = upto


def raw_texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def often_seen(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many documents hold, with counts; only the order of shingles depends on them, no result."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()

        def counted(held: list[np.ndarray]) -> pa.RecordBatch:
            both = np.concatenate(held)
            held.clear()
            both.sort()  # in place: one copy of the shingles is held, no more
            edge = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
            count = np.diff(edge, append=len(both))
            keep = count >= 2  # a shingle of many documents comes back within a few thousand of them
            return pa.RecordBatch.from_arrays([pa.array(both[edge[keep]]), pa.array(count[keep])], names=["token", "n"])

        held, size = [], 0
        for batch in pieces(batches):
            for s in shingle_sets(raw_texts(batch.column(0)), k):
                held.append(s)
                size += len(s)
                if size >= COUNTED:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    rows = (docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
            .where(F.col("n") > OFTEN).orderBy(F.desc("n"), "token").limit(OFTEN_MAX).toPandas())
    rows = rows.sort_values("token")
    return rows["token"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def index_rows(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n, d1, d2 (digest of the set), prefix: the first shingles of the set in the common order."""
    sc = docs.sparkSession.sparkContext
    often = sc.broadcast(often_seen(docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        tokens, counts = often.value
        for batch in pieces(batches):
            n, digest, prefix = [], [], []
            for s in shingle_sets(raw_texts(batch.column(1)), k):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                take = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                if len(tokens) and len(s):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    weight = np.where(tokens[at] == s, counts[at], 0)
                    s = s[np.lexsort((s, weight))]
                prefix.append(s[:take])
            two = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            ends = np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*prefix, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(two[:, 0]), pa.array(two[:, 1]), lists],
                names=["doc_id", "n", "d1", "d2", "prefix"])

    return stage(docs.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, prefix array<long>"), "near-index")


def verify(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The linked ones of staged pairs (a, b, na, nb), on whole sets."""
    ids = stage(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(),
                "near-ids")
    some = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in pieces(batches):
            sets = list(shingle_sets(raw_texts(batch.column(1)), k))
            ends = np.concatenate([[0], np.cumsum([len(p) for p in sets])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "tokens"])

    sets = docs.join(some, "doc_id", "left_semi").mapInArrow(run, "doc_id long, tokens array<long>")
    sets = stage(sets, "near-sets")
    left = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("tb"))
    same = F.size(F.array_intersect("ta", "tb"))
    links = stage(pairs.join(left, "a").join(right, "b")
                  .where((100 + percent) * same >= percent * (F.col("na") + F.col("nb"))).select("a", "b"), "near-links")
    discard(ids, sets)
    return links


def within_bounds(percent: int):
    """Size and position bounds of two entries (na, pa) <= (nb, pb) of one list."""
    rest = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    return (100 * F.col("na") >= percent * F.col("nb")) & ((100 + percent) * rest >= percent * (F.col("na") + F.col("nb")))


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """Steps staged in here run without whole-stage code: compiling its long methods took an executor's JVM up to 450 MB, much of
    which stayed with it, and saves no time on these joins. The session's setting is restored at the end."""
    before = spark.conf.get(WHOLE_STAGE)
    spark.conf.set(WHOLE_STAGE, "false")
    try:
        yield
    finally:
        spark.conf.set(WHOLE_STAGE, before)


def reached(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """index_rows of the documents, the classes of equal sets with the smallest id of each, and the components of these ids."""
    index = index_rows(docs, k, percent)
    classes = (index.where("n > 0 and doc_id is not null").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")))
    classes = stage(classes, "near-classes")
    key = ["doc_id", "n", "d1", "d2"]
    # one row a class, however often it is repeated; the join has brought equal rows together already
    one = index.join(classes.select(F.col("rep").alias("doc_id"), "n", "d1", "d2"), key, "left_semi").dropDuplicates(key)
    # a little wider than the largest ratio of linked sizes, so that rounding never parts a link by two bands
    band = F.floor(F.log("n") / (1.001 * math.log(100 / percent))).cast("int")
    entries = one.select(F.posexplode("prefix").alias("p", "token"), F.col("doc_id").alias("d"), "n", band.alias("band"))
    shared = entries.groupBy("token").count().where("count > 1").withColumnRenamed("count", "size")
    lists = stage(entries.join(shared, "token"), "near-lists")

    # 1. each set with one set of its list, as long as they lie in different components: first with the set that shares most
    # lists (the text that copies were made from holds few shingles of its own), then with others in turn
    degree = lists.groupBy("d").agg(F.count("*").alias("degree"))
    held = stage(lists.join(degree, "d").withColumn("c", F.col("d")), "near-held")
    discard(lists)
    tried = links = None
    for turn in range(ROUNDS):
        weight = F.col("degree") if turn == 0 else F.xxhash64("d", F.lit(turn))
        best = held.groupBy("token", "band").agg(F.max(F.struct(weight.alias("w"), "d", "n", "p", "c")).alias("f"))
        pivots = best.select("token", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"),
                             F.struct("f.n", "f.d", "f.p").alias("x"), F.col("f.c").alias("cx"))
        met = held.join(pivots, ["token", "band"]).where("c <> cx").select("x", F.struct("n", "d", "p").alias("y"))
        low, high = F.least("x", "y"), F.greatest("x", "y")  # by size, then id
        pairs = (met.select(low.alias("l"), high.alias("h"))
                 .select(F.col("l.d").alias("a"), F.col("l.n").alias("na"), F.col("l.p").alias("pa"),
                         F.col("h.d").alias("b"), F.col("h.n").alias("nb"), F.col("h.p").alias("pb"))
                 .where(within_bounds(percent)).select("a", "b", "na", "nb").distinct())
        if turn:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stage(pairs, "near-pairs")
        new = verify(docs, pairs, k, percent)
        tried, links = (tried.unionByName(pairs), links.unionByName(new)) if turn else (pairs, new)
        joined = components(links, "near-round")
        known = joined.withColumnRenamed("node", "d")
        now = held.drop("c").join(known, "d", "left").withColumn("c", F.coalesce("component", "d")).drop("component")
        mixed = now.groupBy("token").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("token")
        now = stage(now.join(mixed, "token"), "near-held")
        discard(held, joined)
        held = now

    # 2. what lists with several components still hold
    salt = F.when(F.col("size") <= BLOCK, 0).otherwise(
        F.pmod(F.xxhash64("d"), F.ceil(F.col("size") / BLOCK))).cast("int")
    blocks = held.groupBy("token", "band", F.floor(8 * F.col("p") / F.col("n")).alias("depth"), salt.alias("salt")).agg(
        F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("p").alias("p0"), F.min("c").alias("c0"),
        F.max("c").alias("c1"), F.collect_list(F.struct("d", "n", "p", "c")).alias("block"))
    probe = held.select("token", F.explode(F.array("band", F.col("band") + 1)).alias("band"), F.col("d").alias("a"),
                        F.col("n").alias("na"), F.col("p").alias("pa"), F.col("c").alias("ca"))
    skip = ((F.col("n1") < F.col("na")) | (100 * F.col("na") < percent * F.col("n0"))
            | ((F.col("c0") == F.col("ca")) & (F.col("c1") == F.col("ca")))
            | ((100 + percent) * F.least(F.col("na") - F.col("pa"), F.col("n1") - F.col("p0"))
               < percent * (F.col("na") + F.col("n0"))))
    # a block gives only the entries that may link: other components, within the bounds of size and position
    may = F.filter("block", lambda e: (e["c"] != F.col("ca"))
                   & ((F.col("na") < e["n"]) | ((F.col("na") == e["n"]) & (F.col("a") < e["d"])))
                   & (100 * F.col("na") >= percent * e["n"])
                   & ((100 + percent) * F.least(F.col("na") - F.col("pa"), e["n"] - e["p"]) >= percent * (F.col("na") + e["n"])))
    cross = (probe.join(blocks, ["token", "band"]).where(~skip).select("a", "na", F.explode(may).alias("e"))
             .select("a", F.col("e.d").alias("b"), "na", F.col("e.n").alias("nb")).distinct())
    more = stage(cross.join(tried, ["a", "b"], "left_anti"), "near-pairs")
    discard(held)
    links = links.unionByName(verify(docs, more, k, percent))
    return index, classes, components(links, "near-round")


def near_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs` (doc_id, text)."""
    docs = take_columns(docs, "doc_id", "text")
    with small_methods(docs.sparkSession):
        index, classes, found = reached(docs, k, percent)
    found = found.withColumnRenamed("node", "rep").withColumnRenamed("component", "reached")
    classes = classes.join(found, "rep", "left").select("n", "d1", "d2", F.coalesce("reached", "rep").alias("component_id"))
    return index.select("doc_id", "n", "d1", "d2").join(classes, ["n", "d1", "d2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def op4_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


#: shingles as hashes of their words; links and their components by plain set operations
OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS shingles
  FROM w),
n AS (SELECT doc_id, len(shingles) AS n FROM s),
e AS (SELECT doc_id, unnest(shingles) AS t FROM s),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT x, y FROM p JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE 185 * c >= 85 * (na.n + nb.n)),
both_ways AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT reach.doc_id, y FROM reach JOIN both_ways ON x = r)
SELECT n.doc_id, n.n AS n_shingles, min(r) AS component_id FROM n JOIN reach USING (doc_id) GROUP BY ALL
"""
