"""Prefix trie of conversations, peeled from the deepest turns up.

1. Every turn becomes a key of 128 bits (SHA-256 of role and text) and its number of words; a conversation is the sequence of
   its keys. Heads are swapped as asked for (`rebuilt`). Equal conversations become one path with their number, smallest
   id and the hash of their ids.
2. Paths are dealt by ranges and sorted, so what shares a prefix lies together even when a third of all rows does. Each
   task takes chunks of sorted paths and peels a chunk: from its greatest depth down, the paths that end there are merged
   with the nodes that survived from one turn deeper, the last turn is stripped, and what has the same rest is grouped again.
   A node is found, counted and summed in that one pass over depths.
3. Only prefixes of a chunk's first and last path can go on in another chunk. They leave the chunk unfinished, as two paths with
   what was added up for each of their depths, and are peeled again with those of all other chunks, until one chunk
   holds all. Nodes right below an unfinished one get their parent by its key afterwards.

The ids of equal conversations are hashed as a sorted stream, whose memory is bounded; SHA-256 is serial, so one task reads
those of one path. A conversation's keys and counts (not its texts) are held at once, some 40 bytes a turn.

Turns go by number, null first; equal numbers by key. Null role or text is empty. Null conv_ids take no part. Repeated rows are
turns of their own. No conversations give no nodes, not even a root. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, stage, table, take_columns

GROUP_OF, HEADS = 20, 4
KEY = 16
CHUNK_ROWS, CHUNK_BYTES, LEAST_ROWS = 4000, 16 << 20, 16
WORD = r"[^\x20\x09-\x0D]+"
NONE = np.iinfo(np.int64).max
#: what is known of a node: members, smallest member, children, leaves and tokens below it, hash of the members that end there
MARK = np.dtype([("depth", "<i8"), ("n", "<i8"), ("least", "<i8"), ("children", "<i8"), ("leaves", "<i8"), ("saved", "<i8"),
                 ("ended", "<i8"), ("ends", "u1", 32)])
NODE, WAITING, PATH = 0, 1, 2
SCHEMA = ("kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
          "ends binary, own_key binary, parent_key binary, path binary, words array<long>, marks binary")
OUT = pa.schema([("kind", pa.int32()), *((n, pa.int64()) for n in (
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends", pa.binary()),
    ("own_key", pa.binary()), ("parent_key", pa.binary()), ("path", pa.binary()), ("words", pa.list_(pa.int64())),
    ("marks", pa.binary())])


def rebuilt(rows: DataFrame, group_of: int = GROUP_OF, heads: int = HEADS) -> DataFrame:
    """conv_id, path (16 bytes a turn), words (a count a turn) of every conversation with its head taken from conversation
    conv_id - conv_id % group_of: as many turns as crc32(conv_id) % heads."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY)
    turns = (take_columns(rows, "conv_id", "turn", "role", "text").where("conv_id is not null")
             .select(F.col("conv_id").cast("long"), F.struct("turn", key.alias("key"), F.regexp_count(text, F.lit(WORD)).alias("words"))
                     .alias("t"))
             .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own")))
    turns = stage(turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % group_of), "trie-turns")
    first = (turns.where("conv_id = base").select("base", F.slice("own", 1, heads - 1).alias("head")))
    h = (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % heads).cast("int")

    def some(turns_: Column, start: Column, length: Column) -> Column:
        return F.slice(turns_, start, F.greatest(length, F.lit(0)))

    whole = F.concat(F.coalesce(some(F.col("head"), F.lit(1), h), some(F.col("own"), F.lit(1), F.lit(0))),
                     some(F.col("own"), h + 1, F.size("own") - h))
    return turns.join(first, "base", "left").select("conv_id", whole.alias("t")).select(
        "conv_id", F.unhex(F.array_join(F.transform("t", lambda x: x["key"]), "")).alias("path"),
        F.transform("t", lambda x: x["words"].cast("long")).alias("words"))


def hashes(members: DataFrame) -> DataFrame:
    """key, ends: SHA-256 of the comma-joined ids of every key, ascending. Ids are read as one sorted stream."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []
        for batch in batches:
            for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        done.append((key, state.digest()))
                    key, state = k, hashlib.sha256(str(i).encode())
                else:
                    state.update(b",%d" % i)
            yield pa.RecordBatch.from_arrays([pa.array([d[c] for d in done], pa.binary()) for c in (0, 1)], names=["key", "ends"])
            done = []
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.digest()], pa.binary())],
                                             names=["key", "ends"])

    return members.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(run, "key binary, ends binary")


def distinct_paths(convs: DataFrame) -> DataFrame:
    """path, words, marks: every distinct conversation, with one mark at its end."""
    paths = stage(convs.groupBy("path").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.first("words").alias("words"))
                  .withColumn("key", F.unhex(F.substring(F.sha2("path", 256), 1, 2 * KEY))), "trie-paths")
    many = stage(hashes(convs.join(paths.where("n > 1").select("path", "key"), "path").select("key", "conv_id")), "trie-ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.zeros(batch.num_rows, MARK)
            marks["depth"] = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            marks["n"], marks["least"] = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            marks["ended"], marks["ends"] = 1, np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, 32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([m.tobytes() for m in marks], pa.binary())],
                                             names=["path", "words", "marks"])

    one = F.unhex(F.sha2(F.col("least").cast("string"), 256))
    return paths.join(many, "key", "left").select("path", "words", "n", "least", F.coalesce("ends", one).alias("ends")).mapInArrow(
        run, "path binary, words array<long>, marks binary")


def shared_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // KEY
    x, y = (np.frombuffer(v, np.uint64, 2 * n).reshape(n, 2) for v in (a, b))
    differ = (x != y).any(1)
    return int(differ.argmax()) if differ.any() else n


def prefix_keys(path: bytes) -> list[bytes]:
    """Key of every prefix, the empty one first."""
    state, out = hashlib.sha256(), [hashlib.sha256().digest()[:KEY]]
    for at in range(0, len(path), KEY):
        state.update(path[at:at + KEY])
        out.append(state.copy().digest()[:KEY])
    return out


class Nodes:
    """Finished nodes as lists of arrays."""

    def __init__(self) -> None:
        self.parts: list[list] = []

    def add(self, nodes: dict, pick: np.ndarray, depth: int, parent: np.ndarray | None, parent_key: list | None) -> None:
        if len(pick):
            ends = nodes["ends"]
            self.parts.append([len(pick), nodes["least"][pick], depth, parent, nodes["n"][pick], nodes["children"][pick], nodes["leaves"][pick],
                               nodes["saved"][pick], [ends[i] for i in pick], [nodes["keys"][i] for i in pick] if nodes["keys"] else None,
                               parent_key])

    def batches(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        none = lambda n: [None] * n
        join = lambda c: np.concatenate([p[c] for p in self.parts])
        flat = lambda c: [x for p in self.parts for x in (none(p[0]) if p[c] is None else p[c])]
        total = sum(p[0] for p in self.parts)
        kind = np.concatenate([np.full(p[0], NODE if p[10] is None else WAITING, np.int32) for p in self.parts])
        depth = np.concatenate([np.full(p[0], p[2], np.int64) for p in self.parts])
        columns = [pa.array(kind), pa.array(join(1)), pa.array(depth), pa.array(flat(3), pa.int64()), *(pa.array(join(c)) for c in (4, 5, 6, 7)),
                   pa.array(flat(8), pa.binary()), pa.array(flat(9), pa.binary()), pa.array(flat(10), pa.binary()),
                   *(pa.nulls(total, f.type) for f in list(OUT)[11:])]
        yield from pieces([pa.RecordBatch.from_arrays(columns, schema=OUT)], 10_000)


def peel(paths: list[bytes], words: list[np.ndarray], marks: list[np.ndarray], whole: bool, keyed: bool) -> Iterator[pa.RecordBatch]:
    """Nodes of a chunk of sorted distinct paths; unless it is the whole, its first and last path come back unfinished."""
    m = len(paths)
    turns = np.array([len(p) // KEY for p in paths], np.int64)
    lcp = np.array([-1] + [shared_turns(a, b) for a, b in zip(paths, paths[1:])], np.int64)
    word = np.concatenate([*words, np.zeros(0, np.int64)])
    at = np.cumsum(turns) - turns
    mark, owner = np.concatenate(marks), np.repeat(np.arange(m), [len(x) for x in marks])
    by_depth = np.argsort(mark["depth"], kind="stable")
    bounds = np.searchsorted(mark["depth"][by_depth], np.arange(int(turns.max()) + 2))
    rims = [] if whole else sorted({0, m - 1})
    keys = {i: prefix_keys(paths[i]) for i in (range(m) if keyed else rims)}
    open_marks: dict[int, list] = {i: [] for i in rims}
    out, below = Nodes(), None
    for d in range(int(turns.max()), -1, -1):
        here = by_depth[bounds[d]:bounds[d + 1]]
        # paths with something known at this depth, and the survivors, which lose their last turn
        rows, known = owner[here], mark[here]
        part = {c: known[c] for c in ("n", "least", "children", "leaves", "saved")}
        ended = np.where(known["ended"] > 0, here, -1)
        if below is not None:
            going = ~below["open"]
            rows = np.concatenate([rows, below["row"]])
            part["children"] = np.concatenate([part["children"], going.astype(np.int64)])
            part["least"] = np.concatenate([part["least"], np.where(going, below["least"], NONE)])
            for c in ("n", "leaves", "saved"):
                part[c] = np.concatenate([part[c], np.where(going, below[c], 0)])
            ended = np.concatenate([ended, np.full(len(below["row"]), -1)])
        order = np.argsort(rows, kind="stable")
        sorted_rows = rows[order]
        new = np.ones(len(rows), bool)
        new[1:] = (sorted_rows[1:] != sorted_rows[:-1]) & (lcp[sorted_rows[1:]] < d)
        starts = np.flatnonzero(new)
        node = {c: np.add.reduceat(part[c][order], starts) for c in ("n", "children", "leaves", "saved")}
        node["least"] = np.minimum.reduceat(part["least"][order], starts)
        last = np.maximum.reduceat(ended[order], starts)
        node["row"] = sorted_rows[starts]
        node["open"] = np.zeros(len(starts), bool)
        if rims:
            node["open"][0] |= bool(node["row"][0] == 0)
            node["open"][-1] |= bool(turns[m - 1] >= d)
        shut = ~node["open"]
        node["leaves"] = np.where(shut & (node["children"] == 0), 1, node["leaves"])
        if d:
            node["saved"] = node["saved"] + np.where(shut, (node["n"] - 1) * word[at[node["row"]] + d - 1], 0)
        node["ends"] = [mark["ends"][i].tobytes() if i >= 0 else None for i in last]
        node["keys"] = [keys[r][d] for r in node["row"]] if keyed else None
        if below is not None:
            group = np.empty(len(rows), np.int64)
            group[order] = np.cumsum(new) - 1
            group = group[len(here):]
            done = ~below["open"]
            pick = np.flatnonzero(done & shut[group])
            out.add(below, pick, d + 1, node["least"][group[pick]], None)
            pick = np.flatnonzero(done & node["open"][group])
            rim = {g: keys[0 if node["row"][g] == 0 else m - 1][d] for g in np.flatnonzero(node["open"]).tolist()}
            out.add(below, pick, d + 1, None, [rim[g] for g in group[pick].tolist()])
        for g in np.flatnonzero(node["open"]).tolist():
            if node["n"][g]:
                ends = np.frombuffer(node["ends"][g] or bytes(32), np.uint8)
                open_marks[0 if node["row"][g] == 0 else m - 1].append(
                    (d, *(int(node[c][g]) for c in ("n", "least", "children", "leaves", "saved")), node["ends"][g] is not None, ends))
        below = node
    pick = np.flatnonzero(~below["open"])
    out.add(below, pick, 0, None, None)
    yield from out.batches()
    for i, left in open_marks.items():
        if left:
            nulls = [pa.nulls(1, f.type) for f in list(OUT)[1:11]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([PATH], pa.int32()), *nulls, pa.array([paths[i]], pa.binary()), pa.array([words[i]], pa.list_(pa.int64())),
                 pa.array([np.array(left, MARK).tobytes()], pa.binary())], schema=OUT)


def peel_chunks(level: DataFrame, whole: bool, keyed: bool, rows: int) -> DataFrame:
    """Peels all paths in sorted chunks, or as one chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: list[tuple] = []
        size = 0
        for batch in pieces(batches, 500):
            for path, words, marks in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                chunk.append((path, words.values.to_numpy().astype(np.int64), np.frombuffer(marks, MARK)))
                size += len(path) * 2 + len(marks)
                if not whole and (len(chunk) >= rows or size >= CHUNK_BYTES and len(chunk) >= LEAST_ROWS):
                    yield from peel(*map(list, zip(*chunk, strict=True)), whole, keyed)
                    chunk, size = [], 0
        if chunk:
            yield from peel(*map(list, zip(*chunk, strict=True)), whole, keyed)

    dealt = level.repartition(1) if whole else level.repartitionByRange("path")
    return dealt.sortWithinPartitions("path").mapInArrow(run, SCHEMA)


def trie(convs: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Nodes of the trie of conversations (conv_id, path, words): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    level, found = stage(distinct_paths(stage(convs, "trie-convs")), "trie-level"), []
    while True:
        rows, size = level.agg(F.count("*"), F.coalesce(F.sum(2 * F.octet_length("path") + F.octet_length("marks")), F.lit(0))).first()
        # a chunk keeps two paths at most, so few chunks are left after few rounds
        whole = rows <= max(chunk_rows, LEAST_ROWS) and (size <= CHUNK_BYTES or rows <= LEAST_ROWS)
        out = stage(peel_chunks(level, whole, bool(found), max(chunk_rows, LEAST_ROWS)), "trie-nodes")
        found.append(out)
        if whole:
            break
        level = out.where(F.col("kind") == PATH).select("path", "words", "marks")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    nodes = found[0].where(F.col("kind") == NODE).select(*columns)
    for out in found[1:]:
        nodes = nodes.unionByName(out.where(F.col("kind") == NODE).select(*columns))
    for i, out in enumerate(found[:-1]):
        later = found[i + 1].where("own_key is not null").select("own_key", F.col("conv_id").alias("p"))
        for more in found[i + 2:]:
            later = later.unionByName(more.where("own_key is not null").select("own_key", F.col("conv_id").alias("p")))
        waiting = out.where(F.col("kind") == WAITING).join(later.withColumnRenamed("own_key", "parent_key"), "parent_key")
        nodes = nodes.unionByName(waiting.withColumn("parent_conv_id", F.col("p")).select(*columns))
    return nodes.withColumn("ends_sha256", F.coalesce(F.lower(F.hex("ends")), F.sha2(F.lit(""), 256))).drop("ends")


def op12_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(table(spark, sf_dir, "conversations")))


#: heads by CRC-32 bit by bit; nodes by the JSON of their turns; subtrees by joining every node with the nodes above it
OP12_SQL = r"""
WITH own AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns,
    list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
whole AS (
  SELECT o.conv_id, list_concat(coalesce(b.turns[1:xor(o.crc, 4294967295) % 4], []), o.turns[xor(o.crc, 4294967295) % 4 + 1:]) AS turns
  FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
pre AS (
  SELECT conv_id, d, len(turns) AS l, sha256(CAST(to_json(turns[1:d]) AS VARCHAR)) AS k,
    CASE WHEN d > 0 THEN sha256(CAST(to_json(turns[1:d - 1]) AS VARCHAR)) END AS pk,
    CASE WHEN d > 0 THEN len(regexp_extract_all(turns[d].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS w
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM whole)),
node AS (
  SELECT k, d AS depth, any_value(pk) AS pk, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS own_saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (l = d), '')) AS ends_sha256
  FROM pre GROUP BY k, d),
kids AS (SELECT pk AS k, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY pk),
full_node AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children, p.conv_id AS parent_conv_id
  FROM node n LEFT JOIN kids c ON c.k = n.k LEFT JOIN node p ON p.k = n.pk),
above AS (
  SELECT DISTINCT a.k AS top, b.k AS k FROM pre a JOIN pre b ON a.conv_id = b.conv_id AND a.d <= b.d),
sums AS (
  SELECT top, CAST(sum(own_saved) AS BIGINT) AS saved_tokens, CAST(count(*) FILTER (n_children = 0) AS BIGINT) AS n_leaves
  FROM above JOIN full_node USING (k) GROUP BY top)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM full_node JOIN sums ON top = k
"""
