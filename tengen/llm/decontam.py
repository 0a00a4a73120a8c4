"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are a stated query set, worked on in blocks of `ITEMS_AT_ONCE`; all documents are searched for all items.

1. Documents become sequences of word numbers over the words of the items (other words cannot match); they are written
   once. Words are weighted by their frequency over distinct texts, so copies of a text do not make its words common; words of
   more than every third text keep a small weight, so an item of nothing else is still found.
2. Items of similar length form groups of at most `GROUP`. Passages of a group are windows of three times its longest item, half
   a window apart, so every stretch of one and a half times an item's length lies within one.
3. The latent space of a group comes from one distributed pass that multiplies a random block by A'A (A: the TF-IDF matrix of its
   passages); the result and random mixes of the items, as many as there are items, are orthonormalised, and a second pass
   gives the small Gram matrix that turns the basis to its singular vectors. Every task returns one matrix of fixed size;
   they are summed in Spark. The basis is not cut, so the second pass turns it and changes no product.
4. Passages and items are multiplied in the latent space. A pair is a candidate unless the product, plus what the parts outside
   of the space could add (by their lengths), stays below the least product of a passage with half of the item's weight.
5. A candidate counts if the longest common subsequence covers most of the item's words, or fewer of them together with most of
   its answer (its last words), and the shared words carry enough of the item's IDF, so common words alone never do.

Words are lower-cased and stripped of ASCII punctuation. Null and empty texts and items match nothing; null ids keep their
meaning as ids; repeated rows give repeated rows; further columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, stage, table, take_columns, texts_of
from .subwords import release

GROUP, EXTRA = 256, 32  # items of a latent space; random directions of the corpus in it
COMMON = 0.1  # weight of words that more than every third text holds
MIN_LCS, FEWER_LCS, MIN_ANSWER, MIN_WEIGHT = 0.75, 0.5, 0.6, 0.5
ANSWER_SHARE = 0.2
ITEMS_AT_ONCE = 5000
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ROWS = 2000  # passages multiplied at once
VALUES = 20_000  # their words multiplied at once
SCHEMA = "doc_id long, item_id long, cosine double, lcs int, item_words int, answer_words int"


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(None, PUNCTUATION).split()


class Items:
    """A block of benchmark items over their own vocabulary."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        words = [(i, words_of(t or "")) for i, t in rows]
        words = [(i, w) for i, w in words if w]
        self.ids = [i for i, _ in words]
        self.number = {w: n for n, w in enumerate(sorted({x for _, w in words for x in w}))}
        self.words = [np.array([self.number[x] for x in w], np.int32) for _, w in words]
        self.groups = [Group(self, g) for g in by_length(self.words)]


class Group:
    """Items of similar length, over their own part of the vocabulary; the last of `local` stands for words of no item."""

    def __init__(self, items: Items, some: list[int]) -> None:
        self.ids = [items.ids[i] for i in some]
        self.seen = np.unique(np.concatenate([items.words[i] for i in some]))
        self.local = np.full(len(items.number) + 1, -1, np.int32)
        self.local[self.seen] = np.arange(len(self.seen))
        self.words = [self.local[items.words[i]] for i in some]
        longest = max(len(w) for w in self.words)
        self.step = longest + longest // 2


def by_length(words: list[np.ndarray]) -> list[list[int]]:
    """Items by doubling length, at most GROUP together."""
    classes: dict[int, list[int]] = {}
    for i in sorted(range(len(words)), key=lambda i: len(words[i])):
        classes.setdefault((len(words[i]) - 1).bit_length(), []).append(i)
    return [c[at:at + GROUP] for c in classes.values() for at in range(0, len(c), GROUP)]


def sequences(docs: DataFrame, items: Broadcast) -> DataFrame:
    """doc_id, word numbers (-1: in no item; empty without a word of an item) and a hash of the text of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        get = items.value.number.get
        for batch in pieces(batches):
            out, digest = [], []
            for text in texts_of(batch.column(1)):
                words = words_of(text)
                seq = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
                out.append(seq.tobytes() if (seq >= 0).any() else b"")
                digest.append(int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(digest, pa.int64())],
                                             names=["doc_id", "words", "digest"])

    return stage(docs.mapInArrow(run, "doc_id long, words binary, digest long"), "decontam-words")


def weights(rows: DataFrame, size: int) -> np.ndarray:
    """IDF of every word over distinct texts: each of n copies counts as 1/n."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        df = np.zeros(size + 1)
        for batch in pieces(batches):
            share = 1 / batch.column(1).to_numpy()
            seqs = [np.frombuffer(w, np.int32) for w in batch.column(0).to_pylist()]
            words, owner = np.concatenate(seqs), np.repeat(np.arange(len(seqs)), [len(x) for x in seqs])
            key = np.unique((owner * size + words)[words >= 0])
            df[:-1] += np.bincount(key % size, share[key // size], size)
            df[-1] += share.sum()
        yield pa.RecordBatch.from_arrays([pa.array([df.tobytes()], pa.binary())], names=["m"])

    copies = stage(rows.groupBy("digest").count().where("count > 1"), "decontam-copies")
    shared = rows.join(copies, "digest", "left").select("words", F.coalesce("count", F.lit(1)).cast("double").alias("n"))
    df = summed(shared.mapInArrow(run, "m binary"), (size + 1,))
    idf = np.log((1 + df[-1]) / (1 + df[:-1]))
    return np.where(idf < 1.0, COMMON, idf)


def summed(matrices: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """Sum of the matrices (k, m) of all tasks, row by row in Spark, then brought to the driver (a fixed size)."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for m in batch.column(0).to_pylist():
                total += np.frombuffer(m).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    # written first, so that summing in fewer tasks does not slow down what makes the matrices
    matrices = stage(matrices, "decontam-sum")
    n = matrices.count()
    while n > 64:
        n = n // 16
        matrices = stage(matrices.coalesce(n).mapInArrow(rows, "m binary"), "decontam-sum")
    out = np.zeros(shape)
    for r in matrices.toLocalIterator():
        out += np.frombuffer(r["m"]).reshape(shape)
    return out


class Rows:
    """TF-IDF passages of some documents as sparse rows: words and values one row after the other, where each row begins, and
    its document and first word there. Only passages of at least `least` weight are kept."""

    def __init__(self, seqs: list[np.ndarray], step: int, idf: np.ndarray, least: float = 0.0) -> None:
        sizes = np.array([len(x) for x in seqs], np.int64)
        count = np.maximum(1, -(-(sizes - step) // step))  # passages of each document
        base = np.cumsum(count) - count
        doc = np.repeat(np.arange(len(seqs)), sizes)
        word = np.concatenate([*seqs, np.zeros(0, np.int32)]).astype(np.int64)
        place = (np.arange(len(word)) - (np.cumsum(sizes) - sizes)[doc]) // step
        doc, place, word = doc[word >= 0], place[word >= 0], word[word >= 0]
        first, second = place < count[doc], place > 0  # a word lies in the passage that begins with its step and the one before
        key = np.concatenate([((base[doc] + place) * len(idf) + word)[first], ((base[doc] + place - 1) * len(idf) + word)[second]])
        key, times = np.unique(key, return_counts=True)
        row, self.words = key // len(idf), key % len(idf)
        if least:
            keep = np.bincount(row, idf[self.words], int(count.sum()))[row] >= least
            row, self.words, times = row[keep], self.words[keep], times[keep]
        self.values = (1 + np.log(times)) * idf[self.words]
        number, self.at, self.sizes = np.unique(row, return_index=True, return_counts=True)
        self.doc = np.searchsorted(base, number, "right") - 1
        self.start = (number - base[self.doc]) * step

    def times(self, block: np.ndarray) -> np.ndarray:
        out, lo = np.zeros((len(self.at), block.shape[1])), 0
        ends = self.at + self.sizes
        while lo < len(self.at):  # bounded slices of products
            hi = max(lo + 1, int(np.searchsorted(ends, self.at[lo] + VALUES)))
            a, b = self.at[lo], ends[hi - 1]
            out[lo:hi] = np.add.reduceat(block[self.words[a:b]] * self.values[a:b, None], self.at[lo:hi] - a, axis=0)
            lo = hi
        return out

    def turned(self, block: np.ndarray, size: int) -> np.ndarray:
        """Transpose of the rows, times a block with one row for each."""
        order = np.argsort(self.words, kind="stable")
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)[order]
        here, first = np.unique(self.words[order], return_index=True)
        out = np.zeros((size, block.shape[1]))
        out[here] = np.add.reduceat(block[owner] * self.values[order][:, None], first, axis=0)
        return out


def cut(datas: list[bytes], group: Group, rows: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Word numbers of documents in the group's own vocabulary, some documents of about so many passages at once."""
    lo, held, size = 0, [], 0
    for n, data in enumerate(datas):
        held.append(group.local[np.frombuffer(data, np.int32)])
        size += 1 + len(held[-1]) // group.step
        if size >= rows:
            yield lo, held
            lo, held, size = n + 1, [], 0
    if held:
        yield lo, held


def multiplied(seqs: DataFrame, shared_group: Broadcast, idf: np.ndarray, block: np.ndarray, gram: bool) -> np.ndarray:
    """A'(A block), or with gram (A block)'(A block), over the passages of all documents."""
    shape = (block.shape[1],) * 2 if gram else block.shape
    shared = seqs.sparkSession.sparkContext.broadcast((idf, block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (weight, right), group = shared.value, shared_group.value
        total = np.zeros(shape)
        for batch in batches:
            for _, some in cut(batch.column(0).to_pylist(), group, ROWS):
                rows = Rows(some, group.step, weight)
                if len(rows.at):
                    left = rows.times(right)
                    total += left.T @ left if gram else rows.turned(left, shape[0])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    return summed(seqs.select("words").mapInArrow(run, "m binary"), shape)


def vectors(group: Group, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of the items."""
    own = np.zeros((len(group.words), len(idf)))
    for r, words in enumerate(group.words):
        w, c = np.unique(words, return_counts=True)
        own[r, w] = (1 + np.log(c)) * idf[w]
    return own


def latent_space(seqs: DataFrame, group: Broadcast, idf: np.ndarray) -> np.ndarray:
    """Orthonormal directions (words x rank) of the TF-IDF matrix of all passages and of every item."""
    rng = np.random.default_rng(11)
    own = vectors(group.value, idf)
    corpus = multiplied(seqs, group, idf, rng.standard_normal((len(idf), EXTRA)), False)
    mixed = own.T @ rng.standard_normal((len(own), len(own)))
    basis = np.linalg.qr(np.concatenate([corpus, mixed], axis=1))[0]
    own_part = own @ basis
    gram = multiplied(seqs, group, idf, basis, True) + own_part.T @ own_part
    return basis @ np.linalg.eigh(gram)[1]


def least_product(weight: np.ndarray) -> float:
    """Least product of an item (of distinct words so weighted) with a passage whose shared words carry MIN_WEIGHT of it."""
    w = np.sort(weight)
    upto = np.cumsum(w)
    whole = int(np.searchsorted(upto, MIN_WEIGHT * upto[-1]))  # the lightest words cost least a weight; the last one in part
    rest = MIN_WEIGHT * upto[-1] - (upto[whole - 1] if whole else 0.0)
    return float((w[:whole] ** 2).sum() + rest * w[whole])


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bits."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for y in b.tolist():
        hit = row & where.get(y, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def matches(seqs: DataFrame, shared_group: Broadcast, idf: np.ndarray, space: np.ndarray) -> DataFrame:
    shared = seqs.sparkSession.sparkContext.broadcast((idf, space))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        (weight, axes), group = shared.value, shared_group.value
        distinct = [np.unique(w) for w in group.words]
        mass = np.array([weight[w].sum() for w in distinct])
        least = np.array([least_product(weight[w]) for w in distinct]) * (1 - 1e-9)
        own = vectors(group, weight)
        latent = own @ axes
        length = np.linalg.norm(latent, axis=1)
        outside = np.sqrt(np.maximum((own ** 2).sum(1) - length ** 2, 0))
        for batch in pieces(batches):
            found: dict[tuple[int, int], tuple] = {}
            docs = batch.column(0).to_pylist()
            for lo, some in cut(batch.column(1).to_pylist(), group, ROWS):
                rows = Rows(some, group.step, weight, MIN_WEIGHT * mass.min() * (1 - 1e-9))
                if not len(rows.at):
                    continue
                here = rows.times(axes)
                long = np.linalg.norm(here, axis=1)
                beyond = np.sqrt(np.maximum(np.add.reduceat(rows.values ** 2, rows.at) - long ** 2, 0))
                product = here @ latent.T
                for p, i in zip(*np.nonzero(product + np.outer(beyond, outside) >= least), strict=True):
                    at, n = rows.at[p], rows.doc[p]
                    both = np.intersect1d(distinct[i], rows.words[at:at + rows.sizes[p]], assume_unique=True)
                    if weight[both].sum() < MIN_WEIGHT * mass[i]:
                        continue
                    part, words = some[n][rows.start[p]:rows.start[p] + 2 * group.step], group.words[i]
                    lcs, tail = common_subsequence(words, part), words[-max(1, round(ANSWER_SHARE * len(words))):]
                    answer = common_subsequence(tail, part)
                    if lcs >= MIN_LCS * len(words) or (lcs >= FEWER_LCS * len(words) and answer >= MIN_ANSWER * len(tail)):
                        cosine = product[p, i] / max(long[p] * length[i], 1e-12)
                        hit = (float(cosine), lcs, len(words), answer)
                        if hit > found.get((lo + n, i), (-1.0,)):
                            found[lo + n, i] = hit
            hits = [(docs[n], group.ids[i], *v) for (n, i), v in found.items()]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
            columns = list(zip(*hits, strict=True)) if hits else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             names=["doc_id", "item_id", "cosine", "lcs", "item_words", "answer_words"])

    return seqs.select("doc_id", "words").mapInArrow(run, SCHEMA)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item found in it: doc_id, item_id, cosine, lcs, item_words, answer_words."""
    spark, docs = docs.sparkSession, take_columns(docs, "doc_id", "text")
    queries = take_columns(benchmark, "item_id", "text").where("text is not null")
    blocks = max(1, -(-queries.count() // ITEMS_AT_ONCE))
    out = spark.createDataFrame([], SCHEMA)
    for k in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        it = Items([(r["item_id"], r["text"]) for r in block.toLocalIterator()])  # one block of the query set
        if not it.words:
            continue
        rows = sequences(docs, spark.sparkContext.broadcast(it))
        seqs = rows.where("length(words) > 0").select("doc_id", "words")
        idf = weights(rows, len(it.number))
        for g in it.groups:
            group, own = spark.sparkContext.broadcast(g), idf[g.seen]
            out = out.unionByName(matches(seqs, group, own, latent_space(seqs, group, own)))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of `docs` in which no benchmark item was found, with their own columns. Rows are told apart by id and text, so a null
    id saves no row and a shared one costs none."""
    row = F.xxhash64(F.col("`doc_id`"), F.col("`text`"))
    found = contaminated(docs.select(row.alias("doc_id"), "text"), benchmark)
    hits = stage(found.select(F.col("doc_id").alias("_hit")).distinct(), "decontam-hits")
    return docs.join(hits, row == hits["_hit"], "left_anti")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
