"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of one to three lower-cased characters that end in a letter (all else counts as a blank), as
frequency within the text times IDF. IDF is counted over all rows that may be learned from. The weights are fitted with
follow-the-regularised-leader (per-coordinate steps, L1 and L2 penalties) on a sample bounded by `MAX_ROWS`, dealt
evenly to the languages; a fifth of the sample is kept back to fit the temperature of the softmax.

Held-out rows (crc32 of doc_id as text, modulo 3, is 1) are never learned from. Texts that are null or hold no letter are
`und` with score 0, as is everything if nothing is labelled. Equal rows get equal results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LETTER, char_classes, pieces, table, take_columns, texts_of
from .subwords import release

BUCKETS = 1 << 15
ORDERS = 3
SCALE = 50.0
MAX_ROWS = 2000
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 0.02, 0.01
SLICE = 1 << 18  # characters handled at once
ROWS = 500  # rows held at once with their texts
UNKNOWN = "und"
MIN_SCORE = 0.5  # less sure texts are rejected by the filter


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # bucket x language, IDF and temperature included


def grams(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of texts: (first, behind last, buckets orders x grams, start of each text among the grams)."""
    kinds = char_classes()
    at = 0
    while at < len(texts):
        sizes = np.cumsum([len(t) + 3 for t in texts[at:at + 4096]])
        upto = at + max(1, int(np.searchsorted(sizes, SLICE)))
        joined = "\n\n\n" + "\n\n\n".join(t.lower() for t in texts[at:upto])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = kinds[np.minimum(points, 0x10FFFF)] == LETTER
        points = np.where(letter, points, 32).astype(np.uint32)
        where = np.flatnonzero(letter)
        key, out = np.zeros(len(where), np.uint32), []
        for k in range(ORDERS):
            key = (key ^ points[where - k]) * np.uint32(0x9E3779B1) + np.uint32(k)
            out.append(((key ^ (key >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(17)).astype(np.int32))
        starts = np.cumsum([0] + [len(t.lower()) + 3 for t in texts[at:upto]])[:-1]
        yield at, upto, np.stack(out), np.searchsorted(where, starts)
        at = upto


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def bounds(starts: np.ndarray, total: int) -> np.ndarray:
    return np.append(starts, total)


def document_counts(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and the number of texts, over all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in pieces(batches, ROWS):
            for a, b, keys, starts in grams(texts_of(batch.column(0))):
                n += b - a
                edge = bounds(starts, keys.shape[1])
                for lo in range(0, b - a, 64):
                    hi = min(lo + 64, b - a)
                    owner = np.repeat(np.arange(hi - lo), np.diff(edge[lo:hi + 1]))
                    seen = np.zeros((hi - lo, BUCKETS), bool)
                    for row in keys[:, edge[lo]:edge[hi]]:
                        seen[owner, row] = True
                    df += seen.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BUCKETS)), pa.array(np.append([n], df))],
                                         names=["bucket", "n"])

    rows = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS + 1, np.int64)
    out[rows["bucket"].to_numpy() + 1] = rows["n"].to_numpy()
    return out[1:], int(out[0])


def sample(docs: DataFrame, max_rows: int) -> pd.DataFrame:
    """Sparse counts of a bounded, evenly dealt sample of the labelled rows: lang, buckets, counts."""
    labelled = docs.where("lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    n_langs = max(1, labelled.select("lang").distinct().count())
    each = max(20, max_rows // n_langs)
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = (labelled.select("lang", "doc_id").withColumn("k", F.row_number().over(w)).where(F.col("k") <= each)
           .select("doc_id").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in pieces(batches, ROWS):
            data = []
            for a, b, keys, starts in grams(texts_of(batch.column(1))):
                edge = bounds(starts, keys.shape[1])
                for i in range(b - a):
                    k, c = np.unique(keys[:, edge[i]:edge[i + 1]], return_counts=True)
                    data.append((k.astype(np.int32).tobytes(), c.astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in data], pa.binary()),
                                              pa.array([x for _, x in data], pa.binary())],
                                             names=["lang", "buckets", "counts"])

    rows = labelled.join(F.broadcast(ids), "doc_id", "left_semi").select("lang", "text").limit(2 * each * n_langs)
    return rows.mapInArrow(run, "lang string, buckets binary, counts binary").toPandas()


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(rows: pd.DataFrame, idf: np.ndarray) -> Model | None:
    rows = rows.sort_values(["lang", "buckets", "counts"])
    langs = sorted(rows["lang"].unique())
    y = rows["lang"].map({v: i for i, v in enumerate(langs)}).to_numpy()
    xs = []
    for k, c in zip(rows["buckets"], rows["counts"], strict=True):
        k, c = np.frombuffer(k, np.int32), np.frombuffer(c, np.int32)
        xs.append((k, SCALE * c / max(1, c.sum()) * idf[k]))
    use = [i for i, x in enumerate(xs) if len(x[0])]
    if not use:
        return None
    order = np.random.default_rng(7).permutation(use)
    kept, back = (order[len(order) // 5:], order[:len(order) // 5]) if len(order) >= 50 else (order, order)
    z, n = np.zeros((BUCKETS, len(langs))), np.zeros((BUCKETS, len(langs)))

    def weights(k: np.ndarray) -> np.ndarray:
        zk = z[k]
        return np.where(np.abs(zk) <= L1, 0.0, (np.sign(zk) * L1 - zk) / ((BETA + np.sqrt(n[k])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i in kept:
            k, v = xs[i]
            w = weights(k)
            p = softmax(v @ w)
            p[y[i]] -= 1
            g = v[:, None] * p
            z[k] += g - (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / ALPHA * w
            n[k] += g * g
    w = weights(np.arange(BUCKETS))
    logits = np.stack([xs[i][1] @ w[xs[i][0]] for i in back])
    loss = [(-np.log(softmax(logits / t)[np.arange(len(back)), y[back]] + 1e-12).mean(), t)
            for t in np.geomspace(0.1, 10, 81)]
    return Model(langs, (SCALE * idf[:, None] * w / min(loss)[1]).astype(np.float32))


def train(docs: DataFrame, max_rows: int = MAX_ROWS) -> Model | None:
    """The model from rows (doc_id, text, lang) that are not held out; None if none is labelled."""
    docs = take_columns(docs, "doc_id", "text", "lang")
    learn = docs.where("lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    df, n = document_counts(learn.select("text"))
    return fit(sample(docs, max_rows), np.log((1 + n) / (1 + df)) + 1) if n else None


def predict(docs: DataFrame, model: Model | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`docs` with the predicted language and its probability, under the given names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    first, second = names

    def scores(texts: list[str]) -> tuple[list[str], list[float]]:
        m, found, sure = shared.value, [], []
        for a, b, keys, starts in grams(texts):
            edge = bounds(starts, keys.shape[1])
            size = np.diff(edge)
            if m is None:
                found += [UNKNOWN] * (b - a)
                sure += [0.0] * (b - a)
                continue
            total = np.zeros((b - a, len(m.langs)))
            full = np.flatnonzero(size)
            if len(full):
                for row in keys:
                    total[full] += np.add.reduceat(m.weights[row], edge[full], axis=0, dtype=np.float64)
            p = softmax(total / np.maximum(1, ORDERS * size)[:, None])
            found += [m.langs[k] if s else UNKNOWN for k, s in zip(p.argmax(1), size, strict=True)]
            sure += np.where(size > 0, p.max(1), 0.0).tolist()
        return found, sure

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in pieces(batches, ROWS):
            found, sure = scores(texts_of(batch.column(batch.schema.get_field_index("text"))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(sure, pa.float64())],
                                             names=[*batch.schema.names, first, second])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"{first} string", f"{second} double"])
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of `docs` (doc_id, text, lang)."""
    model = train(docs, max_rows)
    return predict(take_columns(docs, "doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Rows of `docs` in a language the model is sure of, with their own columns."""
    rows = predict(docs, train(docs), ("_language_", "_sure_"))
    return rows.where((F.col("_language_") != UNKNOWN) & (F.col("_sure_") >= min_score)).drop("_language_", "_sure_")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
