"""Secret scan: fixed patterns plus character Markov models, in DataFrame functions only.

Three patterns give the base spans. Further candidates are long unbroken strings outside them. Two first-order Markov
models over characters, one of random strings and one of ordinary identifiers, are trained on labelled samples: values of
base matches are labelled random, words of texts are labelled ordinary. A candidate is a secret if the mean
log-likelihood ratio per character step reaches a threshold. Both samples are bounded by `MAX_VALUES` and `MAX_TEXTS`;
without labelled secrets the random model is uniform.

Starts come from the lengths of what lies between and in matches, so every pattern reads a text once per function and no
text is searched again for each match. Positions are code points, ends exclusive.

Null and empty texts give no spans; a null doc_id keeps its row; repeated rows keep one result each; further columns stay
untouched in `with_spans` and `redact` unless they are named like a result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, take_columns

#: fixed values: the base patterns
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
MIN_VALUE = 8

KINDS = ["assign", "access", "hex", "markov"]
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WORD = r"[A-Za-z_][A-Za-z0-9_-]{4,}"
MAX_VALUES, MAX_TEXTS = 2000, 300
THRESHOLD = 0.7  # nats for each character step
MASK = "[SECRET]"


def matches(text: Column, pattern: str, kind: int) -> Column:
    """Matches in order: array of (start, kind, stop, value)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # lengths of gap and match in turn; a running sum gives the starts
    both = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.char_length).alias("gap"), found.alias("hit"))
    step = F.aggregate(
        F.filter(both, lambda x: x["hit"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,kind:int,stop:int,value:string>>)").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.char_length(x["hit"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + x["gap"]).alias("start"), F.lit(kind).alias("kind"),
                (acc["at"] + x["gap"] + F.char_length(x["hit"])).alias("stop"), x["hit"].alias("value")))).alias("out")),
        lambda acc: acc["out"])
    return F.when(text.rlike(pattern), step).otherwise(
        F.expr("cast(array() as array<struct<start:int,kind:int,stop:int,value:string>>)"))


def base_spans(text: Column) -> Column:
    assign = F.transform(matches(text, ASSIGN, 0), lambda m: m.withField("value", F.regexp_extract(m["value"], ASSIGN, 2)))
    return F.concat(F.filter(assign, lambda m: F.char_length(m["value"]) >= MIN_VALUE),
                    matches(text, ACCESS, 1), matches(text, HEX, 2))


def steps_of(values: DataFrame) -> DataFrame:
    """Counts of character pairs (a, b) in the strings `value`; characters outside the alphabet end a run."""
    pairs = values.select(F.explode(F.expr("transform(sequence(1, char_length(value) - 1), i -> substring(value, i, 2))")
                                    ).alias("ab"))
    return (pairs.select(F.expr(f"instr('{ALPHABET}', substring(ab, 1, 1)) - 1").alias("a"),
                         F.expr(f"instr('{ALPHABET}', substring(ab, 2, 1)) - 1").alias("b"))
            .where("a >= 0 and b >= 0").groupBy("a", "b").count())


def train(docs: DataFrame) -> list[float]:
    """Log-likelihood ratio of each character step, random over ordinary, at a * size + b."""
    docs = take_columns(docs, "doc_id", "text")
    order = F.xxhash64("doc_id", F.xxhash64("text"))
    labelled = (docs.where(F.col("text").rlike(f"{ASSIGN}|{ACCESS}|{HEX}"))
                .select(order.alias("o"), F.explode(base_spans(F.col("text"))).alias("m"))
                .select("o", F.col("m.value").alias("value")).orderBy("o", "value").limit(MAX_VALUES))
    plain = (docs.where("text is not null").select(order.alias("o"), "text").orderBy("o").limit(MAX_TEXTS)
             .select(F.explode(F.regexp_extract_all(F.regexp_replace("text", f"{ASSIGN}|{ACCESS}|{HEX}", " "),
                                                    F.lit(WORD), F.lit(0))).alias("value")))
    size = len(ALPHABET)
    tables = []
    for sample in (labelled, plain):
        counts = [[1.0] * size for _ in range(size)]
        for r in steps_of(sample.where("char_length(value) > 1")).collect():  # at most size * size rows
            counts[r["a"]][r["b"]] += r["count"]
        tables.append([[math.log(x / sum(row)) for x in row] for row in counts])
    random, ordinary = tables
    return [random[a][b] - ordinary[a][b] for a in range(size) for b in range(size)]


def with_spans(docs: DataFrame, model: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with `all_spans`: array of (start, kind, stop, value), base and Markov ones, by start, then kind."""
    size = len(ALPHABET)
    ratios = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    text = F.coalesce(F.col("`text`"), F.lit(""))

    def score(value: Column) -> Column:
        at = F.transform(F.sequence(F.lit(1), F.char_length(value)),
                         lambda i: F.instr(F.lit(ALPHABET), F.substring(value, i, F.lit(1))) - 1)
        return F.aggregate(
            F.arrays_zip(F.slice(at, F.lit(1), F.size(at) - 1).alias("a"), F.slice(at, F.lit(2), F.size(at) - 1).alias("b")),
            F.lit(0.0), lambda acc, x: acc + F.get(ratios, x["a"] * size + x["b"]),
            lambda acc: acc / (F.size(at) - 1))

    apart = lambda base: lambda c: ~F.exists(base, lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"]))
    rows = docs.withColumn("_base", base_spans(text)).withColumn("_more", matches(text, CANDIDATE, 3))
    more = F.filter(F.filter("_more", apart(F.col("_base"))), lambda c: score(c["value"]) >= threshold)
    return rows.withColumn("all_spans", F.array_sort(F.concat("_base", more))).drop("_base", "_more")


def written(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(name, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of `docs` (doc_id, text)."""
    docs = take_columns(docs, "doc_id", "text")
    rows = with_spans(docs, model or train(docs)).select("doc_id", "all_spans")
    count = lambda k: F.size(F.filter("all_spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("all_spans", lambda s: s["kind"] < 3)
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                       F.sha2(written(base), 256).alias("base_sha256"), written(F.col("all_spans")).alias("spans"))


def redact(docs: DataFrame, model: list[float] | None = None, mask: str = MASK) -> DataFrame:
    """`docs` with every secret in `text` replaced by the mask; overlapping spans share one mask. Null text stays null."""
    rows = with_spans(docs, model or train(docs))
    text = F.col("`text`")
    built = F.aggregate(
        "all_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["stop"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(
                acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)))
            .otherwise(acc["out"]).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    return rows.withColumn("text", F.when(F.size("all_spans") > 0, built).otherwise(text)).drop("all_spans")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
