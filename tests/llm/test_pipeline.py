"""Every stage of the pipeline on its own input, and the whole of it."""

import re

import corpus_pipeline as cp
from test_classify import base_spans
from test_join_and_search import brute_components

from tengen.llm import decontam

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = [decontam.words_of(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    before = {r.doc_id: r for r in docs.collect()}
    for name, step in cp.STAGES[:-1]:
        out = step(spark, docs, SMALL)
        assert out.columns == cp.COLUMNS
        rows = {r.doc_id: r for r in out.collect()}
        if name == "language_id":
            assert rows.keys() == {d for d, r in before.items() if any(c.isalpha() for c in r.text)}
        elif name == "near_duplicates":
            assert rows.keys() == {d for d, (_, c) in brute_components([(r.doc_id, r.text) for r in before.values()]).items() if c == d}
        elif name == "decontamination":
            joined = {d: b" " + b" ".join(decontam.words_of(r.text)) + b" " for d, r in before.items()}
            leaks = {d for d, t in joined.items() if any(b" " + b" ".join(b) + b" " in t for b in bench)}
            assert rows.keys() == before.keys() - leaks and leaks
        else:
            assert rows.keys() == before.keys()
            assert all(r.n_chars == len(r.text) for r in rows.values() if r.text != before[r.doc_id].text)
            assert not any(re.search(r"[0-9a-f]{32,}|AKIA[A-Z0-9]{12,}", r.text) for r in rows.values())
            assert {d for d, r in rows.items() if "[SECRET]" in r.text} >= {d for d, r in before.items() if base_spans(r.text)}


def test_edge_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the thing and that", "en", "s", 5), (3, "the house of the tree", "en", "s", 1),
            (3, "the house of the tree", "en", "s", 1), (3, "the house of the tree", "en", "t", 1)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, start string")
    for _, step in cp.STAGES:
        step(spark, docs, SMALL).collect()
        step(spark, docs.where("false"), SMALL).collect()
    kept = cp.near_duplicates(spark, docs, SMALL).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 2, 3]


def test_run(spark):
    out = cp.run(spark, SMALL)
    total = out.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert sum(r[1] < 1024 for r in total) <= 1 and max(r[1] for r in total) <= 1024


def test_near_duplicates_of_five_words_and_a_fifth(spark):
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join([*base, *(f"a{i}_{k}" for k in range(more))]), "en", "s", 1) for i, more in enumerate((0, 22, 27, 34, 60))]
    sets = [{tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for _, t, *_ in rows]
    alike = [len(sets[0] & s) / len(sets[0] | s) for s in sets]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in cp.near_duplicates(spark, docs, SMALL).collect()}
    assert kept == {0} | {i for i, x in enumerate(alike) if x < 0.8} == {0, 3, 4}


def test_rows_that_share_an_id(spark):
    text = lambda a, n=60: " ".join(f"{a}{k}" for k in range(n))
    rows = [(5, text("p"), "en", "s", 1), (5, text("q"), "en", "s", 1), (9, text("q") + " more", "en", "s", 1), (5, text("q"), "de", "t", 2),
            (3, text("p"), "en", "s", 1), (4, None, "en", "s", 0), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((r.doc_id, r.text or "") for r in cp.near_duplicates(spark, docs, SMALL).collect())
    assert kept == sorted([(3, text("p")), (5, text("q")), (4, ""), (4, "")])  # of each group one row, unlinked texts all


def test_many_equal_rows_of_one_id(spark):
    from tengen.llm import near_join

    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.range(100_000).selectExpr("7L as doc_id", f"'{text}' as text").unionByName(
        spark.createDataFrame([(8, text), (9, text + " x"), (10, "other words")], "doc_id long, text string"))
    got = near_join.near_components(docs).groupBy("doc_id", "component_id").count().collect()
    assert {(r.doc_id, r.component_id, r["count"]) for r in got} == {(7, 7, 100_000), (8, 7, 1), (9, 7, 1), (10, 10, 1)}
