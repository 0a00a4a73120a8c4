"""Near-duplicate join, neighbours and decontamination against brute force."""

import itertools
import re

import numpy as np
import pytest
from check import compare, connect

from tengen.llm import decontam, near_join, neighbours, queries
from tengen.llm.common import components

SMALL = "/root/testdata/sf0.001"


def brute_components(rows):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def join_of(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_join.near_components(df).collect()}


def test_near_join_small_cases(make):
    base = [f"w{i}" for i in range(60)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A B"), (6, "a b c"), (7, " ".join(base)), (8, " ".join(base).upper() + "  "),
            (9, " ".join([*base[:57], "x", "y", "z"])), (10, " ".join(["q", *base[:-1]])), (11, "é É"), (12, "É É"), (13, "a b c d e")]
    assert join_of(make(rows)) == brute_components(rows)
    twice = near_join.near_components(make([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "A b c D")])).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in twice) == sorted([(0, None), (1, 1), (1, 1), (2, 1)], key=lambda x: x[0])
    assert near_join.near_components(make(rows).where("false")).count() == 0


def test_near_join_groups_and_shared_passage(make):
    rng = np.random.default_rng(1)
    base, passage = [f"b{i}" for i in range(120)], " ".join(f"p{i}" for i in range(80))
    rows = []
    for i in range(150):  # near copies with one to three words changed, some chains over the limit
        words = list(base)
        for at in rng.choice(120, 1 + i % 3, replace=False):
            words[at] = f"c{i}_{at}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, passage + " " + " ".join(f"u{i}_{j}" for j in range(15 + i % 5))) for i in range(60)]
    rows += [(2000 + i, passage) for i in range(40)] + [(3000 + i, passage + f" v{i} v{i}") for i in range(40)]
    assert join_of(make(rows)) == brute_components(rows)


def test_near_join_table_and_sql(spark):
    got = queries.QUERIES["op4_near_join"](spark, SMALL).toPandas()
    assert compare(got, connect(SMALL).execute(queries.ORACLES["op4_near_join"]).df()) == ""


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (300, 200), (200, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[k] for k in range(100, 130)} == {100} and got[300] == got[200] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.standard_normal(16).astype(np.float32)]) for i in range(3000)]
    rows += [(5000 + i, [1.0] * 16) for i in range(400)]  # one very common vector
    rows += [(9000, None), (9100, [0.0] * 16), (9200, [float("nan")] * 16), (9300, [None] * 16), (9400, [float("inf")] * 16), (None, [1.0] * 16)]
    rows += [(100, rows[100][1]), (9500, [1.0, 2.0])]
    got = {}
    from tengen.llm.common import ship
    ship(spark)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, rank string")
    for r in neighbours.neighbours(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ids = np.array([i for i, v in rows[:3400]])
    vectors = np.array([v for _, v in rows[:3400]])
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0}
    hit = total = 0
    for q, found in got.items():
        d = np.sqrt(((vectors - vectors[ids == q]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11))
        for _, v, s in found:
            assert abs(s - d[ids == v][0]) < 1e-9
        hit, total = hit + len({v for _, v, _ in found} & set(ids[order].tolist())), total + 10
        if q >= 5000:
            assert [v for _, v, _ in found] == ids[order].tolist()
    assert hit >= 0.9 * total
    assert neighbours.neighbours(df.where("false")).count() == 0


def test_decontamination(spark, make):
    rng = np.random.default_rng(3)
    words = [f"term{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(words, 25 + i % 20))) for i in range(30)] + [(30, None), (31, ""), (32, "...")]
    filler = lambda n: " ".join(f"fill{x}" for x in rng.integers(0, 5000, n))
    docs, want = [], set()
    for d in range(200):
        text = filler(150)
        if d % 5 == 0:
            i = d % 30
            part = items[i][1].upper().replace(" ", "!! ") if d % 2 else items[i][1]
            if d % 3 == 0:  # a paraphrase: one word in eight replaced, one added
                w = part.split()
                part = " ".join("other" if k % 8 == 3 else x for k, x in enumerate(w)) + " more"
            text = filler(int(rng.integers(0, 200))) + " " + part + " " + filler(60)
            want.add((d, i))
        elif d % 7 == 0:
            text += " " + " ".join(items[d % 30][1].split()[:6])  # a short overlap is no leak
        docs.append((d, text))
    docs += [(900, None), (901, ""), (902, "x"), (None, items[3][1])]
    bench = spark.createDataFrame([(*i, 1.0) for i in items], "item_id long, text string, lcs double")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(make(docs), bench).collect()}
    assert got == want | {(None, 3)}
    kept = decontam.clean(make(docs), bench)
    # a contaminated row goes though its id is null, and a clean one stays though it shares its id with a contaminated one
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {d for d, _ in docs} - {d for d, _ in want} - {None}
    twice = make([(0, items[0][1]), (0, "a clean text of its own"), (None, items[0][1]), (None, "clean"), (7, items[1][1]), (7, items[1][1])])
    assert sorted((r.doc_id or -1, r.text) for r in decontam.clean(twice, bench).collect()) == [(-1, "a clean text of its own"), (-1, "clean")]
    assert decontam.contaminated(make(docs).where("false"), bench).count() == 0
    assert decontam.contaminated(make(docs), bench.where("false")).count() == 0


def test_longest_common_subsequence():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = rng.integers(0, 6, rng.integers(0, 20)), rng.integers(-1, 6, rng.integers(0, 30))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert decontam.common_subsequence(a, b) == table[-1, -1]


def test_decontamination_items_of_all_lengths_and_many(spark, make):
    rng = np.random.default_rng(6)
    words = [f"term{i}" for i in range(3000)]
    draw = lambda n: " ".join(rng.choice(words, n))
    items = [(i, draw(15 + i % 4)) for i in range(600)] + [(600, draw(400))]
    docs = [(i, f"{draw(300)} {items[i][1]} {draw(300)}") for i in range(601)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(make(docs), bench).collect()}
    assert got == {(i, i) for i in range(601)}


def test_decontamination_hot_item(spark, make):
    rng = np.random.default_rng(7)
    filler = lambda n: " ".join(f"fill{x}" for x in rng.integers(0, 5000, n))
    items = [(i, " ".join(f"i{i}w{k}" for k in range(60 if i == 4 else 20))) for i in range(5)]
    docs = [(d, f"{filler(65)} {items[0][1]} {filler(65)}" if d < 150 else filler(100)) for d in range(300)]
    docs += [(400 + d, f"{filler(5)} {items[1][1]}") for d in range(3)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(make(docs * 2), bench).collect()}
    assert got == {(d, 0) for d in range(150)} | {(400 + d, 1) for d in range(3)}


def test_near_join_without_long_methods(make, spark, monkeypatch):
    """No step of the join is planned with whole-stage code; the session's own setting is as before, also behind a failure."""
    plans, staged = [], near_join.stage

    def stage(df, label):
        plans.append(df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple"))
        return staged(df, label)
    monkeypatch.setattr(near_join, "stage", stage)
    before = spark.conf.get(near_join.WHOLE_STAGE)
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, text + " x"), (3, text + " y"), (4, "a b c d e")]
    assert join_of(make(rows)) == brute_components(rows)
    assert len(plans) > 8 and not [p for p in plans if "*(" in p]
    assert spark.conf.get(near_join.WHOLE_STAGE) == before
    with pytest.raises(ZeroDivisionError), near_join.small_methods(spark):
        assert 1 // 0
    assert spark.conf.get(near_join.WHOLE_STAGE) == before
