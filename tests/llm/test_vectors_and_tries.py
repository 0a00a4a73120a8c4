"""Whitening, exact top-k products and the conversation trie against brute force."""

import hashlib
import zlib

import numpy as np
import pytest

from tengen.llm import impact_index, turn_trie, whitening
from tengen.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, x string, no string, w string"


def frame(spark, rows):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in rows]
    return spark.createDataFrame([(i, v, 1, "x", "y", "z") for i, v in rows], VECTORS)


def usable(v):
    return v is not None and all(c is not None and np.isfinite(c) for c in v)


# ---- exact top-k ------------------------------------------------------------------------------------------------

def brute_top(rows, k, every, scale):
    rows = sorted({(i, tuple(np.float32(v).tolist())) for i, v in rows if i is not None and usable(v)})
    ints = [(i, np.floor(scale * np.array(v, float)).astype(np.int64)) for i, v in rows]
    out = []
    for q, x in ints:
        if q % every == 0:
            best = sorted((-int(x @ y), i) for i, y in ints if i != q and len(x) == len(y))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def found_top(df, k=3, every=2, scale=64):
    return sorted(tuple(r) for r in impact_index.top_inner_products(df, k, every, scale).select("query_id", "rank", "vec_id", "score").collect())


def test_top_products_edges(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(6).round(1).tolist()) for i in range(80)]
    rows += [(100 + i, rows[4][1]) for i in range(60)]  # a hot vector, ties by id
    rows += [(4, rows[4][1]), (6, rows[7][1]), (None, rows[3][1]), (200, None), (202, [1.0, None, 0, 0, 0, 0]), (204, [float("nan")] * 6),
             (206, [float("inf")] + [0.0] * 5), (208, [0.0] * 6), (210, [1.0, 2.0]), (212, [2.0, -3.0]), (214, [5.0])]
    want = [r for r in brute_top(rows, 3, 2, 64) if r[0] != 6]
    got = found_top(frame(spark, rows))
    assert [r for r in got if r[0] != 6] == want
    assert sum(r[0] == 6 for r in got) == 6  # an id with two vectors asks twice
    assert {r[0] for r in got} == {i for i, v in rows if i is not None and i % 2 == 0 and usable(v)} - {214}
    assert found_top(frame(spark, rows).where("false")) == []


@pytest.mark.parametrize("block,shard", [(64, 128), (4096, 65536)])
def test_top_products_blocks_and_shards(spark, monkeypatch, block, shard):
    for name, value in (("BLOCK", block), ("SHARD", shard), ("PART", 40), ("BATCH", 16), ("SAMPLE", 50)):
        monkeypatch.setattr(impact_index, name, value)
    rng = np.random.default_rng(2)
    v = rng.standard_normal((700, 16)) * rng.choice([0.01, 1, 20], (700, 1))
    rows = [(int(i), x.astype(np.float32).tolist()) for i, x in enumerate(v)]
    assert found_top(frame(spark, rows), 7, 5) == brute_top(rows, 7, 5, 64)


def test_top_products_huge_components(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(c)) for c in rng.standard_normal(4) * 1e5]) for i in range(60)] + [(61, [1e30, 0.0, 0.0, 0.0])]
    got = [r for r in found_top(frame(spark, rows)) if r[2] != 61]
    want = {(q, i, s) for q, _, i, s in brute_top(rows[:60], 60, 2, 64)}
    assert got and {(q, i, s) for q, _, i, s in got} <= want


def test_segments_stop_only_on_proof():
    rng = np.random.default_rng(4)
    x = np.floor(64 * rng.standard_normal((3000, 64)) / 8).astype("<i4")
    block = impact_index.Block(x, [np.array([i]) for i in range(len(x))])
    queries = x[:40]
    scores = queries.astype(np.int64) @ x.T.astype(np.int64)
    least = np.sort(scores, axis=1)[:, -21].astype(float)
    entry, query = block.possible(queries, least)
    assert len(entry) <= 0.03 * scores.size  # most pairs are ruled out without their exact score
    assert set(zip(*np.nonzero(scores >= least[:, None]))) <= set(zip(query.tolist(), entry.tolist()))


# ---- whitening --------------------------------------------------------------------------------------------------

def check_whitened(rows, got, most=8):
    x = np.floor(1024 * np.array([np.float32(v) for _, v in rows], float)).astype(np.int64) + 100000
    n, s = len(x), x.sum(0)
    c = x - s / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    rank = min(most, int((e > 1e-13 * np.trace(v)).sum()))
    assert len(got) == n * rank
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
        assert r.n == n and r.identity_error <= 1e-9
    assert sorted(by) == list(range(1, rank + 1))
    deviation = [(i, int(d)) for (i, _), d in zip(rows, ((n * x - s) ** 2).sum(1), strict=True)]
    key = lambda p: (p[0] is not None, p[0] or 0, p[1])
    for k, part in by.items():
        assert sorted(((r.vec_id, r.deviation) for r in part), key=key) == sorted(deviation, key=key)
        assert abs(part[0].explained / (e[k - 1] / np.trace(v)) - 1) < 1e-9
        w = c @ u[:, k - 1] / np.sqrt(e[k - 1])
        want = dict(zip([i for i, _ in rows], w, strict=True))
        sign = np.sign(sum(r.whitened * want[r.vec_id] for r in part))
        assert max(abs(sign * r.whitened - want[r.vec_id]) for r in part) < 1e-6


def test_whitening_edges(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(12) * np.arange(1, 13)).astype(np.float32).tolist()) for i in range(90)]
    rows += [rows[3], rows[3], (None, rows[4][1])]
    bad = [(300, None), (301, [float("nan")] * 12), (302, [None] * 12), (303, [float("-inf")] * 12), (304, [])]
    check_whitened(rows, whitening.whitened(frame(spark, rows + bad)).collect())
    assert whitening.whitened(frame(spark, bad)).count() == 0
    assert whitening.whitened(frame(spark, rows).where("false")).count() == 0
    assert whitening.whitened(frame(spark, rows[:1])).count() == 0
    assert whitening.whitened(frame(spark, [(i, [0.5, 0.25]) for i in range(9)])).count() == 0


def test_whitening_rank_and_huge_entries(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(-40, 40, (70, 3)) / 8
    flat = [(i, [float(x) for x in (*r, r[0] + r[1], r[2], 0)]) for i, r in enumerate(base)]  # rank 3 of 6
    check_whitened(flat, whitening.whitened(frame(spark, flat)).collect())
    huge = [(i, [float(np.float32(x * 1e9)) for x in r]) for i, r in enumerate(base)]
    got = whitening.whitened(frame(spark, huge)).collect()
    assert len(got) == 210 and all(r.deviation is None or r.deviation >= 0 for r in got)


def test_jacobi_on_a_pivoted_factor():
    rng = np.random.default_rng(7)
    for size, rank in ((1, 1), (5, 5), (9, 4), (30, 30)):
        a = rng.standard_normal((size, rank)) * 10.0 ** -np.arange(rank).clip(0, 6)
        v = a @ a.T
        factor = whitening.pivoted_cholesky(v)
        assert np.abs(factor @ factor.T - v).max() <= 1e-12 * np.trace(v)
        e, u = whitening.components_of(v, size)
        assert np.allclose(e, np.linalg.eigvalsh(v)[::-1][:len(e)], rtol=1e-8, atol=1e-14 * np.trace(v))
        assert np.abs(u.T @ u - np.eye(len(e))).max() < 1e-9


# ---- conversation trie ------------------------------------------------------------------------------------------

def white(c):
    return c in " \t\n\x0b\x0c\r"


def words(text):
    return len("".join(" " if white(c) else c for c in text).split(" ")) - sum(
        not p for p in "".join(" " if white(c) else c for c in text).split(" "))


def turn_key(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def brute_trie(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, turn_key(r or "", x or ""), (r or "", x or "")))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    convs = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        convs[c] = tuple(own.get(c - c % 20, [])[:h] + ts[h:])
    members = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    out = set()
    saved = {p: (len(m) - 1) * (words(p[-1][1]) if p else 0) for p, m in members.items()}
    for p, m in members.items():
        below = [q for q in members if q[:len(p)] == p]
        parents = {q[:-1] for q in members if q}
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), sum(q[:-1] == p for q in members if q),
                 sum(q not in parents for q in below), sum(saved[q] for q in below), hashlib.sha256(ends.encode()).hexdigest()))
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def random_conversations(seed, convs, deep=6):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(convs):
        for t in range(int(rng.integers(0, deep))):
            rows.append((int(c), t, ["user", "bot"][t % 2], " ".join(["w"] * int(rng.integers(1, 3)) + [str(rng.integers(0, 2))])))
    return rows


@pytest.mark.parametrize("chunk", [16, 4000])
def test_trie_of_chunks(spark, chunk):
    rows = random_conversations(8, 300) + [(1000 + i, t, "user", f"same {t}") for i in range(150) for t in range(3)]
    rows += [(5000, t, "user", "deep") for t in range(300)] + [(5020, t, "user", "deep") for t in range(280)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = turn_trie.trie(turn_trie.rebuilt(df), chunk).collect()
    want = brute_trie(rows)
    assert len(got) == len(want) and {tuple(r[c] for c in COLUMNS) for r in got} == want


def test_trie_edges(spark):
    rows = [(1, None, None, None), (1, 0, "user", "a b"), (1, 0, "user", "a b"), (2, 5, "user", ""), (3, 0, "bot", "x" * 300_000), (None, 0, "user", "q"),
            (20, 0, "user", "a b"), (20, 1, "bot", "c d e"), (21, 0, "user", "zz"), (22, 0, "user", "a b"), (23, 1, "u:", "ser"), (24, 1, "u", ":ser"),
            (-3, 0, "user", "a b")]
    df = spark.createDataFrame([(*r, "n", "k") for r in rows], "conv_id long, turn long, role string, text string, path string, words string")
    got = turn_trie.trie(turn_trie.rebuilt(df)).collect()
    want = brute_trie(rows)
    assert len(got) == len(want) and {tuple(r[c] for c in COLUMNS) for r in got} == want
    root = next(r for r in got if r.depth == 0)
    assert root.n_convs == 9 and root.parent_conv_id is None and root.conv_id == -3
    assert turn_trie.trie(turn_trie.rebuilt(df.where("false"))).count() == 0


@pytest.mark.parametrize("name", ["op11_whitening", "op12_turn_trie", "op13_top_products"])
def test_registered_queries(spark, name):
    got = QUERIES[name](spark, SMALL).collect()
    if name == "op12_turn_trie":
        rows = spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
        assert {tuple(r[c] for c in COLUMNS) for r in got} == brute_trie([tuple(r) for r in rows])
        return
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    if name == "op11_whitening":
        check_whitened(rows, got)
    else:
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute_top(rows, 20, 20, 64)
