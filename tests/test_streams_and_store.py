"""Versioned stores, the change log, stateful standings, scopes as rows, landed pages and announced rounds."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from tengen.operators import live, search
from tengen.sources import landed, markup
from tengen.sources.store import Conflict, Store
from tengen.streaming import change_log, standings_state

ROWS = "owner string, v int"


def put(store, rows, table="t", buckets=4, stream=None):
    """Replace the rows of the owners in `rows`."""
    batch = store.spark.createDataFrame(rows, ROWS)

    def work(base):
        touched = store.touched(batch, "owner", buckets)
        old = store.read(table, ROWS, base, touched).join(batch.select("owner").distinct(), "owner", "left_anti")
        return {table: (buckets, store.write(table, old.unionByName(batch), "owner", buckets, touched))}
    return store.commit(work, stream)


def rows_of(store, at=None, table="t"):
    return sorted(tuple(r) for r in store.read(table, ROWS, at).collect())


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def test_versions_and_time_travel(store):
    assert rows_of(store) == [] and store.version().number == 0
    assert put(store, [("a", 1), ("b", 1), ("c", 1)]) == 1
    assert put(store, [("a", 2)]) == 2
    assert put(store, [("d", 3), ("d", 4)]) == 3
    assert rows_of(store) == [("a", 2), ("b", 1), ("c", 1), ("d", 3), ("d", 4)]
    assert rows_of(store, store.version(1)) == [("a", 1), ("b", 1), ("c", 1)]
    with pytest.raises(KeyError):
        store.version(9)


def test_interleaved_writers_lose_nothing(store, spark):
    put(store, [(f"o{i}", 0) for i in range(12)], buckets=2)
    tries = []

    def slow(owner, value, before_publish):
        batch = spark.createDataFrame([(owner, value)], ROWS)

        def work(base):
            tries.append((owner, base.number))
            touched = store.touched(batch, "owner", 2)
            old = store.read("t", ROWS, base, touched).join(batch.select("owner"), "owner", "left_anti")
            change = store.write("t", old.unionByName(batch), "owner", 2, touched)
            before_publish()
            return {"t": (2, change)}
        return store.commit(work)

    done = []
    # a second writer commits between the first one's reading and publishing, to the same bucket once, to the other one once
    where = {f"o{i}": int(r[0]) for i in range(12) for r in [spark.createDataFrame([(f"o{i}", 1)], ROWS).select(
        F.pmod(F.xxhash64("owner"), F.lit(2))).first()]}
    first = "o0"
    same = next(o for o in where if o != first and where[o] == where[first])
    other = next(o for o in where if where[o] != where[first])
    for rival in (same, other):
        todo = [rival]
        tries.clear()
        slow(first, len(done) + 10, lambda: todo and put(store, [(todo.pop(), 7)], buckets=2))
        done.append(len(tries))
    assert done == [2, 1]  # worked out again only where the rival touched the same bucket
    got = dict(rows_of(store))
    assert got[first] == 11 and got[same] == 7 and got[other] == 7 and len(got) == 12


def test_concurrent_writers(store, spark):
    put(store, [("x", 0)], buckets=2)
    errors = []

    def run(k):
        try:
            put(store, [(f"w{k}", k)], buckets=2)
        except Exception as e:  # noqa: BLE001
            errors.append(e)
    threads = [threading.Thread(target=run, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and rows_of(store) == sorted([("x", 0), *((f"w{k}", k) for k in range(4))])
    assert store.version().number == 5


def test_killed_writer_leaves_the_old_view(store):
    put(store, [("a", 1)])

    def dies(base):
        store.write("t", store.spark.createDataFrame([("a", 9)], ROWS), "owner", 4)
        raise RuntimeError("killed")
    with pytest.raises(RuntimeError):
        store.commit(dies)
    assert rows_of(store) == [("a", 1)]
    put(store, [("a", 2)])
    put(store, [("b", 2)])
    assert store.expire(keep=2) == 0  # too young to be given up
    assert store.expire(keep=1, older_than_ms=0) >= 2
    assert rows_of(store) == [("a", 2), ("b", 2)] and store.versions() == [3]
    assert store.expire(keep=1, older_than_ms=0) == 0


def test_repeated_batch_changes_nothing(store):
    put(store, [("a", 1)], stream=("s", 0))
    assert put(store, [("a", 5)], stream=("s", 0)) == 1
    assert put(store, [("a", 6)], stream=("s", 1)) == 2
    assert rows_of(store) == [("a", 6)]


def test_gives_up_after_so_many_rivals(store):
    put(store, [("a", 1)])
    with pytest.raises(Conflict):
        store.commit(lambda base: put(store, [("a", base.number)]) and {
            "t": (4, store.write("t", store.spark.createDataFrame([("a", 0)], ROWS), "owner", 4))}, tries=2)


# ---- change log ------------------------------------------------------------------------------------------------


def test_change_log_batches_compaction_and_replay(fx, spark):
    one, many = change_log.run_fixture(fx), change_log.run_fixture(fx, files_per_trigger=1)
    assert len(many.versions()) > len(one.versions()) == 1
    before = many.version()
    for name in change_log.TABLES:
        a, b = change_log.view(one, name), change_log.view(many, name)
        assert a.count() == b.count() > 0 and a.exceptAll(b).count() == 0
    number = change_log.compact(many, most=2)
    assert number == before.number + 1
    after = many.version()
    assert max(len(f) for t in after.tables for f in after.folders(t).values()) <= 2 < max(
        len(f) for t in before.tables for f in before.folders(t).values())
    for name in change_log.TABLES:
        a, b = change_log.view(one, name), change_log.view(many, name)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
        old = change_log.view(many, name, before)
        assert old.exceptAll(b).count() == 0
    # an older delivery of an emptied owner stays out after the fold, and a repeated batch changes nothing
    gone = fx.groups.filter("event_key % 160 = 0").limit(1).select(*[c for c in fx.groups.columns if c not in ("event_key", "g")])
    late = change_log.deliver(gone, "groups", 100, 5)
    change_log.apply(many, late, 10_000)
    assert change_log.view(many, "groups").join(gone.select("group_id"), "group_id", "left_semi").count() == 0
    assert change_log.apply(many, late, 10_000) == many.version().number


def test_deliveries_of_odd_rows(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    row = '{"group_id":"g","bout":1,"p1_id":"a","p2_id":"b","p1_score":%s}'
    batch = [("matches", "g", 5, 1, [row % 1, row % 2, "not json", row.replace('"a"', '"c"') % 3]), ("matches", "g", 5, 0, [row % 9]),
             ("matches", "h", 5, 1, []), ("matches", "i", 5, 1, None), ("unknown", "x", 1, 1, ["{}"]), ("events", "e", 1, 1, ['{"title":"t"}'])]
    change_log.apply(store, spark.createDataFrame(batch, change_log.ENVELOPE), 0)
    got = {(r.group_id, r.p1_id): r.p1_score for r in change_log.view(store, "matches").collect()}
    assert got[("g", "a")] == 2.0 and got[("g", "c")] == 3.0 and {g for g, _ in got} == {"g"}
    assert [(r.event_id, r.title) for r in change_log.view(store, "events").collect()] == [("e", "t")]
    assert change_log.view(store, "participants").count() == 0


# ---- stateful standings -----------------------------------------------------------------------------------------


def games(spark, rows):
    return spark.createDataFrame(rows, "group_id string, bout int, p1_id string, p2_id string, p1_result string, p2_result string, "
                                       "p1_score double, p2_score double, updated_at long, ingest_seq int")


def seats(spark, groups, players):
    return spark.createDataFrame([("e", g, "G", f"{g}-{p}", f"n{p}", "o", str(p), 0, 0, 0, "0", 0, 1) for g in groups for p in range(players)],
                                 "event_id string, group_id string, group_name string, participant_id string, participant_name string, org string, "
                                 "short_no string, win int, lose int, draw int, score string, rank int, updated_at long")


def test_standings_follow_each_batch(spark, tmp_path):
    """Corrections, late and repeated versions; only groups with changes come out; restart goes on from the checkpoint."""
    rnd = random.Random(5)
    people, land, store = seats(spark, ["g", "h"], 6), str(tmp_path / "in"), Store(spark, str(tmp_path / "store"))
    latest, version = {}, 0

    def game(g, bout, a, b, at, seq):
        r = rnd.choice(["1", "2", "3", ""])
        s = {"1": (2.0, 0.0), "2": (0.0, 2.0), "3": (1.0, 1.0), "": (0.0, 0.0)}[r]
        return (g, bout, f"{g}-{a}", f"{g}-{b}", r, {"1": "2", "2": "1"}.get(r, r), *s, at, seq)

    for step in range(4):
        rows = []
        for g in (["g", "h"] if step % 2 == 0 else ["g"]):
            for bout in range(1, 4):
                for a, b in ((0, 1), (2, 3), (4, 5)):
                    if rnd.random() < 0.7:
                        rows.append(game(g, bout, (a + bout) % 6, (b + bout) % 6, rnd.randint(1, 9), step))
        rows += rows[:2]
        games(spark, rows).coalesce(1).write.mode("append").parquet(land)
        for r in rows:
            k = r[:4]
            if k not in latest or (r[8], r[9]) > (latest[k][8], latest[k][9]):
                latest[k] = r
        stream = spark.readStream.schema(games(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(land)
        standings_state.start(stream, store, str(tmp_path / "checkpoint"), people).awaitTermination()  # a restart each time
        assert store.version().number == version + 1
        if step % 2:
            last = store.read("changes", standings_state.STANDINGS).filter(F.col("batch") == step)
            assert {r.group_id for r in last.select("group_id").distinct().collect()} <= {"g"}
        version += 1
        want = brute_tables(list(latest.values()), ["g", "h"], 6)
        got = {(r.group_id, r.participant_id): (r.score, r.opponent_score, r.rank) for r in standings_state.current(store).collect()}
        assert got == {k: v for k, v in want.items() if k[0] in {r[0] for r in latest.values()}}
    assert standings_state.compact(store, most=1) == version + 1
    again = {(r.group_id, r.participant_id): (r.score, r.opponent_score, r.rank) for r in standings_state.current(store).collect()}
    assert again == got
    # what was emitted adds up to the present tables
    changes = store.read("changes", standings_state.STANDINGS)
    last = changes.groupBy("group_id", "participant_id").agg(F.max_by("rank", "batch").alias("rank"))
    assert {(r.group_id, r.participant_id): r.rank for r in last.collect()} == {k: v[2] for k, v in got.items()}


def brute_tables(rows, groups, players):
    out = {}
    for g in groups:
        mine = [r for r in rows if r[0] == g]
        played = [r for r in mine if r[4] in "123" and r[4]]
        score = {f"{g}-{p}": 0.0 for p in range(players)}
        met = {p: set() for p in score}
        for r in played:
            score[r[2]] += r[6]
            score[r[3]] += r[7]
            met[r[2]].add(r[3])
            met[r[3]].add(r[2])
        bouts = {}
        for r in mine:
            bouts.setdefault(r[1], []).append(r in played)
        done = max([b for b, f in bouts.items() if all(f)], default=0)
        top = max(1.0, *score.values())
        rows_ = {p: (score[p], sum(score[o] for o in met[p])) for p in score}
        total = {p: round(s + (o * 2 / top - max(done, 1)), 5) for p, (s, o) in rows_.items()}
        for p in score:
            out[g, p] = (*rows_[p], 1 + sum((total[q], score[q]) > (total[p], score[p]) for q in score))
    return out


def test_state_is_spread_by_player(spark):
    p = standings_state.sides(games(spark, [("hot", 1, "a", "b", "1", "2", 2.0, 0.0, 1, 1)])).collect()
    assert {(r.group_id, r.participant_id, r.opp, r.result) for r in p} == {("hot", "a", "b", "1"), ("hot", "b", "a", "2")}


# ---- scopes as rows ---------------------------------------------------------------------------------------------


def test_scopes_join_like_brute_force_without_a_loop_join(spark):
    rnd = random.Random(2)
    days = [f"{rnd.randint(1999, 2003)}-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d}" for _ in range(40)]
    events = [(f"e{i}", "t", ("2001-05-05" if i % 3 == 0 else rnd.choice(days)) + rnd.choice(["", " 09:00:00"]), rnd.choice(["A", "B"]), "c", "o",
               i % 5, 1) for i in range(300)] + [("bad", "t", "someday", "A", "c", "o", 3, 1)]
    scopes = []
    for i in range(400):
        a, b = sorted((rnd.choice(days), rnd.choice([*days, "2001-05-05"])))
        scopes.append((f"s{i}", rnd.choice(["", "A", "B", None]), rnd.choice([a, a, "", "0000-01-01"]),
                       rnd.choice([b, b + " 23:59:59", "", "9999-12-31"])))
    scopes.append(("none", "", "2005-01-01", "1990-01-01"))
    e = spark.createDataFrame(events, "event_id string, title string, min_time string, provincename string, city_name string, cname string, "
                                      "play_num int, updated_at long")
    out = search.events_in_scopes(e, spark.createDataFrame(scopes, "scope_id string, province string, date_from string, date_to string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = sorted((r.scope_id, r.event_id) for r in out.collect())
    want = sorted((s[0], x[0]) for s in scopes for x in events if x[6] > 0 and x[0] != "bad" and s[1] in ("", None, x[3])
                  and x[2] >= s[2] and x[2] <= (s[3] or "9999-12-31 23:59:59"))
    assert got == want


def test_ten_thousand_scopes_on_a_skewed_day(spark):
    e = spark.range(3000).select(F.col("id").cast("string").alias("event_id"), F.lit("t").alias("title"), F.lit("2001-05-05").alias("min_time"),
                                 F.lit("A").alias("provincename"), F.lit("c").alias("city_name"), F.lit("o").alias("cname"),
                                 F.lit(1).alias("play_num"))
    first = F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int"))
    s = spark.range(10_000).select(F.col("id").cast("string").alias("scope_id"), F.lit("").alias("province"),
                                   F.date_format(first, "yyyy-MM-dd").alias("date_from"),
                                   F.date_format(F.date_add(first, 29), "yyyy-MM-dd").alias("date_to"))
    got = search.events_in_scopes(e, s).groupBy("scope_id").count().collect()
    assert len(got) == 30 and {r["count"] for r in got} == {3000}


# ---- landed pages, rounds, live groups ---------------------------------------------------------------------------


def test_page_states(spark):
    pages = [(0, "", '{"error":0,"datArr":{"rows":[{"event_id":"1"},{"event_id":"2"}]}}'), (1, "HTTP 500", ""), (2, "", '{"error":1,"msg":"busy","datArr":null}'),
             (3, "", '{"error":0,"datArr":{"rows":['), (4, "", ""), (5, "", '{"datArr":{}}'), (6, "", None), (7, "", '{"error":1}')]
    df = spark.createDataFrame(pages, "page long, fetch_error string, payload string")
    got = {r.page: (r.status, r.error, r.events) for r in landed.event_page_status(df).collect()}
    assert got == {0: ("loaded", "", 2), 1: ("failed", "HTTP 500", 0), 2: ("empty", "busy", 0), 3: ("failed", "invalid JSON", 0),
                   4: ("failed", "invalid JSON", 0), 5: ("loaded", "", 0), 6: ("failed", "invalid JSON", 0), 7: ("empty", "API error", 0)}
    assert landed.norm_events(df, 1).count() == 2


def test_rounds_are_inferred_from_the_first_round(spark):
    def payload(total, n):
        return f'cb({{"error":0,"datArr":{{{total}"rows":[{",".join(["{}"] * n)}]}}}});'
    rows = [("a", 1, payload('"total_bout":6,', 30)), ("b", 1, payload("", 4)), ("c", 1, payload('"total_bout":"",', 5)), ("d", 1, payload('"total_bout":0,', 16)),
            ("e", 1, payload("", 16)), ("e", 1, payload("", 1)), ("f", 2, payload('"total_bout":6,', 3)), ("g", 1, payload('"total_bout":"11轮",', 1))]
    df = spark.createDataFrame(rows, "group_id string, bout int, payload string")
    got = {r.group_id: (r.total_rounds, r.inferred) for r in landed.announced_rounds(df).collect()}
    assert got == {"a": (6, False), "b": (5, True), "c": (7, True), "d": (7, True), "e": (9, True), "g": (11, False)}


def test_live_attributes_of_pages(spark):
    html = ("<a data-groupid='7' data-group-name=\"A &amp; B\" data-pnumber='12人' data-bt='2024-01-01 09:00:00' data-et='' data-groupstate=\"0\">"
            "<a data-groupid=7 data-bt='later'><a data-groupid='8'>")
    row = {r.group_id: r for r in markup.live_groups(spark.createDataFrame([("e", html), ("f", None)], "event_id string, html string")).collect()}
    assert (row["7"].group_name, row["7"].pnumber, row["7"].bt, row["7"].et, row["7"].groupstate) == ("A & B", 12, "2024-01-01 09:00:00", "", "0")
    assert (row["8"].group_name, row["8"].pnumber, row["8"].bt) == ("", 0, "") and len(row) == 2


def test_percent_texts(column):
    got = column([(x,) for x in (0.0, 0.05, 0.125, 0.1235, 0.9999, 1.0, None)], "p double", live.chance_text("p"))
    assert got == ["0%", "5%", "12.5%", "12.4%", "100%", "100%", "0%"]


# ---- incremental views, layout, landed files ---------------------------------------------------------------------


def test_views_equal_a_full_run_and_read_only_what_changed(fx, spark, tmp_path):
    from tengen.operators import promotion, rating
    from tengen.sources.fixtures import AS_OF
    from tengen.streaming import views as V

    out, log = Store(spark, str(tmp_path / "views")), Store(spark, str(tmp_path / "log"))
    change_log.land_fixture(fx, str(tmp_path))
    landing = spark.read.schema(change_log.ENVELOPE).parquet(f"{tmp_path}/landing")
    change_log.apply(log, landing.filter("fetched_at = 1000"), 0)
    V.refresh_ratings(out, log, AS_OF)
    V.refresh_counters(out, log)
    V.refresh_later(out, log)
    first = out.version()
    event = fx.events.filter("min_time > '2000-02-01' and min_time < '2000-06-01' and event_key % 160 <> 0").orderBy("event_id").first()["event_id"]
    mine = F.col("owner").cast("bigint") - F.col("owner").cast("bigint") % 32 == int(event)
    gone = landing.filter("fetched_at = 3000").limit(0)
    change = landing.filter((F.col("fetched_at") == 1000) & mine & (F.col("table") == "matches")).withColumn("fetched_at", F.lit(4000).cast("long")) \
        .withColumn("rows", F.slice("rows", 1, 3)).unionByName(gone)
    lost = landing.filter((F.col("fetched_at") == 1000) & mine & (F.col("table") == "participants")).withColumn("fetched_at", F.lit(4000).cast("long")) \
        .withColumn("rows", F.slice("rows", 1, 12))
    for number, batch in ((1, change), (2, lost)):
        before = log.version()
        change_log.apply(log, batch, number)
        touched = {r[0] for r in V.touched_groups(log, before, log.version()).collect()}
        assert touched and all(int(g) - int(g) % 32 == int(event) for g in touched)
        V.refresh_ratings(out, log, AS_OF)
        V.refresh_counters(out, log)
        V.refresh_later(out, log)
        p, e, m = (change_log.view(log, t) for t in ("participants", "events", "matches"))
        nodes = rating.rating_nodes(rating.window_rows(p, e, AS_OF))
        full = {(r.group_id, r.participant_id): r.rating for r in rating.rating_iterate(nodes, rating.rating_edges(nodes, m)).collect()}
        got = {(r.group_id, r.participant_id): r.rating for r in V.ratings(out, AS_OF).collect()}
        assert got.keys() == full.keys() and max(abs(got[k] - full[k]) for k in got) < 1e-9
        want = {(r.provincename, r.day): (r.n, r.k) for r in e.filter("play_num > 0").join(
            p.groupBy("event_id").count().withColumnRenamed("count", "c"), "event_id", "left").groupBy(
                "provincename", F.substring("min_time", 1, 10).alias("day")).agg(
                    F.count("*").alias("n"), F.sum(F.coalesce("c", F.lit(0))).alias("k")).collect()}
        assert {(r.province, r.day): (r.events, r.entries) for r in V.counters(out).collect()} == want
        every = V._levelled_entries(log, log.version(), e.select("event_id")).withColumn("lv", F.struct("kind", "current"))
        later = {tuple(r[c] for c in promotion.KEY): (r.later_event_id, r.later_group_id) for r in promotion.next_decisive_entry(every, every).collect()}
        assert {tuple(r[c] for c in promotion.KEY): (r.later_event_id, r.later_group_id) for r in V.later_entries(out).collect()} == later
    # a repeated refresh changes nothing, and only the buckets of touched groups were written
    assert V.refresh_ratings(out, log, AS_OF) == V.refresh_counters(out, log) == V.refresh_later(out, log) == out.version().number
    now, name = out.version(), f"ratings-{AS_OF}"
    moved = {b for b in now.folders(name) if now.folders(name)[b] != first.folders(name).get(b)}
    assert moved <= out.touched(spark.createDataFrame([(str(int(event) + g),) for g in range(4)], "group_id string"), "group_id", V.BUCKETS)


def test_one_player_needs_only_their_groups(fx):
    from tengen.operators.strength import StrengthRun
    from tengen.sources.fixtures import AS_OF

    full = {r.name: r for r in StrengthRun(fx.participants, fx.events, fx.matches, AS_OF).strength().collect()}
    for name in sorted(full)[:2]:
        run = StrengthRun(fx.participants, fx.events, fx.matches, AS_OF, name=name)
        got = run.strength().collect()
        assert len(got) == 1
        for c, v in full[name].asDict().items():
            assert got[0][c] == (pytest.approx(v, abs=1e-9) if isinstance(v, float) else v), c
        mine = fx.participants.filter(F.col("participant_name") == name).select("group_id").distinct()
        assert run.rows.join(mine, "group_id", "left_anti").count() == 0
    assert StrengthRun(fx.participants, fx.events, fx.matches, AS_OF, name="nobody").strength().count() == 0


def test_layout_joins_without_a_shuffle(spark):
    from conftest import SMALL

    from tengen.plans.queries import REGISTRY

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = REGISTRY["bucketed_schedule"](spark, SMALL)
        assert out.count() == REGISTRY["player_schedule"](spark, SMALL).count()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan and "Bucketed: true" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_landed_files_as_table_and_stream(spark, tmp_path):
    from tengen.sources import landing

    root = tmp_path / "landed"
    files = {"kind=events/day=2024-01-01/1.json": '{"error":0,"datArr":{"rows":[{"event_id":"1"}]}}', "kind=events/day=2024-01-01/2.failed": "HTTP 500",
             "kind=events/day=2024-01-02/3.json": '{"error":0,', "kind=matches/day=2024-01-02/7-2.json": "cb({\n})", "kind=events/day=2024-01-02/4.json": ""}
    for name, body in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    df = landing.payloads(spark, str(root))
    rows = {(r.kind, r.key): (r.fetch_error, r.payload) for r in df.collect()}
    assert rows[("events", "1")] == ("", files["kind=events/day=2024-01-01/1.json"]) and rows[("events", "2")] == ("HTTP 500", "")
    assert rows[("events", "3")][1] == '{"error":0,' and rows[("matches", "7-2")][1] == "cb({\n})" and len(rows) >= 4
    some = df.filter("kind = 'events' and day >= '2024-01-02'")
    scan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in scan and "(day" in scan and some.count() <= 2
    pages = df.filter("kind = 'events'").select(F.col("key").cast("long").alias("page"), "fetch_error", "payload")
    got = {r.page: r.status for r in landed.event_page_status(pages).collect()}
    assert got[1] == "loaded" and got[2] == "failed" and got[3] == "failed"
    stream = landing.payload_stream(spark, str(root), 2)
    run = lambda: stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True) \
        .format("parquet").option("path", str(tmp_path / "out")).start().awaitTermination()
    run()
    (root / "kind=events/day=2024-01-02/5.json").write_text("{}")
    run()
    seen = {r.key for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {"1", "2", "3", "7-2", "5"} <= seen


def test_confirmed_public_events_come_from_a_table(spark):
    from tengen.operators import rules

    rows = [("54", "四川省", False, True, ("dan", 3)), ("55", "四川省", False, True, ("dan", 3)), ("54", "四川省", False, True, ("dan", 2)),
            ("54", "四川省", False, False, ("dan", 3)), ("60", "四川省", True, False, ("level", 2))]
    df = spark.createDataFrame(rows, "event_id string, provincename string, rank_event boolean, backed_public_event boolean, "
                                     "lv struct<kind:string,current:int>")
    got = [(r.event_id, r.lv.current, r.association_rule is not None) for r in rules.association_rules(
        df, spark.createDataFrame([("54",), ("54",)], "event_id string")).collect()]
    assert sorted(got) == sorted([("54", 3, True), ("55", 3, False), ("54", 2, False), ("54", 3, False), ("60", 2, True)])
    assert sum(r.association_rule is not None for r in rules.association_rules(df).collect()) == 1


def test_label_index_like_brute_force(spark):
    from tengen.operators import rules

    rnd = random.Random(9)
    names = [f"{a}{b}组" for a in range(1, 10) for b in ("级", "段")] + ["定2段组", "U8组", "组"]
    groups = [(f"e{i % 3}", n, "level" if "级" in n else "dan", int(n[0]) if n[0].isdigit() else 1) for i, n in enumerate(names * 3)]
    notices = [(f"e{i}", "。".join("".join(rnd.choice([*names, "前3名", "升", "晋升", "，"]) for _ in range(rnd.randint(1, 9))) for _ in range(40)))
               for i in range(3)] + [("e9", "1级组升"), ("e0x", None)]
    g = spark.createDataFrame(groups, "event_id string, group_name string, kind string, current int").distinct()
    n = spark.createDataFrame(notices, "event_id string, notice_text string")
    key = lambda rows: sorted((r.event_id, r.group_name, r.pos, r[-1]) for r in rows)
    want = key(rules.group_fragments(g, n).select("event_id", "group_name", "pos", "matched_text").collect())
    assert key(rules.indexed_matches(g, n).select("event_id", "group_name", "pos", "fragment").collect()) == want and len(want) > 200


def test_state_of_a_whole_landing_needs_no_python_call_a_key(spark, tmp_path):
    """Corrections, older and repeated versions; groups whose deliveries changed nothing don't come out again."""
    land, store = str(tmp_path / "in"), Store(spark, str(tmp_path / "store"))
    people = seats(spark, ["g", "h"], 2)
    first = [("g", 1, "g-0", "g-1", "1", "2", 2.0, 0.0, 5, 1), ("h", 1, "h-0", "h-1", "3", "3", 1.0, 1.0, 5, 1),
             ("h", 2, "h-0", "h-1", "", "", 0.0, 0.0, 5, 1)]
    again = [("g", 1, "g-0", "g-1", "2", "1", 0.0, 2.0, 5, 2), ("h", 1, "h-0", "h-1", "1", "2", 2.0, 0.0, 4, 9), first[2]]
    for rows in (first, again):
        games(spark, rows).coalesce(1).write.mode("append").parquet(land)
        stream = spark.readStream.schema(games(spark, []).schema).parquet(land)
        plan = standings_state.changed_players(stream)._jdf.queryExecution().analyzed().toString()
        assert "TransformWithState" not in plan and "Python" not in plan
        standings_state.start(stream, store, str(tmp_path / "checkpoint"), people).awaitTermination()
    rows = {(r.group_id, r.participant_id): r for r in standings_state.latest_players(store.read("records", standings_state.RECORDS)).collect()}
    g, h = rows["g", "g-1"], rows["h", "h-0"]
    assert (g.win, g.lose, g.draw, g.score, g.opponents) == (1, 0, 0, 2.0, ["g-0"])
    assert (h.win, h.lose, h.draw, h.score, h.opponents) == (0, 0, 1, 1.0, ["h-1"])
    assert [tuple(b) for b in h.bouts] == [(1, True), (2, False)]
    tables = store.read("standings", standings_state.STANDINGS).groupBy("group_id").agg(F.countDistinct("batch").alias("n")).collect()
    assert {r.group_id: r.n for r in tables} == {"g": 2, "h": 1}
