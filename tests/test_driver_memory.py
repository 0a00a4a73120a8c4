"""Joins of tables whose files are far smaller than their rows don't send them through the driver."""

from pyspark.sql import functions as F

from tengen.operators import live, rules


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scenario_rows_are_not_broadcast(fx, spark, monkeypatch):
    seen = []
    kept = live.stage
    monkeypatch.setattr(live, "stage", lambda df, *a: seen.append(plan(df)) or kept(df, *a))
    groups = fx.scenarios.select("group_id").distinct()
    progress = groups.select("group_id", F.lit(9).alias("total_rounds"), F.lit(5).alias("completed_rounds"))
    args = live.seat_list(fx.participants), fx.matches, progress, fx.scenarios
    one, two = live.scenario_rank_distribution(*args), live.scenario_rank_distribution(*args, buckets=4)
    assert len(seen) == 6 and not any("Broadcast" in p for p in [*seen, plan(one), plan(two)])
    assert one.count() == two.count() > 0 and one.exceptAll(two).count() == 0


def test_standings_work_out_scores_once(fx):
    found = live.standings(live.seat_list(fx.participants), fx.matches, live.round_progress(fx.matches, fx.match_status.select(
        "group_id", F.col("rounds").alias("total_rounds"))), display=False, buckets=4)
    assert "fx_matches" not in plan(found) and "fx_participants" not in plan(found)
    assert found.count() == fx.participants.count()


def test_runs_of_fragments_are_not_broadcast(fx):
    groups = rules.rule_groups(fx.participants)
    found = rules.indexed_matches(groups, fx.notices)
    assert not any("Join" in line and "Broadcast" in line and "head" in line for line in plan(found).splitlines())
    want = rules.group_fragments(groups, fx.notices).select("event_id", "group_name", "pos", F.col("matched_text").alias("fragment"))
    found = found.select(*want.columns)
    assert found.count() == want.count() > 0 and found.exceptAll(want).count() == 0
