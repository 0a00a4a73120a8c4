"""Games, schedules, live state, standings, rank distribution."""

from .base import with_tables
from .ingest import _BODY
from .snippets import OUTCOME, PLAYED, SIDES, china_ms, half_up

O: dict[str, str] = {}

_FIRST = {"sides": SIDES, "first_game": """select * from (select *, row_number() over (
  partition by group_id, me_id, bout order by p1_id, p2_id) as rn from sides) where rn = 1"""}
O["first_game_per_bout"] = with_tables("select group_id, bout, me_id, opp_id, p1_id, p2_id from first_game", _FIRST)
O["outcome_code"] = with_tables(f"""select group_id, bout, p1_id, p2_id, me_id, opp_id, {OUTCOME} as outcome,
  cast(case me_result when '1' then 1 when '2' then 0 else 0.5 end as double) as points from sides""", {"sides": SIDES})
O["player_schedule"] = with_tables(f"""select p.event_id, p.group_id, p.participant_id, p.participant_name, p.rounds,
  cast(b.bout as int) as bout, g.opp_name as opponent, g.opp_id as opponent_id, g.opp_org as opponent_org,
  case when g.me_id is not null then {OUTCOME} end as result, g.me_score as score, g.opp_score as opp_score
  from (select *, win + lose + draw as rounds from fx_participants) p
  join range(1, 100) b(bout) on b.bout <= p.rounds
  left join first_game g on g.group_id = p.group_id and g.me_id = p.participant_id and g.bout = b.bout""", _FIRST)
O["bucketed_schedule"] = O["player_schedule"]
O["h2h_games"] = with_tables(f"""select s.group_id, a.group_name, e.event_id, e.title, substr(e.min_time, 1, 10) as date,
  e.provincename as province, e.city_name as city, e.cname as organizer,
  'event/' || e.event_id || '.html#groupID=' || s.group_id as detail_url, s.bout, s.me_id as player_a_id,
  a.participant_name as player_a, s.me_org as player_a_org, s.opp_id as player_b_id, b.participant_name as player_b,
  s.opp_org as player_b_org, {OUTCOME} as result, s.me_score as score, s.opp_score
  from sides s join fx_participants a on a.group_id = s.group_id and a.participant_id = s.me_id
  join fx_participants b on b.group_id = s.group_id and b.participant_id = s.opp_id
  join fx_events e on e.event_id = a.event_id
  where a.participant_name < b.participant_name and (a.win + a.lose + a.draw > 0 or b.win + b.lose + b.draw > 0)""",
                             {"sides": SIDES})
O["played_flag"] = with_tables(f"select group_id, bout, p1_id, p2_id, {PLAYED} as played from fx_matches")
O["opponent_edges"] = with_tables(f"""select distinct m.group_id, least(p1_id, p2_id) as a_id, greatest(p1_id, p2_id) as b_id
  from fx_matches m join fx_participants a on a.group_id = m.group_id and a.participant_id = m.p1_id
  join fx_participants b on b.group_id = m.group_id and b.participant_id = m.p2_id where {PLAYED}""")

_STATUS = f"""case when {china_ms('min_time')} <= now_ms and now_ms <= {china_ms('max_time')} then 'live'
  when now_ms < {china_ms('min_time')} then 'upcoming'
  when now_ms - {china_ms('max_time')} <= 28800000 then 'today-ended'
  when now_ms - {china_ms('max_time')} <= 172800000 then 'recent-ended' else 'old' end"""
_LABEL = """case status when 'live' then '进行中' when 'upcoming' then '即将开始' when 'today-ended' then '今日结束'
  when 'recent-ended' then '近期结束' else '可查询' end"""
_ORDER = """cast(case status when 'live' then 0 when 'upcoming' then 1 when 'today-ended' then 2
  when 'recent-ended' then 3 else 9 end as int)"""
O["event_status"] = with_tables(f"""select event_id, status, {_LABEL} as status_label, {_ORDER} as status_order
  from (select event_id, {_STATUS} as status from fx_events)""")
_LIVE = f"""(case when bt <> '' and et <> '' then {china_ms('bt')} <= now_ms and now_ms <= {china_ms('et')}
  when bt <> '' then {china_ms('bt')} <= now_ms and now_ms - {china_ms('bt')} < 259200000
  else groupstate = '0' end)"""
O["group_live_flag"] = with_tables(f"select group_id, {_LIVE} as live from fx_live_groups")
# as the pages write them: names with a mark behind, no state where the first group of an event isn't running
O["live_event_groups"] = with_tables(f"""select event_id, group_id,
  group_name || ' & "' || (cast(group_id as bigint) % 32) || '"' as group_name, pnumber,
  case when groupstate = '1' and cast(group_id as bigint) % 32 = 0 then '' else groupstate end as group_state, bt as begins_at, et as ends_at, {_LIVE} as live from fx_live_groups""")
# fixed values: the group names in Chinese collation (digits, then characters by their reading, then letters)
_NAMES = ["1-2级组", "1段组", "1级组", "2段组", "2级升1段组", "2级组", "3段-4段组", "3段组", "4段组", "5段组", "5级组", "初中组", "低段组", "定2段组",
          "定段组", "高段组", "公开组", "甲组", "启蒙组", "少儿A组", "一年级组", "U10组", "U8组"]
O["group_menu_order"] = with_tables(f"""select event_id, group_id, group_name, pnumber, group_state, begins_at, ends_at, live,
  cast(row_number() over (partition by event_id order by live desc, list_position([{", ".join(f"'{n}'" for n in _NAMES)}],
    regexp_extract(group_name, '^[^ ]+')), group_id) as int) as place from ({O["live_event_groups"]})""")
O["live_candidates"] = with_tables("""select event_id, substr(min_time, 1, 10) as start_date,
  substr(max_time, 1, 10) as end_date, provincename, play_num from fx_events
  where substr(max_time, 1, 10) >= cast(cast(make_timestamp((now_ms + 28800000) * 1000) as date) - 2 as varchar)
    and substr(min_time, 1, 10) <= cast(cast(make_timestamp((now_ms + 28800000) * 1000) as date) + 7 as varchar)""")
_ROLL = f"""select event_id, title, substr(min_time, 1, 10) as date, provincename as province, city_name as city,
  cname as organizer, group_count, live_group_count, status, {_LABEL} as status_label, {_ORDER} as status_order,
  coalesce(first_bt, min_time) as begins_at, coalesce(last_et, max_time) as ends_at
  from (select e.*, g.*exclude (event_id), case when g.live_group_count > 0 then 'live' else {_STATUS} end as status
    from fx_events e join (select event_id, count(*) as group_count, count(*) filter ({_LIVE}) as live_group_count,
        min(nullif(bt, '')) as first_bt, max(nullif(et, '')) as last_et from fx_live_groups group by event_id) g
    on g.event_id = e.event_id) where status <> 'old'"""
O["event_live_rollup"] = with_tables(_ROLL)
O["live_order"] = with_tables(f"select event_id, status_order, date from ({_ROLL})")

_PROG = {
    "announced": f"""select group_id, cast(case when told > 0 then told when players <= 8 then 5 when players <= 32 then 7 else 9 end as int)
        as total_rounds, coalesce(told, 0) <= 0 as inferred
      from (select group_id, max(try_cast(json_extract_string(j, '$.datArr.total_bout') as int)) as told,
          2 * sum(json_array_length(j, '$.datArr.rows')) as players
        from (select group_id, cast({_BODY} as json) as j from fx_payload_matches where bout = 1) group by group_id)""",
    "given": """select g.group_id, greatest(g.top, coalesce(a.total_rounds, 0)) as total
      from (select group_id, max(bout) as top from fx_matches group by group_id) g
      left join announced a on a.group_id = g.group_id""",
    "inside": f"select m.*, {PLAYED} as played from fx_matches m",
    "progress": """select t.group_id, cast(t.total as int) as total_rounds,
        cast(coalesce(max(b.bout) filter (b.done), 0) as int) as completed_rounds,
        cast(coalesce(max(b.bout), 0) as int) as known_pairing_rounds
      from given t left join (select group_id, bout, bool_and(played) as done from inside group by group_id, bout) b
        on b.group_id = t.group_id group by t.group_id, t.total""",
}
O["group_announced_rounds"] = with_tables("select * from announced", {"announced": _PROG["announced"]})
O["round_progress"] = with_tables("select * from progress", _PROG)

_STAND = {
    **_PROG,
    "seats": """select group_id, participant_id, participant_name as name, org, short_no, cast(score as double) as sc,
        win, lose, draw, rank as cloud_rank from fx_participants""",
    "met": """select group_id, p1_id as me, p2_id as opp from inside where played
      union select group_id, p2_id, p1_id from inside where played""",
    "scored": f"""select s.group_id, s.participant_id, s.name, s.org, s.short_no, s.win, s.lose, s.draw, s.cloud_rank,
        {half_up('s.sc', 2)} as score, {half_up('coalesce(o.opp, 0)', 2)} as opponent_score,
        {half_up('s.sc + (coalesce(o.opp, 0) * 2 / greatest(1, max(s.sc) over (partition by s.group_id)) - greatest(coalesce(p.completed_rounds, 0), 1))', 5)} as total_score
      from seats s left join (select m.group_id, m.me, sum(q.sc) as opp from met m
          join seats q on q.group_id = m.group_id and q.participant_id = m.opp group by m.group_id, m.me) o
        on o.group_id = s.group_id and o.me = s.participant_id
      left join progress p on p.group_id = s.group_id""",
    "ranked": """select *, rank() over (partition by group_id order by total_score desc, score desc) as rank,
        row_number() over (partition by group_id order by total_score desc, score desc,
          coalesce(nullif(try_cast(short_no as int), 0), 9999), name, participant_id) as display_order from scored""",
}
O["standings"] = with_tables("select * exclude (display_order) from ranked", _STAND)
O["standing_rank"] = with_tables("""select group_id, participant_id, total_score, score, rank, display_order
  from ranked""", _STAND)

_SCORED_GAMES = """(select group_id, pid, sum(sc) as sc from (
    select group_id, p1_id as pid, p1_score as sc from {0} union all select group_id, p2_id, p2_score from {0}) group by all)"""
O["stream_standings"] = with_tables("select * exclude (display_order) from ranked", {
    **{k: v for k, v in _STAND.items() if k in _PROG},
    "decided": "select * from inside where played",
    "seats": f"""select p.group_id, p.participant_id, participant_name as name, org, short_no, coalesce(g.sc, 0) as sc,
        win, lose, draw, rank as cloud_rank from fx_participants p
      left join {_SCORED_GAMES.format('decided')} g on g.group_id = p.group_id and g.pid = p.participant_id""",
    **{k: v for k, v in _STAND.items() if k not in _PROG and k != "seats"}})

_CHANCES = f"""select group_id, participant_id, rank, n as count, sims as simulations,
  {half_up('n / sims')} as probability, cast(place as int) as place from (
  select *, row_number() over (partition by group_id, participant_id order by n desc, rank) as place from (
    select group_id, participant_id, rank, sims, count(*) as n from sim_ranked group by all)) where place <= 5"""
_SIMULATED = {
    **{k: _STAND[k] for k in ("announced", "given", "inside", "progress", "seats")},
    "sc": "select s.* from fx_scenarios s join given t on t.group_id = s.group_id",
    "runs": "select distinct scenario_id, group_id from sc",
    "sims": "select group_id, count(*) as sims from runs group by group_id",
    "sim_score": """select r.scenario_id, s.group_id, s.participant_id, s.name, s.short_no,
        s.sc + coalesce(w.n, 0) * 2 as sc
      from runs r join seats s on s.group_id = r.group_id
      left join (select scenario_id, group_id, case when p1_wins then p1_id else p2_id end as pid, count(*) as n
          from sc group by all) w
        on w.scenario_id = r.scenario_id and w.group_id = s.group_id and w.pid = s.participant_id""",
    "sim_met": """select group_id, p1_id as me, p2_id as opp from inside where played
      union select group_id, p2_id, p1_id from inside where played
      union select group_id, p1_id, p2_id from sc union select group_id, p2_id, p1_id from sc""",
    "sim_opp": """select q.scenario_id, m.group_id, m.me, sum(q.sc) as opp from sim_met m
      join sim_score q on q.group_id = m.group_id and q.participant_id = m.opp group by all""",
    "sim_total": f"""select s.scenario_id, s.group_id, s.participant_id, {half_up('s.sc', 2)} as score,
        {half_up('s.sc + (coalesce(o.opp, 0) * 2 / greatest(1, max(s.sc) over (partition by s.scenario_id, s.group_id)) - greatest(t.total, 1))', 5)} as total_score
      from sim_score s left join sim_opp o on o.scenario_id = s.scenario_id and o.group_id = s.group_id
        and o.me = s.participant_id join given t on t.group_id = s.group_id""",
    "sim_ranked": """select s.group_id, s.participant_id, k.sims,
        rank() over (partition by s.scenario_id, s.group_id order by total_score desc, score desc) as rank
      from sim_total s join sims k on k.group_id = s.group_id""",
}
O["scenario_rank_distribution"] = with_tables(_CHANCES, _SIMULATED)
O["rank_chance_text"] = with_tables(f"""select group_id, participant_id, rank, case when t % 10 = 0 then cast(t // 10 as varchar)
    else (t // 10) || '.' || (t % 10) end || '%' as chance
  from (select *, cast(floor(probability * 1000 + 5e-1) as bigint) as t from ({_CHANCES}))""", _SIMULATED)
O["stream_changed_standings"] = O["stream_standings"]
O["round_half_up"] = with_tables(f"""select group_id, bout, p1_id, p2_id, {half_up('v', 0)} as r0, {half_up('v', 2)} as r2,
  {half_up('v / 3', 5)} as r5 from (select *, (p1_score - p2_score) * bout / 8 as v from fx_matches)""")
O["china_time"] = with_tables(f"select group_id, {china_ms('bt')} as begin_ms, {china_ms('et')} as end_ms from fx_live_groups")
O["date_only"] = with_tables("""select group_id, regexp_extract(bt, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') as begin_date,
  regexp_extract(et, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') as end_date, '' as no_date from fx_live_groups""")
O["date_window_bounds"] = with_tables("""select event_id,
  strftime(cast(substr(min_time, 1, 10) as date) - 180, '%Y-%m-%d') as window_start,
  strftime(cast(substr(min_time, 1, 10) as date) - 2, '%Y-%m-%d') as live_from,
  strftime(cast(substr(min_time, 1, 10) as date) + 7, '%Y-%m-%d') as live_to,
  cast(null as varchar) as no_date from fx_events""")
O["record_score"] = with_tables(f"""select event_id, group_id, participant_id, win + lose + draw as rounds,
  {half_up('case when win + lose + draw > 0 then (win + 5e-1 * draw) / (win + lose + draw) else 0 end')} as record_score
  from fx_participants""")

ORACLES = O
