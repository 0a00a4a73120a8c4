"""Scopes, coverage, histories, search results."""

from ..sources.fixtures import AS_OF
from .base import with_tables
from .snippets import ENTRY, EVENT, half_up
from .ingest import _CTE_P

O: dict[str, str] = {}

_NEEDS = f"""(s.event_id is null
  or (e.updated_at > s.indexed_at and cast(substr(e.min_time, 1, 10) as date)
      between date '{AS_OF}' - interval 45 day and date '{AS_OF}' + interval 14 day)
  or s.last_error ilike 'SQLITE_%' or s.last_error ilike '%database is locked%'
  or s.last_error ilike '%cannot start a transaction%' or s.last_error ilike '%timeout%'
  or s.last_error ilike '%socket hang up%' or s.last_error ilike '%ECONNRESET%'
  or s.last_error ilike '%ETIMEDOUT%' or s.last_error ilike 'HTTP %')"""
_FLAG = {"flagged": f"""select e.*, coalesce({_NEEDS}, false) as needs_index from fx_events e
  left join fx_index_status s on s.event_id = e.event_id"""}
_HIST = f"select {EVENT}, {ENTRY} from fx_participants p join fx_events e on e.event_id = p.event_id"

O["events_in_scope"] = with_tables(f"""select {EVENT} from fx_events e where play_num > 0
  and provincename = '四川省' and min_time >= '1996-01-01' and min_time <= '2000-12-31'""")
O["needs_index_flag"] = with_tables("select event_id, needs_index from flagged", _FLAG)
O["index_worklist"] = with_tables(f"select {EVENT} from flagged e where play_num > 0 and needs_index", _FLAG)
O["events_in_scopes"] = with_tables("""select s.scope_id, count(*) as events, min(e.min_time) as first_time, max(e.min_time) as last_time
  from fx_events e join (select event_id as scope_id, case when k % 3 = 0 then '' else provincename end as province,
      case when k % 7 = 0 then '' else substr(min_time, 1, 10) end as date_from,
      case when k % 11 = 0 then '9999-12-31' else strftime(cast(substr(min_time, 1, 10) as date) + cast(k % 400 as int), '%Y-%m-%d')
        || case when k % 4 = 0 then ' 23:59:59' else '' end end as date_to
    from (select *, event_key // 32 as k from fx_events)) s
  on (s.province = '' or s.province = e.provincename) and e.min_time >= s.date_from and e.min_time <= s.date_to
  where e.play_num > 0 group by s.scope_id""")
O["scope_defaults"] = with_tables("""select s.scope_id, s.date_from, s.date_to, count(*) as events,
  min(e.min_time) as first_time, max(e.min_time) as last_time
  from fx_events e join (values ('open', '', '0000-01-01', '9999-12-31'),
    ('year-1998', '', '1998-01-01', '1998-12-31'), ('sichuan-1996-2000', '四川省', '1996-01-01', '2000-12-31'),
    ('one-day', '', '1997-03-01', '1997-06-30'), ('one-day-whole', '', '1997-03-01', '1997-06-30 23:59:59'),
    ('trailing', '', '1998-06-30', '2000-06-30')) s(scope_id, province, date_from, date_to)
  on (s.province = '' or s.province = e.provincename) and e.min_time >= s.date_from and e.min_time <= s.date_to
  where e.play_num > 0 group by s.scope_id, s.date_from, s.date_to""")

_COVER = """select coalesce(provincename, '__ALL__') as province, count(*) as event_count,
  cast(sum(case when needs_index then 0 else 1 end) as bigint) as indexed_event_count,
  cast(sum(case when needs_index then 1 else 0 end) as bigint) as unindexed_event_count
  from flagged where play_num > 0 group by rollup (provincename)"""
O["index_coverage"] = with_tables(_COVER, _FLAG)
O["search_mode"] = with_tables("""select *,
  case when partial then 'index-partial' when unindexed_event_count = 0 then 'index'
    when indexed_event_count > 0 then 'hybrid' else 'live' end as mode
  from (select c.*, f.full_search, c.unindexed_event_count > 0 and not f.full_search
      and (c.province = '__ALL__' or c.unindexed_event_count > 40) as partial
    from coverage c cross join (values (false), (true)) f(full_search))""", {**_FLAG, "coverage": _COVER})
O["store_stats"] = with_tables("""select (select count(*) from fx_events) as event_count,
  (select max(updated_at) from fx_events) as last_updated,
  (select count(*) from fx_participants) as participant_count,
  (select max(updated_at) from fx_participants) as participant_last_updated,
  (select count(*) from fx_index_status where last_error = '') as indexed_event_count""")
O["player_history"] = with_tables(_HIST)


def _hit(source):
    return f"""'{source}' as source, event_id, title, substr(min_time, 1, 10) as date, provincename as province,
  city_name as city, cname as organizer, 'event/' || event_id || '.html#groupID=' || group_id as detail_url,
  participant_name as name, group_name, org, cast(win as varchar) as win, cast(lose as varchar) as lose,
  cast(draw as varchar) as draw, score, case when rank = 0 then '' else cast(rank as varchar) end as rank,
  group_id, participant_id,
  'player?id=' || group_id || '&pID=' || participant_id || '&eventid=' || event_id as player_url"""


O["search_hits"] = with_tables(f"select {_hit('index')} from hist", {"hist": _HIST})
O["hits_by_date"] = with_tables("""select event_id, substr(min_time, 1, 10) as date, group_id, participant_id,
  participant_name as name from hist""", {"hist": _HIST})
O["hits_union"] = with_tables(f"""select {_hit('index')} from hist union all select {_hit('live')} from (
  select {EVENT}, l.group_id, coalesce(g.group_name, '') as group_name, l.participant_id, l.participant_name, l.org,
    l.win, l.lose, l.draw, l.score, l.rank from landed l
  join flagged e on e.event_id = l.event_id and e.needs_index and e.play_num > 0
  left join fx_groups g on g.group_id = l.group_id)""", {"hist": _HIST, **_FLAG, **_CTE_P})
O["rows_for_groups"] = with_tables(_HIST + """ where p.group_id in (
  select group_id from fx_match_status where last_error = '' union select group_id from fx_groups where pnumber = 0)""")
O["distinct_groups"] = with_tables("select distinct group_id from fx_participants where group_id <> ''")
O["group_size_count"] = with_tables("select group_id, count(*) as group_size from fx_participants group by group_id")
O["promotion_candidates"] = with_tables(f"""select {EVENT}, {ENTRY}, g.pnumber as group_size,
  count(*) over (partition by p.group_id) as indexed_group_size
  from fx_participants p join fx_events e on e.event_id = p.event_id
  left join fx_groups g on g.group_id = p.group_id""")
O["event_groups_ordered"] = with_tables("""select group_id, event_id, group_name, team_type, pnumber,
  cast(group_id as bigint) as group_no from fx_groups""")
O["newest_limit"] = with_tables(f"""select {EVENT} from fx_events e where play_num > 0
  order by min_time desc, event_id limit 50""")

H2H_PAIRS = f"""select {EVENT}, a.group_id, a.group_name, a.participant_id as player_a_id,
  a.participant_name as player_a_name, a.org as player_a_org, b.participant_id as player_b_id,
  b.participant_name as player_b_name, b.org as player_b_org, a.win + a.lose + a.draw as player_a_rounds,
  b.win + b.lose + b.draw as player_b_rounds
  from fx_pair_requests r join fx_participants a on a.participant_name = r.player_a
  join fx_participants b on b.participant_name = r.player_b and b.event_id = a.event_id and b.group_id = a.group_id
    and b.participant_id <> a.participant_id
  join fx_events e on e.event_id = a.event_id"""
O["h2h_candidates"] = with_tables(H2H_PAIRS)
O["h2h_summary"] = with_tables(f"""select r.player_a, r.player_b, coalesce(c.n, 0) as candidates,
  coalesce(c.k, 0) as checked_groups, coalesce(g.n, 0) as games, coalesce(g.w, 0) as win, coalesce(g.l, 0) as lose,
  coalesce(g.d, 0) as draw, {half_up('coalesce((g.w + 5e-1 * g.d) / g.n, 0)')} as win_rate
  from fx_pair_requests r
  left join (select player_a_name, player_b_name, count(*) as n,
      count(*) filter (player_a_rounds > 0 or player_b_rounds > 0) as k from cand group by all) c
    on c.player_a_name = r.player_a and c.player_b_name = r.player_b
  left join (select player_a_name, player_b_name, count(*) as n, count(*) filter (res = '1') as w,
      count(*) filter (res = '2') as l, count(*) filter (res not in ('1', '2')) as d
    from (select c.player_a_name, c.player_b_name,
        case when m.p1_id = c.player_a_id then m.p1_result else m.p2_result end as res
      from cand c join fx_matches m on m.group_id = c.group_id and (
        (m.p1_id = c.player_a_id and m.p2_id = c.player_b_id) or (m.p2_id = c.player_a_id and m.p1_id = c.player_b_id))
      where c.player_a_rounds > 0 or c.player_b_rounds > 0) group by all) g
    on g.player_a_name = r.player_a and g.player_b_name = r.player_b""", {"cand": H2H_PAIRS})

ORACLES = O
