"""Sources, normalisation, stored-table maintenance."""

from ..sources.fixtures import AS_OF_MS
from .base import with_tables
from .snippets import WS, first_text, pfloat, pint, strip_html, trim, uri

O: dict[str, str] = {}

_BODY = (f"regexp_replace(regexp_replace(regexp_replace({trim('payload')}, '^[^(]+\\(', ''), "
         f"'\\);{WS}*$', ''), '\\){WS}*$', '')")
_PLAYERS = f"""select event_id, group_id, unnest(cast(json_extract(j, '$.datArr.rows[*]') as json[])) as r
  from (select event_id, group_id, {_BODY} as j from fx_payload_participants)
  where json_extract_string(j, '$.error') = '0' and json_extract_string(j, '$.datArr') <> 'wait'"""


def _j(k):
    return f"r->>'{k}'"


_NORM_P = f"""select * from (select event_id, group_id,
  {first_text("r->>'participantid'", "r->>'id'", "r->>'pid'")} as participant_id,
  {first_text("r->>'participantname'", "r->>'name'")} as participant_name,
  {first_text("r->>'teamname'", "r->>'othername'")} as org, coalesce({_j('short')}, '') as short_no,
  cast(coalesce({pint(_j('vicsum'))}, 0) as int) as win, cast(coalesce({pint(_j('faisum'))}, 0) as int) as lose,
  cast(coalesce({pint(_j('deusum'))}, 0) as int) as draw, coalesce({_j('integral')}, '') as score,
  coalesce({pfloat(_j('integral'))}, 0) as score_value,
  cast(coalesce({pint(_j('compositor'))}, 0) as int) as rank
  from players) where participant_id <> '' and participant_name <> ''"""
_CTE_P = {"players": _PLAYERS, "landed": _NORM_P}

_GAMES = f"""select group_id, bout, unnest(cast(json_extract(j, '$.datArr.rows[*]') as json[])) as r
  from (select group_id, bout, {_BODY} as j from fx_payload_matches)"""
_NORM_M = f"""select * from (select group_id, bout, cast(coalesce({pint(_j('seatnum'))}, 0) as int) as seat,
  coalesce({_j('p1id')}, '') as p1_id, coalesce({_j('p2id')}, '') as p2_id,
  coalesce({_j('p1')}, '') as p1_name, coalesce({_j('p2')}, '') as p2_name,
  coalesce({_j('p1_teamname')}, '') as p1_org, coalesce({_j('p2_teamname')}, '') as p2_org,
  coalesce({_j('p1_result')}, '') as p1_result, coalesce({_j('p2_result')}, '') as p2_result,
  coalesce({pfloat(_j('p1_score'))}, 0) as p1_score, coalesce({pfloat(_j('p2_score'))}, 0) as p2_score
  from games) where p1_id <> '' and p2_id <> ''"""
_CTE_M = {"games": _GAMES, "landed": _NORM_M}

O["norm_events"] = with_tables(f"""select coalesce({_j('event_id')}, '') as event_id,
  coalesce({_j('title')}, '') as title, coalesce({_j('min_time')}, '') as min_time,
  coalesce({_j('provincename')}, '') as provincename, coalesce({_j('city_name')}, '') as city_name,
  coalesce({_j('cname')}, '') as cname, cast(coalesce({pint(_j('play_num'))}, 0) as int) as play_num,
  cast(5000 as bigint) as updated_at
  from (select unnest(cast(json_extract(payload, '$.datArr.rows[*]') as json[])) as r
        from fx_payload_events where fetch_error = '' and json_valid(payload))""")

O["latest_events"] = with_tables("""select event_id, title, min_time, provincename, city_name, cname, play_num,
  updated_at from (select *, row_number() over (partition by event_id order by updated_at desc,
  ingest_seq desc) as rn from fx_event_updates) where rn = 1""")

_ANCHORS = {
    "tags": """select event_id, unnest(t) as tag, unnest(range(len(t))) as pos from (select event_id,
      regexp_extract_all(html, '(?i)<a\\b[^>]*data-groupid=["'']?[0-9]+["'']?[^>]*>') as t from fx_event_pages)""",
    "attrs": """select event_id, pos, unnest(k) as k, unnest(v) as v from (select event_id, pos,
      regexp_extract_all(tag, '(?i)data-([a-z0-9_-]+)=["'']([^"'']*)["'']', 1) as k,
      regexp_extract_all(tag, '(?i)data-([a-z0-9_-]+)=["'']([^"'']*)["'']', 2) as v from tags)""",
    "found": """select event_id, pos, max(case when k = 'groupid' then v end) as group_id,
      coalesce(max(case when replace(k, '-', '') = 'groupname' then
        replace(replace(replace(replace(replace(v, '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') end), '') as group_name,
      coalesce(max(case when k = 'team' then v end), '') as team_type,
      coalesce(max(case when k = 'pnumber' then v end), '') as pnumber from attrs group by event_id, pos""",
    "first_seen": """select *, row_number() over (partition by event_id, group_id order by pos) as rn from found
      where group_id <> ''""",
}
O["extract_anchor_groups"] = with_tables("""select p.event_id, f.group_id, cast(f.pos as int) as pos,
  f.group_name, f.team_type, f.pnumber,
  case when f.group_id is null then 'no groups found' else '' end as error
  from fx_event_pages p left join (select * from first_seen where rn = 1) f on f.event_id = p.event_id""", _ANCHORS)

O["latest_groups"] = with_tables(f"""select group_id, event_id, group_name, team_type, pnumber, updated_at from (
  select *, row_number() over (partition by group_id order by updated_at desc) as rn from (
    select group_id, event_id, group_name, team_type, pnumber, updated_at from fx_groups
    union all
    select group_id, event_id, group_name, coalesce(nullif(team_type, ''), '0'),
      cast(coalesce({pint('pnumber')}, 0) as int), 2000 from first_seen where rn = 1)) where rn = 1""", _ANCHORS)

O["extract_page_links"] = with_tables("""select page_id, href, cast(min(pos) as int) as pos, cast(1 as int) as attr_count
  from (select page_id, pos, regexp_extract(tag, '(?i)\\bhref=["'']([^"'']*)["'']', 1) as raw,
    replace(replace(replace(replace(replace(raw, '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') as href
    from (select page_id, unnest(t) as tag, unnest(range(len(t))) as pos from (select page_id,
      regexp_extract_all(html, '(?i)<a\\b[^>]*href=["''][^"'']*["''][^>]*>') as t from pages)))
  where href <> '' group by page_id, href""")

O["norm_participants"] = with_tables("select * from landed", _CTE_P)
O["norm_matches"] = with_tables("select * from landed", _CTE_M)

# what the payloads of an event carry: none while it waits or errs, else all seats but every 17th, which has no id
O["replace_participants"] = with_tables("""select event_id, group_id, group_name, participant_id, participant_name, org, short_no,
    win, lose, draw, score, rank, case when waits then updated_at else cast(5000 as bigint) end as updated_at
  from (select *, cast(event_id as bigint) % 256 in (0, 32) as waits from fx_participants)
  where waits or cast(short_no as int) % 17 <> 0""")

_M = "group_id, bout, p1_id, p2_id, p1_name, p2_name, p1_org, p2_org, p1_result, p2_result, p1_score, p2_score"
# payloads lack the first player in every 23rd place, and add half a point where the seat is a multiple of 7
O["replace_matches"] = with_tables(f"""select {_M.replace("p1_score", "p1_score + case when kept or seat_a % 7 <> 0 then 0 else 0.5 end as p1_score")},
    case when kept then updated_at else cast(5000 as bigint) end as updated_at
  from (select m.*, f.group_id is not null as kept from fx_matches m
        left join (select group_id from fx_match_status where last_error <> '') f on f.group_id = m.group_id)
  where kept or (seat_a + bout) % 23 <> 0""")

O["match_status_upsert"] = with_tables("""select group_id, cast(max(bout) as int) as rounds, cast(5000 as bigint) as updated_at,
  '' as last_error from fx_matches group by group_id
  union all select s.group_id, s.rounds, s.updated_at, s.last_error from fx_match_status s
  where s.group_id not in (select group_id from fx_matches)""")

O["index_status_upsert"] = with_tables("""select coalesce(c.event_id, b.event_id) as event_id, cast(5000 as bigint) as indexed_at,
  cast(case when b.event_id is null then c.g else 0 end as int) as group_count,
  cast(case when b.event_id is null then c.n else 0 end as int) as participant_count,
  coalesce(b.last_error, '') as last_error
  from (select event_id, count(distinct group_id) as g, count(*) as n from fx_participants group by event_id) c
  full join (select * from fx_index_status where last_error <> '') b on b.event_id = c.event_id""")

_LIST = "case when payload like '[%' then payload else '[]' end"
_SECTION = f"""(select string_agg(coalesce(s->>'t', '') || ': ' || {{clean}}, chr(10) order by i)
  from (select unnest(cast(json_extract({_LIST}, '$[*]') as json[])) as s,
               unnest(range(cast(json_array_length({_LIST}) as bigint))) as i))"""
_CLEAN_H = strip_html(uri("coalesce(s->>'h', '')"))
_PAYLOAD = (f"case when payload like '[%' then {trim(_SECTION.format(clean=_CLEAN_H))} "
            f"else {strip_html(uri('payload'))} end")
O["notice_payload_text"] = with_tables(f"select event_id, {_PAYLOAD} as text from fx_payload_notices")
O["clean_text"] = with_tables(f"select page_id, {strip_html(uri('html'))} as text from pages")

O["notice_upsert"] = with_tables(f"""select n.event_id,
  case when f.event_id is not null and f.err = '' then f.txt else n.notice_text end as notice_text,
  case when f.event_id is not null then cast({AS_OF_MS} as bigint) else n.updated_at end as updated_at,
  case when f.event_id is not null then f.err else n.last_error end as last_error
  from fx_notices n left join (select p.event_id, {_PAYLOAD} as txt,
      case when e.event_key % 256 = 0 then 'HTTP 502' else '' end as err
    from fx_payload_notices p join fx_events e on e.event_id = p.event_id) f
  on f.event_id = n.event_id""")

O["jsonp_rows"] = with_tables("""select event_id, group_id, chunk, status,
  case when status = 'error' then coalesce(nullif(j->>'msg', ''), 'API error') else '' end as msg,
  cast(case when status = 'ready' then coalesce(json_array_length(j, '$.datArr.rows'), 0) else 0 end as int) as row_count
  from (select event_id, group_id, chunk, j, case when json_extract_string(j, '$.datArr') = 'wait' then 'wait'
      when coalesce(json_extract_string(j, '$.error'), '1') <> '0' then 'error' else 'ready' end as status
    from (select event_id, group_id, chunk, cast(""" + _BODY + """ as json) as j from fx_payload_participants))""")

ENRICHED = """select p.*, cast(coalesce(nullif(p.rank, 0), f.rank, 0) as int) as rank2,
  cast(coalesce(nullif(g.pnumber, 0), nullif(c.n, 0), 0) as int) as group_size
  from fx_participants p left join fx_groups g on g.group_id = p.group_id
  join (select group_id, count(*) as n from fx_participants group by group_id) c on c.group_id = p.group_id
  left join (select group_id, participant_id, max(rank) as rank from landed group by group_id, participant_id) f
    on f.group_id = p.group_id and f.participant_id = p.participant_id"""
ENRICH_CTE = {**_CTE_P, "enriched": ENRICHED}
O["rank_size_enrich"] = with_tables("""select event_id, group_id, participant_id, rank2 as rank, group_size
  from enriched""", ENRICH_CTE)

O["notice_freshness"] = with_tables(f"""select e.event_id,
  coalesce(n.updated_at > 0 and {AS_OF_MS} - n.updated_at < 1209600000 and n.last_error = '', false) as usable,
  case when n.event_id is null then 'missing' when n.last_error <> '' then 'failed'
    when {AS_OF_MS} - n.updated_at < 1209600000 then 'fresh' else 'stale' end as state
  from fx_events e left join fx_notices n on n.event_id = e.event_id""")

O["match_freshness"] = with_tables("""select g.group_id, g.rounds, s.rounds as stored_rounds,
  s.group_id is not null and s.last_error = '' and s.rounds >= g.rounds as usable
  from (select group_id, max(win + lose + draw) as rounds from fx_participants group by group_id
        having max(win + lose + draw) > 0) g left join fx_match_status s on s.group_id = g.group_id""")

_PAGES = {"pages_seen": """select page, case when fetch_error <> '' or not ok then 'failed' when err <> '0' then 'empty' else 'loaded' end as status,
    case when fetch_error <> '' then fetch_error when not ok then 'invalid JSON' when err <> '0' then coalesce(nullif(msg, ''), 'API error')
      else '' end as error, cast(case when fetch_error <> '' or not ok then 0 else n end as int) as events
  from (select page, fetch_error, ok, coalesce(json_extract_string(p, '$.error'), '0') as err, json_extract_string(p, '$.msg') as msg,
      coalesce(json_array_length(p, '$.datArr.rows'), 0) as n
    from (select page, fetch_error, json_valid(payload) as ok, case when json_valid(payload) then payload else '{}' end as p
          from fx_payload_events))"""}
O["event_page_status"] = with_tables("select * from pages_seen", _PAGES)
O["ingest_run_report"] = with_tables("""select a.*, b.*, c.failed_sample from (
  select count(*) filter (status <> 'failed') as pages_loaded, count(*) filter (status = 'failed') as pages_failed,
    cast(coalesce(sum(events), 0) as bigint) as events_stored from pages_seen) a, (
  select count(*) filter (last_error = '') as events_indexed, count(*) filter (last_error <> '') as events_failed,
    cast(coalesce(sum(group_count) filter (last_error = ''), 0) as bigint) as groups_indexed,
    cast(coalesce(sum(participant_count) filter (last_error = ''), 0) as bigint) as participants_indexed
  from fx_index_status) b, (
  select coalesce(string_agg(page || ':' || error, ', ' order by page), '') as failed_sample from (
    select page, error from pages_seen where status = 'failed' order by page limit 12)) c""", _PAGES)

def _delivered(table, columns, owner, mark):
    """Newest deliveries: every third owner's mark is one more, every fifth has lost its rows, late older ones change nothing."""
    cols = ", ".join(f"cast({c} + case when k % 96 = 0 then 1 else 0 end as int) as {c}" if c == mark else c for c in columns.split())
    return with_tables(f"""select {cols} from (select *, cast({owner} as bigint) - cast({owner} as bigint) % 32 as k from {table})
  where k % 160 <> 0""")


O["stream_groups"] = _delivered("fx_groups", "group_id event_id group_name team_type pnumber updated_at", "group_id", "pnumber")
O["stream_participants"] = _delivered(
    "fx_participants", "event_id group_id group_name participant_id participant_name org short_no win lose draw score rank updated_at",
    "event_id", "win")
O["stream_matches"] = _delivered("fx_matches", f"{_M.replace(',', '')} updated_at", "group_id", "bout")

O["stream_upsert_events"] = with_tables("""select event_id, title, min_time, provincename, city_name, cname, play_num,
  updated_at from (select *, row_number() over (partition by event_id order by updated_at desc, ingest_seq desc) as rn
    from fx_event_updates) where rn = 1""")

O["stream_live_records_table"] = with_tables("""select group_id, pid as participant_id,
  count(*) filter (res = '1') as win, count(*) filter (res = '2') as lose,
  count(*) filter (res not in ('1', '2')) as draw, sum(sc) as score from (
    select group_id, p1_id as pid, p1_result as res, p1_score as sc from fx_matches where p1_result <> ''
    union all select group_id, p2_id, p2_result, p2_score from fx_matches where p1_result <> '')
  group by group_id, pid""")

ORACLES = O
