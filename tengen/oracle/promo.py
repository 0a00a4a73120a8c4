"""Promotion levels, rule texts, decisions, later evidence, history."""

from .base import with_tables
from .ingest import ENRICH_CTE
from .snippets import WS, has, num, rx, strip, strip_html, uri
from .strength import LEFT, on_left

O: dict[str, str] = {}

_TEXT = "(title || ' ' || cname || ' ' || city_name)"
_PROV = "provincename in ('四川省', '河北省')"
RANK_EVENT = (f"({_PROV} and {_TEXT} like '%围棋%' and {has(_TEXT, '段级位赛|段位赛')} and not "
              f"{has(_TEXT, '公开赛|网赛|公益|争霸赛|邀请赛|联赛')} and {has(_TEXT, '省|围棋协会|棋院|段位赛|段级位赛|级位赛')})")
BACKED = (f"({_PROV} and {_TEXT} like '%围棋%' and {has('title', '公开赛|冠军赛|大奖赛|争霸赛')} and "
          f"{has(_TEXT, '围棋(爱好者)?协会|棋类协会|棋院|智力运动中心|体育局')})")
CASUAL = has(_TEXT, "公益|慈善|网赛|网络赛|线上|邀请赛|交流赛|联谊")
INFER = f"(not {CASUAL} and ({has(_TEXT, '段级位赛|段位赛|级位赛|定级|定段')} or {BACKED}))"
O["public_event_flags"] = with_tables(f"""select event_id, title, {RANK_EVENT} as rank_event, {BACKED} as backed_public_event,
  {CASUAL} as casual_event, {INFER} as inferable_event from fx_events""")

# level of a group name: columns n (blank-free name), ms (non-zero mentions)
LEVELS = {
    "gnames": f"select distinct group_name, {strip('group_name')} as n from fx_participants",
    "mentions": """select group_name, n, list_filter(regexp_extract_all(n, '[0-9]+[段级]'),
        lambda m: cast(regexp_extract(m, '[0-9]+') as bigint) > 0) as ms from gnames""",
    "lvls": f"""select group_name, split_part(code, ' ', 1) as kind, cast(split_part(code, ' ', 2) as int) as current
      from (select group_name, case when n not like '%组%' then ''
          when {num('n', '^定([0-9]+)段.*组')} = 1 then 'level 1'
          when {num('n', '^定([0-9]+)段.*组')} between 2 and 6
            then 'dan ' || cast({num('n', '^定([0-9]+)段.*组')} - 1 as int)
          when {has('n', '^[0-9]+级升[0-9]+段.*组')} then 'level ' || cast({num('n', '^([0-9]+)级')} as int)
          when {has('n', '[0-9]+[段级]?[-—－~～至到][0-9]+[段级]')} or {has('n', '[0-9]+[段级][-—－~～至到][0-9]+')}
            or len(ms) > 1 then ''
          when len(ms) = 1 and ms[1] like '%级' then 'level ' || cast({num('ms[1]', '([0-9]+)')} as int)
          when len(ms) = 1 and {num('ms[1]', '([0-9]+)')} between 1 and 5 then 'dan ' || cast({num('ms[1]', '([0-9]+)')} as int)
          when {num('n', '^([0-9]+)段.*组')} between 1 and 5 then 'dan ' || cast({num('n', '^([0-9]+)段')} as int)
          when {has('n', '^[0-9]+级.*组')} then 'level ' || cast({num('n', '^([0-9]+)级')} as int)
          when {has('n', '一级组|定段组')} then 'level 1' else '' end as code from mentions) where code <> ''"""}
O["candidate_level"] = with_tables("""select g.group_id, g.group_name, l.kind, l.current
  from fx_groups g left join lvls l on l.group_name = g.group_name""", LEVELS)

LADDER = {"ladders": """select event_id, case when len(l) >= 2 then l end as ladder from (
  select event_id, list_sort(list(distinct v) filter (v is not null), 'DESC') as l from (
    select event_id, try_cast(nullif(regexp_extract(group_name, '([0-9]+)""" + WS + """*级组', 1), '') as int) as v from fx_groups)
  group by event_id)"""}
O["level_ladder"] = with_tables("select event_id, array_to_string(ladder, ',') as ladder from ladders", LADDER)


def at(lv):
    return f"nullif(list_position(ladder, {lv}), 0)"


def up(n):
    """Label n steps above (kind, current)."""
    p = f"({at('current')} - 1 + {n})"
    return f"""case when {n} > 0 then case when kind = 'dan' then (current + {n}) || '段'
      when {p} < len(ladder) then ladder[cast({p} + 1 as bigint)] || '级'
      when {p} >= len(ladder) then ({p} - len(ladder) + 1) || '段' end end"""


STEP = f"""case when kind = 'dan' and to_kind = 'dan' then cast(to_current - current as bigint)
  when kind = 'level' and to_kind = 'level' then {at('to_current')} - {at('current')}
  when kind = 'level' and to_kind = 'dan' then len(ladder) - ({at('current')} - 1) + to_current - 1 end"""
_NEXT = {**LEVELS, **LADDER, "gl": """select g.event_id, g.g, l.kind, l.current from fx_groups g
    left join lvls l on l.group_name = g.group_name""",
         "nb": """select a.*, b.kind as to_kind, b.current as to_current, d.ladder from gl a
    join gl b on b.event_id = a.event_id and b.g = a.g + 1 left join ladders d on d.event_id = a.event_id"""}
O["level_step"] = with_tables(f"select event_id, g, kind, current, to_kind, to_current, {STEP} as step from nb", _NEXT)
O["target_by_steps"] = with_tables(f"""select event_id, g, kind, current, {up('1')} as up_1, {up('2')} as up_2, {up('3')} as up_3
  from nb""", _NEXT)


def cn(x):
    return f"""case {x} when '一' then 1 when '二' then 2 when '两' then 2 when '三' then 3 when '四' then 4 when '五' then 5
      when '六' then 6 when '七' then 7 when '八' then 8 when '九' then 9 when '十' then 10 end"""


def steps_of(x):
    return f"coalesce(nullif(try_cast(nullif(regexp_extract({x}, '^([0-9]+)', 1), '') as bigint), 0), {cn(x)})"


_STRICT = "升段|升级|晋升|升为|升至|升[0-9]+[段级]|申请[0-9]+级"
FRAGS = {
    "clean": f"""select event_id, {strip(strip_html(uri('notice_text')))} as t from fx_notices""",
    "parts": """select event_id, unnest(l) as f, unnest(range(len(l))) as i from (
      select event_id, regexp_split_to_array(t, '[。；;]') as l from clean)""",
    "loose": f"""select *, {has('f', _STRICT)} as strict, max(case when {has('f', _STRICT)} then 1 else 0 end)
        over (partition by event_id) as any_strict from parts where {has('f', _STRICT + '|段位|级位')}""",
    "frags": """select event_id, f as fragment, cast(row_number() over (partition by event_id order by i) - 1 as int) as pos
      from loose where strict or any_strict = 0"""}
O["notice_fragments"] = with_tables("select * from frags", FRAGS)
O["chinese_number"] = with_tables(f"""select event_id, pos, cast(nth as int) as nth, raw, cast({cn('raw')} as bigint) as numeral,
  cast({steps_of('raw')} as bigint) as steps from (
    select event_id, pos, unnest(l) as raw, unnest(range(len(l))) as nth from (
      select event_id, pos, regexp_extract_all(fragment, '[一二两三四五六七八九十]+|[0-9]+') as l from frags))""", FRAGS)

_CUE = "%|晋升|升为|升至|申请|前[0-9]+名|第[0-9]+名|[0-9]+胜"
MATCH = {
    **LEVELS, **LADDER, **FRAGS,
    "rgroups": """select distinct p.event_id, p.group_name, l.kind, l.current from fx_participants p
      join lvls l on l.group_name = p.group_name""",
    "labels": f"""select *, {strip('group_name')} as n, case when {has(strip('group_name'), '^定[0-9]+段')}
        then [n, '定' || {rx('n', '^定([0-9]+)段')} || '段组', '定' || {rx('n', '^定([0-9]+)段')} || '段']
        else [n, current || case kind when 'dan' then '段' else '级' end || '组'] end as ls from rgroups""",
    "hits": """select g.*, f.fragment as whole, f.pos as fpos, x.label, position(x.label in f.fragment) as at_pos
      from labels g join frags f on f.event_id = g.event_id, lateral (select unnest(g.ls) as label) x
      where contains(f.fragment, x.label)""",
    "starts": """select * from (select *, row_number() over (partition by event_id, group_name, fpos
      order by at_pos, length(label) desc) as rn from hits) where rn = 1""",
    # next group names after the label, each as a candidate end
    "tails": f"""select *, substr(whole, at_pos) as own,
        regexp_split_to_array(regexp_replace(substr(whole, at_pos + length(label)), '([0-9]+[段级]组)', chr(1) || '\\1', 'g'), chr(1)) as ps
      from starts""",
    "ends": f"""select event_id, group_name, fpos, min(k) as k from (
        select event_id, group_name, fpos, label, ps, unnest(range(1, len(ps))) as k from tails)
      where {has("label || array_to_string(ps[1:k], '')", _CUE)} group by all""",
    "narrow": """select t.event_id, t.group_name, t.kind, t.current, t.whole,
        cast(row_number() over (partition by t.event_id, t.group_name order by t.fpos) - 1 as int) as pos,
        case when e.k is not null then t.label || array_to_string(t.ps[1:e.k], '') else t.own end as fragment, d.ladder
      from tails t left join ends e on e.event_id = t.event_id and e.group_name = t.group_name and e.fpos = t.fpos
      left join ladders d on d.event_id = t.event_id"""}
O["fragment_group_match"] = with_tables("select event_id, group_name, pos, whole as fragment from narrow", MATCH)
O["fragment_label_index"] = O["fragment_group_match"]
O["fragment_narrow"] = with_tables("select event_id, group_name, pos, fragment from narrow", MATCH)

_FULL = "(全胜|[0-9]+连胜)[^。；;]*(跳升|晋升|升)"
_TT = "(第([0-9]+)名|前([0-9]+)名)[^。；;]*(晋升|升)(为|至)?([0-9]+)(段|级)"
_TS = "(各组)?(第([0-9]+)名|第([一二三四五六七八九十]+)名|第一)[^。；;]*(晋升|升)([一二两三0-9]+)个(级别|段位)"


def _lab(pattern, i):
    return f"case when {has('fragment', pattern)} then cast({rx('fragment', pattern, i)} as bigint) || {rx('fragment', pattern, i + 1)} end"


RULES = {**MATCH, "f1": f"""select *,
    coalesce({num('fragment', _TT, 2)}, {num('fragment', _TT, 3)}) as tt_n, {num('fragment', _TT, 6)} as tt_to,
    {rx('fragment', _TT, 7)} as tt_unit,
    case when {has('fragment', _TS)} then case when {rx('fragment', _TS, 0)} like '%第一%' then 1
      else coalesce(nullif({num('fragment', _TS, 3)}, 0), {cn(rx('fragment', _TS, 4))}) end end as ts_n,
    {steps_of(rx('fragment', _TS, 6))} as ts_up,
    nullif({num('fragment', '(前|按|按照)?([0-9]+(\\.[0-9]+)?)%', 2)}, 0) as percent,
    nullif({num('fragment', '前([0-9]+)名')}, 0) as plain_top,
    case when {has('fragment', '胜[0-9]+盘')} then nullif({num('fragment', '胜([0-9]+)盘')}, 0)
      else nullif({num('fragment', '([0-9]+)胜')}, 0) end as wins,
    coalesce({_lab('(晋升|升)(为|至)?([0-9]+)(段|级)', 3)}, {_lab('申请([0-9]+)(级)', 1)}) as said,
    {_lab(_FULL + '(为|至)?([0-9]+)(段|级)', 4)} as full_said,
    {steps_of(rx('fragment', _FULL + '([一二两三0-9]+)个级别', 3))} as full_steps,
    coalesce({steps_of(rx('fragment', '(晋升|升)([一二两三0-9]+)个(级别|段位)', 2))},
      case when {has('fragment', '(晋升|升)为?(1|一)个(级别|段位)|(晋升|升)(1|一)个')} then 1 end) as steps from narrow""",
         "fields": f"""select event_id, group_name, kind, current, pos, fragment, percent, wins,
    coalesce(case when tt_n > 0 and tt_to > 0 then tt_n end, case when ts_n > 0 and ts_up > 0 then ts_n end, plain_top,
      case when fragment like '%冠军%' then 1 end) as top_n,
    coalesce(case when tt_n > 0 and tt_to > 0 then cast(tt_to as bigint) || tt_unit end,
      case when ts_n > 0 and ts_up > 0 then {up('ts_up')} end) as top_n_target,
    coalesce(said, {up('steps')}) as target, coalesce(full_said, {up('full_steps')}) as full_win_target from f1""",
         "picked": """select * from (select *, row_number() over (partition by event_id, group_name order by
      case when target is not null or full_win_target is not null or regexp_matches(fragment, '晋升|升|申请') then 0 else 1 end, pos) as rn
    from fields) where rn = 1"""}
O["rule_fields"] = with_tables("""select event_id, group_name, kind, current, pos, fragment, percent, cast(top_n as double) as top_n,
  wins, top_n_target, target, full_win_target from fields""", RULES)
O["rule_pick"] = with_tables("""select event_id, group_name, fragment as rule_text, percent, cast(top_n as double) as top_n, wins,
  top_n_target, target, full_win_target from picked""", RULES)

STANDARD = """(values ('四川省', 'dan', 4, 15e0, '5段', null), ('四川省', 'dan', 3, 20, '4段', null), ('四川省', 'dan', 2, 25, '3段', '4段'),
  ('四川省', 'dan', 1, 30, '2段', '3段'), ('四川省', 'level', 1, 35, '1段', '2段'), ('四川省', 'level', 2, 50, '1级', '1段'),
  ('四川省', 'level', 5, 50, '2级', '1级'), ('河北省', 'dan', 4, 15, '5段', null), ('河北省', 'dan', 3, 30, '4段', null),
  ('河北省', 'dan', 2, 50, '3段', null), ('河北省', 'dan', 1, 65, '2段', null), ('河北省', 'level', 1, 75, '1段', null),
  ('河北省', 'level', 2, 75, '1级', null), ('河北省', 'level', 3, 80, '2级', null), ('河北省', 'level', 4, 80, '3级', null),
  ('河北省', 'level', 5, 85, '4级', null), ('河北省', 'level', 6, 85, '5级', null), ('河北省', 'level', 7, 90, '6级', null))
  s(province, kind, level, percent, target, full_win_target)"""
_STD_TEXT = """province || '围棋段级位赛通用晋升标准（来源：' || case province when '四川省' then 'http://www.scwqxh.com/go-a327.htm'
  else 'https://sport.hebei.gov.cn/m/view.php?aid=8392' end || '）'"""
_STD = {"std": f"""select *, {_STD_TEXT} as text, case province when '四川省' then 'ceil' else 'round' end as rounding,
  cast(7 as int) as min_rounds from {STANDARD}"""}
O["rule_dims"] = with_tables("""select s.*, coalesce(c.events, 0) as events, coalesce(c.entries, 0) as entries from std s
  left join (select e.provincename, l.kind, l.current, count(distinct p.event_id) as events, count(*) as entries
    from fx_participants p join lvls l on l.group_name = p.group_name join fx_events e on e.event_id = p.event_id group by 1, 2, 3) c
  on c.provincename = s.province and c.kind = s.kind and c.current = s.level""", {**LEVELS, **_STD})

CAND = {**ENRICH_CTE, **RULES, **_STD, "cand": """select e.title, e.min_time, e.provincename, e.city_name, e.cname,
    x.* exclude (rank, rank2), x.rank2 as rank, l.kind, l.current, d.ladder
  from enriched x join fx_events e on e.event_id = x.event_id join lvls l on l.group_name = x.group_name
  left join ladders d on d.event_id = x.event_id"""}
_QUALIFIES = f"""({RANK_EVENT} or ({BACKED} and c.kind = 'dan' and c.current >= 3
    and c.event_id in (select event_id from fx_confirmed_events)))"""
O["association_rule_join"] = with_tables(f"""select c.event_id, c.group_id, c.participant_id, c.provincename, c.kind, c.current, s.percent,
  s.target, s.full_win_target, s.rounding, s.min_rounds, s.text as rule_text from cand c left join std s
  on s.province = c.provincename and s.kind = c.kind and s.level = c.current and {_QUALIFIES}""", CAND)

CHOSEN = {**CAND, "ruled": f"""select c.*,
    case when n.event_id is not null then 'notice' when k.event_id is not null then 'user-confirmed-rule'
      when s.province is not null then 'association-general-rule' end as source,
    case when n.event_id is not null then n.fragment when k.event_id is not null then k.text else s.text end as rule_text,
    case when n.event_id is not null then n.percent when k.event_id is null then s.percent end as percent,
    cast(n.top_n as double) as top_n, n.wins, n.top_n_target,
    case when n.event_id is not null then n.target when k.event_id is null then s.target end as target,
    case when n.event_id is not null then n.full_win_target when k.event_id is not null then k.full_win_target
      else s.full_win_target end as full_win_target,
    case when n.event_id is null and k.event_id is null then s.rounding end as rounding,
    case when n.event_id is null and k.event_id is null then s.min_rounds end as min_rounds
  from cand c left join picked n on n.event_id = c.event_id and n.group_name = c.group_name
  left join fx_confirmed_rules k on k.event_id = c.event_id and k.group_name = {strip('c.group_name')}
  left join std s on s.province = c.provincename and s.kind = c.kind and s.level = c.current and {_QUALIFIES}"""}
O["rule_source_choice"] = with_tables("""select event_id, group_id, participant_id, source, rule_text, percent, top_n, wins, target,
  full_win_target, top_n_target from ruled""", CHOSEN)


def plain(x):
    return f"case when {x} = floor({x}) then cast(cast({x} as bigint) as varchar) else cast({x} as varchar) end"


DECIDED = {**CHOSEN, "d1": """select *, win + lose + draw as rounds,
    full_win_target is not null and win + lose + draw > 0 and win = win + lose + draw as is_full,
    greatest(1, case rounding when 'round' then floor(group_size * percent / 100 + 5e-1) else ceil(group_size * percent / 100) end) as places
  from ruled where source is not null""",
           "d2": f"""select *, case when is_full then 1 when top_n_target is not null and top_n > 0 and rank > 0 and rank <= top_n then 2
      when percent > 0 and rank > 0 and group_size > 0 then 3 when top_n > 0 and rank > 0 then 4 when wins > 0 then 5 else 0 end as branch,
    case when min_rounds > 0 and rounds < min_rounds then false else true end as enough from d1""",
           "d3": """select *, case branch when 1 then full_win_target when 2 then top_n_target else target end as t,
    case branch when 1 then true when 2 then true when 3 then rank <= places when 4 then rank <= top_n when 5 then win >= wins
      else false end as ok from d2""",
           "decs": f"""select *, enough and ok and t is not null as promoted,
    case when enough and ok and t is not null then case branch
      when 1 then '规程写明全胜特殊晋升；选手' || win || '胜全胜'
      when 2 then '规程写明' || group_name || '前' || {plain('top_n')} || '名晋升至' || t || '；选手第' || rank || '名'
      when 3 then '规程写明' || group_name || '前' || {plain('percent')} || '%晋升；本组' || group_size || '人，'
        || case rounding when 'round' then '按比例四舍五入' when 'floor' then '按比例向下取整' else '按比例向上取整' end
        || '为' || cast(places as bigint) || '个名额，选手第' || rank || '名'
      when 4 then '规程写明' || group_name || '前' || {plain('top_n')} || '名晋升；选手第' || rank || '名'
      else '规程写明达到' || {plain('wins')} || '胜晋升；选手' || win || '胜' || lose || '负'
        || case when draw > 0 then draw || '和' else '' end end end as basis from d3""",
           "decided": """select r.*, d.promoted, case when d.promoted then d.t end as promoted_to, d.basis,
      r.win + r.lose + r.draw as rounds from ruled r
    left join decs d on d.group_id = r.group_id and d.participant_id = r.participant_id"""}
O["promotion_decision"] = with_tables("select event_id, group_id, participant_id, promoted, promoted_to, basis from decided", DECIDED)
_EXPLICIT = """(coalesce(percent, 0) > 0 or coalesce(top_n, 0) > 0 or coalesce(wins, 0) > 0 or target is not null
  or full_win_target is not null or top_n_target is not null)"""
O["explicit_rule_flag"] = with_tables(f"select event_id, group_id, participant_id, {_EXPLICIT} as explicit_rule from decided", DECIDED)
O["quota"] = with_tables("""select g.group_id, g.pnumber, p.percent, m.mode, cast(greatest(1, case m.mode
    when 'round' then floor(g.pnumber * p.percent / 100 + 5e-1) when 'floor' then floor(g.pnumber * p.percent / 100)
    else ceil(g.pnumber * p.percent / 100) end) as bigint) as places,
  case m.mode when 'round' then '按比例四舍五入' when 'floor' then '按比例向下取整' else '按比例向上取整' end as label
  from fx_groups g cross join (values (10e0), (15e0), (30e0), (35e0), (50e0)) p(percent)
  cross join (values ('ceil'), ('round'), ('floor')) m(mode)""")

# first later entry with a defined step, by comparing all entries of a player
LATER = {**DECIDED, "usable": f"select * from cand where not {CASUAL}",
         "undecided": "select * from decided where not coalesce(promoted, false)",
         "pairs": f"""select c.event_id, c.group_id, c.participant_id, l.min_time as later_time, l.event_id as later_event_id,
      l.group_id as later_group_id, l.kind as later_kind, l.current as later_current,
      row_number() over (partition by c.group_id, c.participant_id order by l.min_time, l.event_id, l.group_id, l.participant_id) as rn
    from undecided c join usable l on l.participant_name = c.participant_name and l.min_time > c.min_time
    where case when c.kind = 'dan' then l.kind = 'dan' when c.ladder is null or list_position(c.ladder, c.current) is null
      or list_position(c.ladder, c.current) = 0 then false when l.kind = 'dan' then true
      else coalesce(list_position(c.ladder, l.current), 0) > 0 end""",
         "nxt": "select * exclude (rn) from pairs where rn = 1",
         "inf1": f"""select u.*, n.* exclude (event_id, group_id, participant_id), n.later_kind as to_kind, n.later_current as to_current
    from undecided u join nxt n on n.group_id = u.group_id and n.participant_id = u.participant_id
    where not {CASUAL} and ({INFER} or {_EXPLICIT})""",
         "inferred": f"""select *, {STEP} as step, case when rounds > 0 then (win + 5e-1 * draw) / rounds else 0 end as rate from inf1""",
         "inf": """select *, coalesce(step between 1 and 2 and rounds >= 5 and (rate >= 0.75e0
        or (rank > 0 and group_size > 0 and rank <= ceil(group_size * 0.35e0))
        or (step = 1 and win > lose and rate >= 2e0 / 3e0)), false) as yes from inferred"""}
# the same for all entries that the deliveries leave
_LEFT_CAND = {**LEFT, "left_groups": "select * from fx_groups where (cast(group_id as bigint) - cast(group_id as bigint) % 32) % 160 <> 0",
              **{k: on_left(v) for k, v in CAND.items()}, "usable": f"select * from cand where not {CASUAL}",
              "pairs": LATER["pairs"].replace("from undecided c", "from cand c"), "nxt": LATER["nxt"]}
O["stream_later_entries"] = with_tables("select * from nxt", _LEFT_CAND)
O["next_decisive_event"] = with_tables("select * from nxt", LATER)
O["later_group_inference"] = with_tables("""select event_id, group_id, participant_id, later_time, later_event_id, later_group_id,
  step, yes as inferred, case when yes then later_current || case later_kind when 'dan' then '段' else '级' end end as inferred_target
  from inf""", LATER)

_COLS = """event_id, title, substr(min_time, 1, 10) as date, provincename as province, city_name as city, cname as organizer,
  group_name, rank, group_size, win, lose, draw, score"""
_URL = "'event/' || event_id || '.html#groupID=' || group_id"
UNION = {**LATER, "items": f"""select participant_name as name, {_COLS}, promoted_to, '高' as confidence, basis, rule_text, source,
      {_URL} as detail_url, group_id, participant_id, min_time, cast(0 as int) as external from decided where promoted
    union all select participant_name, {_COLS}, later_current || case later_kind when 'dan' then '段' else '级' end, '中', '', '',
      'subsequent-group', {_URL}, group_id, participant_id, min_time, 0 from inf where yes
    union all select name, event_id, title, date, province, city, organizer, group_name, 0, 0, null, null, null, '', promoted_to, '高',
      '', '', source, '', '', '', date, 1 from fx_evidence""",
         "uniq": """select * exclude (rn) from (select *, row_number() over (partition by name, date, title, group_name, promoted_to
      order by external, min_time desc, event_id, group_id, participant_id) as rn from items) where rn = 1"""}


def monotone(src):
    return f"""select * exclude (dan, best) from (select *, max(dan) over (partition by name order by date, event_id, external,
      group_id, participant_id, promoted_to, title, group_name rows between unbounded preceding and 1 preceding) as best from (
      select *, coalesce(try_cast(nullif(regexp_extract(promoted_to, '^([0-9]+)\\s*段$', 1), '') as int), 0) as dan from {src}))
    where dan = 0 or dan > coalesce(best, 0)"""


HIST = {**UNION, "hist": monotone("uniq")}
_ITEM = "name, date, event_id, group_id, participant_id, title, group_name, promoted_to, source"
O["evidence_union"] = with_tables(f"select {_ITEM}, confidence, external from items", UNION)
O["dedupe_first"] = with_tables(f"select {_ITEM} from uniq", UNION)
O["monotone_sequence"] = with_tables(f"select {_ITEM} from ({monotone('items')})", UNION)
O["promotion_history"] = with_tables("select * exclude (min_time, external) from hist", HIST)
O["promotion_summary"] = with_tables("""select n.name, n.scanned, coalesce(c.k, 0) as count from (
    select participant_name as name, count(*) as scanned from fx_participants group by 1) n
  left join (select name, count(*) as k from hist group by 1) c on c.name = n.name""", HIST)
_WHOLE = "title || '（' || cname || '，' || city_name || '）'"
O["display_titles"] = with_tables(f"""select event_id, case when length({_WHOLE}) > 24 then substr({_WHOLE}, 1, 24) || '…' else {_WHOLE} end as title_24,
  case when length({_WHOLE}) > 22 then substr({_WHOLE}, 1, 22) || '…' else {_WHOLE} end as title_22 from fx_events""")
O["display_fields"] = with_tables("""select name, event_id, group_id, participant_id, promoted_to, date,
  case when length(title) > 28 then substr(title, 1, 28) || '…' else title end as short_title,
  case when rank > 0 and group_size > 0 then '第' || rank || '名 / ' || group_size || '人' when rank > 0 then '第' || rank || '名'
    else '名次待确认' end as place,
  case when coalesce(win + lose + draw, 0) > 0 then win || '胜' || lose || '负' || case when draw > 0 then draw || '和' else '' end
    else '' end as record from hist""", HIST)

ORACLES = O
