"""Level features, rating passes and both strength estimates."""

import re

from ..sources.fixtures import AS_OF, RECENT_N
from .base import with_tables
from .snippets import OUTCOME, SIDES, WS, half_up, has, num, trim

O: dict[str, str] = {}
FROM_DAY = "2000-01-02"


def group_l(open_l):
    """CASE over column n (trimmed group name)."""
    band = "([0-9]+)\\s*[~\\-－—至到]\\s*([0-9]+)\\s*级"
    kyu, dan = num("n", "([0-9]+)\\s*级"), num("n", "([0-9]+)\\s*段")
    return f"""case when {has('n', '启蒙|吃子|入门|幼儿|棋趣')} then null when n like '%定段%' then 25.3e0
      when {has('n', band)} then ((26 - {num('n', band, 1)}) + (26 - {num('n', band, 2)})) / 2
      when {kyu} between 1 and 25 then 26 - {kyu} when {dan} between 1 and 8 then 25 + {dan}
      when n like '%低段%' then 27.5e0 when n like '%高段%' then 30e0 when n like '%公开%' then {open_l}e0 end"""


def tier(model):
    t = {"graph": ("29.85e0", "29.35e0", "28.85e0", "27.5e0", "24e0", "27.5e0"),
         "quick": ("31e0", "30e0", "30e0", "28e0", "24.5e0", "28e0")}[model]
    about = "(title || ' ' || cname)"
    return f"""case when {has(about, '全国|国际')} then {t[0]} when {has(about, '省')} then {t[1]}
      when {has(about, '市')} then {t[2]} when {has(about, '区|县')} then {t[3]}
      when {has(about, '学校|班级|校内')} then {t[4]} else {t[5]} end"""


def age_adj(model):
    g = {"graph": ("0.25", "0.5", "0.75", "1.0", "1.25", "0.9", "1.35"),
         "quick": ("0.3", "0.6", "0.9", "1.2", "1.5", "1.0", "1.5")}[model]
    ages = {"graph": ("0.25", "0.6", "1.0", "1.35"), "quick": ("0.3", "0.7", "1.1", "1.5")}[model]
    letters = {"graph": "when n like '%甲组%' then 0.9e0 when n like '%乙组%' then 0.55e0 when n like '%丙组%' then 0.2e0 "
                        "when regexp_matches(n, '[AＡ]组') then 0.85e0 when regexp_matches(n, '[BＢ]组') then 0.45e0 "
                        "when regexp_matches(n, '[CＣ]组') then 0.15e0",
               "quick": "when n like '%甲组%' then 1e0 when n like '%乙组%' then 0.6e0 when n like '%丙组%' then 0.2e0"}[model]
    grade = f"""case when {has('n', '初中|中学生')} then {g[6]}e0 when n like '%高年级%' then {g[5]}e0
      when n like '%低年级%' then 0.2e0 when n like '%一年级%' then 0e0 when n like '%二年级%' then {g[0]}e0
      when n like '%三年级%' then {g[1]}e0 when n like '%四年级%' then {g[2]}e0 when n like '%五年级%' then {g[3]}e0
      when n like '%六年级%' then {g[4]}e0 else 0e0 end"""
    age = f"coalesce({num('n', '(?i)U([0-9]+)')}, {num('n', '([0-9]+) *岁')})"
    return f"""case when {age} <= 7 then 0e0 when {age} <= 9 then {ages[0]}e0 when {age} <= 11 then {ages[1]}e0
      when {age} <= 13 then {ages[2]}e0 when {age} is not null then {ages[3]}e0
      when {grade} <> 0 then {grade} else case {letters} else 0e0 end end"""


def gate(model):
    extra = {"graph": "小学.*组|儿童.*组|少儿.*组", "quick": "小学生?组"}[model]
    letters = {"graph": "[甲乙丙丁ABCDＡＢＣＤ]组", "quick": "[甲乙丙丁]组"}[model]
    return (f"({has('n', f'[一二三四五六]年级|低年级|高年级|{extra}|初中|中学生?组|U[0-9]+|[0-9]+ *岁|{letters}')} "
            f"and not {has('n', '启蒙|吃子|入门')})")


def event_w(model):
    w = {"graph": ("1.45", "1.3", "1.15", "|省青少年"), "quick": ("1.6", "1.4", "1.2", "")}[model]
    about = "(title || ' ' || cname)"
    return f"""case when {has(about, '全国|国际|中国围棋协会')} then {w[0]}e0
      when {has(about, '省级|省赛|省锦标|全省|省围棋' + w[3])} then {w[1]}e0
      when {has(about, '市级|市锦标|全市|市围棋')} then {w[2]}e0 else 1e0 end"""


_DAYS = f"(date '{AS_OF}' - cast(substr(min_time, 1, 10) as date))"
TIME_W = {
    "graph": f"case when {_DAYS} < 0 or {_DAYS} > 180 then 0e0 when {_DAYS} <= 60 then 1e0 when {_DAYS} <= 120 then 0.7e0 else 0.45e0 end",
    "quick": f"case when {_DAYS} <= 90 then 1e0 when {_DAYS} <= 180 then 0.4e0 else 0e0 end"}


def level_of(x):
    v = f"greatest(5e-1, least(33.99e0, {x}))"
    fl = f"cast(floor({v}) as int)"
    t = f"case when {v} - floor({v}) < 0.34e0 then '弱' when {v} - floor({v}) < 0.67e0 then '普通' else '强' end"
    return f"""case when {fl} between 1 and 25 then {t} || (26 - {fl}) || '级'
      when {fl} between 26 and 33 then {t} || ({fl} - 25) || '段' end"""


def entries(model, where):
    """CTEs: lv (per group of an event), rows (entries with features)."""
    open_l = {"graph": "30.15", "quick": "30.2"}[model]
    f, off = {"graph": ("1.5e0", "0.35e0"), "quick": ("2e0", "0.5e0")}[model]
    gain, loss = {"graph": ("0.75e0", "0.6e0"), "quick": ("1e0", "0.75e0")}[model]
    base = "group_l + case when is_age_group then 0e0 else " + off + " end + wr_adj"
    if model == "graph":
        base = f"case when is_open then greatest({base}, 29.2e0) else {base} end"
    return {
        "ev": f"""select event_id, title, min_time, provincename, city_name, cname, {TIME_W[model]} as time_weight,
          {event_w(model)} as event_weight, {tier(model)} as tier from fx_events where {where}""",
        "names": f"select distinct group_name, {trim('group_name')} as n from fx_participants",
        "lv": f"""select group_name, n, {group_l(open_l)} as skill_l,
          case when {gate(model)} then {age_adj(model)} end as adj from names""",
        "e1": f"""select e.*, p.* exclude (event_id), p.win + p.lose + p.draw as rounds, coalesce(l.skill_l, e.tier + l.adj) as group_l,
          l.skill_l is null and l.adj is not null as is_age_group,
          l.skill_l is not null and p.group_name like '%公开%' as is_open,
          case when p.win + p.lose + p.draw = 0 then 0e0 else
            {f} * ((p.win + 5e-1 * p.draw) / (p.win + p.lose + p.draw) - 5e-1) end as adj0
          from fx_participants p join ev e on e.event_id = p.event_id join lv l on l.group_name = p.group_name""",
        "e2": f"""select *, case when is_open and adj0 > 0 then adj0 * {gain} when is_open and adj0 < 0 then adj0 * {loss}
          else adj0 end as wr_adj from e1""",
        "rws": f"select *, case when rounds > 0 then {base} end as base from e2",
    }


_GROUPS = f"""select g.group_id, g.group_name, {trim('g.group_name')} as n, e.title, e.cname from fx_groups g
  join fx_events e on e.event_id = g.event_id"""
O["group_level_l"] = with_tables(f"select group_id, group_name, {group_l('30.15')} as l, {group_l('30.2')} as quick_l from gs",
                                 {"gs": _GROUPS})
O["age_group_l"] = with_tables(f"""select group_id,
  {half_up(f"case when {gate('graph')} then {tier('graph')} + {age_adj('graph')} end")} as l,
  {half_up(f"case when {gate('quick')} then {tier('quick')} + {age_adj('quick')} end")} as quick_l from gs""", {"gs": _GROUPS})
O["time_weight"] = with_tables(f"select event_id, {TIME_W['graph']} as weight, {TIME_W['quick']} as quick_weight from fx_events")
O["event_level_weight"] = with_tables(f"select event_id, {event_w('graph')} as weight, {event_w('quick')} as quick_weight from fx_events")
_ALL = entries("graph", "true")
O["entry_base"] = with_tables(f"""select event_id, group_id, participant_id, {half_up('group_l')} as group_l,
  {half_up('wr_adj')} as wr_adj, {half_up('base')} as base, is_age_group, is_open, rounds from rws""", _ALL)
O["level_label"] = with_tables(f"""select event_id, group_id, participant_id, case when base is not null then {level_of('base')} end as label,
  case when base is not null then {level_of('(base - 26)')} end as low_label from rws""", _ALL)

# ---- graph model ------------------------------------------------------------


def window(day_from, day_to):
    c = entries("graph", f"min_time >= '{day_from}' and min_time <= '{day_to} 23:59:59'")
    c["stat"] = """select participant_name, count(*) as n, count(base) as k, count(*) filter (base >= 29.7e0) as hi,
      count(*) filter (base <= 27.8e0) as lo, count(distinct nullif(provincename, '')) as pv from rws group by 1"""
    c["hi_pv"] = "select distinct participant_name, provincename from rws where base >= 29.7e0 and provincename <> ''"
    c["split"] = """select r.*, coalesce(s.n > 1 and s.k > 1 and s.hi >= 2 and s.lo > 0 and s.pv >= 2
        and r.base <= 27.8e0 and h.participant_name is null, false) as removed
      from rws r join stat s on s.participant_name = r.participant_name
      left join hi_pv h on h.participant_name = r.participant_name and h.provincename = r.provincename"""
    c["targets"] = "select * from split where not removed"
    return c


WIN = window(FROM_DAY, AS_OF)
O["namesake_split"] = with_tables(f"""select event_id, group_id, participant_id, participant_name, provincename,
  {half_up('base')} as base, removed from split""", WIN)
O["removed_rows"] = with_tables("select event_id, group_id, participant_id, participant_name from split where removed", WIN)
O["recent_n_per_player"] = with_tables(f"""select event_id, group_id, participant_id, participant_name, min_time,
  cast(recency as int) as recency from (select *, row_number() over (partition by participant_name
    order by min_time desc, event_id, group_id, participant_id) as recency from rws) where recency <= {RECENT_N}""", WIN)

NODES = {**WIN, "nodes": """select group_id, participant_id, participant_name, base, is_age_group,
    case when is_age_group then 3.5e0 else 5e0 end as prior, case when is_age_group then 31.05e0 else 33.5e0 end as cap,
    time_weight * event_weight as ew from rws where base is not null and time_weight > 0"""}
_PTS = "case {} when '1' then 1e0 when '2' then 0e0 else 5e-1 end"
EDGES = {**NODES, "edges": f"""select m.group_id, m.bout, m.p1_id, m.p2_id, {_PTS.format('m.p1_result')} as p1_points,
    {_PTS.format('m.p2_result')} as p2_points, least(a.ew, b.ew) as weight
  from fx_matches m join nodes a on a.group_id = m.group_id and a.participant_id = m.p1_id
  join nodes b on b.group_id = m.group_id and b.participant_id = m.p2_id where least(a.ew, b.ew) > 0"""}
O["rating_edges"] = with_tables("select * from edges", EDGES)
_OWN = """select t.event_id, t.group_id, t.participant_id, t.participant_name, count(m.me_id) as own_games,
    count(distinct nullif(n.participant_name, '')) as opponents
  from targets t left join sides m on m.group_id = t.group_id and m.me_id = t.participant_id
  left join nodes n on n.group_id = m.group_id and n.participant_id = m.opp_id
  group by t.event_id, t.group_id, t.participant_id, t.participant_name"""
O["own_matches"] = with_tables(_OWN, {**NODES, "sides": SIDES})
O["group_max_rounds"] = with_tables("""select group_id, max(win + lose + draw) as rounds from fx_participants
  group by group_id having max(win + lose + draw) > 0""")

_RATE = {**EDGES, "half": """select group_id, p1_id as me, p2_id as opp, p1_points as pts, weight from edges
    union all select group_id, p2_id, p1_id, p2_points, weight from edges""",
         "r0": "select group_id, participant_id, base as rating from nodes"}
for _i in range(1, 9):
    _RATE[f"r{_i}"] = f"""select n.group_id, n.participant_id, greatest(1e0, least(n.cap,
        (n.base * n.prior + coalesce(g.s, 0e0)) / (n.prior + coalesce(g.w, 0e0)))) as rating
      from nodes n left join (select h.group_id, h.me, sum(h.weight) as w,
          sum(h.weight * (q.rating + 1.15e0 * (h.pts - 5e-1) * 2)) as s
        from half h join r{_i - 1} q on q.group_id = h.group_id and q.participant_id = h.opp group by 1, 2) g
      on g.group_id = n.group_id and g.me = n.participant_id"""
_RATED = f"""select n.group_id, n.participant_id, n.participant_name, {half_up('n.base')} as base,
  n.is_age_group, {half_up('r.rating')} as rating from nodes n join r8 r on r.group_id = n.group_id
  and r.participant_id = n.participant_id"""
O["rating_iterate"] = with_tables(_RATED, _RATE)
# the same over what the deliveries leave: a fifth of all owners has no rows any more, some entries have one win more
_KEY_OF = "(cast({0} as bigint) - cast({0} as bigint) % 32)"
LEFT = {
    "left_events": f"select * from fx_events where {_KEY_OF.format('event_id')} % 160 <> 0",
    "left_participants": f"""select * replace (cast(win + case when {_KEY_OF.format('event_id')} % 96 = 0 then 1 else 0 end as int) as win)
      from fx_participants where {_KEY_OF.format('event_id')} % 160 <> 0""",
    "left_matches": f"select * from fx_matches where {_KEY_OF.format('group_id')} % 160 <> 0"}


def on_left(text: str) -> str:
    for t in ("events", "participants", "matches", "groups"):
        text = re.sub(rf"\bfx_{t}\b", f"left_{t}", text)
    return text


O["stream_ratings"] = with_tables(_RATED, {**LEFT, **{k: on_left(v) for k, v in _RATE.items()}})
O["coverage_counters"] = with_tables("""select provincename as province, substr(min_time, 1, 10) as day, count(*) as events,
    cast(sum(coalesce(p.n, 0)) as bigint) as entries
  from left_events e left join (select event_id, count(*) as n from left_participants group by event_id) p on p.event_id = e.event_id
  where play_num > 0 group by all""", LEFT)

ENTRIES = {**_RATE, "sides": SIDES, "own": _OWN, "u1": """select t.*, o.own_games,
    greatest(1, t.rounds) * t.time_weight * t.event_weight * case when o.own_games > 0 then 1.15e0 else 0.75e0 end as weight,
    case when t.is_age_group then least(coalesce(r.rating, t.base), 31.05e0) else coalesce(r.rating, t.base) end as first_rating,
    case when t.rounds > 0 then (t.win + 5e-1 * t.draw) / t.rounds else 0e0 end as rs
  from targets t join own o on o.group_id = t.group_id and o.participant_id = t.participant_id
  left join r8 r on r.group_id = t.group_id and r.participant_id = t.participant_id
  where t.base is not null and t.time_weight > 0""",
           "anchors": """select participant_name, sum(first_rating * weight) / sum(weight) as anchor from u1
             where not is_age_group group by 1""",
           "used": """select u.*, a.anchor, case when a.anchor is not null and u.is_age_group and u.rs >= 5e-1
               then greatest(u.first_rating, least(31.05e0, a.anchor - 0.05e0)) else u.first_rating end as rating
             from u1 u left join anchors a on a.participant_name = u.participant_name"""}
O["skill_anchor_floor"] = with_tables(f"""select event_id, group_id, participant_id, participant_name, is_age_group,
  {half_up('first_rating')} as first_rating, {half_up('anchor')} as anchor, {half_up('rating')} as rating from used""", ENTRIES)
O["top_basis_events"] = with_tables(f"""select event_id, group_id, participant_id, participant_name, cast(place as int) as place,
  {half_up('base')} as base, {half_up('rating')} as rating, {half_up('rating - base')} as correction,
  {half_up('weight')} as weight, own_games from (select *, row_number() over (partition by participant_name
    order by substr(min_time, 1, 10) desc, weight desc, event_id, group_id, participant_id) as place from used)
  where place <= 5""", ENTRIES)

TOTAL = {**ENTRIES, "tot": """select participant_name, count(*) as events, sum(rounds) as rounds, sum(own_games) as match_games,
    sum(rating * weight) / sum(weight) as l_mean, count(*) filter (not is_age_group) as skill_events,
    count(*) filter (is_age_group and rs >= 0.75e0 and rounds >= 7) as strong_events,
    count(*) filter (not is_age_group and rs < 5e-1) as weak_skill_events,
    count(*) filter (not is_age_group and regexp_matches(group_name, '5""" + WS + """*段') and rs >= 5e-1 and rounds >= 5) as five_dan_proofs,
    sum(rs * rounds) filter (is_age_group and rs >= 0.75e0 and rounds >= 7)
      / sum(rounds) filter (is_age_group and rs >= 0.75e0 and rounds >= 7) as strong,
    count(*) filter (is_open or rating >= 30.1e0 or regexp_matches(org, '5""" + WS + """*段')) as evidence
  from used group by 1""",
         "elite": """select *, case when rounds >= 20 and strong_events >= 2 and weak_skill_events = 0 and five_dan_proofs > 0
      then greatest(l_mean, least(31.18e0, l_mean + 0.28e0 + greatest(0e0, least(0.18e0, strong - 0.75e0))))
      when rounds >= 20 and strong_events >= 3 and skill_events = 0
      then greatest(l_mean, least(31.12e0, l_mean + 0.43e0 + greatest(0e0, least(0.18e0, strong - 0.75e0))))
      else l_mean end as l_elite from tot"""}
O["elite_youth_bonus"] = with_tables(f"""select participant_name, {half_up('l_mean')} as l_mean, {half_up('l_elite')} as l_elite,
  strong_events, skill_events, weak_skill_events, five_dan_proofs from elite""", TOTAL)
_OPP = """select u.participant_name, count(distinct nullif(n.participant_name, '')) as opponents
  from used u join sides m on m.group_id = u.group_id and m.me_id = u.participant_id
  left join nodes n on n.group_id = m.group_id and n.participant_id = m.opp_id group by 1"""
O["player_strength"] = with_tables(f"""select f.participant_name as name, {half_up('l')} as l, {level_of('l')} as label,
  confidence, {half_up('greatest(5e-1, least(33.99e0, l - unc))')} as low, {half_up('greatest(5e-1, least(33.99e0, l + unc))')} as high,
  {level_of('(l - unc)')} as low_label, {level_of('(l + unc)')} as high_label, events, cast(rounds as bigint) as rounds,
  cast(match_games as bigint) as match_games, coalesce(o.opponents, 0) as opponents,
  coalesce(g.gp, 0) as graph_players, coalesce(g.gg, 0) as graph_games
  from (select *, case confidence when '高' then 0.45e0 when '中' then 0.75e0 else 1.15e0 end as unc from (
    select *, case when l_elite >= 29.85e0 and l_elite < 30 and evidence > 0 and rounds >= 12 then 30.02e0 else l_elite end as l,
      case when match_games >= 14 and events >= 2 then '高' when match_games >= 5 or rounds >= 8 then '中' else '低' end as confidence
    from elite)) f left join opp o on o.participant_name = f.participant_name
  left join (select t.participant_name, cast(sum(s.np) as bigint) as gp, cast(sum(coalesce(s.ng, 0)) as bigint) as gg
    from (select distinct participant_name, group_id from targets) t
    join (select n.group_id, n.np, e.ng from (select group_id, count(*) as np from nodes group by 1) n
      left join (select group_id, count(*) as ng from edges group by 1) e on e.group_id = n.group_id) s
    on s.group_id = t.group_id group by 1) g on g.participant_name = f.participant_name""", {**TOTAL, "opp": _OPP})
O["strength_sets"] = with_tables("""select u.participant_name as name,
  coalesce((select string_agg(v, '|' order by v) from (select distinct org as v from targets t
     where t.participant_name = u.participant_name and base is not null and org <> '')), '') as orgs,
  coalesce((select string_agg(v, '|' order by v) from (select distinct provincename as v from targets t
     where t.participant_name = u.participant_name and base is not null and provincename <> '')), '') as provinces,
  (select count(distinct group_name) from targets t where t.participant_name = u.participant_name and base is not null) as groups,
  coalesce(o.opponents, 0) as opponents,
  concat_ws('|', case when u.mg = 0 then '未取得对局明细，主要依据组别与胜负估算' end,
    case when (select count(distinct org) from targets t where t.participant_name = u.participant_name and base is not null
      and org <> '') >= 4 then '同名棋手可能来自多个机构，建议结合省份或机构判断' end,
    case when k.kept > k.used then '同名记录较多，已优先采用最近 ' || k.used || ' 场比赛估算' end,
    case when k.dropped > 0 then '已排除 ' || k.dropped || ' 场疑似同名但级别/地区不一致的记录' end) as warnings
  from (select participant_name, sum(own_games) as mg from used group by 1) u
  left join opp o on o.participant_name = u.participant_name
  join (select s.participant_name, count(*) filter (not removed) as kept, count(*) filter (removed) as dropped,
      (select count(*) from targets t where t.participant_name = s.participant_name) as used
    from split s group by s.participant_name) k on k.participant_name = u.participant_name""", {**ENTRIES, "opp": _OPP})
O["unavailable_reason"] = with_tables("""select n.participant_name as name,
  case when t.k is null then '近180天内没有找到该棋手的索引记录' else '近180天内缺少可用棋力样本' end as reason,
  coalesce(t.groups, '') as groups
  from (select distinct participant_name from fx_participants) n
  left join (select participant_name, count(*) as k, count(*) filter (base is not null and time_weight > 0) as ok,
      string_agg(distinct group_name, '|' order by group_name) filter (base is not null and group_name <> '') as groups
    from targets group by 1) t on t.participant_name = n.participant_name
  where coalesce(t.ok, 0) = 0""", {k: v.replace(AS_OF, "1995-01-31") for k, v in
                                   window("1994-08-04", "1995-01-31").items()})

# ---- quick model ------------------------------------------------------------

Q = {**entries("quick", "min_time >= '1998-06-30' and min_time <= '2000-06-30'"), "sides": SIDES,
     "ok": "select * from rws where base is not null and time_weight > 0",
     "sched": f"""select * from (select r.event_id, r.group_id, r.participant_id, r.participant_name, s.bout, s.opp_name as opponent,
         {OUTCOME} as result, row_number() over (partition by s.group_id, s.me_id, s.bout order by s.p1_id, s.p2_id) as rn
       from rws r join sides s on s.group_id = r.group_id and s.me_id = r.participant_id and s.bout <= r.rounds
       where r.time_weight > 0) where rn = 1""",
     "rec": """select participant_name, opponent, count(*) as games, count(*) filter (result = 'win') as win,
         count(*) filter (result = 'lose') as lose, count(*) filter (result = 'draw') as draw
       from sched where opponent <> '' group by 1, 2""",
     "h2h": """select s.event_id, s.group_id, s.participant_id, greatest(-0.8e0, least(0.8e0, 1.6e0 * (
           sum(((r.win + 5e-1 * r.draw) / r.games - 5e-1) * (least(1e0, r.games / 4) * r.games))
             / sum(least(1e0, r.games / 4) * r.games)))) as h2h_adj,
         cast(sum(r.games) as bigint) as h2h_games, count(distinct s.opponent) as h2h_opponents
       from sched s join rec r on r.participant_name = s.participant_name and r.opponent = s.opponent and r.games >= 2
       group by 1, 2, 3"""}


def _estimate(src, name):
    """CTEs for floor, value and confidence over entries src(t_raw, w, eff, ...)."""
    return {
        name + "_t": f"""select e.*, case when e.is_open then greatest(30e0, t1) else t1 end as t from (
            select e.*, case when e.is_age_group and e.wr_adj >= 0
              then greatest(e.t_raw, e.group_l, coalesce(a.m, e.group_l)) else e.t_raw end as t1
            from {src} e left join (select participant_name, sum(t_raw * w) / sum(w) as m from {src}
              where not is_age_group group by 1) a on a.participant_name = e.participant_name) e""",
        name: f"""select participant_name as name, sum(t * w) / sum(w) as l, count(*) as events,
            cast(coalesce(sum(eff) filter (time_weight = 1), 0) as bigint) as recent_rounds,
            count(*) filter (time_weight = 1) as recent_events, bool_and(is_age_group) as all_age
          from {name}_t group by 1"""}


_CONF = """case when not all_age and recent_rounds >= 15 and recent_events >= 2 then '高'
  when recent_rounds >= 8 or events >= 1 then '中' else '低' end"""
Q["p1"] = """select *, base as t_raw, rounds as eff, rounds * time_weight * event_weight
  * case when is_age_group then 0.6e0 else 0.75e0 end as w from ok"""
Q.update(_estimate("p1", "est1"))
Q["oppadj"] = f"""select o.event_id, o.group_id, o.participant_id, o.participant_name, o.group_l,
    count(*) as known_opponents, avg(k.l) as opponent_l,
    greatest(-1.5e0, least(1.5e0, 0.4e0 * (avg(k.l) - o.group_l))) as opp_adj
  from ok o join sched s on s.event_id = o.event_id and s.group_id = o.group_id and s.participant_id = o.participant_id
  join (select * from est1 where {_CONF} in ('高', '中')) k on k.name = s.opponent group by 1, 2, 3, 4, 5"""
Q["p2"] = """select *, base + opp_adj + h2h_adj as t_raw, eff * time_weight * event_weight * case
    when is_age_group then case when h2h_games >= 4 then 0.72e0 else 0.6e0 end when h2h_games >= 4 then 1.08e0
    when known_opponents >= 2 then 1e0 when has_games then 0.85e0 else 0.75e0 end as w
  from (select o.*, coalesce(a.opp_adj, 0e0) as opp_adj, coalesce(a.known_opponents, 0) as known_opponents,
      coalesce(h.h2h_adj, 0e0) as h2h_adj, coalesce(h.h2h_games, 0) as h2h_games,
      coalesce(n.k, o.rounds) as eff, o.group_id in (select group_id from fx_matches) as has_games
    from ok o left join oppadj a on a.event_id = o.event_id and a.group_id = o.group_id and a.participant_id = o.participant_id
    left join h2h h on h.event_id = o.event_id and h.group_id = o.group_id and h.participant_id = o.participant_id
    left join (select event_id, group_id, participant_id, count(*) as k from sched group by 1, 2, 3) n
      on n.event_id = o.event_id and n.group_id = o.group_id and n.participant_id = o.participant_id)"""
Q.update(_estimate("p2", "est2"))

O["opponent_record"] = with_tables("select * from rec", Q)
O["h2h_adjustment"] = with_tables(f"""select event_id, group_id, participant_id, {half_up('h2h_adj')} as h2h_adj, h2h_games,
  h2h_opponents from h2h""", Q)
O["opponent_strength_adj"] = with_tables(f"""select event_id, group_id, participant_id, participant_name,
  {half_up('group_l')} as group_l, known_opponents, {half_up('opponent_l')} as opponent_l, {half_up('opp_adj')} as opp_adj
  from oppadj""", Q)
O["basic_strength"] = with_tables(f"""select name, {half_up('l')} as l, {level_of('l')} as label, {_CONF} as confidence, events,
  recent_rounds, recent_events, all_age from est2""", Q)
O["quick_basis_events"] = with_tables(f"""select event_id, group_id, participant_id, participant_name, cast(place as int) as place,
  {half_up('t')} as t, {half_up('opp_adj')} as opp_adj, {half_up('h2h_adj')} as h2h_adj, {half_up('w')} as weight
  from (select *, row_number() over (partition by participant_name order by time_weight desc, min_time desc, event_id,
    group_id, participant_id) as place from est2_t) where place <= 4""", Q)
O["strength_notes"] = with_tables("""select h.participant_name as name, h.hits, h.has_recent, coalesce(e.used, 0) as used,
  coalesce(e.age, 0) as age_entries, coalesce(e.known, 0) as known_opponent_entries, coalesce(e.rep, 0) as repeat_entries,
  coalesce(e.reps, 0) as repeat_games, h.hits - coalesce(e.used, 0) as skipped
  from (select participant_name, count(*) as hits, bool_or(time_weight > 0) as has_recent from rws group by 1) h
  left join (select participant_name, count(*) as used, count(*) filter (is_age_group) as age,
      count(*) filter (known_opponents >= 2) as known, count(*) filter (h2h_games >= 4) as rep,
      cast(sum(h2h_games) as bigint) as reps from p2 group by 1) e on e.participant_name = h.participant_name""", Q)

O["one_player_strength"] = f"""select * from ({O['player_strength']}) s
  where name = (select min(s_name) from supplier where s_suppkey in (select l_suppkey from lineitem))"""

ORACLES = O
