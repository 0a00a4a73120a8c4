"""Small SQL text helpers for the oracle statements."""

WS = (r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}"
      r"\x{205F}\x{3000}\x{FEFF}]")


def strip(x):
    return f"regexp_replace(coalesce({x}, ''), '{WS}+', '', 'g')"


def trim(x):
    return f"regexp_replace(coalesce({x}, ''), '^{WS}+|{WS}+$', '', 'g')"


def rx(x, pattern, i=1):
    return f"regexp_extract({x}, '{pattern}', {i})"


def num(x, pattern, i=1):
    return f"try_cast(nullif(regexp_extract({x}, '{pattern}', {i}), '') as double)"


def has(x, pattern):
    return f"regexp_matches({x}, '{pattern}')"


def pint(x):
    return f"try_cast(nullif(regexp_extract(coalesce({x}, ''), '^{WS}*([+-]?[0-9]+)', 1), '') as bigint)"


def pfloat(x):
    return (f"try_cast(nullif(regexp_extract(coalesce({x}, ''), "
            f"'^{WS}*([+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?)', 1), '') as double)")


def half_up(x, digits=6):
    return f"floor(cast({x} as double) * 1e{digits} + 5e-1) / 1e{digits}"


def first_text(*xs):
    return "coalesce(" + ", ".join(f"nullif({x}, '')" for x in xs) + ", '')"


def strip_html(x):
    t = f"regexp_replace({x}, '(?is)<script.*?</script>', ' ', 'g')"
    t = f"regexp_replace({t}, '(?is)<style.*?</style>', ' ', 'g')"
    t = f"regexp_replace({t}, '<[^>]+>', ' ', 'g')"
    t = f"regexp_replace({t}, '{WS}+', ' ', 'g')"
    for a, b in (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = f"replace({t}, '{a}', '{b}')"
    return trim(f"regexp_replace({t}, '{WS}+', ' ', 'g')")


def uri(x):
    return (f"case when contains(regexp_replace({x}, '%[0-9A-Fa-f]{{2}}', '', 'g'), '%') then {x} "
            f"else url_decode({x}) end")


def china_ms(x):
    x = trim(x)
    p = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})([ T]([0-9]{2}):([0-9]{2})(:([0-9]{2}))?)?"

    def part(i):
        return f"coalesce(try_cast(nullif(regexp_extract({x}, '{p}', {i}), '') as bigint), 0)"
    return (f"case when regexp_matches({x}, '{p}') then "
            f"cast(epoch_ms(make_timestamp({part(1)}, {part(2)}, {part(3)}, {part(5)}, {part(6)}, "
            f"cast({part(8)} as double))) - 28800000 as bigint) end")


EVENT = "e.event_id, e.title, e.min_time, e.provincename, e.city_name, e.cname"
ENTRY = ("p.group_id, p.group_name, p.participant_id, p.participant_name, p.org, p.win, p.lose, p.draw, "
         "p.score, p.rank")
SIDES = """select group_id, bout, p1_id, p2_id, p1_id as me_id, p2_id as opp_id, p1_name as me_name,
  p2_name as opp_name, p1_org as me_org, p2_org as opp_org, p1_result as me_result, p2_result as opp_result,
  p1_score as me_score, p2_score as opp_score from fx_matches
  union all
  select group_id, bout, p1_id, p2_id, p2_id, p1_id, p2_name, p1_name, p2_org, p1_org, p2_result, p1_result,
  p2_score, p1_score from fx_matches"""
OUTCOME = "case me_result when '1' then 'win' when '2' then 'lose' else 'draw' end"
PLAYED = ("(p1_result in ('1', '2', '3') or p2_result in ('1', '2', '3') or p1_score > 0 or p2_score > 0)")
