"""Tournament tables derived from the star-schema test tables (see FIXTURES.md).

The derivation is plain SQL that both Spark and DuckDB run; a small dialect
object covers the few spellings that differ. Spark materialises each table
once per session in the shared folder, so that queries read stored Parquet
tables as they would in production.

Tables with rows for every seat or game are bucketed by group, and their number
of buckets follows the size of the input. The lines are shuffled once, when they
become seats; games, participants and payloads are worked out, and later joined
and counted, where the seats of their group lie.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import work_dir
from .layout import write_bucketed

AS_OF = "2000-06-30"
AS_OF_MS = 962_323_200_000
RECENT_N = 20
SCENARIOS = 20
LAID_OUT = ("fx_seat", "fx_groups", "fx_matches", "fx_participants", "fx_payload_participants", "fx_payload_matches", "fx_scenarios")
BUCKET_BYTES = 2 << 20  # of stored lines; about 150,000 seats and 650,000 games
FEWEST_BUCKETS = 4
BROADCAST_BYTES = 16 << 20


@dataclass(frozen=True)
class Dialect:
    name: str

    def days(self, d: str) -> str:
        """Days from the epoch to a date."""
        return f"datediff({d}, date '1970-01-01')" if self.name == "spark" \
            else f"cast({d} - date '1970-01-01' as integer)"

    def numbers(self, low: int, high: int) -> str:
        """Column expression that repeats its row for each number."""
        return f"explode(sequence({low}, {high}))" if self.name == "spark" \
            else f"cast(unnest(range({low}, {high + 1})) as int)"

    def join_rows(self, expr: str) -> str:
        return f"array_join(array_sort(collect_list({expr})), ',')" if self.name == "spark" \
            else f"string_agg({expr}, ',' order by {expr})"


def views(d: Dialect) -> dict[str, str]:
    """Name to SQL; {name} marks another table."""
    v: dict[str, str] = {}
    v["fx_line"] = """
        select o.o_orderkey, o.o_orderkey - o.o_orderkey % 32 as event_key,
               cast(o.o_orderkey % 4 as int) as g, l.l_linenumber, l.l_partkey, l.l_suppkey,
               l.l_quantity, l.l_extendedprice, l.l_shipdate
        from {orders} o join {lineitem} l on l.l_orderkey = o.o_orderkey"""
    v["fx_seat"] = """
        select x.event_key, x.g, cast(x.event_key + x.g as string) as group_id, x.seat, x.n,
               cast(x.event_key + x.g as string) || '-' || cast(x.seat as string) as participant_id,
               s.s_name as name, na.n_name as org, x.l_suppkey, x.l_quantity
        from (select event_key, g, l_suppkey, l_quantity,
                     cast(row_number() over (partition by event_key, g order by o_orderkey,
                       l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)
                       - 1 as int) as seat,
                     cast(count(*) over (partition by event_key, g) as int) as n
              from {fx_line}) x
        join {supplier} s on s.s_suppkey = x.l_suppkey
        join {nation} na on na.n_nationkey = s.s_nationkey"""
    v["fx_events"] = f"""
        select e.event_key, cast(e.event_key as string) as event_id,
               case e.event_key % 192 when 0 then '四川省围棋段级位赛' when 32 then '河北省围棋段位赛'
                 when 64 then '全国少儿围棋锦标赛' when 96 then '市围棋公开赛'
                 when 128 then '区校内围棋赛' else '网络公益围棋邀请赛' end as title,
               cast(e.d as string) || case when e.event_key % 64 = 0 then ' 09:00:00' else '' end
                 as min_time,
               cast(e.d + 2 as string) || ' 18:00:00' as max_time,
               case na.n_nationkey % 5 when 0 then '四川省' when 1 then '河北省' when 2 then '浙江省'
                 when 3 then '北京市' else '广东省' end as provincename,
               na.n_name as city_name, na.n_name || '围棋协会' as cname,
               cast(p.play_num as int) as play_num,
               cast(case when e.event_key % 64 = 0 then 500 else 2000 end as bigint) as updated_at,
               cast({d.days('e.d')} as bigint) * 86400000
                 + cast(case e.event_key % 160 when 0 then -24 when 32 then 12 when 64 then 68
                        when 96 then 90 else 200 end as bigint) * 3600000 - 28800000 as now_ms
        from (select o_orderkey - o_orderkey % 32 as event_key,
                     cast(min_by(o_orderdate, o_orderkey) as date) as d,
                     min_by(o_custkey, o_orderkey) as custkey
              from {{orders}} group by o_orderkey - o_orderkey % 32) e
        join (select event_key, count(*) as play_num from {{fx_line}} group by event_key) p
          on p.event_key = e.event_key
        join {{customer}} c on c.c_custkey = e.custkey
        join {{nation}} na on na.n_nationkey = c.c_nationkey"""
    v["fx_groups"] = """
        select cast(event_key + g as string) as group_id, cast(event_key as string) as event_id,
               case event_key % 192 + g
                 when 0 then '5级组' when 1 then '2级组' when 2 then '1级组' when 3 then '1段组'
                 when 32 then '1段组' when 33 then '2段组' when 34 then '3段组' when 35 then '4段组'
                 when 64 then 'U8组' when 65 then 'U10组' when 66 then '甲组' when 67 then '公开组'
                 when 96 then '1-2级组' when 97 then '定段组' when 98 then '低段组'
                 when 99 then '启蒙组'
                 when 128 then '一年级组' when 129 then '初中组' when 130 then '3段-4段组'
                 when 131 then '定2段组'
                 when 160 then '5段组' when 161 then '高段组' when 162 then '2级升1段组'
                 else '少儿A组' end as group_name,
               '0' as team_type,
               cast(case when event_key % 352 = 0 then 0 else n end as int) as pnumber,
               cast(1000 as bigint) as updated_at, event_key, g
        from (select event_key, g, count(*) as n from {fx_line}
              where event_key % 416 <> 0 group by event_key, g) t"""
    v["fx_matches"] = f"""
        select a.group_id, a.bout, a.participant_id as p1_id, b.participant_id as p2_id,
               a.name as p1_name, b.name as p2_name, a.org as p1_org, b.org as p2_org,
               case when a.event_key % 160 = 0 and a.bout >= 6 then '' when a.l_quantity > b.l_quantity
                 then '1' when a.l_quantity < b.l_quantity then '2' else '3' end as p1_result,
               case when a.event_key % 160 = 0 and a.bout >= 6 then '' when a.l_quantity > b.l_quantity
                 then '2' when a.l_quantity < b.l_quantity then '1' else '3' end as p2_result,
               cast(case when a.event_key % 160 = 0 and a.bout >= 6 then 0 when a.l_quantity > b.l_quantity
                 then 2 when a.l_quantity < b.l_quantity then 0 else 1 end as double) as p1_score,
               cast(case when a.event_key % 160 = 0 and a.bout >= 6 then 0 when a.l_quantity > b.l_quantity
                 then 0 when a.l_quantity < b.l_quantity then 2 else 1 end as double) as p2_score,
               cast(1000 as bigint) as updated_at, a.event_key, a.g, a.seat as seat_a, b.seat as seat_b
        from (select s.*, {d.numbers(1, 9)} as bout from {{fx_seat}} s) a
        join {{fx_seat}} b on b.group_id = a.group_id
         and b.seat = (a.bout - 1 - a.seat + 2 * a.n) % a.n
        where a.seat < b.seat and a.bout <= a.n"""
    v["fx_match_status"] = """
        select group_id, cast(case when g = 3 then 5 else 9 end as int) as rounds,
               cast(1000 as bigint) as updated_at,
               case when event_key % 288 = 32 then 'HTTP 500' else '' end as last_error
        from (select distinct group_id, event_key, g from {fx_seat} where event_key % 96 <> 0) t"""
    v["fx_participants"] = """
        select cast(s.event_key as string) as event_id, s.group_id,
               coalesce(eg.group_name, '') as group_name, s.participant_id,
               s.name as participant_name, s.org, cast(s.seat + 1 as string) as short_no,
               s.win, s.lose, s.draw, cast(2 * s.win + s.draw as string) as score,
               cast(case when s.event_key % 224 = 0 then 0 else
                 rank() over (partition by s.group_id order by 2 * s.win + s.draw desc) end as int) as rank,
               cast(1000 as bigint) as updated_at
        from (select t.event_key, t.group_id, t.participant_id, t.name, t.org, t.seat,
                     cast(coalesce(r.win, 0) as int) as win, cast(coalesce(r.lose, 0) as int) as lose,
                     cast(coalesce(r.draw, 0) as int) as draw
              from {fx_seat} t
              left join (select group_id, pid, sum(case when res = '1' then 1 else 0 end) as win,
                                sum(case when res = '2' then 1 else 0 end) as lose,
                                sum(case when res = '3' then 1 else 0 end) as draw
                         from (select group_id, p1_id as pid, p1_result as res from {fx_matches}
                               union all
                               select group_id, p2_id as pid, p2_result as res from {fx_matches}) u
                         group by group_id, pid) r
                on r.group_id = t.group_id and r.pid = t.participant_id) s
        left join {fx_groups} eg on eg.group_id = s.group_id"""
    v["fx_index_status"] = """
        select cast(event_key as string) as event_id, cast(1000 as bigint) as indexed_at,
               cast(4 as int) as group_count, cast(n as int) as participant_count,
               case event_key % 256 when 0 then 'SQLITE_BUSY: database is locked'
                 when 32 then 'HTTP 429' when 64 then 'network TIMEOUT'
                 when 96 then 'no groups found' else '' end as last_error
        from (select event_key, count(*) as n from {fx_line} where event_key % 288 <> 0
              group by event_key) t"""
    v["fx_notices"] = f"""
        select event_id,
               case event_key % 192
                 when 0 then '5级组前50%晋升2级，全胜晋升1级。2级组前50%升1级；1级组胜5盘升1段'
                 when 32 then '升段办法：1段组前30%晋升2段；2段组前3名升为3段；3段组第1名升5段。4段组冠军晋升1个段位'
                 when 96 then '定段组7胜升1段'
                 when 128 then '各组奖励前6名'
                 when 160 then '%E5%8D%87%E6%AE%B5：5段组全胜晋升6段' else '' end as notice_text,
               cast({AS_OF_MS} - case when event_key % 64 = 0 then 20 else 3 end * cast(86400000 as bigint)
                    as bigint) as updated_at,
               case when event_key % 448 = 0 then 'HTTP 500' else '' end as last_error
        from {{fx_events}} where event_key % 960 <> 0"""
    v["fx_confirmed_rules"] = """
        select event_id, '5级组' as group_name, '本次赛事5级组全胜升1级' as text,
               '1级' as full_win_target
        from {fx_events} where event_key % 960 = 0"""
    v["fx_confirmed_events"] = "select event_id from {fx_events} where event_key % 128 = 96"
    v["fx_evidence"] = """
        select s.name, 'external-' || e.event_id as event_id,
               e.title || '（3段-4段组）' as title, substring(e.min_time, 1, 10) as date,
               e.provincename as province, e.city_name as city, e.cname as organizer,
               '3段-4段组' as group_name, '5段' as promoted_to,
               'association-promotion-list' as source
        from {fx_seat} s join {fx_events} e on e.event_key = s.event_key
        where s.g = 3 and s.seat = 0 and e.event_key % 256 = 0"""
    v["fx_live_groups"] = """
        select eg.group_id, eg.event_id, eg.group_name, eg.pnumber,
               case when eg.g = 3 then '' else substring(e.min_time, 1, 10) || ' 08:30:00' end as bt,
               case when eg.g >= 2 then '' else e.max_time end as et,
               case when eg.event_key % 64 = 0 then '0' else '1' end as groupstate,
               e.now_ms
        from {fx_groups} eg join {fx_events} e on e.event_id = eg.event_id"""
    v["fx_scenarios"] = f"""
        select scenario_id, group_id, bout, p1_id, p2_id,
               (scenario_id * 31 + seat_a * 7 + seat_b * 3 + bout) % 2 = 0 as p1_wins
        from (select m.*, {d.numbers(0, SCENARIOS - 1)} as scenario_id
              from {{fx_matches}} m where m.p1_result = '') t"""
    v["fx_pair_requests"] = """
        select a.s_name as player_a, b.s_name as player_b
        from {supplier} a join {supplier} b on b.s_suppkey = a.s_suppkey + 1"""
    v["fx_payload_events"] = f"""
        select page, case when page % 5 = 4 then 'HTTP 500' else '' end as fetch_error,
               case when page % 5 = 4 then '' when page % 11 = 6 then '{{{{"error":1,"msg":"busy","datArr":null}}}}'
                 when page % 11 = 9 then '{{{{"error":0,"datArr":{{{{"rows":[' else
                 '{{{{"error":0,"datArr":{{{{"TotalPage":9,"rows":[' || {d.join_rows('r')} || ']}}}}}}}}' end as payload
        from (select cast(floor(event_key / 320) as bigint) as page,
                     '{{{{"event_id":' || event_id || ',"title":"' || title || '","min_time":"' || min_time
                     || '",' || case when event_key % 160 = 0 then '' else '"provincename":"'
                     || provincename || '",' end || '"city_name":"' || city_name || '","cname":"' || cname
                     || '","play_num":"' || case when event_key % 352 = 0 then '' else
                        cast(play_num as string) || case when event_key % 128 = 0 then '人' else '' end end
                     || '"}}}}' as r
              from {{fx_events}}) t group by page"""
    v["fx_payload_participants"] = f"""
        select event_id, group_id, chunk,
               case when event_key % 256 = 0 then 'cb({{{{"error":0,"datArr":"wait"}}}});'
                 when event_key % 256 = 32 then 'cb({{{{"error":1,"msg":"busy","datArr":null}}}});'
                 else 'cb({{{{"error":0,"datArr":{{{{"rows":[' || {d.join_rows('r')} || ']}}}}}}}});' end as payload
        from (select s.event_key, p.event_id, p.group_id, cast(floor(s.seat / 50) as bigint) as chunk,
                     '{{{{' || case s.seat % 17 when 16 then '' when 15 then '"participantid":"","id":"'
                       || p.participant_id || '",' when 14 then '"pid":"' || p.participant_id || '",'
                       else '"participantid":"' || p.participant_id || '",' end
                     || case when s.seat % 5 = 4 then '"participantname":"","name":"'
                       else '"participantname":"' end || p.participant_name || '","'
                     || case when s.seat % 2 = 1 then 'teamname":"","othername' else 'teamname' end
                     || '":"' || p.org || '","short":"' || p.short_no || '","vicsum":"'
                     || cast(p.win as string) || '","faisum":"' || cast(p.lose as string)
                     || '局","deusum":"' || cast(p.draw as string) || '","integral":"' || p.score
                     || '","compositor":"' || case when p.rank = 0 then '' else cast(p.rank as string) end
                     || '"}}}}' as r
              from {{fx_participants}} p join {{fx_seat}} s on s.group_id = p.group_id
               and s.participant_id = p.participant_id) t
        group by event_key, event_id, group_id, chunk"""
    v["fx_payload_matches"] = f"""
        select group_id, bout, chunk,
               'cb({{{{"error":0,"datArr":{{{{' || case when event_key % 64 = 32 then '' when event_key % 192 = 0 then '"total_bout":"",'
                 else '"total_bout":9,' end || '"rows":[' || {d.join_rows('r')} || ']}}}}}}}})' as payload
        from (select event_key, group_id, bout, cast(floor(seat_a / 50) as bigint) as chunk,
                     '{{{{"seatnum":"' || cast(seat_a + 1 as string) || '","p1id":"'
                     || case when (seat_a + bout) % 23 = 0 then '' else p1_id end || '","p2id":"' || p2_id
                     || '","p1":"' || p1_name || '","p2":"' || p2_name || '","p1_teamname":"' || p1_org
                     || '","p2_teamname":"' || p2_org || '",'
                     || case when p1_result = '' then '"p1_result":null,' else '"p1_result":' || p1_result
                       || ',' end
                     || '"p2_result":"' || p2_result || '","p1_score":"' || cast(cast(p1_score as int) as string)
                     || case when seat_a % 7 = 0 then '.5分' else '' end || '"'
                     || case when p2_score = 0 then '' else ',"p2_score":'
                       || cast(cast(p2_score as int) as string) end || '}}}}' as r
              from {{fx_matches}}) t
        group by event_key, group_id, bout, chunk"""
    v["fx_payload_notices"] = """
        select event_id,
               case when event_key % 64 = 0 then '<p>' || notice_text || '</p><script>x("<p>");</script>'
                 else '[{{"t":"规程","h":"<div class=a>' || notice_text
                   || '</div>"}},{{"t":"备注","h":"A&amp;B%20&nbsp; 100%25 <br>"}}]' end as payload
        from (select e.event_key, n.event_id, n.notice_text from {fx_notices} n
              join {fx_events} e on e.event_id = n.event_id) t"""
    v["fx_event_pages"] = f"""
        select event_id,
               '<html><body><a href="/x">x</a>' || {d.join_rows('a')}
                 || '<a class="dup" data-groupid="' || min(group_id) || '" data-groupname="repeat">r</a>'
                 || '</body></html>' as html
        from (select s.event_id, s.group_id,
                     '<a class="g" data-groupid="' || s.group_id || '" data-group-name="' || s.group_name
                     || ' &amp; &quot;' || cast(s.g as string) || '&quot;" data-team="0" data-pnumber='''
                     || cast(s.pnumber as string) || ''' data-bt="' || l.bt || '" data-et="' || l.et || '" '
                     || case when l.groupstate = '1' and s.g = 0 then '' else 'data-group-state=''' || l.groupstate || '''' end
                     || ' href="#">' || s.group_name || '</a>' as a
              from {{fx_groups}} s join {{fx_live_groups}} l on l.group_id = s.group_id) t
        group by event_id"""
    v["fx_event_updates"] = """
        select event_id, title, min_time, provincename, city_name, cname, play_num, updated_at,
               cast(1 as bigint) as ingest_seq, event_key from {fx_events}
        union all
        select event_id, title || '（更新）' as title, min_time, provincename, city_name, cname,
               play_num + 1 as play_num, updated_at + 1000 as updated_at,
               cast(2 as bigint) as ingest_seq, event_key from {fx_events} where event_key % 128 = 0
        union all
        select event_id, title || '（重复）' as title, min_time, provincename, city_name, cname,
               play_num, updated_at, cast(3 as bigint) as ingest_seq, event_key
        from {fx_events} where event_key % 96 = 0"""
    return v


_NAME = re.compile(r"\{([a-z_]+)\}")


def dependencies(sql: str) -> list[str]:
    return sorted(set(_NAME.findall(sql)))


class Fixtures:
    """Lazily stored tables of one data directory."""

    _cache: dict[tuple[str, str], "Fixtures"] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self.sql = views(Dialect("spark"))
        label = re.sub(r"[^A-Za-z0-9.]+", "_", self.sf_dir)
        self.root = f"{work_dir(spark)}/{spark.sparkContext.applicationId}/tables{label}"
        self._frames: dict[str, DataFrame] = {}
        self._shared: dict = {}
        # a group's rows lie in one bucket, so joins by group and player, round or seat need not move them
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Fixtures":
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._cache:
            cls._cache[key] = cls(spark, sf_dir)
        return cls._cache[key]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    def shared(self, label: str, make: Callable):
        """A result that several queries build on, made once per session."""
        if label not in self._shared:
            self._shared[label] = make()
        return self._shared[label]

    def forget_shared(self) -> None:
        self._shared.clear()

    def path(self, name: str) -> str:
        return f"{self.root}/fx_{name}"

    def table(self, name: str) -> DataFrame:
        """A stored table by its short name, e.g. 'events' for fx_events."""
        full = name if name.startswith("fx_") else f"fx_{name}"
        if full not in self._frames:
            self._frames[full] = self._store(full)
        return self._frames[full]

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _bytes(self, name: str) -> int:
        """Size of a source table's files."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.sf_dir}/{name}.parquet")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()

    def buckets(self) -> int:
        return self.shared("buckets", lambda: max(FEWEST_BUCKETS, -(-self._bytes("lineitem") // BUCKET_BYTES)))

    def _resolve(self, name: str) -> DataFrame:
        if name == "fx_line":
            return self._query(name)
        return self.table(name) if name.startswith("fx_") else self.source(name)

    def _query(self, full: str) -> DataFrame:
        sql = self.sql[full]
        return self.spark.sql(sql, **{n: self._resolve(n) for n in dependencies(sql)})

    def _seats(self) -> DataFrame:
        """fx_seat with one shuffle of the lines: a group's orders and lines meet, are numbered and stored in one bucket.

        event_key and g are parts of the order key, so group_id stands for both.
        """
        n = self.buckets()

        def by_group(table: str, key: str, *cols: str) -> DataFrame:
            return self.source(table).filter(f"{key} is not null") \
                .selectExpr(f"cast({key} - {key} % 32 + cast({key} % 4 as int) as string) as group_id", key, *cols) \
                .repartition(n, "group_id")
        order = ["o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
        lines = by_group("lineitem", "l_orderkey", *order[1:]).join(
            by_group("orders", "o_orderkey").withColumnRenamed("group_id", "order_group"),
            F.expr("l_orderkey = o_orderkey and group_id = order_group"))
        seats = lines.withColumn("seat", (F.row_number().over(Window.partitionBy("group_id").orderBy(*order)) - 1).cast("int")) \
            .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("group_id")).cast("int"))
        nations = F.broadcast(self.source("nation").select("n_nationkey", F.col("n_name").alias("org")))
        who = self.source("supplier").join(nations, F.expr("n_nationkey = s_nationkey")).select("s_suppkey", F.col("s_name").alias("name"), "org")
        few = self._bytes("supplier") <= BROADCAST_BYTES
        named = seats.join(F.broadcast(who) if few else who, F.expr("s_suppkey = l_suppkey"))
        return (named if few else named.repartition(n, "group_id")).selectExpr(
            "o_orderkey - o_orderkey % 32 as event_key", "cast(o_orderkey % 4 as int) as g", "group_id", "seat", "n",
            "group_id || '-' || cast(seat as string) as participant_id", "name", "org", "l_suppkey", "l_quantity")

    def _matches(self) -> DataFrame:
        """fx_matches with the half of the pairs that counts cut off before seats meet."""
        sql = self.sql["fx_matches"].replace("from (select s.*", "from (select a0.* from (select s.*").replace(
            "from {fx_seat} s) a", "from {fx_seat} s) a0 where a0.seat < (a0.bout - 1 - a0.seat + 2 * a0.n) % a0.n) a")
        return self.spark.sql(sql, fx_seat=self.table("fx_seat"))

    def _participants(self) -> DataFrame:
        """fx_participants with both sides of a game from one scan; a union would lose the buckets."""
        sql = self.sql["fx_participants"]
        start, end = sql.index("select group_id, p1_id as pid"), sql.index(") u")
        sides = "select group_id, inline(array(struct(p1_id as pid, p1_result as res), struct(p2_id as pid, p2_result as res))) from {fx_matches}"
        sql = sql[:start] + sides + sql[end:]
        return self.spark.sql(sql, **{n: self.table(n) for n in dependencies(sql)})

    def _store(self, full: str) -> DataFrame:
        df = {"fx_seat": self._seats, "fx_matches": self._matches, "fx_participants": self._participants}.get(full, lambda: self._query(full))()
        path = f"{self.root}/{full}"
        if full in LAID_OUT:
            name = re.sub(r"[^A-Za-z0-9]+", "_", f"{full}_{path}")
            write_bucketed(df, name, path, ["group_id"], self.buckets(), gather=full == "fx_groups")
            return self.spark.table(name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
