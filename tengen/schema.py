"""Stored tables: names, types and keys."""

from pyspark.sql import types as T

_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _schema(**cols) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in cols.items()])


EVENTS = _schema(event_id=_S, title=_S, min_time=_S, provincename=_S, city_name=_S,
                 cname=_S, play_num=_I, updated_at=_L)
EVENT_GROUPS = _schema(group_id=_S, event_id=_S, group_name=_S, team_type=_S,
                       pnumber=_I, updated_at=_L)
PARTICIPANTS = _schema(event_id=_S, group_id=_S, group_name=_S, participant_id=_S,
                       participant_name=_S, org=_S, short_no=_S, win=_I, lose=_I, draw=_I,
                       score=_S, rank=_I, updated_at=_L)
INDEX_STATUS = _schema(event_id=_S, indexed_at=_L, group_count=_I, participant_count=_I,
                       last_error=_S)
MATCHES = _schema(group_id=_S, bout=_I, p1_id=_S, p2_id=_S, p1_name=_S, p2_name=_S,
                  p1_org=_S, p2_org=_S, p1_result=_S, p2_result=_S, p1_score=_D,
                  p2_score=_D, updated_at=_L)
MATCH_STATUS = _schema(group_id=_S, rounds=_I, updated_at=_L, last_error=_S)
NOTICES = _schema(event_id=_S, notice_text=_S, updated_at=_L, last_error=_S)

TABLES = {
    "events": (EVENTS, ["event_id"]),
    "event_groups": (EVENT_GROUPS, ["group_id"]),
    "participants": (PARTICIPANTS, ["event_id", "group_id", "participant_id"]),
    "index_status": (INDEX_STATUS, ["event_id"]),
    "matches": (MATCHES, ["group_id", "bout", "p1_id", "p2_id"]),
    "match_status": (MATCH_STATUS, ["group_id"]),
    "notices": (NOTICES, ["event_id"]),
}

EVENT_VIEW = ["event_id", "title", "min_time", "provincename", "city_name", "cname"]
ENTRY_VIEW = ["group_id", "group_name", "participant_id", "participant_name", "org",
              "win", "lose", "draw", "score", "rank"]
