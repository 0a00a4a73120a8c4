"""DuckDB statements that the registered queries are checked against.

Written from the semantics, not from the Spark plans.
"""

from . import ingest, play, promo, search, strength

ORACLES: dict[str, str] = {}
for _m in (ingest, search, play, strength, promo):
    ORACLES.update(_m.ORACLES)
