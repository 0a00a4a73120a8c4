"""DuckDB text: the derived tables a query needs, as common table expressions."""

from __future__ import annotations

import re

from ..sources.fixtures import Dialect, dependencies, views

_VIEWS = views(Dialect("duckdb"))
_FX = re.compile(r"\bfx_[a-z_]+\b")


def _needed(names: set[str]) -> list[str]:
    seen: set[str] = set()

    def visit(n: str) -> None:
        if n in seen or n not in _VIEWS:
            return
        for dep in dependencies(_VIEWS[n]):
            visit(dep)
        seen.add(n)
        order.append(n)

    order: list[str] = []
    for n in sorted(names):
        visit(n)
    return order


def _view_text(name: str) -> str:
    sql = _VIEWS[name]
    return sql.format(**{d: d for d in dependencies(sql)})


def with_tables(body: str, ctes: dict[str, str] | None = None) -> str:
    """Complete statement: derived tables, then the query's own steps, then its select."""
    ctes = ctes or {}
    used = set(_FX.findall(body)).union(*[set(_FX.findall(t)) for t in ctes.values()]) \
        if ctes else set(_FX.findall(body))
    parts = [f"{n} as materialized ({_view_text(n)})" for n in _needed(used)]
    parts += [f"{n} as materialized ({t})" for n, t in ctes.items()]
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + body
