"""Pieces of SQL text for the statements that check the queries."""

from __future__ import annotations

BARS = """bars AS (
SELECT l_suppkey AS asset_id, r_name AS market, n_name AS industry, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
  round(avg(l_extendedprice / l_quantity), 10) AS open, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS adj_close,
  CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY ALL)"""

ASSET = "PARTITION BY asset_id ORDER BY date"
CROSS = "PARTITION BY date, market"


def lag(e: str, n: int = 1, over: str = ASSET) -> str:
    return f"lag({e}, {n}) OVER ({over})"


def change(e: str, n: int = 1) -> str:
    return f"({e} / nullif({lag(e, n)}, 0) - 1)"


def roll(agg: str, e: str, n: int, least: int | None = None, over: str = ASSET, shift: int = 0) -> str:
    w = f"OVER ({over} ROWS BETWEEN {n - 1 + shift} PRECEDING AND {f'{shift} PRECEDING' if shift else 'CURRENT ROW'})"
    return f"(CASE WHEN count({e}) {w} >= {n if least is None else least} THEN {agg}({e}) {w} END)"


def rank(e: str, keys: str = "date, market") -> str:
    return f"(CASE WHEN {e} IS NOT NULL THEN (rank() OVER (PARTITION BY {keys} ORDER BY {e} NULLS LAST) + (count({e}) OVER (PARTITION BY {keys}, {e}) - 1) / 2.0) / count({e}) OVER (PARTITION BY {keys}) END)"


def mean_rank(e: str, keys: str) -> str:
    return f"(CASE WHEN {e} IS NOT NULL THEN rank() OVER (PARTITION BY {keys} ORDER BY {e} NULLS LAST) + (count({e}) OVER (PARTITION BY {keys}, {e}) - 1) / 2.0 END)"


def z(e: str, keys: str = "date, market") -> str:
    w = f"OVER (PARTITION BY {keys})"
    return f"(({e} - avg({e}) {w}) / (CASE WHEN stddev_pop({e}) {w} > 1e-12 THEN stddev_pop({e}) {w} END))"


def chain(stages: list[dict[str, str]], start: str = "bars", head: str = BARS) -> str:
    """WITH ..., each stage adding columns to the one before; the last is named ``last``."""
    parts, at = [head], start
    for i, s in enumerate(stages):
        name = "last" if i == len(stages) - 1 else f"s{i}"
        parts.append(f"{name} AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in s.items())} FROM {at})")
        at = name
    return "WITH " + ",\n".join(parts)


def final(stages: list[dict[str, str]], columns: list[str], digits: int = 6, keys: str = "asset_id, market, date", where: str = "", head: str = BARS) -> str:
    return f"{chain(stages, head=head)}\nSELECT {keys}, {', '.join(f'round({c}, {digits}) + 0.0 AS {c}' for c in columns)} FROM last {where}"
