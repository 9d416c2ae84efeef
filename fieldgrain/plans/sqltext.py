"""Small builders for the SQL side of the checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence


def pct_cte(name: str, source: str, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> str:
    """CTE with midpoint-position percentiles, from a row number over the whole group."""
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    key_list = "".join(f"{k}, " for k in keys)
    outs = []
    for out, p in probs.items():
        rank = f"least(n, greatest(1.0::DOUBLE, n * {p}::DOUBLE + 0.5::DOUBLE))"
        low = f"max(v) FILTER (rn = floor({rank}))"
        high = f"max(v) FILTER (rn = ceil({rank}))"
        outs.append(f"{low} + max({rank} - floor({rank})) * ({high} - {low}) AS {out}")
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""{name} AS (SELECT {key_list}{', '.join(outs)} FROM (
      SELECT {key_list}{value} AS v, row_number() OVER ({part} ORDER BY {value}) AS rn, count(*) OVER ({part}) AS n
      FROM {source} WHERE {value} IS NOT NULL) {group})"""


def spearman_cte(name: str, source: str, keys: Sequence[str], x: str, y: str, out: str = "spearman") -> str:
    """CTE with the rank correlation from windowed average ranks."""
    part = ", ".join(keys)
    p = f"PARTITION BY {part}" if keys else ""
    comma = f"{part}, " if keys else ""
    px = f"PARTITION BY {comma}{x}"
    py = f"PARTITION BY {comma}{y}"
    group = f"GROUP BY {part}" if keys else ""
    return f"""{name} AS (SELECT {comma}corr(rx, ry) AS {out} FROM (
      SELECT {comma}rank() OVER ({p} ORDER BY {x}) + (count(*) OVER ({px}) - 1) / 2.0::DOUBLE AS rx,
             rank() OVER ({p} ORDER BY {y}) + (count(*) OVER ({py}) - 1) / 2.0::DOUBLE AS ry
      FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) {group})"""


def rnd(columns: Sequence[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)
