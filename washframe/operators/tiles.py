"""Aggregations over many columns, cut into tiles of expressions.

One aggregation with a thousand expressions outgrows what the JVM compiles as one
method: it is slow to plan and its rows run uncompiled. Tiles of about ``TILE``
expressions stay compiled, and as expressions of one column stand together, each tile
reads its own columns only: all tiles together read a columnar table about once.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import Column, DataFrame

TILE = 96       # expressions of one aggregation
AT_A_TIME = 4   # tiles whose jobs run side by side


def cut_tiles(weights: list[int], tile: int) -> list[range]:
    """Runs of expressions with a weight of ``tile`` at most (or one heavier expression)."""
    out, start, held = [], 0, 0
    for i, w in enumerate(weights):
        if i > start and held + w > tile:
            out.append(range(start, i))
            start, held = i, 0
        held += w
    return out + [range(start, len(weights))] if weights else out


def aggregate_row(df: DataFrame, aggs: list[Column], weights: list[int] | None = None,
                  tile: int | None = TILE) -> dict[str, Any]:
    """Values of aliased aggregate expressions over all of ``df``, by alias.

    Expressions whose ``weights`` (1 each by default) add up to ``tile`` make one
    aggregation, in the given order. Every tile reads ``df``, so that should be a stored
    or persisted table; ``tile=None`` gives one aggregation for any other."""
    weights = weights or [1] * len(aggs)
    parts = cut_tiles(weights, sum(weights) if tile is None else tile)

    def run(part: range) -> dict[str, Any]:
        return df.groupBy().agg(*aggs[part.start:part.stop]).collect()[0].asDict()

    if len(parts) <= 1:
        return run(parts[0]) if parts else {}
    with ThreadPoolExecutor(AT_A_TIME) as pool:
        found = list(pool.map(run, parts))
    return {name: value for part in found for name, value in part.items()}
