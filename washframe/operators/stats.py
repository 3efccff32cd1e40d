"""One-pass column statistics: the ``fit`` half shared by most operators.

All requested statistics of all requested columns come from a single
aggregation (partial aggregation on every task, one tiny final merge), and the
result is one row: bounded by the number of columns, never by the data.
Exact quantiles come from ``quantiles.column_quantiles`` (no single-task merge).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washframe.functions.columns import missing_sql, value_sql
from washframe.operators.quantiles import column_quantiles

_AGGS = {
    "count": "count({})",
    "mean": "avg({})",
    "std_pop": "stddev_pop({})",
    "std_samp": "stddev_samp({})",
    "min": "min({})",
    "max": "max({})",
    "sum": "sum({})",
}


@dataclass
class ColumnStats:
    """Fitted statistics, keyed ``stats[column][statistic]``; ``rows`` is the row count."""
    rows: int
    stats: dict[str, dict[str, object]] = field(default_factory=dict)

    def __getitem__(self, col: str) -> dict[str, object]:
        return self.stats[col]


def fit_stats(df: DataFrame, cols: list[str], which=("count", "mean", "std_pop", "min", "max"),
              quantiles: dict[str, float] | None = None, approx: bool = False,
              missing: bool = False) -> ColumnStats:
    """Statistics of ``cols`` in one job (plus the quantile jobs when asked).

    ``quantiles`` maps a statistic name to a probability, e.g. ``{"median": .5}``.
    ``missing`` adds the count of null / NaN cells per column.
    """
    exprs = ["count(1) AS __rows"]
    for i, c in enumerate(cols):
        v = value_sql(df, c)
        for name in which:
            exprs.append(_AGGS[name].format(v) + f" AS {name}__{i}")
        if missing:
            exprs.append(f"count_if({missing_sql(df, c)}) AS missing__{i}")
    row = df.groupBy().agg(*[F.expr(e) for e in exprs]).collect()[0]
    out = ColumnStats(rows=row["__rows"])
    for i, c in enumerate(cols):
        got = {name: row[f"{name}__{i}"] for name in which}
        # decimals meet doubles in the fitted expressions
        out.stats[c] = {k: float(v) if isinstance(v, Decimal) else v for k, v in got.items()}
        if missing:
            out.stats[c]["missing"] = row[f"missing__{i}"]
    if quantiles and cols:
        names = list(quantiles)
        counts = [out.stats[c]["count"] for c in cols] if "count" in which else None
        got = column_quantiles(df, cols, [quantiles[n] for n in names], approx=approx,
                               max_group_size=max(counts) if counts else None)
        for c in cols:
            for n, val in zip(names, got[c]):
                out.stats[c][n] = val
    return out
