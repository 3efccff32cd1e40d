"""Outlier treatment on numeric columns: z-score to median, z-score capping, IQR capping.

Fits: one aggregation (mean, stds), one counting pass for the flag that any
value exceeds the threshold, and the exact-median / quartile jobs of
``quantiles`` (no single-task percentile). Application is a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from washframe.functions.columns import columns_of_kind, q, sql_literal, value_of, value_sql
from washframe.operators.quantiles import column_quantiles, direct_budget
from washframe.operators.stats import fit_stats
from washframe.report import StepLog


def _zscore_flags(df: DataFrame, cols: list[str], threshold: float, with_median: bool = False):
    """(stats, {column: outlier count}) and, when asked and provably bounded,
    the exact medians from the same pass: ``stats[c]["median"]``."""
    st = fit_stats(df, cols, which=("count", "mean", "std_pop", "std_samp"))
    live = [c for c in cols if st[c]["std_pop"]]   # zero / undefined std: no outliers
    if not live:
        return st, {}
    exprs = []
    direct = direct_budget([st[c]["count"] for c in live]) if with_median else [False] * len(live)
    for i, c in enumerate(live):
        v = value_sql(df, c)
        exprs.append(f"count_if(abs(({v} - {sql_literal(float(st[c]['mean']))}) / "
                     f"{sql_literal(float(st[c]['std_pop']))}) > {sql_literal(float(threshold))}) AS o{i}")
        # One exact percentile map per column, bounded by its count and a total.
        if direct[i]:
            exprs.append(f"percentile(CAST({v} AS DOUBLE), 0.5D) AS p{i}")
    row = df.groupBy().agg(*[F.expr(e) for e in exprs]).collect()[0]
    for i, c in enumerate(live):
        if f"p{i}" in row.asDict():
            st[c]["median"] = row[f"p{i}"]
    return st, {c: row[f"o{i}"] for i, c in enumerate(live) if row[f"o{i}"] > 0}


def replaced(v: Column, mean: float, std: float, threshold: float, median) -> Column:
    """The outlier-to-median projection of one column (as double)."""
    v = v.cast("double")
    z = F.abs((v - F.lit(mean)) / F.lit(std))
    return F.when(z > F.lit(threshold), F.lit(median).cast("double")).otherwise(v)


def outliers_to_median(df: DataFrame, cols: list[str] | None = None, threshold: float = 3.0,
                       approx: bool = False, log: StepLog | None = None) -> DataFrame:
    """|x - mean| / population std > threshold -> the column median (of all values).

    A threshold of 0 means 3.0; missing values are never outliers. Columns with
    outliers come out as double.
    """
    threshold = threshold or 3.0
    cols = cols if cols is not None else columns_of_kind(df, "numeric")
    st, flagged = _zscore_flags(df, cols, threshold, with_median=not approx)
    if not flagged:
        return df
    med = {c: [st[c]["median"]] for c in flagged if "median" in st[c]}
    rest = [c for c in flagged if c not in med]
    if rest:
        med.update(column_quantiles(df, rest, [0.5], approx=approx,
                                    max_group_size=max(st[c]["count"] for c in rest)))
    out = []
    for c in df.columns:
        if c in flagged:
            out.append(replaced(value_of(df, c), st[c]["mean"], st[c]["std_pop"], threshold,
                                med[c][0]).alias(c))
        else:
            out.append(q(c))
    if log is not None:
        for c in flagged:
            log.add(f"handled_outliers_{c}", columns=[c], count=flagged[c])
    return df.select(*out)


def cap_zscore(df: DataFrame, cols: list[str] | None = None, threshold: float = 3.0) -> DataFrame:
    """If any |z| > threshold (population std): clip to mean +/- threshold * sample std."""
    cols = cols if cols is not None else columns_of_kind(df, "numeric")
    st, flagged = _zscore_flags(df, cols, threshold)
    out = []
    for c in df.columns:
        if c in flagged and st[c]["std_samp"] is not None:
            lo = st[c]["mean"] - threshold * st[c]["std_samp"]
            hi = st[c]["mean"] + threshold * st[c]["std_samp"]
            v = value_of(df, c).cast("double")
            out.append(F.least(F.greatest(v, F.lit(lo)), F.lit(hi)).alias(c))
        else:
            out.append(q(c))
    return df.select(*out)


def cap_iqr(df: DataFrame, cols: list[str] | None = None, multiplier: float = 1.5,
            approx: bool = False) -> DataFrame:
    """Clip to [Q1 - k*IQR, Q3 + k*IQR] with linear quartiles."""
    cols = cols if cols is not None else columns_of_kind(df, "numeric")
    qs = column_quantiles(df, cols, [0.25, 0.75], approx=approx)
    out = []
    for c in df.columns:
        if c in qs and qs[c][0] is not None:
            q1, q3 = qs[c]
            iqr = q3 - q1
            v = value_of(df, c).cast("double")
            out.append(F.least(F.greatest(v, F.lit(q1 - multiplier * iqr)),
                               F.lit(q3 + multiplier * iqr)).alias(c))
        else:
            out.append(q(c))
    return df.select(*out)
