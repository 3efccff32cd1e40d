"""Missing values: NA tokens, counts, and the fill strategies.

Fill values are fitted in bounded aggregations (one row per column) and
applied with ``coalesce``; the mode is a per-value count (partial
aggregation, so a hot value costs nothing) followed by ``min(struct(-count,
value))`` per column, never a collect of a column's distinct values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from washframe.functions.columns import (columns_of_kind, dtype_of, is_datetime, is_numeric,
                                         is_string, missing_sql, q, sql_literal, unpivot_sql,
                                         value_of, value_sql)
from washframe.functions.text import DEFAULT_NA_TOKENS, null_if_token
from washframe.operators.columns import fit_null_counts
from washframe.operators.ordered_fill import fill_bfill, fill_ffill
from washframe.operators.quantiles import column_quantiles
from washframe.operators.stats import fit_stats
from washframe.report import StepLog


def replace_na_tokens(df: DataFrame, tokens=DEFAULT_NA_TOKENS,
                      columns: list[str] | None = None) -> DataFrame:
    """Cells of string columns exactly equal to a token become null."""
    targets = set(columns if columns is not None else columns_of_kind(df, "string"))
    targets &= set(columns_of_kind(df, "string"))
    return df.select(*[null_if_token(q(c), tokens).alias(c) if c in targets else q(c)
                       for c in df.columns])


def null_counts(df: DataFrame) -> DataFrame:
    """Long form ``(column_name, null_count)``: one aggregation, then a 1-row unpivot."""
    one = df.groupBy().agg(*[F.expr(f"count_if({missing_sql(df, c)}) AS m{i}")
                             for i, c in enumerate(df.columns)])
    return one.selectExpr(unpivot_sql([{"column_name": c, "null_count": f"@m{i}"}
                                       for i, c in enumerate(df.columns)]))


def _apply_fills(df: DataFrame, values: dict[str, object], as_double: set[str] = frozenset()) -> DataFrame:
    out = []
    for c in df.columns:
        if c in values and values[c] is not None:
            dt = T.DoubleType() if c in as_double else dtype_of(df, c)
            out.append(F.coalesce(value_of(df, c).cast(dt), F.lit(values[c]).cast(dt)).alias(c))
        else:
            out.append(q(c))
    return df.select(*out)


def _with_missing(df: DataFrame, cols: list[str] | None, kind_ok) -> list[str]:
    cols = cols if cols is not None else [f.name for f in df.schema.fields if kind_ok(f.dataType)]
    return [c for c in cols if kind_ok(dtype_of(df, c))]


def fit_medians(df: DataFrame, cols: list[str], approx: bool = False,
                max_group_size: int | None = None) -> dict[str, float]:
    """Exact medians; ``max_group_size`` (a known bound of the non-null counts)
    skips the counting pass."""
    if max_group_size is not None and cols:
        got = column_quantiles(df, cols, [0.5], approx=approx, max_group_size=max_group_size)
        return {c: got[c][0] for c in cols}
    st = fit_stats(df, cols, which=("count",), quantiles={"median": 0.5}, approx=approx)
    return {c: st[c]["median"] for c in cols}


def fill_median(df: DataFrame, cols: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Numeric columns: missing -> exact median (``approx`` -> percentile_approx).
    Filled columns come out as double (a median may be x.5)."""
    cols = _with_missing(df, cols, is_numeric)
    med = fit_medians(df, cols, approx)
    return _apply_fills(df, med, as_double=set(cols))


def fill_mean(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = _with_missing(df, cols, is_numeric)
    st = fit_stats(df, cols, which=("mean",))
    return _apply_fills(df, {c: st[c]["mean"] for c in cols}, as_double=set(cols))


def column_modes(df: DataFrame, cols: list[str]) -> dict[str, object]:
    """Most frequent non-missing value per column; ties -> smallest value."""
    out: dict[str, object] = {}
    # integers are counted as integers: as doubles, large ones would merge
    groups: dict[str, list[str]] = {"double": [], "bigint": [], "string": []}
    others = []
    for c in cols:
        dt = dtype_of(df, c)
        if isinstance(dt, (T.DoubleType, T.FloatType)):
            groups["double"].append(c)
        elif isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            groups["bigint"].append(c)
        elif is_string(dt):
            groups["string"].append(c)
        else:
            others.append(c)
    for kind, names in groups.items():
        if not names:
            continue
        items = "inline(array(" + ", ".join(
            f"named_struct('_col', {sql_literal(c)}, '_val', CAST({value_sql(df, c)} AS {kind}))"
            for c in names) + "))"
        long_df = df.selectExpr(items).where(F.col("_val").isNotNull())
        per_value = long_df.groupBy("_col", "_val").agg(F.count(F.lit(1)).alias("_cnt"))
        best = per_value.groupBy("_col").agg(
            F.min(F.struct((-F.col("_cnt")).alias("k"), F.col("_val").alias("v"))).alias("_b"))
        for row in best.collect():
            out[row["_col"]] = row["_b"]["v"]
    for c in others:
        per_value = (df.where(q(c).isNotNull()).groupBy(q(c).alias("_val"))
                     .agg(F.count(F.lit(1)).alias("_cnt")))
        row = per_value.agg(F.min(F.struct((-F.col("_cnt")).alias("k"),
                                           F.col("_val").alias("v"))).alias("_b")).collect()[0]
        out[c] = row["_b"]["v"] if row["_b"] is not None else None
    for c in cols:
        out.setdefault(c, None)
    return out


def fill_mode(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Missing -> most frequent value (ties: smallest). Default: string columns."""
    cols = cols if cols is not None else columns_of_kind(df, "string")
    return _apply_fills(df, column_modes(df, cols))


def fill_constant(df: DataFrame, strategy: str | float = "0",
                  cols: list[str] | None = None) -> DataFrame:
    """Numeric: the number in ``strategy`` (else 0); string: ``''``."""
    try:
        number = float(strategy)
    except (TypeError, ValueError):
        number = 0.0
    cols = cols if cols is not None else df.columns
    values, as_double = {}, set()
    for c in cols:
        dt = dtype_of(df, c)
        if is_numeric(dt):
            values[c] = number
            if not isinstance(dt, T.DecimalType) and not number.is_integer():
                as_double.add(c)
        elif is_string(dt):
            values[c] = ""
    return _apply_fills(df, values, as_double)


def drop_null_rows(df: DataFrame) -> DataFrame:
    """Drop rows with any missing cell (null, or NaN in float columns)."""
    return df.dropna(how="any")


def fill_missing(df: DataFrame, order_by: list[str] | None = None,
                 custom_na_values=None, partition_by: list[str] | None = None,
                 approx: bool = False, log: StepLog | None = None,
                 counts: tuple[int, dict[str, int]] | None = None) -> DataFrame:
    """Automatic fill: NA tokens -> null, drop all-missing columns, then numeric
    -> median, datetime -> forward fill along ``order_by``, other -> mode.
    ``counts``: (rows, missing per column) already fitted on ``df``."""
    if custom_na_values:
        df = replace_na_tokens(df, custom_na_values)
        counts = None
    rows, missing = counts if counts is not None else fit_null_counts(df)
    empty = [c for c, m in missing.items() if rows > 0 and m == rows]
    if empty:
        df = df.drop(*empty)
        if log is not None:
            for c in empty:
                log.add(f"dropped_empty_column_{c}", columns=[c])
    todo = [c for c in df.columns if missing.get(c, 0) > 0]
    numeric = [c for c in todo if is_numeric(dtype_of(df, c))]
    dates = [c for c in todo if is_datetime(dtype_of(df, c))]
    other = [c for c in todo if c not in numeric and c not in dates]
    if numeric:
        bound = max(rows - missing[c] for c in numeric)
        df = _apply_fills(df, fit_medians(df, numeric, approx, max_group_size=bound),
                          as_double=set(numeric))
    if other:
        df = _apply_fills(df, column_modes(df, other))
    if dates:
        if not order_by:
            raise ValueError(f"forward fill of {dates} needs order_by")
        df = fill_ffill(df, dates, order_by, partition_by, rows=rows)
    if log is not None:
        for c in todo:
            log.add(f"filled_missing_values_{c}", columns=[c], count=missing[c])
    return df


__all__ = ["replace_na_tokens", "null_counts", "fill_median", "fill_mean", "fill_mode",
           "fill_constant", "drop_null_rows", "fill_missing", "fill_ffill", "fill_bfill",
           "column_modes", "fit_medians"]
