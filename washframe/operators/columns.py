"""Column-level operators: names, empty / high-null / constant columns, checks, type subsets.

Every data-dependent decision is one aggregation returning one row per call
(bounded by the column count); the result is a projection of the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from washframe.functions.columns import columns_of_kind, missing_sql, q, value_sql
from washframe.functions.names import standard_name_list
from washframe.report import StepLog


def standardize_columns(df: DataFrame, log: StepLog | None = None) -> DataFrame:
    """snake_case names (see ``functions.names``); collisions get ``_2``, ``_3``."""
    names = standard_name_list(df.columns)
    if log is not None:
        log.add("standardized_column_names",
                detail=";".join(f"{a}->{b}" for a, b in zip(df.columns, names) if a != b),
                columns=names)
    # by position: names that repeat or differ in case only cannot be looked up
    return df.toDF(*names)


def fit_null_counts(df: DataFrame, cols: list[str] | None = None) -> tuple[int, dict[str, int]]:
    """(row count, missing cells per column) in one aggregation."""
    cols = cols if cols is not None else df.columns
    row = df.groupBy().agg(F.expr("count(1) AS __rows"),
                           *[F.expr(f"count_if({missing_sql(df, c)}) AS m{i}") for i, c in enumerate(cols)]
                           ).collect()[0]
    return row["__rows"], {c: row[f"m{i}"] for i, c in enumerate(cols)}


def empty_columns(df: DataFrame) -> list[str]:
    rows, missing = fit_null_counts(df)
    return [c for c, m in missing.items() if rows > 0 and m == rows]


def drop_empty_columns(df: DataFrame, log: StepLog | None = None) -> DataFrame:
    """Drop columns in which every value is missing."""
    cols = empty_columns(df)
    if log is not None and cols:
        log.add("dropped_empty_columns", columns=cols)
    return df.drop(*cols)


def drop_high_null_columns(df: DataFrame, threshold: float = 0.5,
                           log: StepLog | None = None) -> DataFrame:
    """Drop columns whose missing ratio is strictly above ``threshold``."""
    rows, missing = fit_null_counts(df)
    cols = [c for c, m in missing.items() if rows > 0 and m / rows > threshold]
    if log is not None and cols:
        log.add("dropped_high_na_columns", columns=cols)
    return df.drop(*cols)


def _orderable(dt: T.DataType) -> bool:
    if isinstance(dt, T.MapType):
        return False
    if isinstance(dt, T.ArrayType):
        return _orderable(dt.elementType)
    if isinstance(dt, T.StructType):
        return all(_orderable(f.dataType) for f in dt.fields)
    return True


def constant_columns(df: DataFrame, keep_all_null: bool = False) -> list[str]:
    """Columns with at most one distinct non-missing value, via min <=> max.

    No count-distinct: two bounded aggregates per column. ``keep_all_null``
    keeps all-missing columns (the ``nunique == 1`` variant).
    """
    cols = [f.name for f in df.schema.fields if _orderable(f.dataType)]
    if not cols:
        return []
    exprs = []
    for i, c in enumerate(cols):
        v = value_sql(df, c)
        exprs += [F.expr(f"min({v}) AS lo{i}"), F.expr(f"max({v}) AS hi{i}")]
    row = df.groupBy().agg(*exprs).collect()[0]
    return [c for i, c in enumerate(cols) if is_constant(row[f"lo{i}"], row[f"hi{i}"], keep_all_null)]


def is_constant(lo, hi, keep_all_null: bool = False) -> bool:
    """At most one distinct non-missing value, from the column's min and max."""
    if lo is None and hi is None:
        return not keep_all_null
    return lo == hi


def remove_constant_columns(df: DataFrame, keep_all_null: bool = False,
                            log: StepLog | None = None) -> DataFrame:
    cols = constant_columns(df, keep_all_null)
    if log is not None and cols:
        log.add("removed_constant_columns", columns=cols)
    return df.drop(*cols)


def require_columns(df: DataFrame, columns: list[str], allow_empty: bool = False) -> DataFrame:
    """Raise on unknown columns or (unless allowed) an empty table; else return ``df``."""
    unknown = [c for c in columns if c and c not in df.columns]
    if unknown:
        raise ValueError(f"no such column: {unknown[0]!r}")
    if not allow_empty and df.isEmpty():
        raise ValueError("the table has no rows")
    return df


def select_by_type(df: DataFrame, kind: str) -> DataFrame:
    """Only the ``numeric`` / ``string`` / ``datetime`` / ``other`` columns."""
    return df.select(*[q(c) for c in columns_of_kind(df, kind)])
