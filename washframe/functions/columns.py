"""Column-expression helpers shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)
_FRACTIONAL = (T.FloatType, T.DoubleType)
_DATETIME = (T.TimestampType, T.TimestampNTZType, T.DateType)


def is_numeric(dt: T.DataType) -> bool:
    """Numbers in the pandas ``np.number`` sense: booleans are not numeric."""
    return isinstance(dt, _NUMERIC)


def is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, _DATETIME)


def is_string(dt: T.DataType) -> bool:
    return isinstance(dt, T.StringType)


def columns_of_kind(df: DataFrame, kind: str) -> list[str]:
    """Column names by kind: ``numeric``, ``string``, ``datetime`` or ``other``."""
    tests = {"numeric": is_numeric, "string": is_string, "datetime": is_datetime}
    if kind == "other":
        return [f.name for f in df.schema.fields
                if not any(t(f.dataType) for t in tests.values())]
    if kind not in tests:
        raise ValueError(f"unknown column kind {kind!r}")
    return [f.name for f in df.schema.fields if tests[kind](f.dataType)]


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def q(name: str) -> Column:
    """A column reference that tolerates any characters in the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def value_of(df: DataFrame, name: str) -> Column:
    """The column with float NaN read as missing (pandas treats NaN as null)."""
    c = q(name)
    if isinstance(dtype_of(df, name), _FRACTIONAL):
        return F.when(F.isnan(c), F.lit(None).cast(dtype_of(df, name))).otherwise(c)
    return c


def is_missing(df: DataFrame, name: str) -> Column:
    c = q(name)
    if isinstance(dtype_of(df, name), _FRACTIONAL):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def nan_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Turn float NaN into null at entry (Spark's median would rank NaN largest)."""
    cols = cols if cols is not None else df.columns
    fractional = {f.name for f in df.schema.fields if isinstance(f.dataType, _FRACTIONAL)}
    return df.select(*[value_of(df, c).alias(c) if c in fractional and c in cols else q(c)
                       for c in df.columns])


# SQL-text forms of the helpers above. Operators that build many expressions
# (one per column or per column pair) emit SQL text parsed on the JVM side:
# one Py4J call per expression instead of one per Column operator.

def ident(name: str) -> str:
    """Back-quoted identifier."""
    return "`" + name.replace("`", "``") + "`"


def sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int):
        return f"{v}L" if abs(v) > 2**31 - 1 else str(v)
    if isinstance(v, float):
        if v != v:
            return "CAST('NaN' AS DOUBLE)"
        if v in (float("inf"), float("-inf")):
            return f"CAST('{'-' if v < 0 else ''}Infinity' AS DOUBLE)"
        return f"CAST({v!r} AS DOUBLE)"
    text = str(v).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def value_sql(df: DataFrame, name: str) -> str:
    """SQL text of ``value_of``: float NaN read as null."""
    dt = dtype_of(df, name)
    if isinstance(dt, _FRACTIONAL):
        return f"nanvl({ident(name)}, CAST(NULL AS {dt.simpleString()}))"
    return ident(name)


def missing_sql(df: DataFrame, name: str) -> str:
    if isinstance(dtype_of(df, name), _FRACTIONAL):
        return f"({ident(name)} IS NULL OR isnan({ident(name)}))"
    return f"({ident(name)} IS NULL)"


def unpivot_sql(rows: list[dict[str, object]]) -> str:
    """``inline(array(named_struct(...), ...))`` text: one output row per dict.

    Values that are strings starting with ``@`` are column references; others
    are literals.
    """
    structs = []
    for spec in rows:
        parts = []
        for key, src in spec.items():
            val = ident(src[1:]) if isinstance(src, str) and src.startswith("@") else sql_literal(src)
            parts.append(f"{sql_literal(key)}, {val}")
        structs.append("named_struct(" + ", ".join(parts) + ")")
    return "inline(array(" + ", ".join(structs) + "))"
