"""Profiles: table summary, describe (numeric / text), column and data summaries,
and the correlation matrix.

Each profile is a lazy DataFrame built from one aggregation over the input (or
a per-value count with partial aggregation for the text statistics); results
are one row per column (or column pair), never per input row. The wide
expression lists are written as SQL text so building a plan over many columns
costs one JVM call per expression.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from washframe.functions.columns import (columns_of_kind, dtype_of, ident, is_numeric, missing_sql,
                                         sql_literal, unpivot_sql, value_sql)
from washframe.operators.quantiles import column_quantiles


def _unpivot_one_row(one: DataFrame, rows: list[dict[str, object]]) -> DataFrame:
    """One-row aggregate -> one row per spec (``@name`` = column of ``one``)."""
    return one.selectExpr(unpivot_sql(rows))


def table_summary(df: DataFrame) -> DataFrame:
    """One row per column: position, name, Spark type, missing count, table rows."""
    one = df.groupBy().agg(F.expr("count(1)").alias("rows"),
                           *[F.expr(f"count_if({missing_sql(df, c)})").alias(f"m{i}")
                             for i, c in enumerate(df.columns)])
    specs = [{"position": i, "column_name": c, "data_type": dtype_of(df, c).simpleString(),
              "null_count": f"@m{i}", "n_rows": "@rows"} for i, c in enumerate(df.columns)]
    return _unpivot_one_row(one, specs)


DESCRIBE_STATS = ("count", "mean", "std", "min", "q25", "q50", "q75", "max")


def describe(df: DataFrame, cols: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Numeric describe, one row per column: count, mean, sample std, min,
    linear quartiles (exact unless ``approx``), max."""
    cols = cols if cols is not None else columns_of_kind(df, "numeric")
    if not cols:
        return describe_text(df)
    aggs = []
    for i, c in enumerate(cols):
        v = value_sql(df, c)
        aggs += [f"count({v}) AS n{i}", f"avg({v}) AS a{i}", f"stddev_samp({v}) AS s{i}",
                 f"CAST(min({v}) AS DOUBLE) AS lo{i}", f"CAST(max({v}) AS DOUBLE) AS hi{i}"]
    row = df.groupBy().agg(*[F.expr(a) for a in aggs]).collect()[0]
    spark = df.sparkSession
    qs = column_quantiles(df, cols, [0.25, 0.5, 0.75], approx=approx,
                          max_group_size=max(row[f"n{i}"] for i in range(len(cols))))
    return spark.createDataFrame(
        [(c, row[f"n{i}"], row[f"a{i}"], row[f"s{i}"], row[f"lo{i}"], *qs[c], row[f"hi{i}"])
         for i, c in enumerate(cols)],
        "column_name string, count bigint, mean double, std double, min double, "
        "q25 double, q50 double, q75 double, max double")


def _micros_sql(df: DataFrame, c: str) -> str:
    v, kind = value_sql(df, c), dtype_of(df, c).typeName()
    if kind == "timestamp":
        return f"unix_micros({v})"
    return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({v} AS TIMESTAMP_NTZ))"


def describe_datetime(df: DataFrame, cols: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Datetime describe, one row per column: count, mean, min, linear quartiles and
    max, as times without zone (UTC for columns of instants), to the microsecond.

    Quartiles are taken of the distance from the column's minimum, which a double
    holds exactly up to 285 years. A column without values has nulls."""
    cols = cols if cols is not None else columns_of_kind(df, "datetime")
    schema = ("column_name string, count bigint, mean timestamp_ntz, min timestamp_ntz, q25 timestamp_ntz, "
              "q50 timestamp_ntz, q75 timestamp_ntz, max timestamp_ntz")
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], schema)
    micros = df.selectExpr(*[f"{_micros_sql(df, c)} AS t{i}" for i, c in enumerate(cols)])
    ends = micros.groupBy().agg(*[F.expr(f"{f}(t{i}) AS {f}{i}") for i in range(len(cols))
                                  for f in ("count", "min", "max")]).collect()[0]
    away = micros.selectExpr(*[f"CAST(t{i} - {ends[f'min{i}'] or 0}L AS DOUBLE) AS t{i}" for i in range(len(cols))])
    means = away.groupBy().agg(*[F.expr(f"avg(t{i}) AS a{i}") for i in range(len(cols))]).collect()[0]
    qs = column_quantiles(away, away.columns, [0.25, 0.5, 0.75], approx=approx,
                          max_group_size=max(ends[f"count{i}"] for i in range(len(cols))))

    def time(micros_from_epoch):
        return datetime(1970, 1, 1) + timedelta(microseconds=micros_from_epoch)

    rows = []
    for i, c in enumerate(cols):
        lo = ends[f"min{i}"]
        if lo is None:
            rows.append((c, 0, *[None] * 6))
        else:
            mid = [time(lo + round(x)) for x in (means[f"a{i}"], *qs[f"t{i}"])]
            rows.append((c, ends[f"count{i}"], mid[0], time(lo), *mid[1:], time(ends[f"max{i}"])))
    return spark.createDataFrame(rows, schema)


MIXED_STATS = ("mean", "std", "min", "q25", "q50", "q75", "max")


def describe_mixed(df: DataFrame, approx: bool = False) -> DataFrame:
    """Describe of a table with numbers and times together, one row per numeric or
    datetime column in the table's order: kind, count, and mean, min, quartiles and max
    twice, as doubles and as times (``mean_time``, ...), one of which is null; times have
    no std. A table with neither kind has no rows."""
    kinds = {c: k for k in ("numeric", "datetime") for c in columns_of_kind(df, k)}
    numbers = [c for c, k in kinds.items() if k == "numeric"]
    times = [c for c, k in kinds.items() if k == "datetime"]
    place = {c: i for i, c in enumerate(df.columns)}
    double = ", ".join(f"CAST({{}} AS DOUBLE) AS {s}" for s in MIXED_STATS)
    stamp = ", ".join(f"CAST({{}} AS TIMESTAMP_NTZ) AS {s}_time" for s in MIXED_STATS if s != "std")
    parts = []
    for cols, kind, table in ((numbers, "numeric", describe), (times, "datetime", describe_datetime)):
        if cols:
            values = (list(MIXED_STATS), ["NULL"] * 6) if kind == "numeric" else \
                (["NULL"] * 7, [s for s in MIXED_STATS if s != "std"])
            rows = table(df, cols, approx=approx)
            at = "CASE column_name " + " ".join(f"WHEN {sql_literal(c)} THEN {place[c]}" for c in cols) + " END AS position"
            parts.append(rows.selectExpr(at, "column_name", f"'{kind}' AS kind", "count",
                                         *double.format(*values[0]).split(", "), *stamp.format(*values[1]).split(", ")))
    if not parts:
        return df.sparkSession.createDataFrame([], "position int, column_name string, kind string, count bigint, " + ", ".join(
            [f"{s} double" for s in MIXED_STATS] + [f"{s}_time timestamp_ntz" for s in MIXED_STATS if s != "std"]))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def value_counts_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, value as text, cnt) for every distinct non-missing value."""
    items = "inline(array(" + ", ".join(
        f"named_struct('column_name', {sql_literal(c)}, 'value', CAST({value_sql(df, c)} AS STRING))"
        for c in cols) + "))"
    long_df = df.selectExpr(items).where(F.col("value").isNotNull())
    return long_df.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("cnt"))


def describe_text(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Text describe, one row per column: count, unique, top (ties: smallest), freq."""
    cols = cols if cols is not None else columns_of_kind(df, "string")
    counts = value_counts_long(df, cols)
    return counts.groupBy("column_name").agg(
        F.expr("CAST(sum(cnt) AS BIGINT)").alias("count"),
        F.expr("count(1)").alias("unique"),
        F.expr("min(named_struct('k', -cnt, 'v', value))").alias("_b")
    ).selectExpr("column_name", "count", "unique", "_b.v AS top", "-_b.k AS freq")


SAMPLE_VALUES = 3


def _distinct_values(df: DataFrame) -> DataFrame:
    """(column_name, key, value) of every distinct non-missing value: the key tells
    values apart (instants by their microseconds, bytes in hex, -0.0 as 0.0), the
    value is their text. One pass over the table, combined before the shuffle."""
    items = []
    for c in df.columns:
        v, kind = value_sql(df, c), dtype_of(df, c).typeName()
        if kind in ("float", "double"):
            v = f"({v} + CAST(0 AS {kind}))"
        key = {"timestamp": f"unix_micros({v})", "binary": f"hex({v})"}.get(kind, v)
        items.append(f"named_struct('column_name', {sql_literal(c)}, 'key', CAST({key} AS STRING), "
                     f"'value', CAST({v} AS STRING))")
    long_df = df.selectExpr("inline(array(" + ", ".join(items) + "))")
    return long_df.where(F.col("value").isNotNull()).distinct()


def _first_values(values: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("column_name").orderBy("value")
    top = values.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return top.groupBy("column_name").agg(
        F.expr("array_join(transform(array_sort(collect_list(named_struct('r', _r, 'v', value))), "
               "x -> x.v), ', ')").alias("sample_values"))


def sample_values(df: DataFrame, k: int = SAMPLE_VALUES) -> DataFrame:
    """(column_name, sample_values): the ``k`` smallest distinct non-missing values
    of each column as text (text order), joined by ', '. A ``row_number() <= k``
    window: Spark keeps k rows per column on each task before the shuffle."""
    return _first_values(_distinct_values(df), k)


def column_summary(df: DataFrame, samples: int = SAMPLE_VALUES, approx: bool = False) -> DataFrame:
    """Per column: dtype, missing, unique, mean/std/min/max when numeric, and the
    ``samples`` smallest values as text (0: null).

    Missing counts and moments come from one aggregation; unique counts and samples
    share one shuffle of distinct (column, value) rows, so no row is multiplied for
    several distinct counts. ``approx``: HyperLogLog unique counts in the first
    aggregation, no such shuffle, and null samples."""
    aggs = []
    for i, c in enumerate(df.columns):
        v = value_sql(df, c)
        aggs.append(f"count_if({missing_sql(df, c)}) AS m{i}")
        if approx:
            aggs.append(f"approx_count_distinct({v}) AS u{i}")
        if is_numeric(dtype_of(df, c)):
            aggs += [f"avg({v}) AS a{i}", f"stddev_samp({v}) AS s{i}",
                     f"CAST(min({v}) AS DOUBLE) AS lo{i}", f"CAST(max({v}) AS DOUBLE) AS hi{i}"]
    one = df.groupBy().agg(*[F.expr(a) for a in aggs])
    specs = []
    for i, c in enumerate(df.columns):
        num = is_numeric(dtype_of(df, c))
        specs.append({"name": c, "dtype": dtype_of(df, c).simpleString(),
                      "missing_count": f"@m{i}", "unique_count": f"@u{i}" if approx else None,
                      "mean": f"@a{i}" if num else None, "std": f"@s{i}" if num else None,
                      "min": f"@lo{i}" if num else None, "max": f"@hi{i}" if num else None})
    out = _unpivot_one_row(one, specs).withColumn("sample_values", F.lit(None).cast("string"))
    if not approx:
        values = _distinct_values(df)
        found = values.groupBy("column_name").agg(F.count(F.lit(1)).alias("_u"))
        if samples:
            found = found.join(_first_values(values, samples), "column_name")
        else:
            found = found.withColumn("sample_values", F.lit(None).cast("string"))
        out = (out.drop("unique_count", "sample_values")
               .join(found.withColumnRenamed("column_name", "name"), "name", "left")
               .withColumn("unique_count", F.coalesce("_u", F.lit(0))))
    return out.selectExpr("name", "dtype", "missing_count", "CAST(unique_count AS BIGINT) AS unique_count",
                          *[f"CAST({s} AS DOUBLE) AS {s}" for s in ("mean", "std", "min", "max")], "sample_values")


def data_summary(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells, duplicate rows and column lists by kind.

    Duplicates and missing cells come from the same per-distinct-row count, so
    the table is shuffled once (with map-side combining).
    """
    norm = df.selectExpr(*[f"{value_sql(df, c)} AS {ident(c)}" for c in df.columns])
    miss = " + ".join(f"CAST({ident(c)} IS NULL AS INT)" for c in df.columns) or "0"
    groups = norm.groupBy(*[F.col(ident(c)) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n")) \
                 .withColumn("_miss", F.expr(f"({miss}) * _n"))
    kinds = {k: ",".join(columns_of_kind(df, k)) for k in ("numeric", "string", "datetime")}
    return groups.agg(
        F.expr("CAST(coalesce(sum(_n), 0) AS BIGINT)").alias("total_rows"),
        F.lit(len(df.columns)).alias("total_columns"),
        F.expr("CAST(coalesce(sum(_miss), 0) AS BIGINT)").alias("missing_cells"),
        F.expr("CAST(coalesce(sum(_n), 0) - count(1) AS BIGINT)").alias("duplicate_rows"),
        F.lit(kinds["numeric"]).alias("numeric_columns"),
        F.lit(kinds["string"]).alias("categorical_columns"),
        F.lit(kinds["datetime"]).alias("datetime_columns"))


# Above this many sum expressions a single JVM aggregation spends its time
# planning and updating thousands of aggregate buffers per row; the pairwise
# sums then come from matrix products per Arrow batch instead.
WIDE_CORR_SUMS = 256


def _pearson_sql(n, sa, sb, qa, qb, x):
    n = f"CAST({n} AS DOUBLE)"
    cov = f"(try_divide({x}, {n}) - try_divide({sa}, {n}) * try_divide({sb}, {n}))"
    va = f"greatest(try_divide({qa}, {n}) - try_divide({sa}, {n}) * try_divide({sa}, {n}), 0D)"
    vb = f"greatest(try_divide({qb}, {n}) - try_divide({sb}, {n}) * try_divide({sb}, {n}), 0D)"
    return f"try_divide({cov}, sqrt({va} * {vb}))"


def _pair_sums(centred: DataFrame, k: int) -> DataFrame:
    """Pairwise-complete sums of k centred columns ``v0..v{k-1}``, long form
    ``(i, j, n, sa, sb, qa, qb, x)`` for i >= j: rows with both present, sums of
    v_i and v_j over them, their squares, and the cross product.

    Each task accumulates k x k matrices over its Arrow batches (M = presence
    mask, Z = values with nulls as 0: n = M'M, sa = Z'M, qa = (Z*Z)'M, x = Z'Z)
    and emits k(k+1)/2 rows once; a grouped sum merges the tasks (partial
    aggregation, k(k+1)/2 groups)."""
    import numpy as np
    import pandas as pd

    li, lj = np.tril_indices(k)

    def per_task(batches):
        n = np.zeros((k, k)); s = np.zeros((k, k)); qq = np.zeros((k, k)); x = np.zeros((k, k))
        for pdf in batches:
            z = pdf.to_numpy(dtype=np.float64, na_value=np.nan)
            m = ~np.isnan(z)
            z = np.where(m, z, 0.0)
            mf = m.astype(np.float64)
            n += mf.T @ mf
            s += z.T @ mf
            qq += (z * z).T @ mf
            x += z.T @ z
        yield pd.DataFrame({"i": li.astype(np.int32), "j": lj.astype(np.int32),
                            "n": n[li, lj], "sa": s[li, lj], "sb": s[lj, li],
                            "qa": qq[li, lj], "qb": qq[lj, li], "x": x[li, lj]})

    schema = "i int, j int, n double, sa double, sb double, qa double, qb double, x double"
    return (centred.mapInPandas(per_task, schema).groupBy("i", "j")
            .agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "qa", "qb", "x")]))


def correlation_matrix(df: DataFrame, cols: list[str] | None = None,
                       lower_only: bool = False) -> DataFrame:
    """Pearson correlation, pairwise-complete, long form ``(x, y, corr)``.

    Pass 1 (tiny result): per column, non-null count and mean. Pass 2: plain
    sums of values centred at those means (centring keeps the sums free of
    cancellation). A column without nulls shares its sums across all its
    pairs; only pairs touching a column with nulls need sums restricted to
    the rows where both are present. A constant column gives null (no division
    error under ANSI). ``lower_only`` keeps the strict lower triangle. Wide
    inputs (more than ``WIDE_CORR_SUMS`` sums) take the matrix-product path.
    """
    cols = cols if cols is not None else columns_of_kind(df, "numeric")
    if len(cols) < 2:
        raise ValueError("correlation takes two or more numeric columns")
    vals = {c: f"CAST({value_sql(df, c)} AS DOUBLE)" for c in cols}
    first = df.groupBy().agg(F.expr("count(1)").alias("rows"), *[
        F.expr(e) for i, c in enumerate(cols)
        for e in (f"count({vals[c]}) AS n{i}", f"avg({vals[c]}) AS m{i}")]).collect()[0]
    rows = first["rows"]
    complete = {c: first[f"n{i}"] == rows for i, c in enumerate(cols)}
    d = {c: f"({vals[c]} - {sql_literal(float(first[f'm{i}'] or 0.0))})" for i, c in enumerate(cols)}
    pairs = [(i, j) for i in range(len(cols)) for j in range(i)]
    n_sums = 1 + 2 * len(cols) + sum(1 if complete[cols[i]] and complete[cols[j]] else 6
                                     for i, j in pairs)
    if n_sums > WIDE_CORR_SUMS and rows > 0:     # an empty input keeps its null-valued pairs
        return _correlation_wide(df, cols, d, lower_only)

    sums = ["count(1) AS rows"]
    for i, c in enumerate(cols):   # sums skip nulls: per-column moments over present values
        sums += [f"sum({d[c]}) AS s{i}", f"sum({d[c]} * {d[c]}) AS q{i}"]
    for i, j in pairs:
        a, b = cols[i], cols[j]
        if complete[a] and complete[b]:
            sums.append(f"sum({d[a]} * {d[b]}) AS x{i}_{j}")
        else:
            both = f"({vals[a]} IS NOT NULL AND {vals[b]} IS NOT NULL)"
            da, db = f"IF({both}, {d[a]}, NULL)", f"IF({both}, {d[b]}, NULL)"
            sums += [f"count_if({both}) AS n{i}_{j}", f"sum({da}) AS sa{i}_{j}",
                     f"sum({db}) AS sb{i}_{j}", f"sum({da} * {da}) AS qa{i}_{j}",
                     f"sum({db} * {db}) AS qb{i}_{j}", f"sum({da} * {db}) AS x{i}_{j}"]
    one = df.groupBy().agg(*[F.expr(s) for s in sums])

    exprs = []
    for i, j in pairs:
        a, b = cols[i], cols[j]
        if complete[a] and complete[b]:
            r = _pearson_sql("rows", f"s{i}", f"s{j}", f"q{i}", f"q{j}", f"x{i}_{j}")
        else:
            r = _pearson_sql(f"n{i}_{j}", f"sa{i}_{j}", f"sb{i}_{j}", f"qa{i}_{j}", f"qb{i}_{j}",
                             f"x{i}_{j}")
        exprs.append(f"{r} AS c{i}_{j}")
    for i, c in enumerate(cols):
        n = sql_literal(float(max(first[f"n{i}"], 1)))
        exprs.append(f"IF(q{i} / {n} - pow(s{i} / {n}, 2) > 0, 1D, CAST(NULL AS DOUBLE)) AS d{i}")
    one = one.selectExpr(*exprs)
    specs = []
    for i, j in pairs:
        specs.append({"x": cols[i], "y": cols[j], "corr": f"@c{i}_{j}"})
        if not lower_only:
            specs.append({"x": cols[j], "y": cols[i], "corr": f"@c{i}_{j}"})
    if not lower_only:
        specs += [{"x": c, "y": c, "corr": f"@d{i}"} for i, c in enumerate(cols)]
    out = _unpivot_one_row(one, specs)
    return out.selectExpr("x", "y", "CAST(corr AS DOUBLE) AS corr")


def _correlation_wide(df: DataFrame, cols: list[str], centred_sql: dict[str, str],
                      lower_only: bool) -> DataFrame:
    """The same correlations from ``_pair_sums`` (one row per pair, no wide row)."""
    k = len(cols)
    centred = df.selectExpr(*[f"{centred_sql[c]} AS v{i}" for i, c in enumerate(cols)])
    sums = _pair_sums(centred, k)
    names = df.sparkSession.createDataFrame(list(enumerate(cols)), "idx int, name string")
    # Diagonal: 1 where the column varies, null for a constant column.
    r = F.expr(f"IF(i = j, IF(try_divide(qa, n) - pow(try_divide(sa, n), 2) > 0, 1D, "
               f"CAST(NULL AS DOUBLE)), {_pearson_sql('n', 'sa', 'sb', 'qa', 'qb', 'x')})")
    pairs = sums.select("i", "j", r.alias("corr"))
    if lower_only:
        pairs = pairs.where("i > j")
    else:
        # mirror the finished rows: a union with itself would run the matrix pass twice
        both = "array(named_struct('i', i, 'j', j), named_struct('i', j, 'j', i))"
        pairs = pairs.selectExpr("corr", f"inline(slice({both}, 1, IF(i = j, 1, 2)))")
    # ``names`` has k rows (the column list): a bounded broadcast.
    ni, nj = F.broadcast(names).alias("ni"), F.broadcast(names).alias("nj")
    return (pairs.join(ni, F.col("i") == F.col("ni.idx")).join(nj, F.col("j") == F.col("nj.idx"))
            .select(F.col("ni.name").alias("x"), F.col("nj.name").alias("y"),
                    F.col("corr").cast("double").alias("corr")))
