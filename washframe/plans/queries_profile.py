"""Registered queries: profiles (A1-A7) and chart tables (V1-V9)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from washframe.operators import charts as V
from washframe.operators import profile as A
from washframe.operators import stored_profiles as P
from washframe.plans import dirt
from washframe.plans.registry import register, rounded, sql_rounded
from washframe.sources.tables import load_table

LINE_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                "l_quantity", "l_extendedprice", "l_discount", "l_tax"]

# ---------------------------------------------------------------- A1-A4

_EV_TYPES = [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
             ("event_type", "string"), ("value", "double"), ("props", "string")]

_A1_SQL = "WITH " + dirt.EVENTS_CLEAN_NULLS_SQL + "\n" + "\nUNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS column_name, '{t}' AS data_type, "
    f"count(*) FILTER (WHERE {c} IS NULL) AS null_count, count(*) AS n_rows FROM events_cn"
    for i, (c, t) in enumerate(_EV_TYPES))


@register("table_summary", _A1_SQL)
def q_table_summary(spark, sf):
    return A.table_summary(dirt.events_tokens_nulled(spark, sf))


_A2_SQL = sql_rounded("\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, "
    f"CAST(min({c}) AS DOUBLE) AS min, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, "
    f"quantile_cont({c}, 0.75) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM lineitem"
    for c in LINE_NUMERIC), ["mean", "std", "min", "q25", "q50", "q75", "max"])


@register("describe", _A2_SQL)
def q_describe(spark, sf):
    return rounded(A.describe(load_table(spark, sf, "lineitem")))


_A2T_SQL = "\nUNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count({c}) AS count, count(DISTINCT {c}) AS "unique",
       (SELECT {c} FROM part WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS top,
       (SELECT count(*) FROM part WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS freq
FROM part""" for c in ["p_name", "p_brand", "p_type"])


@register("describe_text", _A2T_SQL)
def q_describe_text(spark, sf):
    return A.describe_text(load_table(spark, sf, "part"))


_A2D_STATS = ("mean", "min", "q25", "q50", "q75", "max")
_A2D_SQL = sql_rounded("""SELECT 'ts' AS column_name, count(ts) AS count, avg(epoch_us(ts)) / 1e6 AS mean,
  epoch_us(min(ts)) / 1e6 AS min, quantile_cont(epoch_us(ts), 0.25) / 1e6 AS q25,
  quantile_cont(epoch_us(ts), 0.5) / 1e6 AS q50, quantile_cont(epoch_us(ts), 0.75) / 1e6 AS q75,
  epoch_us(max(ts)) / 1e6 AS max FROM events""", list(_A2D_STATS), 3)


@register("describe_datetime", _A2D_SQL)
def q_describe_datetime(spark, sf):
    """Times as seconds since 1970, to the millisecond."""
    found = A.describe_datetime(load_table(spark, sf, "events"))
    seconds = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {0}) / 1e6D AS {0}"
    return rounded(found.selectExpr("column_name", "count", *[seconds.format(c) for c in _A2D_STATS]), 3)


def _a3_row(c, t, numeric):
    stats = (f"avg({c}) AS mean, stddev_samp({c}) AS std, CAST(min({c}) AS DOUBLE) AS min, "
             f"CAST(max({c}) AS DOUBLE) AS max" if numeric else
             "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, "
             "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max")
    samples = (f"(SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v "
               f"FROM events_cn WHERE {c} IS NOT NULL ORDER BY v LIMIT 3)) AS sample_values")
    return (f"SELECT '{c}' AS name, '{t}' AS dtype, count(*) FILTER (WHERE {c} IS NULL) AS missing_count, "
            f"count(DISTINCT {c}) AS unique_count, {stats}, {samples} FROM events_cn")


_A3_SQL = sql_rounded("WITH " + dirt.EVENTS_CLEAN_NULLS_SQL + "\n" + "\nUNION ALL ".join(
    _a3_row(c, t, t in ("bigint", "double")) for c, t in _EV_TYPES), ["mean", "std", "min", "max"])


@register("column_summary", _A3_SQL)
def q_column_summary(spark, sf):
    return rounded(A.column_summary(dirt.events_tokens_nulled(spark, sf)))


def _stored_row(c: str, dtype: str) -> str:
    number, text, time = dtype in ("bigint", "double"), dtype == "string", dtype.startswith("timestamp")
    moments = f"avg({c}), stddev_samp({c}), CAST(min({c}) AS DOUBLE), CAST(max({c}) AS DOUBLE)" if number else "NULL, NULL, NULL, NULL"
    ends = f"min({c}), max({c})"
    return f"""SELECT '{c}', '{dtype}', count(*), count(*) - count({c}), {moments}, {ends if text else "NULL, NULL"},
  {ends if time else "NULL, NULL"}, true, {"true" if number else "NULL"} FROM events_cn"""


_STORED_COLUMNS = ["name", "dtype", "n_rows", "missing_count", "mean", "std", "min", "max", "first_value", "last_value",
                   "first_time", "last_time", "unique_close", "median_close"]
_STORED_TYPES = [*((c, t) for c, t in _EV_TYPES if c != "user_id"), ("user_id", "bigint")]
_STORED_SQL = sql_rounded(
    "WITH " + dirt.EVENTS_CLEAN_NULLS_SQL + f", stored({', '.join(_STORED_COLUMNS)}) AS (\n"
    + "\nUNION ALL ".join(_stored_row(c, t) for c, t in _STORED_TYPES) + ")\nSELECT * FROM stored",
    ["mean", "std", "min", "max"])


@register("profile_united", _STORED_SQL)
def q_profile_united(spark, sf):
    """Profiles of every event type's rows, united; estimates are held against exact values."""
    df = dirt.events_tokens_nulled(spark, sf)
    kinds = df.withColumn("kind", F.col("event_type"))
    found = P.profile_summary(P.unite_profiles(P.profile_parts(kinds, by=["kind"])))
    exact = A.column_summary(df, samples=0).select("name", "unique_count")
    ranks = A.describe(df).select(F.col("column_name").alias("name"), F.col("q25").alias("e25"), F.col("q75").alias("e75"))
    found = found.join(exact, "name").join(ranks, "name", "left")
    unique = F.abs(F.col("unique_estimate") - F.col("unique_count")) <= 0.05 * F.col("unique_count") + 1
    return rounded(found.withColumn("unique_close", unique)
                   .withColumn("median_close", F.col("q50").between(F.col("e25"), F.col("e75"))).select(*_STORED_COLUMNS))


_A4_SQL = "WITH " + dirt.EVENTS_CLEAN_NULLS_SQL + """,
both_ AS (SELECT * FROM events_cn UNION ALL SELECT * FROM events_cn WHERE event_id % 10 = 0)
SELECT count(*) AS total_rows, 6 AS total_columns,
       sum((event_id IS NULL)::INT + (ts IS NULL)::INT + (user_id IS NULL)::INT
           + (event_type IS NULL)::INT + (value IS NULL)::INT + (props IS NULL)::INT) AS missing_cells,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM both_)) AS duplicate_rows,
       'event_id,user_id,value' AS numeric_columns, 'event_type,props' AS categorical_columns,
       'ts' AS datetime_columns
FROM both_"""


@register("data_summary", _A4_SQL)
def q_data_summary(spark, sf):
    df = dirt.events_tokens_nulled(spark, sf)
    return A.data_summary(df.unionByName(df.where(F.col("event_id") % 10 == 0)))


_A2M_SQL = sql_rounded("\nUNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS column_name, 'numeric' AS kind, count({c}) AS count, avg({c}) AS mean, "
    f"CAST(min({c}) AS DOUBLE) AS min, quantile_cont({c}, 0.5) AS q50, CAST(max({c}) AS DOUBLE) AS max FROM events"
    for i, c in ((0, "event_id"), (2, "user_id"), (4, "value"))) + """
UNION ALL SELECT 1, 'ts', 'datetime', count(ts), avg(epoch_us(ts)) / 1e6, epoch_us(min(ts)) / 1e6,
  quantile_cont(epoch_us(ts), 0.5) / 1e6, epoch_us(max(ts)) / 1e6 FROM events""", ["mean", "min", "q50", "max"], 3)


@register("describe_mixed", _A2M_SQL)
def q_describe_mixed(spark, sf):
    """Numbers and times of events together; times as seconds since 1970."""
    found = A.describe_mixed(load_table(spark, sf, "events"))
    seconds = "coalesce({0}, timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {0}_time) / 1e6D) AS {0}"
    return rounded(found.selectExpr("position", "column_name", "kind", "count",
                                    *[seconds.format(c) for c in ("mean", "min", "q50", "max")]), 3)


# ---------------------------------------------------------------- A6, V5

def _corr_sql(cols, lower_only):
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if j < i:
                parts.append(f"SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS corr FROM lineitem")
                if not lower_only:
                    parts.append(f"SELECT '{b}' AS x, '{a}' AS y, corr({a}, {b}) AS corr FROM lineitem")
        if not lower_only:
            parts.append(f"SELECT '{a}' AS x, '{a}' AS y, CASE WHEN var_pop({a}) > 0 THEN 1.0 END AS corr "
                         f"FROM lineitem")
    return sql_rounded("\nUNION ALL ".join(parts), ["corr"])


@register("correlation_matrix", _corr_sql(LINE_NUMERIC, False))
def q_correlation_matrix(spark, sf):
    return rounded(A.correlation_matrix(load_table(spark, sf, "lineitem")))


@register("heatmap_data", _corr_sql(LINE_NUMERIC, True))
def q_heatmap_data(spark, sf):
    return rounded(V.heatmap_data(load_table(spark, sf, "lineitem")))


# ---------------------------------------------------------------- A7, V1-V3

_TOP_SQL = """WITH top AS (SELECT p_brand FROM part GROUP BY p_brand
                  ORDER BY avg(p_retailprice) DESC, p_brand LIMIT 20)"""


@register("group_mean_topn", sql_rounded(_TOP_SQL + """
SELECT p_partkey, p_brand, p_retailprice FROM part WHERE p_brand IN (SELECT p_brand FROM top)""",
                                         ["p_retailprice"]))
def q_group_mean_topn(spark, sf):
    pa = load_table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    return rounded(V.group_mean_topn(pa, "p_brand", "p_retailprice"))


def _line_sql(source, x, y):
    return sql_rounded(f"""SELECT {x}, count({y}) AS n, avg({y}) AS mean,
       avg({y}) - {V.Z95!r} * stddev_samp({y}) / sqrt(count({y})) AS ci_low,
       avg({y}) + {V.Z95!r} * stddev_samp({y}) / sqrt(count({y})) AS ci_high
FROM {source} WHERE {x} IS NOT NULL GROUP BY {x}""", ["mean", "ci_low", "ci_high"] +
                       ([x] if x == "l_quantity" else []))


@register("line_data", _line_sql("lineitem", "l_quantity", "l_extendedprice"))
def q_line_data(spark, sf):
    return rounded(V.line_data(load_table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"))


@register("bar_data", _TOP_SQL.replace("WITH top AS", "WITH top AS") + ",\n" +
          "src AS (SELECT * FROM part WHERE p_brand IN (SELECT p_brand FROM top))\n" +
          _line_sql("src", "p_brand", "p_retailprice"))
def q_bar_data(spark, sf):
    return rounded(V.bar_data(load_table(spark, sf, "part"), "p_brand", "p_retailprice"))


@register("scatter_data", sql_rounded(
    "SELECT l_quantity, l_extendedprice FROM lineitem "
    "WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL", ["l_quantity", "l_extendedprice"]))
def q_scatter_data(spark, sf):
    return rounded(V.scatter_data(load_table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"))


# ---------------------------------------------------------------- V4

def _hist_sql(table, col):
    return sql_rounded(f"""WITH s AS (
  SELECT count({col}) AS n, CAST(min({col}) AS DOUBLE) AS lo, CAST(max({col}) AS DOUBLE) AS hi,
         quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.75) AS q3 FROM {table}),
w AS (SELECT *, (hi - lo) / (log2(n) + 1.0) AS sturges, 2.0 * (q3 - q1) * pow(n, -1.0 / 3.0) AS fd FROM s),
p AS (SELECT n, lo, hi, CAST(ceil((hi - lo) / CASE WHEN fd > 0 THEN least(fd, sturges) ELSE sturges END)
                            AS INTEGER) AS k FROM w),
b AS (SELECT CAST(least(floor((CAST({col} AS DOUBLE) - lo) * (k / (hi - lo))), k - 1) AS BIGINT) AS bin,
             count(*) AS cnt
      FROM {table}, p WHERE {col} IS NOT NULL GROUP BY 1)
SELECT CAST(r.bin AS BIGINT) AS bin, lo + r.bin * ((hi - lo) / k) AS bin_low,
       CASE WHEN r.bin = k - 1 THEN hi ELSE lo + (r.bin + 1) * ((hi - lo) / k) END AS bin_high,
       coalesce(b.cnt, 0) AS count, coalesce(b.cnt, 0) / (n * ((hi - lo) / k)) AS density
FROM p, range(0, p.k) AS r(bin) LEFT JOIN b ON b.bin = r.bin""", ["bin_low", "bin_high", "density"])


@register("histogram_data", _hist_sql("events", "value"))
def q_histogram_data(spark, sf):
    return rounded(V.histogram_data(load_table(spark, sf, "events"), "value"))


_HIST_HUE_SQL = sql_rounded("""WITH s AS (
  SELECT count(value) AS n, min(value) AS lo, max(value) AS hi,
         quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
w AS (SELECT *, (hi - lo) / (log2(n) + 1.0) AS sturges, 2.0 * (q3 - q1) * pow(n, -1.0 / 3.0) AS fd FROM s),
p AS (SELECT lo, hi, CAST(ceil((hi - lo) / CASE WHEN fd > 0 THEN least(fd, sturges) ELSE sturges END)
                        AS INTEGER) AS k FROM w),
b AS (SELECT event_type, CAST(least(floor((value - lo) * (k / (hi - lo))), k - 1) AS BIGINT) AS bin,
             count(*) AS cnt
      FROM events, p WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT event_type, bin, lo + bin * ((hi - lo) / k) AS bin_low,
       CASE WHEN bin = k - 1 THEN hi ELSE lo + (bin + 1) * ((hi - lo) / k) END AS bin_high,
       cnt AS count, cnt / (sum(cnt) OVER (PARTITION BY event_type) * ((hi - lo) / k)) AS density
FROM b, p""", ["bin_low", "bin_high", "density"])


@register("histogram_by_group", _HIST_HUE_SQL)
def q_histogram_by_group(spark, sf):
    return rounded(V.histogram_data(load_table(spark, sf, "events"), "value", hue="event_type"))


@register("create_plot", _hist_sql("customer", "c_acctbal"))
def q_create_plot(spark, sf):
    return rounded(V.create_plot(load_table(spark, sf, "customer"), "histogram", "c_acctbal"))


# ---------------------------------------------------------------- V6

_BOX_Q = """q AS (SELECT event_type, count(value) AS n, quantile_cont(value, 0.25) AS q1,
              quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
       FROM events WHERE value IS NOT NULL GROUP BY event_type),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)"""


@register("box_data", sql_rounded("WITH " + _BOX_Q + """
SELECT f.event_type, n, q1, median, q3,
       min(value) FILTER (WHERE value >= lo AND value <= hi) AS whisker_low,
       max(value) FILTER (WHERE value >= lo AND value <= hi) AS whisker_high,
       count(*) FILTER (WHERE value < lo OR value > hi) AS n_outliers
FROM events e JOIN f ON e.event_type = f.event_type
GROUP BY f.event_type, n, q1, median, q3""", ["q1", "median", "q3", "whisker_low", "whisker_high"]))
def q_box_data(spark, sf):
    return rounded(V.box_data(load_table(spark, sf, "events"), "event_type", "value"))


@register("box_outliers", sql_rounded("WITH " + _BOX_Q + """
SELECT e.event_type, e.value FROM events e JOIN f ON e.event_type = f.event_type
WHERE e.value < lo OR e.value > hi""", ["value"]))
def q_box_outliers(spark, sf):
    return rounded(V.box_outliers(load_table(spark, sf, "events"), "event_type", "value"))


# ---------------------------------------------------------------- V7, V8

def _kde_sql(src_sql, gname, gridsize=100, cut=2.0, fine=8.0):
    return sql_rounded(f"""WITH src AS ({src_sql}),
st AS (SELECT g, count(y) AS n, min(y) AS lo, max(y) AS hi, stddev_samp(y) * pow(count(y), -0.2) AS h
       FROM src WHERE y IS NOT NULL GROUP BY g),
st2 AS (SELECT * FROM st WHERE h > 0),
binned AS (SELECT src.g, CAST(floor((y - lo) / (h / {fine})) AS BIGINT) AS b,
                  count(*) AS w, avg(y) AS c
           FROM src JOIN st2 ON src.g = st2.g WHERE y IS NOT NULL GROUP BY 1, 2),
pts AS (SELECT binned.g, b, w, n, h, c, lo - {cut!r} * h AS s,
               ((hi - lo) + {2 * cut!r} * h) / {gridsize - 1} AS st
        FROM binned JOIN st2 ON binned.g = st2.g)
SELECT g AS {gname}, point, first(s + point * st) AS value,
       sum(w * exp(-0.5 * pow(((s + point * st) - c) / h, 2))) / (first(n) * first(h) * {math.sqrt(2 * math.pi)!r})
         AS density
FROM pts, range(0, {gridsize}) AS r(point)
GROUP BY g, point""", ["value", "density"])


@register("violin_data", _kde_sql("SELECT event_type AS g, value AS y FROM events", "event_type"))
def q_violin_data(spark, sf):
    return rounded(V.violin_data(load_table(spark, sf, "events"), "event_type", "value"))


@register("histogram_curve", _kde_sql("SELECT 'all' AS g, value AS y FROM events", '"group"', 200, 0.0))
def q_histogram_curve(spark, sf):
    return rounded(V.histogram_curve(load_table(spark, sf, "events"), "value"))


@register("box_single", sql_rounded("""WITH q AS (SELECT count(c_acctbal) AS n,
  quantile_cont(CAST(c_acctbal AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(c_acctbal AS DOUBLE), 0.5) AS median,
  quantile_cont(CAST(c_acctbal AS DOUBLE), 0.75) AS q3 FROM customer),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT 'all' AS "group", n, q1, median, q3,
  CAST(min(c_acctbal) FILTER (WHERE c_acctbal >= lo AND c_acctbal <= hi) AS DOUBLE) AS whisker_low,
  CAST(max(c_acctbal) FILTER (WHERE c_acctbal >= lo AND c_acctbal <= hi) AS DOUBLE) AS whisker_high,
  count(*) FILTER (WHERE c_acctbal < lo OR c_acctbal > hi) AS n_outliers
FROM customer, f GROUP BY n, q1, median, q3""", ["q1", "median", "q3", "whisker_low", "whisker_high"]))
def q_box_single(spark, sf):
    return rounded(V.box_data(load_table(spark, sf, "customer"), None, "c_acctbal"))


_PART_NUM = ["p_partkey", "p_size", "p_retailprice"]


@register("pair_data", sql_rounded("\nUNION ALL ".join(
    f"SELECT '{a}' AS x_name, '{b}' AS y_name, CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y "
    f"FROM part WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    for a in _PART_NUM for b in _PART_NUM if a != b), ["x", "y"]))
def q_pair_data(spark, sf):
    return rounded(V.pair_data(load_table(spark, sf, "part")))


@register("pair_half", sql_rounded("\nUNION ALL ".join(
    f"SELECT '{a}' AS x_name, '{b}' AS y_name, CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y "
    f"FROM part WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    for i, a in enumerate(_PART_NUM) for b in _PART_NUM[i + 1:]), ["x", "y"]))
def q_pair_half(spark, sf):
    """Each pair of columns once: the lower panels of a pair plot."""
    return rounded(V.pair_data(load_table(spark, sf, "part"), mirrored=False))


@register("pair_diagonal", _kde_sql("\nUNION ALL ".join(
    f"SELECT '{c}' AS g, CAST({c} AS DOUBLE) AS y FROM part" for c in _PART_NUM), "column_name"))
def q_pair_diagonal(spark, sf):
    return rounded(V.pair_diagonal(load_table(spark, sf, "part")))
