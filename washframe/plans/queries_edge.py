"""Registered queries on untidy forms of the tables: date formats and offsets, codes
that look like numbers, keys beyond 2**53, decimals, names that differ in case,
groups without a mean, cells with blanks and newlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from washframe.operators import charts, coerce, columns, missing, outliers
from washframe.plans.registry import register, rounded, sql_rounded
from washframe.session import scratch_path
from washframe.sources import files
from washframe.sources.tables import load_table


@register("parse_dates_by_column", """SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS us_date,
  date_trunc('day', o_orderdate)::TIMESTAMP AS eu_date,
  (date_trunc('second', o_orderdate) - INTERVAL 5 HOUR)::TIMESTAMP AS zone_time, 'soon' AS due_date FROM orders""")
def q_parse_dates_by_column(spark, sf):
    """Month-first, day-first and offset text, each column by its own format; a
    date-named column that holds no date stays text."""
    d = F.col("o_orderdate")
    df = load_table(spark, sf, "orders").select(
        "o_orderkey", F.date_format(d, "MM/dd/yyyy").alias("us_date"), F.date_format(d, "dd/MM/yyyy").alias("eu_date"),
        F.concat(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:00")).alias("zone_time"),
        F.lit("soon").alias("due_date"))
    return coerce.parse_dates(df)


@register("detect_codes", """SELECT o_orderkey, (o_orderkey % 100)::VARCHAR || 'D' AS code,
  o_orderkey % 2 = 0 AS flag, (o_orderkey % 9)::DOUBLE * 100 AS amount FROM orders""")
def q_detect_codes(spark, sf):
    """``12D`` stays a code, True / False becomes boolean, ``3e2`` a number."""
    k = F.col("o_orderkey")
    df = load_table(spark, sf, "orders").select(
        "o_orderkey", F.concat((k % 100).cast("string"), F.lit("D")).alias("code"),
        F.when(k % 2 == 0, F.lit("True")).otherwise(F.lit("False")).alias("flag"),
        F.concat((k % 9).cast("string"), F.lit("e2")).alias("amount"))
    return coerce.detect_and_convert(df)


_BIG = 2 ** 53


@register("fill_mode_large_keys", f"""WITH k AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL
  ELSE {_BIG} + o_custkey % 5 END AS k FROM orders),
m AS (SELECT k FROM k WHERE k IS NOT NULL GROUP BY k ORDER BY count(*) DESC, k LIMIT 1)
SELECT o_orderkey, coalesce(k.k, m.k)::BIGINT AS k FROM k, m""")
def q_fill_mode_large_keys(spark, sf):
    """Keys that differ only beyond a double's precision keep their own counts."""
    df = load_table(spark, sf, "orders").select("o_orderkey", F.when(
        F.col("o_orderkey") % 7 != 0, F.lit(_BIG) + F.col("o_custkey") % 5).alias("k"))
    return missing.fill_mode(df, ["k"])


@register("standardize_case_names", "SELECT c_custkey AS id, c_nationkey AS id_2, c_name AS full_name FROM customer")
def q_standardize_case_names(spark, sf):
    df = load_table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_name").toDF("ID", "id", "Full\tName")
    return columns.standardize_columns(df)


@register("cap_zscore_decimal", sql_rounded("""WITH s AS (SELECT avg(v) AS m, stddev_pop(v) AS p, stddev_samp(v) AS d
  FROM (SELECT c_acctbal::DECIMAL(12, 2)::DOUBLE AS v FROM customer)),
f AS (SELECT count(*) AS n FROM customer, s WHERE abs((c_acctbal - m) / p) > 1.5)
SELECT c_custkey, CASE WHEN n > 0 THEN least(greatest(c_acctbal::DECIMAL(12, 2)::DOUBLE, m - 1.5 * d), m + 1.5 * d)
  ELSE c_acctbal END AS c_acctbal FROM customer, s, f""", ["c_acctbal"]))
def q_cap_zscore_decimal(spark, sf):
    df = load_table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(12,2)").alias("c_acctbal"))
    return rounded(outliers.cap_zscore(df, ["c_acctbal"], 1.5))


@register("bar_groups_with_mean", sql_rounded("""WITH p AS (SELECT p_size AS x,
  CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_retailprice END AS y FROM part),
t AS (SELECT x FROM p GROUP BY x HAVING avg(y) IS NOT NULL ORDER BY avg(y) DESC, x LIMIT 20)
SELECT x, count(y) AS n, avg(y) AS mean FROM p WHERE x IN (SELECT x FROM t) GROUP BY x""", ["mean"]))
def q_bar_groups_with_mean(spark, sf):
    """Only groups that have a mean count among the shown ones."""
    df = load_table(spark, sf, "part").select(F.col("p_size").alias("x"), F.when(
        F.col("p_size") % 3 != 0, F.col("p_retailprice")).alias("y"))
    return rounded(charts.bar_data(df, "x", "y").select("x", "n", "mean"))


@register("csv_round_trip", r"""SELECT doc_id, '  ' || replace(text, chr(13), ' ') || chr(10) || 'end "quoted", ' AS text FROM documents""")
def q_csv_round_trip(spark, sf):
    """Blanks at the ends, newlines, quotes and commas survive the CSV sink."""
    df = load_table(spark, sf, "documents").select("doc_id", F.concat(
        F.lit("  "), F.translate("text", "\r", " "), F.lit('\nend "quoted", ')).alias("text"))
    path = files.write_csv(df, scratch_path(spark, "csv-padded"))
    return files.read_csv(spark, path, schema=df.schema)
