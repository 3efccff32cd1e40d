"""Registered queries: column, missing-value, duplicate, type, outlier and text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from washframe.functions.text import NUMBER_TEXT_PATTERN, STRIP_PATTERN
from washframe.operators import coerce as T
from washframe.operators import columns as P
from washframe.operators import dedup as D
from washframe.operators import missing as M
from washframe.operators import outliers as O
from washframe.operators import strings as C
from washframe.plans import dirt
from washframe.plans.registry import register, rounded, sql_rounded
from washframe.sources.tables import load_table

EV_COLS = "event_id, ts, user_id, event_type, value, props"

# ---------------------------------------------------------------- P1-P6

_P1_SQL = sql_rounded("""SELECT c_custkey AS cust_key, c_name AS customer_name,
       c_nationkey AS col_1st_nation, c_acctbal AS balance, c_mktsegment AS mkt_segment,
       c_nationkey AS a_b, c_custkey AS a_b_2, c_acctbal AS col_
FROM customer""", ["balance", "col_"])


@register("standardize_columns", _P1_SQL)
def q_standardize_columns(spark, sf):
    cu = load_table(spark, sf, "customer")
    messy = cu.select(F.col("c_custkey").alias("Cust Key"), F.col("c_name").alias("Customer-Name"),
                      F.col("c_nationkey").alias("1st Nation"), F.col("c_acctbal").alias("Balance ($)"),
                      F.col("c_mktsegment").alias("  Mkt  Segment "), F.col("c_nationkey").alias("a b"),
                      F.col("c_custkey").alias("a_b"), F.col("c_acctbal").alias("$$"))
    return rounded(P.standardize_columns(messy))


@register("drop_empty_columns", sql_rounded(
    f"SELECT {EV_COLS}, CASE WHEN event_id % 2 = 0 THEN value END AS half FROM events",
    ["value", "half"]))
def q_drop_empty_columns(spark, sf):
    ev = load_table(spark, sf, "events")
    wide = ev.select("*", F.lit(None).cast("string").alias("empty_text"),
                     F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("half"),
                     F.lit(None).cast("double").alias("empty_num"))
    return rounded(P.drop_empty_columns(wide))


@register("drop_high_null_columns", sql_rounded(
    f"SELECT {EV_COLS}, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS some_null FROM events",
    ["value", "some_null"]))
def q_drop_high_null_columns(spark, sf):
    ev = load_table(spark, sf, "events")
    wide = ev.select("*", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("mostly_null"),
                     F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("some_null"))
    return rounded(P.drop_high_null_columns(wide, 0.5))


@register("remove_constant_columns", sql_rounded(f"SELECT {EV_COLS} FROM events", ["value"]))
def q_remove_constant_columns(spark, sf):
    ev = load_table(spark, sf, "events")
    wide = ev.select("*", F.lit("x").alias("const_text"),
                     F.when(F.col("event_id") % 2 == 0, F.lit("k")).alias("const_or_null"),
                     F.lit(None).cast("double").alias("all_null"), F.lit(1.5).alias("const_num"))
    return rounded(P.remove_constant_columns(wide))


@register("require_columns", sql_rounded("SELECT * FROM orders", ["o_totalprice"]))
def q_require_columns(spark, sf):
    od = load_table(spark, sf, "orders")
    return rounded(P.require_columns(od, ["o_orderkey", "o_totalprice"]))


@register("select_by_type", sql_rounded(
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
    "l_discount, l_tax FROM lineitem",
    ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def q_select_by_type(spark, sf):
    return rounded(P.select_by_type(load_table(spark, sf, "lineitem"), "numeric"))


# ---------------------------------------------------------------- M1-M10

_CN = "WITH " + dirt.EVENTS_CLEAN_NULLS_SQL + "\n"


@register("replace_na_tokens", sql_rounded(_CN + f"SELECT {EV_COLS} FROM events_cn", ["value"]))
def q_replace_na_tokens(spark, sf):
    return rounded(M.replace_na_tokens(dirt.events_nulls(spark, sf)))


_NULLS_SQL = _CN + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM events_cn"
    for c in ["event_id", "ts", "user_id", "event_type", "value", "props"])


@register("null_counts", _NULLS_SQL)
def q_null_counts(spark, sf):
    return M.null_counts(dirt.events_tokens_nulled(spark, sf))


@register("fill_median", sql_rounded(_CN + """SELECT event_id, ts, user_id, event_type,
       coalesce(value, (SELECT median(value) FROM events_cn)) AS value, props FROM events_cn""",
                                     ["value"]))
def q_fill_median(spark, sf):
    return rounded(M.fill_median(dirt.events_tokens_nulled(spark, sf), ["value"]))


@register("fill_mean", sql_rounded(_CN + """SELECT event_id, ts, user_id, event_type,
       coalesce(value, (SELECT avg(value) FROM events_cn)) AS value, props FROM events_cn""",
                                   ["value"]))
def q_fill_mean(spark, sf):
    return rounded(M.fill_mean(dirt.events_tokens_nulled(spark, sf), ["value"]))


@register("fill_ffill", sql_rounded(_CN + """SELECT event_id,
       last_value(ts IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ts,
       user_id, event_type, value, props FROM events_cn""", ["value"]))
def q_fill_ffill(spark, sf):
    return rounded(M.fill_ffill(dirt.events_tokens_nulled(spark, sf), ["ts"], ["event_id"]))


@register("fill_ffill_by_group", sql_rounded(_CN + """SELECT event_id,
       last_value(ts IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ts,
       user_id, event_type,
       last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value,
       props FROM events_cn""", ["value"]))
def q_fill_ffill_by_group(spark, sf):
    return rounded(M.fill_ffill(dirt.events_tokens_nulled(spark, sf), ["ts", "value"],
                                ["event_id"], partition_by=["user_id"]))


@register("fill_bfill", sql_rounded(_CN + """SELECT event_id, ts, user_id, event_type,
       first_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value,
       props FROM events_cn""", ["value"]))
def q_fill_bfill(spark, sf):
    return rounded(M.fill_bfill(dirt.events_tokens_nulled(spark, sf), ["value"], ["event_id"]))


_MODE_SQL = _CN + """SELECT event_id, ts, user_id,
       coalesce(event_type, (SELECT event_type FROM events_cn WHERE event_type IS NOT NULL
                             GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type,
       value, props FROM events_cn"""


@register("fill_mode", sql_rounded(_MODE_SQL, ["value"]))
def q_fill_mode(spark, sf):
    return rounded(M.fill_mode(dirt.events_tokens_nulled(spark, sf), ["event_type"]))


@register("fill_constant", sql_rounded(_CN + """SELECT event_id, ts, user_id,
       coalesce(event_type, '') AS event_type, coalesce(value, -1.0) AS value, props FROM events_cn""",
                                       ["value"]))
def q_fill_constant(spark, sf):
    return rounded(M.fill_constant(dirt.events_tokens_nulled(spark, sf), "-1"))


@register("drop_null_rows", sql_rounded(_CN + f"""SELECT {EV_COLS} FROM events_cn
WHERE event_id IS NOT NULL AND ts IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL
  AND value IS NOT NULL AND props IS NOT NULL""", ["value"]))
def q_drop_null_rows(spark, sf):
    return rounded(M.drop_null_rows(dirt.events_tokens_nulled(spark, sf)))


_AUTO_SQL = "WITH " + dirt.EVENTS_NULLS_SQL + """,
cn AS (SELECT event_id, ts, user_id, NULLIF(event_type, 'N/A') AS event_type, value, props FROM events_nulls)
SELECT event_id,
       last_value(ts IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ts,
       user_id,
       coalesce(event_type, (SELECT event_type FROM cn WHERE event_type IS NOT NULL
                             GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type,
       coalesce(value, (SELECT median(value) FROM cn)) AS value,
       props
FROM cn"""


@register("fill_missing", sql_rounded(_AUTO_SQL, ["value"]))
def q_fill_missing(spark, sf):
    df = dirt.events_nulls(spark, sf).withColumn("unused", F.lit(None).cast("string"))
    return rounded(M.fill_missing(df, order_by=["event_id"], custom_na_values=["N/A"]))


# ---------------------------------------------------------------- D1-D2

_COPIES = "WITH " + dirt.EVENTS_COPIES_SQL + "\n"


@register("drop_duplicates", sql_rounded(_COPIES + "SELECT DISTINCT * FROM events_copies", ["value"]))
def q_drop_duplicates(spark, sf):
    return rounded(D.drop_duplicates(dirt.events_with_copies(spark, sf)))


@register("drop_duplicates_keep_first", sql_rounded("""SELECT * FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""",
                                                    ["o_totalprice"]))
def q_drop_duplicates_keep_first(spark, sf):
    od = load_table(spark, sf, "orders")
    return rounded(D.drop_duplicates(od, subset=["o_custkey"], order_by=["o_orderdate", "o_orderkey"]))


@register("duplicate_count", _COPIES + """SELECT count(*) AS total_rows,
       (SELECT count(*) FROM (SELECT DISTINCT * FROM events_copies)) AS distinct_rows,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM events_copies)) AS duplicate_rows
FROM events_copies""")
def q_duplicate_count(spark, sf):
    return D.duplicate_count(dirt.events_with_copies(spark, sf))


# ---------------------------------------------------------------- T1-T5

_TX = "WITH " + dirt.EVENTS_TEXT_SQL + "\n"


@register("coerce_numeric", sql_rounded(
    _TX + "SELECT event_id, TRY_CAST(value_text AS DOUBLE) AS value_text FROM events_text", ["value_text"]))
def q_coerce_numeric(spark, sf):
    df = dirt.events_as_text(spark, sf).select("event_id", "value_text")
    return rounded(T.coerce_numeric(df, ["value_text"]))


@register("coerce_datetime",
          _TX + "SELECT event_id, TRY_CAST(ts_text AS TIMESTAMP) AS ts_text FROM events_text")
def q_coerce_datetime(spark, sf):
    df = dirt.events_as_text(spark, sf).select("event_id", "ts_text")
    return T.coerce_datetime(df, ["ts_text"])


@register("detect_types", _TX + """SELECT event_id, CAST(id_text AS BIGINT) AS id_text, value_text,
       TRY_CAST(ts_text AS TIMESTAMP) AS ts_text, type_text,
       TRY_CAST(mixed_text AS BIGINT) AS mixed_text
FROM events_text""")
def q_detect_types(spark, sf):
    df = dirt.events_as_text(spark, sf)
    return T.detect_and_convert(df, min_ratio=0.9)


@register("clean_number_text", sql_rounded(_TX + f"""SELECT event_id,
       CASE WHEN regexp_matches(value_text, '{NUMBER_TEXT_PATTERN}')
            THEN TRY_CAST(regexp_replace(value_text, '[^0-9.\\-]', '', 'g') AS DOUBLE) END AS value_text
FROM events_text""", ["value_text"]))
def q_clean_number_text(spark, sf):
    df = dirt.events_as_text(spark, sf).select("event_id", "value_text")
    return rounded(T.clean_number_text(df, ["value_text"]))


@register("parse_dates", sql_rounded("""SELECT o_orderkey,
       TRY_CAST(CASE WHEN o_orderkey % 13 = 0 THEN 'not a date'
                     ELSE strftime(o_orderdate, '%Y-%m-%d') END AS TIMESTAMP) AS order_date,
       TRY_CAST(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS TIMESTAMP) AS "Ship Time",
       o_orderpriority AS priority, o_totalprice
FROM orders""", ["o_totalprice"]))
def q_parse_dates(spark, sf):
    od = load_table(spark, sf, "orders")
    df = od.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 13 == 0, F.lit("not a date"))
         .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("order_date"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("Ship Time"),
        F.col("o_orderpriority").alias("priority"), "o_totalprice")
    return rounded(T.parse_dates(df))


# ---------------------------------------------------------------- O1-O3

@register("outliers_to_median", sql_rounded("""WITH s AS (
  SELECT avg(value) AS m, stddev_pop(value) AS sd, median(value) AS md FROM events)
SELECT event_id, user_id, CASE WHEN abs((value - m) / sd) > 3 THEN md ELSE value END AS value
FROM events, s""", ["value"]))
def q_outliers_to_median(spark, sf):
    ev = load_table(spark, sf, "events").select("event_id", "user_id", "value")
    return rounded(O.outliers_to_median(ev, ["value"], 3.0))


@register("cap_zscore", sql_rounded("""WITH s AS (
  SELECT avg(value) AS m, stddev_samp(value) AS sds,
         count(*) FILTER (WHERE abs((value - avg_all) / sd_all) > 3) AS n_out
  FROM events, (SELECT avg(value) AS avg_all, stddev_pop(value) AS sd_all FROM events))
SELECT event_id, CASE WHEN n_out > 0 THEN least(greatest(value, m - 3 * sds), m + 3 * sds)
                      ELSE value END AS value
FROM events, s""", ["value"]))
def q_cap_zscore(spark, sf):
    ev = load_table(spark, sf, "events").select("event_id", "value")
    return rounded(O.cap_zscore(ev, ["value"], 3.0))


@register("cap_iqr", sql_rounded("""WITH s AS (
  SELECT quantile_cont(l_extendedprice, 0.25) AS q1e, quantile_cont(l_extendedprice, 0.75) AS q3e,
         quantile_cont(l_quantity, 0.25) AS q1q, quantile_cont(l_quantity, 0.75) AS q3q FROM lineitem)
SELECT l_orderkey, l_linenumber,
       least(greatest(l_extendedprice, q1e - 1.5 * (q3e - q1e)), q3e + 1.5 * (q3e - q1e)) AS l_extendedprice,
       least(greatest(l_quantity, q1q - 1.5 * (q3q - q1q)), q3q + 1.5 * (q3q - q1q)) AS l_quantity
FROM lineitem, s""", ["l_extendedprice", "l_quantity"]))
def q_cap_iqr(spark, sf):
    li = load_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return rounded(O.cap_iqr(li, ["l_extendedprice", "l_quantity"]))


# ---------------------------------------------------------------- C1-C2

def padded_documents(spark, sf):
    """documents with whitespace added around text: tab + ideographic space on
    doc_id % 3, two spaces + one space on doc_id % 2."""
    doc = load_table(spark, sf, "documents")
    did, text = F.col("doc_id"), F.col("text")
    padded = (F.when(did % 3 == 0, F.concat(F.lit("\t"), text, F.lit("　")))
              .when(did % 2 == 0, F.concat(F.lit("  "), text, F.lit(" ")))
              .otherwise(text))
    return doc.select("doc_id", padded.alias("text"),
                      F.concat(F.lit(" "), F.col("lang")).alias("lang"), "source")


_PADDED_SQL = """WITH padded AS (
  SELECT doc_id,
         CASE WHEN doc_id % 3 = 0 THEN chr(9) || text || chr(12288)
              WHEN doc_id % 2 = 0 THEN '  ' || text || ' '
              ELSE text END AS text,
         ' ' || lang AS lang, source
  FROM documents)
"""


@register("strip_whitespace", _PADDED_SQL + f"""SELECT doc_id,
       regexp_replace(text, '{STRIP_PATTERN}', '', 'g') AS text,
       regexp_replace(lang, '{STRIP_PATTERN}', '', 'g') AS lang,
       regexp_replace(source, '{STRIP_PATTERN}', '', 'g') AS source
FROM padded""")
def q_strip_whitespace(spark, sf):
    return C.strip_whitespace(padded_documents(spark, sf))


@register("clean_strings", _PADDED_SQL + f"""SELECT doc_id,
       lower(regexp_replace(text, '{STRIP_PATTERN}', '', 'g')) AS text,
       lower(regexp_replace(lang, '{STRIP_PATTERN}', '', 'g')) AS lang,
       lower(regexp_replace(source, '{STRIP_PATTERN}', '', 'g')) AS source
FROM padded""")
def q_clean_strings(spark, sf):
    return C.clean_strings(padded_documents(spark, sf))
