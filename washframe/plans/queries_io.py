"""Registered queries: sources and sinks (S1-S4) and the cleaning plan (L1, A5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from washframe.functions.text import STRIP_PATTERN
from washframe.plans import dirt
from washframe.plans.cleaning import CleaningOptions, clean_csv, clean_data
from washframe.plans.registry import register, rounded, sql_rounded
from washframe.session import scratch_path
from washframe.sources import files as S
from washframe.sources.tables import load_table

EV_COLS = "event_id, ts, user_id, event_type, value, props"

# ---------------------------------------------------------------- S1-S4


@register("read_csv", sql_rounded("WITH " + dirt.EVENTS_CLEAN_NULLS_SQL +
                                  f"\nSELECT {EV_COLS} FROM events_cn", ["value"]))
def q_read_csv(spark, sf):
    """events (with NA tokens and nulls) written as CSV, read back: tokens -> null,
    types detected (bigint, timestamp, double, text)."""
    path = S.write_csv(dirt.events_nulls(spark, sf), scratch_path(spark, "csv-in"))
    return rounded(S.read_csv(spark, path, na_tokens=["N/A"]))


@register("write_csv", sql_rounded("WITH " + dirt.EVENTS_NULLS_SQL +
                                   f"\nSELECT {EV_COLS} FROM events_nulls", ["value"]))
def q_write_csv(spark, sf):
    """CSV sink round trip with the original schema: every cell survives."""
    df = dirt.events_nulls(spark, sf)
    path = S.write_csv(df, scratch_path(spark, "csv-out"))
    return rounded(S.read_csv(spark, path, schema=df.schema))


_LINED_SQL = """replace(replace(text, ', ', chr(10) || '"'), '. ', '.' || chr(10) || chr(10))"""


@register("read_csv_multiline", f"SELECT doc_id, lang, {_LINED_SQL} AS text FROM documents")
def q_read_csv_multiline(spark, sf):
    """documents with newlines and quotes put into the texts, through CSV files whose
    quoted cells span lines and splits."""
    docs = load_table(spark, sf, "documents")
    lined = F.replace(F.replace("text", F.lit(", "), F.lit('\n"')), F.lit(". "), F.lit(".\n\n"))
    df = docs.select("doc_id", "lang", lined.alias("text"))
    return S.read_csv(spark, S.write_csv(df, scratch_path(spark, "csv-lines")), schema=df.schema)


@register("clean_csv", """SELECT event_id, last_value(CASE WHEN event_id % 7 <> 0 THEN ts END IGNORE NULLS) OVER (
         ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ts, user_id, event_type
FROM events""")
def q_clean_csv(spark, sf):
    """events with null times written as CSV in event order, then cleaned: the times are
    filled along the order of the rows in the files."""
    ts = F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("ts")
    df = load_table(spark, sf, "events").select("event_id", ts, "user_id", "event_type").orderBy("event_id")
    path = S.write_csv(df, scratch_path(spark, "csv-order"))
    return clean_csv(spark, path, CleaningOptions(handle_outliers=False, remove_constant_columns=False)).df


@register("preview", sql_rounded("SELECT * FROM orders ORDER BY o_orderkey LIMIT 5", ["o_totalprice"]))
def q_preview(spark, sf):
    return rounded(S.preview(load_table(spark, sf, "orders"), ["o_orderkey"]))


@register("file_manifest", """SELECT regexp_extract(filename, '([^/]+)$', 1) AS file_name,
       size AS size_bytes, sha256(content) AS sha256, 'parquet' AS extension,
       false AS extension_ok, size <= 104857600 AS size_ok, true AS sha256_ok,
       'bad_extension' AS verdict
FROM read_blob('/root/testdata/sf0.01/*.parquet')""")
def q_file_manifest(spark, sf):
    out = S.file_manifest(spark, f"{sf.rstrip('/')}/*.parquet")
    return out.drop("path", "modified")


# ---------------------------------------------------------------- L1, A5

def dirty_events_frame(spark, sf):
    """events with messy names, NA tokens, nulls, padded text, number text, a
    constant and an empty column, bad dates, and copies of every 10th row."""
    ev = load_table(spark, sf, "events")
    eid = F.col("event_id")
    base = ev.select(
        eid.alias("Event ID"),
        F.when(eid % 7 == 0, F.lit(None)).otherwise(F.col("ts")).alias("Event Time"),
        F.col("user_id").cast("string").alias("User-Id"),
        F.when(eid % 11 == 0, F.lit("N/A"))
         .otherwise(F.concat(F.lit("  "), F.col("event_type"), F.lit(" "))).alias("Event Type"),
        F.when(eid % 5 == 0, F.lit(None)).otherwise(F.col("value")).alias("Value ($)"),
        F.lit("web").alias("Source"),
        F.lit(None).cast("string").alias("Empty"),
        F.when(eid % 13 == 0, F.lit("not a date"))
         .otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("Signup Date"),
        F.col("props").alias("Props"))
    return base.unionByName(base.where(F.col("Event ID") % 10 == 0))


_DIRTY_SQL = """base AS (
  SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS event_time,
         CAST(user_id AS VARCHAR) AS user_id,
         CASE WHEN event_id % 11 = 0 THEN 'N/A' ELSE '  ' || event_type || ' ' END AS event_type,
         CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value,
         'web' AS source,
         CASE WHEN event_id % 13 = 0 THEN 'not a date' ELSE strftime(ts, '%Y-%m-%d') END AS signup_date,
         props
  FROM events),
dirty AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE event_id % 10 = 0),
tok AS (SELECT event_id, event_time, user_id, NULLIF(event_type, 'N/A') AS event_type, value, source,
               signup_date, props FROM dirty),
filled AS (
  SELECT event_id,
         last_value(event_time IGNORE NULLS) OVER (ORDER BY event_id
                                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS event_time,
         user_id,
         coalesce(event_type, (SELECT event_type FROM tok WHERE event_type IS NOT NULL GROUP BY event_type
                               ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type,
         coalesce(value, (SELECT median(value) FROM tok)) AS value,
         source, signup_date, props
  FROM tok),
dedup AS (SELECT DISTINCT * FROM filled),
typed AS (SELECT event_id, event_time, CAST(user_id AS BIGINT) AS user_id, event_type, value, source,
                 signup_date, props FROM dedup),
st AS (SELECT avg(value) AS m, stddev_pop(value) AS sd, median(value) AS md FROM typed),
outl AS (SELECT typed.*, CASE WHEN abs((value - m) / sd) > 3 THEN md ELSE value END AS value2,
                abs((value - m) / sd) > 3 AS is_out
         FROM typed, st)"""

_CLEAN_SQL = sql_rounded("WITH " + _DIRTY_SQL + f"""
SELECT event_id, event_time, user_id,
       regexp_replace(event_type, '{STRIP_PATTERN}', '', 'g') AS event_type,
       value2 AS value,
       TRY_CAST(regexp_replace(signup_date, '{STRIP_PATTERN}', '', 'g') AS TIMESTAMP) AS signup_date,
       regexp_replace(props, '{STRIP_PATTERN}', '', 'g') AS props
FROM outl""", ["value"])


def _run_plan(spark, sf):
    return clean_data(dirty_events_frame(spark, sf),
                      CleaningOptions(custom_na_values=["N/A"], order_by=["Event ID"]))


@register("clean_data", _CLEAN_SQL)
def q_clean_data(spark, sf):
    return rounded(_run_plan(spark, sf).df)


_REPORT_SQL = "WITH " + _DIRTY_SQL + """,
counts AS (SELECT count(*) FILTER (WHERE event_time IS NULL) AS n_time,
                  count(*) FILTER (WHERE event_type IS NULL) AS n_type,
                  count(*) FILTER (WHERE value IS NULL) AS n_value FROM tok)
SELECT * FROM (
  SELECT 1 AS step_no, 'standardized_column_names' AS step, 0 AS count
  UNION ALL SELECT 2, 'dropped_empty_column_empty', 0
  UNION ALL SELECT 3, 'filled_missing_values_event_time', (SELECT n_time FROM counts)
  UNION ALL SELECT 4, 'filled_missing_values_event_type', (SELECT n_type FROM counts)
  UNION ALL SELECT 5, 'filled_missing_values_value', (SELECT n_value FROM counts)
  UNION ALL SELECT 6, 'removed_duplicates', (SELECT count(*) FROM dirty) - (SELECT count(*) FROM dedup)
  UNION ALL SELECT 7, 'converted_user_id_to_numeric', 0
  UNION ALL SELECT 8, 'handled_outliers_value', (SELECT count(*) FILTER (WHERE is_out) FROM outl)
  UNION ALL SELECT 9, 'stripped_whitespace', 0
  UNION ALL SELECT 10, 'parsed_signup_date_as_datetime', 0
  UNION ALL SELECT 11, 'removed_constant_columns', 0)"""


@register("cleaning_report", _REPORT_SQL)
def q_cleaning_report(spark, sf):
    res = _run_plan(spark, sf)
    return res.report(spark).select("step_no", "step", "count")


_COLUMNS_SQL = "WITH " + _DIRTY_SQL + """,
cleaned AS (""" + _CLEAN_SQL + """),
b AS (SELECT count(*) AS n, count(event_time) AS t, count(event_type) AS y, count(value) AS v FROM tok),
a AS (SELECT count(*) AS n, count(event_time) AS t, count(signup_date) AS s FROM cleaned)
SELECT position, original_name, column_name,
       CASE column_name WHEN 'event_time' THEN b.n - b.t WHEN 'event_type' THEN b.n - b.y WHEN 'value' THEN b.n - b.v
                        WHEN 'empty' THEN b.n ELSE 0 END AS nulls_before,
       CASE WHEN dropped THEN NULL WHEN column_name = 'event_time' THEN a.n - a.t
            WHEN column_name = 'signup_date' THEN a.n - a.s ELSE 0 END AS nulls_after, dropped
FROM (VALUES (0, 'Event ID', 'event_id', false), (1, 'Event Time', 'event_time', false),
             (2, 'User-Id', 'user_id', false), (3, 'Event Type', 'event_type', false), (4, 'Value ($)', 'value', false),
             (5, 'Source', 'source', true), (6, 'Empty', 'empty', true), (7, 'Signup Date', 'signup_date', false),
             (8, 'Props', 'props', false)) AS c(position, original_name, column_name, dropped), a, b"""


@register("column_report", _COLUMNS_SQL)
def q_column_report(spark, sf):
    """The cleaning report's columns: missing cells before and after, and what was dropped."""
    return _run_plan(spark, sf).column_report().drop("dtype_before", "dtype_after")


# ---------------------------------------------------------------- streaming apply

_STREAM_SQL = sql_rounded("WITH " + dirt.EVENTS_CLEAN_NULLS_SQL + """,
f AS (SELECT event_id, ts, user_id,
             coalesce(event_type, (SELECT event_type FROM events_cn WHERE event_type IS NOT NULL
                                   GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type,
             coalesce(value, (SELECT median(value) FROM events_cn)) AS value, props
      FROM events_cn),
s AS (SELECT avg(value) AS m, stddev_pop(value) AS sd, median(value) AS md FROM f)
SELECT event_id, ts, user_id, event_type,
       CASE WHEN abs((value - m) / sd) > 3 THEN md ELSE value END AS value, props
FROM f, s""", ["value"])


@register("stream_clean", _STREAM_SQL)
def q_stream_clean(spark, sf):
    """Fit on the batch table, then clean the same table read as a file stream."""
    from washframe.streaming.fitted import StreamCleaner, read_stream, run_to_table
    batch = dirt.events_nulls(spark, sf)
    cleaner = StreamCleaner.fit(batch, na_tokens=["N/A"])
    raw = load_table(spark, sf, "events")
    stream = read_stream(spark, sf, raw.schema, glob="events.parquet")
    cleaned = cleaner.transform(dirt.dirty_nulls(stream))
    return rounded(run_to_table(cleaned, "stream-clean", spark))
