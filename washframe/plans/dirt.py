"""Deterministic dirt for the registered queries, defined twice: Spark and SQL.

The driver tables carry no nulls, NA tokens, duplicates or stray whitespace, so
each query dirties its input by fixed expressions of the row key (the recipes
of FIXTURES.md). Every row is kept; the modulus only decides which cells get
dirty. The SQL twins below build exactly the same tables for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from washframe.sources.tables import load_table


def _null_when(cond, col):
    return F.when(cond, F.lit(None)).otherwise(col)


def events_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """events with null ts (id % 5), NA token event_type (id % 11), null value (id % 7)."""
    return dirty_nulls(load_table(spark, sf, "events"))


def dirty_nulls(ev: DataFrame) -> DataFrame:
    """The ``events_nulls`` dirt on any events frame (batch or stream)."""
    eid = F.col("event_id")
    return ev.select(
        "event_id",
        _null_when(eid % 5 == 0, F.col("ts")).alias("ts"),
        "user_id",
        F.when(eid % 11 == 0, F.lit("N/A")).otherwise(F.col("event_type")).alias("event_type"),
        _null_when(eid % 7 == 0, F.col("value")).alias("value"),
        "props")


EVENTS_NULLS_SQL = """events_nulls AS (
  SELECT event_id,
         CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END AS ts,
         user_id,
         CASE WHEN event_id % 11 = 0 THEN 'N/A' ELSE event_type END AS event_type,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value,
         props
  FROM events)"""


def events_tokens_nulled(spark: SparkSession, sf: str) -> DataFrame:
    """events_nulls with its NA tokens already read as null."""
    df = events_nulls(spark, sf)
    return df.withColumn("event_type", _null_when(F.col("event_type") == "N/A", F.col("event_type")))


EVENTS_CLEAN_NULLS_SQL = EVENTS_NULLS_SQL + """,
events_cn AS (
  SELECT event_id, ts, user_id, NULLIF(event_type, 'N/A') AS event_type, value, props
  FROM events_nulls)"""


def events_with_copies(spark: SparkSession, sf: str) -> DataFrame:
    """events plus a second copy of every row with id % 10 = 0 (full-row duplicates)."""
    ev = load_table(spark, sf, "events")
    return ev.unionByName(ev.where(F.col("event_id") % 10 == 0))


EVENTS_COPIES_SQL = """events_copies AS (
  SELECT * FROM events
  UNION ALL
  SELECT * FROM events WHERE event_id % 10 = 0)"""


def events_as_text(spark: SparkSession, sf: str) -> DataFrame:
    """events rendered as text columns with junk cells and formatted numbers.

    id_text: integer text; value_text: number text, '$' prefix on id % 4, 'n/a?'
    junk on id % 13; ts_text: timestamp text, 'not a date' on id % 13;
    type_text: plain words; mixed_text: digits except 'x' on id % 17.
    """
    ev = load_table(spark, sf, "events")
    eid = F.col("event_id")
    value_text = F.format_string("%.2f", F.col("value"))
    return ev.select(
        "event_id",
        F.col("event_id").cast("string").alias("id_text"),
        F.when(eid % 13 == 0, F.lit("n/a?"))
         .when(eid % 4 == 0, F.concat(F.lit("$"), value_text))
         .otherwise(value_text).alias("value_text"),
        F.when(eid % 13 == 0, F.lit("not a date"))
         .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("ts_text"),
        F.col("event_type").alias("type_text"),
        F.when(eid % 17 == 0, F.lit("x")).otherwise(F.col("user_id").cast("string")).alias("mixed_text"))


EVENTS_TEXT_SQL = """events_text AS (
  SELECT event_id,
         CAST(event_id AS VARCHAR) AS id_text,
         CASE WHEN event_id % 13 = 0 THEN 'n/a?'
              WHEN event_id % 4 = 0 THEN '$' || printf('%.2f', value)
              ELSE printf('%.2f', value) END AS value_text,
         CASE WHEN event_id % 13 = 0 THEN 'not a date'
              ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts_text,
         event_type AS type_text,
         CASE WHEN event_id % 17 = 0 THEN 'x' ELSE CAST(user_id AS VARCHAR) END AS mixed_text
  FROM events)"""
