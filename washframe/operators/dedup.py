"""Duplicate rows: removal and counting.

Full-row removal is ``dropDuplicates`` (hash aggregate with map-side
combining, so a value repeated across a third of the table collapses on each
task before the shuffle). Keep-first on a key subset is a ``min(struct(order,
row))`` per key: bounded state per key, no window over a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washframe.functions.columns import q, value_of
from washframe.report import StepLog


def drop_duplicates(df: DataFrame, subset: list[str] | None = None,
                    order_by: list[str] | None = None, log: StepLog | None = None) -> DataFrame:
    """Drop repeated rows; missing equals missing (NaN is read as null first).

    With ``subset`` the first row per key along ``order_by`` is kept (ties and
    no ``order_by``: the smallest remaining row, deterministically).
    """
    norm = df.select(*[value_of(df, c).alias(c) for c in df.columns])
    if not subset:
        out = norm.dropDuplicates()
    else:
        order_by = [c for c in (order_by or []) if c not in subset]
        rest = [c for c in df.columns if c not in subset and c not in order_by]
        packed = F.struct(*[q(c).alias(f"o{i}") for i, c in enumerate(order_by)],
                          *[q(c).alias(f"r{i}") for i, c in enumerate(rest)])
        first = norm.groupBy(*[q(c) for c in subset]).agg(F.min(packed).alias("_first"))
        names = {c: f"_first.o{i}" for i, c in enumerate(order_by)}
        names.update({c: f"_first.r{i}" for i, c in enumerate(rest)})
        out = first.select(*[q(c) if c in subset else F.col(names[c]).alias(c) for c in df.columns])
    if log is not None:
        log.add("removed_duplicates")
    return out


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: ``total_rows``, ``distinct_rows``, ``duplicate_rows`` (= total - distinct)."""
    norm = df.select(*[value_of(df, c).alias(c) for c in df.columns])
    groups = norm.groupBy(*[q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("total_rows"),
        F.count(F.lit(1)).alias("distinct_rows")
    ).withColumn("duplicate_rows", F.col("total_rows") - F.col("distinct_rows"))
