"""Joins of rows with one row per group, where a few groups may hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from washframe.functions.columns import q

HOT_PER_PARTITION = 4   # a group is hot beyond this part of a partition's even share


def hot_share(groups: DataFrame, count: str) -> Column | None:
    """Condition for the hot groups: those with more than 1 / (4 x shuffle partitions) of
    all rows, so there are fewer than 4 x shuffle partitions of them. None without rows."""
    most = HOT_PER_PARTITION * int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = groups.agg(F.sum(F.col(count).cast("double"))).first()[0]
    return F.col(count) * F.lit(float(most)) > F.lit(total) if total else None


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, n_groups: int, small: int) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (stored or persisted; ``count`` is the rows
    of each row's group) on ``keys``.

    Up to ``small`` rows of ``groups`` are broadcast. Beyond that only the hot ones are,
    whose number is bounded, so their rows stay where they are; the rows of all other
    groups are shuffled, and none of these groups fills more than a part of a task."""
    if n_groups <= small:
        return rows.join(F.broadcast(groups), on=keys)
    hot = hot_share(groups, count)
    if hot is None:
        return rows.join(groups, on=keys)
    heavy = groups.where(hot)
    light_rows = rows.join(F.broadcast(heavy.select(*[q(k) for k in keys]).distinct()), on=keys, how="left_anti")
    return rows.join(F.broadcast(heavy), on=keys).unionByName(light_rows.join(groups.where(~hot), on=keys))
