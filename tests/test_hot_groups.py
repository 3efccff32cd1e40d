"""Joins with one row per group above the broadcast bound: hot groups do not fill a task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from washframe.operators import charts, hot_keys, quantiles


@pytest.fixture
def hot(spark):
    """6,000 rows over 8 partitions, a third of them in group 0, and null keys and values."""
    df = spark.range(0, 6000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97).alias("g"),
        F.when(F.col("id") % 50 == 1, None).otherwise(F.sin("id") * 100 + F.col("id") % 7).alias("y"))
    return df.withColumn("g", F.when(F.col("g") != 13, F.col("g")))


def _rows(df, keys, digits=9):
    return {tuple(r[k] for k in keys): tuple(round(v, digits) if isinstance(v, float) else v for v in r)
            for r in df.orderBy(*df.columns).collect()}


def test_hot_rows_are_not_shuffled(spark, hot):
    groups = hot.where("g IS NOT NULL").groupBy("g").agg(F.count("*").alias("_n")).persist()
    n = groups.count()
    out = hot_keys.join_groups(hot, groups, ["g"], "_n", n, 0)
    want = hot.join(groups, "g")
    assert out.exceptAll(want).isEmpty() and want.exceptAll(out).isEmpty()
    share = out.where("g = 0").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert share <= out.where("g = 0").count() / 7        # 8 partitions of rows
    heavy = groups.where(hot_keys.hot_share(groups, "_n")).count()
    assert 1 <= heavy < hot_keys.HOT_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in text and text.count("strategy=broadcast") == 2 and "Union" in text
    groups.unpersist()


def test_no_groups(spark, hot):
    none = hot.where("g = -1").groupBy("g").agg(F.count("*").alias("_n"))
    assert hot_keys.join_groups(hot, none, ["g"], "_n", 1, 0).isEmpty()


def test_boxes_violins_and_quantiles_are_the_same_above_the_bound(spark, hot, monkeypatch):
    def all_of():
        found = [_rows(charts.box_data(hot, "g", "y"), ["g"]), _rows(charts.box_outliers(hot, "g", "y"), ["g", "y"]),
                 _rows(charts.violin_data(hot, "g", "y", gridsize=9), ["g", "point"])]
        found.append(_rows(quantiles.exact_quantiles(hot.where("g IS NOT NULL"), ["g"], "y", [0.1, 0.5], resolve_max=100), ["g"]))
        return found

    below = all_of()
    monkeypatch.setattr(charts, "SMALL_SIDE_ROWS", 0)
    monkeypatch.setattr(quantiles, "BROADCAST_TARGETS", 0)
    assert all_of() == below
    pdf = hot.toPandas().dropna()
    for g, y in pdf.groupby("g")["y"]:
        assert np.allclose(below[3][g,][2:], np.quantile(y, [0.1, 0.5]))
