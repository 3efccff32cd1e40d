"""Fills with copies and clashing names, histograms of far and infinite values."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from washframe.operators import charts, ordered_fill
from washframe.report import StepLog

HELPERS = ["_tb", "_key", "_blk", "_g", "_f0", "_copies", "_chunk", "u0"]


@pytest.mark.parametrize("fill", [ordered_fill.fill_ffill, ordered_fill.fill_bfill])
def test_columns_named_like_helpers(spark, fill):
    df = spark.range(40).selectExpr("id AS k", "IF(id % 3 = 0, id, null) AS v", *[f"id AS `{c}`" for c in HELPERS])
    got = fill(df, ["v"], ["k"], blocks=4)
    assert got.columns == df.columns
    step = 1 if fill is ordered_fill.fill_bfill else 0
    assert {r.k: r.v for r in got.collect()} == {k: min((k + 2) // 3 * 3, 99) if step else k // 3 * 3 for k in range(40)}
    by = fill(df.withColumn("v", F.expr("IF(k % 3 = 0, k, null)")), ["v"], ["_key"], ["_g"], blocks=3)
    assert by.count() == 40


def test_unknown_order_column(spark):
    with pytest.raises(ValueError, match="unknown columns: nope"):
        ordered_fill.fill_ffill(spark.range(3), ["id"], ["nope"])


def test_copies_of_one_row_spread(spark, monkeypatch):
    """A row copied for a third of the table: the fill equals the plain window, and no
    task holds more than a small share of the rows."""
    monkeypatch.setattr(ordered_fill, "COPIES_CHUNK", 500)
    n = 30_000
    df = spark.range(n).selectExpr("IF(id % 3 = 0, 5000L, id) AS k", "IF(id % 3 = 0, null, IF(id % 4 = 0, null, id)) AS v",
                                   "IF(id % 3 = 0, 'x', 'y') AS s")
    got = ordered_fill.fill_ffill(df, ["v"], ["k"], blocks=40)
    assert got.groupBy("k", "s").count().exceptAll(df.groupBy("k", "s").count()).count() == 0
    tie = F.xxhash64("k", "v", "s")
    w = Window.orderBy(F.col("k").asc_nulls_first(), tie).rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("k", F.last("v", ignorenulls=True).over(w).alias("v"), "s")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 0.3 * n     # 8 partitions here; a plain window over blocks gives one task a third


def test_blocks_follow_the_row_count(spark):
    assert ordered_fill._blocks(spark.range(1), None, 10) == 1
    assert ordered_fill._blocks(spark.range(1), None, 10 ** 9) == 2000
    assert ordered_fill._blocks(spark.range(1), 7, 10) == 7


def test_histogram_of_infinite_values(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 2.5, math.inf, -math.inf, None)], "v double")
    log = StepLog()
    rows = charts.histogram_data(df, "v", log=log).collect()
    assert sum(r["count"] for r in rows) == 3 and rows[0].bin_low == 1.0 and max(r.bin_high for r in rows) == 2.5
    assert log.to_frame(spark).collect()[0]["count"] == 2
    assert sum(r["count"] for r in charts.create_plot(df, "histogram", "v").collect()) == 3
    only = spark.createDataFrame([(math.inf,)], "v double")
    assert charts.histogram_data(only, "v").collect() == []
    assert set(charts.plot_tables(df, "histogram", "v")) == {"data", "curve"}


@pytest.mark.parametrize("far", [[1e300], [1e308, -1e308], [1e18], [5e-324]])
def test_histogram_of_far_values(spark, far):
    values = [*np.random.default_rng(0).normal(size=200).tolist(), *far]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = charts.histogram_data(df, "v").where("count > 0").collect()
    assert sum(r["count"] for r in rows) == len(values)
    assert all(math.isfinite(r.bin_low) and math.isfinite(r.bin_high) and r.bin >= 0 for r in rows)


def test_box_with_helper_names(spark):
    df = spark.createDataFrame([(k % 2, float(k), k % 3) for k in range(60)], "`_y` int, `_lo` double, g0 int")
    rows = {(r["_y"], r["g0"]): r for r in charts.box_data(df, "_y", "_lo", hue="g0").collect()}
    for (a, b), r in rows.items():
        v = [float(k) for k in range(60) if k % 2 == a and k % 3 == b]
        assert (r.n, r.q1, r.median, r.q3) == (len(v), *np.percentile(v, [25, 50, 75]))
    assert charts.box_outliers(df, "_y", "_lo").columns == ["_y", "_lo"]


def test_pair_diagonal_with_hue(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(float(a), float(b), "pq"[k % 2]) for k, (a, b) in enumerate(rng.normal(size=(80, 2)))],
                               "a double, h double, s string")
    got = charts.pair_diagonal(df, gridsize=20, hue="s")
    assert got.columns == ["column_name", "hue", "point", "value", "density"]
    one = {r.point: r for r in got.where("column_name = 'h' AND hue = 'p'").collect()}
    want = {r.point: r for r in charts.kde_data(df.where("s = 'p'"), "h", gridsize=20).collect()}
    assert len(one) == 20 and all(abs(one[k].density - want[k].density) < 1e-9 for k in want)
    many = df.withColumn("s", F.expr("cast(a as string)"))
    assert charts.pair_diagonal(many, gridsize=20, hue="s").columns == ["column_name", "point", "value", "density"]
