"""Untidy inputs: dates, codes, infinities, heavy tails, groups without a mean."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from washframe.operators import charts, coerce, columns
from washframe.operators.quantiles import exact_quantiles
from washframe.plans.cleaning import clean_data


def test_us_dates_survive_the_plan(spark):
    rows = [(i, f"{i % 12 + 1:02d}/{i % 28 + 1:02d}/2020", f"{i}D") for i in range(40)]
    out = clean_data(spark.createDataFrame(rows, "id long, join_date string, code string")).df
    assert dict(out.dtypes)["join_date"].startswith("timestamp") and dict(out.dtypes)["code"] == "string"
    assert out.where("join_date IS NULL").count() == 0


def test_unparsed_date_column_stays_text(spark):
    df = spark.createDataFrame([("soon",), (None,)], "due_date string")
    assert coerce.parse_dates(df).dtypes == [("due_date", "string")]


def test_offsets_become_utc_walls(spark):
    df = spark.createDataFrame([("2021-01-01T00:00:00+05:00",), ("2021-01-01T00:00:00Z",), ("2021-01-01 10:00:00",)],
                               "t string")
    got = [str(r.t) for r in coerce.coerce_datetime(df, ["t"]).collect()]
    assert got == ["2020-12-31 19:00:00", "2021-01-01 00:00:00", "2021-01-01 10:00:00"]


def test_density_on_tails(spark):
    x = np.random.default_rng(1).lognormal(0, 2, 4000)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    got = sorted((r.value, r.density) for r in charts.kde_data(df, "v").collect())
    h = x.std(ddof=1) * len(x) ** -0.2
    exact = [float(np.exp(-0.5 * ((g - x) / h) ** 2).sum() / (len(x) * h * math.sqrt(2 * math.pi))) for g, _ in got]
    assert len(got) == 100
    assert max(abs(a - d) for a, (_, d) in zip(exact, got)) < 1e-3 * max(exact)


def test_histogram_with_a_far_value(spark):
    df = spark.createDataFrame([(float(i % 10),) for i in range(1000)] + [(1e12,)], "v double")
    got = charts.histogram_data(df, "v").collect()
    assert sum(r["count"] for r in got) == 1001
    empty = charts.histogram_data(spark.createDataFrame([(None, "a")], "v double, h string"), "v", hue="h")
    assert empty.columns == ["h", "bin", "bin_low", "bin_high", "count", "density"] and empty.count() == 0


@pytest.mark.parametrize("limit", [1, 1_000_000])
def test_quantiles_with_infinities(spark, limit, monkeypatch):
    from washframe.operators import quantiles
    monkeypatch.setattr(quantiles, "RESOLVE_MAX", limit)
    df = spark.createDataFrame([(v,) for v in (1.0, math.inf, math.inf, math.inf)], "v double")
    got = exact_quantiles(df, [], "v", [0.5, 0.75], max_group_size=4 if limit > 1 else None).collect()[0]
    assert (got["q0"], got["q1"]) == (math.inf, math.inf)


def test_names_by_position_and_clear_errors(spark):
    df = spark.createDataFrame([(1, 2)], "a long, b long").toDF("ID", "id")
    assert columns.standardize_columns(df).columns == ["id", "id_2"]
    assert clean_data(df.union(spark.createDataFrame([(3, 4)], "a long, b long"))).df.columns == ["id", "id_2"]
    with pytest.raises(ValueError, match="needs a y column"):
        charts.create_plot(df, "line", "ID")


def test_before_and_after_nulls(spark):
    res = clean_data(spark.createDataFrame([(1.0, "x"), (None, "y"), (3.0, None)], "v double, s string"))
    assert res.nulls_before == {"v": 1, "s": 1} and set(res.nulls_after().values()) == {0}
    assert res.dtypes()["v"] == "double"


def test_group_without_mean_is_not_shown(spark):
    df = spark.createDataFrame([(g, float(g) if g < 10 else None) for g in range(25)], "x long, y double")
    assert charts.bar_data(df, "x", "y").count() == 10
    assert df.select(F.count("x")).first()[0] == 25
