"""Profiles of parts, united, against the profile of the whole."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from washframe.operators import stored_profiles as P


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(0, 30000, 1, 6).select(
        (F.col("id") % 3).alias("day"),
        F.when(F.col("id") % 7 == 0, float("nan")).otherwise(F.lit(1e9) + F.sin("id") * 5).alias("x"),
        F.when(F.col("id") % 11 > 0, F.concat(F.lit("w"), F.col("id") % 4000)).alias("s"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id)").alias("t"),
        F.lit(None).cast("int").alias("none"), F.array("id").alias("a"))


def _by_name(df):
    return {r.name: r for r in df.collect()}


def test_parts_unite_to_the_whole(spark, table, tmp_path):
    table = table.drop("day").withColumn("day", F.lit(1))
    a, b = table.where("x > 1e9 OR s IS NULL"), table.where("NOT coalesce(x > 1e9 OR s IS NULL, false)")
    assert a.count() + b.count() == 30000
    whole = _by_name(P.profile_summary(P.unite_profiles(P.profile_parts(table))))
    united = _by_name(P.profile_summary(P.unite_profiles(P.profile_parts(a), P.profile_parts(b))))
    assert list(whole) and set(united) == set(table.columns)
    for name, w in whole.items():
        u = united[name]
        for f in ("position", "dtype", "n_rows", "missing_count", "min", "max", "first_value", "last_value",
                  "first_time", "last_time", "unique_estimate"):
            assert u[f] == w[f], (name, f)
    x = np.array([r.x for r in table.select("x").collect()])
    x = x[~np.isnan(x)]
    u = united["x"]
    assert u.n_rows == 30000 and u.missing_count == 30000 - len(x)
    # a mean of 1e9 is known to 1.2e-7 only, and so is the distance between the parts' means
    assert np.isclose(u["mean"], x.mean(), rtol=1e-14) and np.isclose(u["std"], x.std(ddof=1), rtol=1e-7)
    for p, q in ((0.25, u.q25), (0.5, u.q50), (0.75, u.q75)):
        assert abs((x <= q).mean() - p) < 0.01
    assert abs(united["s"].unique_estimate - 4000) < 200 and united["s"].last_value == "w999"
    assert united["t"].first_time == dt.datetime(2024, 1, 1) and united["t"].min is None
    assert united["none"].unique_estimate == 0 and united["none"]["mean"] is None and united["none"].q50 is None
    assert united["a"].unique_estimate is None and united["a"].missing_count == 0


def test_by_groups_and_types_that_differ(spark, table):
    per = P.profile_parts(table, by=["day"])
    assert per.columns[0] == "day" and per.select("day").distinct().count() == 3
    rows = P.profile_summary(P.unite_profiles(per, per, by=["day"]), by=["day"]).where("name = 's'").collect()
    assert sorted((r.day, r.n_rows) for r in rows) == [(0, 20000), (1, 20000), (2, 20000)]
    other = spark.createDataFrame([(1,)], "x int")
    both = P.profile_summary(P.unite_profiles(P.profile_parts(table.select("x")), P.profile_parts(other))).collect()
    assert sorted((r.dtype, r.n_rows) for r in both) == [("double", 30000), ("int", 1)]


def test_clashing_names_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 2, 3.0), (1, 2, 3.0), (None, 2, float("inf"))], "`_profile` int, g0 int, `a b` double")
    r = _by_name(P.profile_summary(P.unite_profiles(P.profile_parts(df, by=["g0"]))))
    assert r["_profile"].missing_count == 1 and r["a b"].max == float("inf") and set(r) == {"_profile", "a b"}
    assert set(_by_name(P.profile_summary(P.unite_profiles(P.profile_parts(df))))) == {"_profile", "g0", "a b"}
    with pytest.raises(ValueError, match="rename"):
        P.profile_parts(df.toDF("x", "name", "y"), by=["name"])
    none = P.unite_profiles(P.profile_parts(df.limit(0)))
    assert none.collect() == []
    some = P.unite_profiles(P.profile_parts(df.limit(0)), P.profile_parts(df))
    assert P.table_estimate(some).collect()[0][:] == (3, 2, 1)


def test_store_replaces_a_part(spark, table, tmp_path):
    store = P.ProfileStore(spark, str(tmp_path / "profiles"))
    for day in (0, 1, 2, 1):
        store.add(f"day/{day}", table.where(F.col("day") == day))
    r = P.table_estimate(store.profile()).collect()[0]
    assert r.total_rows == 30000 and abs(r.distinct_rows - 30000) < 1500
    assert _by_name(P.profile_summary(store.profile()))["x"].n_rows == 30000
