"""Profiles: times, one shuffle of distinct values, one pass of the wide correlation."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd

from washframe.operators import profile


def test_describe_datetime_matches_pandas(spark):
    start = datetime(2020, 2, 29, 1, 2, 3, 456789)
    times = [start + timedelta(seconds=37 * i * i, microseconds=i) for i in range(25)]
    df = spark.createDataFrame([(t, None) for t in times] + [(None, None)], "t timestamp_ntz, e timestamp_ntz")
    t, e = sorted(profile.describe_datetime(df).collect(), key=lambda r: r.column_name, reverse=True)
    want = pd.Series(times).describe()
    assert t["count"] == 25 and (t["min"], t["max"]) == (times[0], times[-1])
    for ours, theirs in (("mean", "mean"), ("q25", "25%"), ("q50", "50%"), ("q75", "75%")):
        assert abs((t[ours] - want[theirs].to_pydatetime()).total_seconds()) <= 1e-6
    assert e["count"] == 0 and e["min"] is None and e["q50"] is None


def test_describe_datetime_of_instants_and_dates(spark):
    df = spark.sql("SELECT TIMESTAMP '2021-01-01 00:00:00Z' AS a, DATE '1969-12-31' AS b")
    rows = {r.column_name: r for r in profile.describe_datetime(df).collect()}
    assert rows["a"]["q50"] == datetime(2021, 1, 1)
    assert rows["b"]["mean"] == datetime(1969, 12, 31)
    assert profile.describe_datetime(df.select(df.a.cast("string").alias("s"))).collect() == []


def test_column_summary_values_and_plan(spark):
    df = spark.createDataFrame([(0.0, "b", True), (-0.0, "a", None), (None, "a", None), (2.5, None, None)],
                               "x double, s string, n boolean")
    out = profile.column_summary(df)
    rows = {r.name: r for r in out.collect()}
    assert [rows[c].unique_count for c in ("x", "s", "n")] == [2, 2, 1]
    assert [rows[c].missing_count for c in ("x", "s", "n")] == [1, 1, 3]
    assert rows["x"].sample_values == "0.0, 2.5" and rows["s"].sample_values == "a, b"
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    assert profile.column_summary(df, approx=True).columns == out.columns
    assert profile.column_summary(df, samples=0).columns == out.columns
    empty = {r.name: r for r in profile.column_summary(df.limit(0)).collect()}
    assert empty["s"].unique_count == 0 and empty["s"].sample_values is None


def test_wide_correlation_reads_once(spark, monkeypatch):
    monkeypatch.setattr(profile, "WIDE_CORR_SUMS", 0)
    pdf = pd.DataFrame(np.random.default_rng(3).normal(size=(60, 4)), columns=list("abcd"))
    out = profile.correlation_matrix(spark.createDataFrame(pdf))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    got = {(r.x, r.y): r.corr for r in out.collect()}
    want = pdf.corr()
    assert len(got) == 16 and all(abs(got[a, b] - want.loc[a, b]) < 1e-9 for a in "abcd" for b in "abcd")
