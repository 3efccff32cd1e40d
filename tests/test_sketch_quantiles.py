"""Exact quantiles of whole columns by sketches and literal brackets, against numpy."""

import time

import numpy as np
import pytest

from washframe.operators import quantiles

PROBS = [0.0, 0.001, 0.25, 0.5, 0.75, 0.9, 1.0]


def check(spark, columns, monkeypatch=None):
    import pandas as pd
    df = spark.createDataFrame(pd.DataFrame(columns)).repartition(5)
    got = quantiles.column_quantiles(df, list(columns), PROBS)
    for name, v in columns.items():
        v = np.asarray(v, dtype=float)
        v = np.sort(v[~np.isnan(v)])
        for p, q in zip(PROBS, got[name]):
            if not len(v):
                assert q is None
                continue
            at = p * (len(v) - 1)
            a, b, part = v[int(np.floor(at))], v[int(np.ceil(at))], at - np.floor(at)
            want = a if a == b or part == 0 else (1 - part) * a + part * b
            assert q == want or abs(q - want) <= 1e-12 * max(1, abs(want)), (name, p, q, want)


@pytest.mark.parametrize("read_max", [200_000, 50, 3])
def test_columns_of_all_kinds(spark, monkeypatch, read_max):
    monkeypatch.setattr(quantiles, "READ_MAX", read_max)
    rng, n = np.random.default_rng(read_max), 6000
    hot = np.where(rng.random(n) < 0.6, 7.0, rng.normal(size=n) * 10)
    holes = np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n))
    ends = rng.normal(size=n)
    ends[:40], ends[40:100] = np.inf, -np.inf
    check(spark, {"normal": rng.normal(size=n), "hot": hot, "holes": holes, "ends": ends, "far": rng.lognormal(0, 8, n),
                  "two": rng.integers(0, 2, n).astype(float), "one": np.full(n, 3.5), "none": np.full(n, np.nan),
                  "whole": rng.integers(-50, 50, n)})


def test_sketch_that_is_off_is_opened_up(spark, monkeypatch):
    """Counts decide: brackets that miss their rank are widened to the column's ends."""
    inner, calls = quantiles._closed_in, []

    def off(row, i, ranks, below):
        calls.append(i)
        return (row["mn0"] - 2, row["mn0"] - 1) if len(calls) <= 7 else inner(row, i, ranks, below)

    monkeypatch.setattr(quantiles, "_closed_in", off)
    check(spark, {"v": np.random.default_rng(1).normal(size=500)})


def test_few_rows(spark):
    for n in (1, 2, 3):
        check(spark, {"v": np.arange(n) * 1.5})


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double, b int")
    assert quantiles.column_quantiles(df, ["a", "b"], [0.5]) == {"a": [None], "b": [None]}


def test_long_columns_in_few_jobs(spark):
    df = spark.range(600_000).selectExpr(*[f"rand({k}) * {k + 1} AS c{k}" for k in range(4)])
    from washframe.session import checkpoint_root
    checkpoint_root(spark)
    tracker, group = spark.sparkContext.statusTracker(), f"quantiles-{time.time()}"
    spark.sparkContext.setJobGroup(group, "quantiles")
    got = quantiles.column_quantiles(df, [f"c{k}" for k in range(4)], [0.25, 0.5, 0.75])
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert all(abs(q - (k + 1) * p) < 0.02 * (k + 1) for k in range(4) for q, p in zip(got[f"c{k}"], (0.25, 0.5, 0.75)))
    assert len(tracker.getJobIdsForGroup(group)) <= 10
