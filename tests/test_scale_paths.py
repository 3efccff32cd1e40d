"""Brute-force checks of the operators built to avoid single-task hot spots."""

import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from washframe.operators import charts, missing
from washframe.operators.ordered_fill import ordered_fill
from washframe.operators.quantiles import exact_quantiles


def _frame(spark, n=4000, seed=7):
    rng = np.random.default_rng(seed)
    # one hot group holding about a third of all rows, heavy ties, NaN and nulls
    g = np.where(rng.random(n) < 0.35, "hot", rng.choice(["a", "b", "c", "d"], n))
    v = np.round(rng.normal(50, 20, n), 1)
    v[rng.random(n) < 0.05] = np.nan
    pdf = pd.DataFrame({"g": g, "v": v, "k": np.arange(n)})
    return spark.createDataFrame(pdf), pdf


@pytest.mark.parametrize("resolve_max", [30, 400, 10**6])
def test_exact_quantiles_match_numpy(spark, resolve_max):
    df, pdf = _frame(spark)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {r.g: [r[f"q{i}"] for i in range(len(probs))]
           for r in exact_quantiles(df, ["g"], "v", probs, resolve_max=resolve_max).collect()}
    for g, part in pdf.dropna().groupby("g"):
        want = np.quantile(part.v.to_numpy(), probs)   # numpy 'linear'
        assert got[g] == pytest.approx(want, rel=1e-12, abs=1e-9), g
    glob = exact_quantiles(df, [], "v", [0.5], resolve_max=resolve_max).collect()[0]
    assert glob.q0 == pytest.approx(float(np.nanmedian(pdf.v)))


def test_exact_quantiles_single_value_hot_key(spark):
    df = spark.createDataFrame([(1.0,)] * 500 + [(float(i),) for i in range(20)], "v double")
    r = exact_quantiles(df, [], "v", [0.5, 0.99], resolve_max=10).collect()[0]
    vals = np.array([1.0] * 500 + list(range(20)), dtype=float)
    assert [r.q0, r.q1] == pytest.approx(list(np.quantile(vals, [0.5, 0.99])))


@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("blocks", [1, 7, 64, 2000])
def test_ordered_fill_matches_pandas(spark, backward, blocks):
    df, pdf = _frame(spark, n=3000, seed=3)
    df = df.withColumn("v", F.when(F.isnan("v"), None).otherwise(F.col("v")))
    out = ordered_fill(df, ["v"], ["k"], partition_by=["g"], backward=backward, blocks=blocks)
    got = out.toPandas().sort_values("k").reset_index(drop=True)
    exp = pdf.sort_values("k").copy()
    grp = exp.groupby("g")["v"]
    exp["v"] = grp.bfill() if backward else grp.ffill()
    exp = exp.reset_index(drop=True)
    pd.testing.assert_series_equal(got.v, exp.v, check_names=False)
    glob = ordered_fill(df, ["v"], ["k"], backward=backward, blocks=blocks).toPandas().sort_values("k")
    want = pdf.sort_values("k").v
    want = want.bfill() if backward else want.ffill()
    np.testing.assert_allclose(glob.v.to_numpy(), want.to_numpy())


def test_mode_with_hot_value(spark):
    rows = [("hot",)] * 300 + [("b",)] * 5 + [(None,)] * 3
    df = spark.createDataFrame(rows, "s string")
    assert missing.column_modes(df, ["s"]) == {"s": "hot"}


def test_box_and_histogram_against_numpy(spark):
    df, pdf = _frame(spark, n=2000, seed=11)
    box = {r.g: r for r in charts.box_data(df, "g", "v").collect()}
    for g, part in pdf.dropna().groupby("g"):
        q1, med, q3 = np.quantile(part.v, [0.25, 0.5, 0.75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = part.v[(part.v >= lo) & (part.v <= hi)]
        b = box[g]
        assert (b.q1, b.median, b.q3) == pytest.approx((q1, med, q3))
        assert (b.whisker_low, b.whisker_high) == (inside.min(), inside.max())
        assert b.n_outliers == int(((part.v < lo) | (part.v > hi)).sum())
    hist = charts.histogram_data(df, "v").orderBy("bin").collect()
    edges = np.histogram_bin_edges(pdf.v.dropna(), bins="auto")
    assert len(hist) == len(edges) - 1
    assert sum(r["count"] for r in hist) == pdf.v.notna().sum()
    counts, _ = np.histogram(pdf.v.dropna(), bins=edges)
    assert [r["count"] for r in hist] == pytest.approx(list(counts), abs=2)


def test_kde_integrates_to_one(spark):
    df, _ = _frame(spark, n=2000, seed=5)
    rows = charts.kde_data(df, "v", "g", gridsize=200, cut=3).toPandas()
    for g, part in rows.groupby("g"):
        part = part.sort_values("point")
        area = np.trapezoid(part.density, part.value)
        assert area == pytest.approx(1.0, abs=0.02), g


def test_group_mean_topn_keeps_top_groups(spark):
    rows = [(f"g{i:02d}", float(i), j) for i in range(25) for j in range(3)]
    df = spark.createDataFrame(rows, "x string, y double, j long")
    kept = {r.x for r in charts.group_mean_topn(df, "x", "y", 20).collect()}
    assert kept == {f"g{i:02d}" for i in range(5, 25)}
    small = df.where("x < 'g05'")
    assert charts.group_mean_topn(small, "x", "y", 20).count() == small.count()


def test_ordered_fill_timestamp_and_null_keys(spark):
    rng = np.random.default_rng(2)
    n = 500
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.permutation(n), unit="s")
    v = rng.normal(size=n)
    v[rng.random(n) < 0.4] = np.nan
    pdf = pd.DataFrame({"t": ts, "v": v, "s": [f"u{i % 3}" for i in range(n)]})
    df = spark.createDataFrame(pdf).selectExpr("CAST(t AS TIMESTAMP) AS t", "nanvl(v, NULL) AS v", "s")
    df = df.unionByName(spark.createDataFrame([(None, 9.0, "u0")], "t timestamp, v double, s string"))
    got = ordered_fill(df, ["v"], ["t"], partition_by=["s"], blocks=9).toPandas()
    exp = pd.concat([pdf, pd.DataFrame({"t": [pd.NaT], "v": [9.0], "s": ["u0"]})])
    exp = exp.sort_values(["s", "t"], na_position="first")
    exp["v"] = exp.groupby("s")["v"].ffill()
    got = got.sort_values(["s", "t"], na_position="first")
    np.testing.assert_allclose(got.v.to_numpy(dtype=float), exp.v.to_numpy(dtype=float))


def test_exact_quantiles_bracket_of_endpoint_copies(spark):
    # two heavy values with a thin middle: the grid alone cannot narrow the bracket
    vals = [1.0] * 400 + [2.0] * 400 + [1.5, 1.25, 1.75]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    probs = [0.3, 0.4999, 0.5, 0.5001, 0.7]
    r = exact_quantiles(df, [], "v", probs, resolve_max=5).collect()[0]
    assert [r[f"q{i}"] for i in range(len(probs))] == pytest.approx(list(np.quantile(vals, probs)))


@pytest.mark.parametrize("wide_sums", [10**9, 0])
def test_correlation_paths_match_pandas(spark, monkeypatch, wide_sums):
    """Both the one-aggregation path and the matrix-product path (wide tables)
    give pandas' pairwise-complete Pearson, including a constant column."""
    from washframe.operators import profile
    monkeypatch.setattr(profile, "WIDE_CORR_SUMS", wide_sums)
    rng = np.random.default_rng(11)
    n, k = 3000, 9
    base = rng.normal(0, 1, n)
    data = {f"c{i}": base * (i - 4) + rng.normal(0, 1 + i, n) + 1e6 for i in range(k)}
    pdf = pd.DataFrame(data)
    for i in range(k):                           # nulls in different rows per column
        pdf.loc[rng.random(n) < 0.03 * (i % 4), f"c{i}"] = np.nan
    pdf["flat"] = 7.0
    got = {(r.x, r.y): r.corr for r in profile.correlation_matrix(spark.createDataFrame(pdf)).collect()}
    want = pdf.corr()
    assert len(got) == want.size
    for (x, y), r in got.items():
        w = want.loc[x, y]
        if np.isnan(w):
            assert r is None
        else:
            assert r == pytest.approx(w, abs=1e-9)
    empty = profile.correlation_matrix(spark.createDataFrame(pdf).limit(0)).collect()
    assert len(empty) == want.size and all(r.corr is None for r in empty)


@pytest.mark.parametrize("backward", [False, True])
def test_ordered_fill_hot_tied_order_key(spark, backward):
    """A third of the rows share one order value: ties are broken by a hash of
    the row (spread over blocks); the result equals one plain window ordered
    the same way."""
    from pyspark.sql import Window
    rng = np.random.default_rng(5)
    n = 3000
    k = np.where(rng.random(n) < 0.34, 500, rng.integers(0, 1000, n))
    v = np.round(rng.normal(0, 1, n), 3)
    v[rng.random(n) < 0.3] = np.nan
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], n), "k": k, "v": v, "row": np.arange(n)})
    df = spark.createDataFrame(pdf).withColumn("v", F.when(F.isnan("v"), None).otherwise(F.col("v")))
    tb = F.xxhash64(*[F.col(c) for c in df.columns])
    for part in ([], ["g"]):
        got = ordered_fill(df, ["v"], ["k"], partition_by=part, backward=backward, blocks=16)
        if backward:
            order = [F.col("k").desc_nulls_last(), tb.desc_nulls_last()]
        else:
            order = [F.col("k").asc_nulls_first(), tb.asc_nulls_first()]
        w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        want = df.select("row", F.last("v", ignorenulls=True).over(w).alias("v"))
        a = {r.row: r.v for r in got.select("row", "v").collect()}
        b = {r.row: r.v for r in want.collect()}
        assert a == b


def test_shared_percentile_budget_keeps_results(spark, monkeypatch):
    """Exact medians added to a shared aggregation stay within a total value
    budget; columns beyond it take the chunked path with equal results."""
    from washframe.operators import outliers, quantiles
    from washframe.plans.cleaning import CleaningOptions, clean_data
    rng = np.random.default_rng(21)
    n = 2000
    pdf = pd.DataFrame({f"c{i}": rng.standard_t(2, n) * (i + 1) for i in range(4)})
    pdf.loc[rng.random(n) < 0.1, "c1"] = np.nan
    df = spark.createDataFrame(pdf)

    def run():
        a = outliers.outliers_to_median(df).toPandas()
        b = clean_data(df, CleaningOptions(materialize="none")).df.toPandas()
        return a.sort_values(list(a.columns)).reset_index(drop=True), \
            b.sort_values(list(b.columns)).reset_index(drop=True)

    wide_a, wide_b = run()
    monkeypatch.setattr(quantiles, "DIRECT_TOTAL_MAX", n + 10)   # one column per aggregation
    assert quantiles.direct_budget([n, n, n]) == [True, False, False]
    tight_a, tight_b = run()
    pd.testing.assert_frame_equal(wide_a, tight_a)
    pd.testing.assert_frame_equal(wide_b, tight_b)


def test_fill_boundaries_span_the_whole_sample(spark, monkeypatch):
    """A sample larger than meant keeps its highest keys as split points."""
    module = sys.modules[ordered_fill.__module__]
    monkeypatch.setattr(module, "SAMPLE_MAX", 100)
    bounds = module._boundaries(spark.range(10_000).toDF("k0"), 10, rows=1000)   # about 1000 keys sampled
    assert len(bounds) == 9 and bounds[-1][0] > 8000
