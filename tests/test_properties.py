"""Property tests on random small frames for the custom distributed algorithms."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from washframe.operators.ordered_fill import ordered_fill
from washframe.operators.profile import column_summary
from washframe.operators.quantiles import exact_quantiles

SETTINGS = dict(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))

values = st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float),
                            st.floats(-1e6, 1e6, allow_nan=False, allow_infinity=False)),
                  min_size=1, max_size=60)


@settings(**SETTINGS)
@given(vals=values, resolve_max=st.sampled_from([1, 3, 10, 10**6]),
       probs=st.lists(st.floats(0, 1), min_size=1, max_size=4))
def test_quantiles_equal_numpy(spark, vals, resolve_max, probs):
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(vals)], "g long, v double")
    got = {r.g: [r[f"q{i}"] for i in range(len(probs))]
           for r in exact_quantiles(df, ["g"], "v", probs, resolve_max=resolve_max).collect()}
    pdf = pd.DataFrame({"g": [i % 3 for i in range(len(vals))], "v": vals}).dropna()
    for g, part in pdf.groupby("g"):
        assert got[g] == pytest.approx(list(np.quantile(part.v.to_numpy(), probs)), rel=1e-9, abs=1e-9)
    assert set(got) == set(pdf.g)


@settings(**SETTINGS)
@given(vals=values, blocks=st.integers(1, 9), backward=st.booleans(), groups=st.integers(1, 3))
def test_ordered_fill_equals_pandas(spark, vals, blocks, backward, groups):
    rows = [(i, i % groups, v) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "k long, g long, v double")
    got = ordered_fill(df, ["v"], ["k"], partition_by=["g"], backward=backward, blocks=blocks) \
        .toPandas().sort_values("k").v.to_numpy(dtype=float)
    pdf = pd.DataFrame(rows, columns=["k", "g", "v"])
    exp = (pdf.groupby("g").v.bfill() if backward else pdf.groupby("g").v.ffill()).to_numpy(dtype=float)
    np.testing.assert_array_equal(got, exp)


def test_column_summary_approx_close(spark):
    df = spark.createDataFrame([(i % 97, f"s{i % 13}") for i in range(5000)], "a long, b string")
    exact = {r.name: r.unique_count for r in column_summary(df).collect()}
    approx = {r.name: r.unique_count for r in column_summary(df, approx=True).collect()}
    assert exact == {"a": 97, "b": 13}
    assert all(abs(approx[c] - exact[c]) <= 0.1 * exact[c] for c in exact)
