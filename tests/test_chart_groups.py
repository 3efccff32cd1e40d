"""Box and violin with one variable and with hue."""

import numpy as np

from washframe.operators import charts


def test_box_and_violin_groups(spark):
    rng = np.random.default_rng(5)
    rows = [(x, h, float(v)) for x in "ab" for h in (1, 2) for v in [*rng.normal(size=40), 50.0]]
    df = spark.createDataFrame(rows + [("a", None, 7.0), (None, 1, 7.0), ("a", 1, None)], "x string, h int, y double")
    boxes = {(r.x, r.h): r for r in charts.box_data(df, "x", "y", hue="h").collect()}
    assert set(boxes) == {("a", 1), ("a", 2), ("b", 1), ("b", 2)}
    for (x, h), r in boxes.items():
        v = np.array([w for a, b, w in rows if (a, b) == (x, h)])
        assert r.n == 41 and np.allclose([r.q1, r.median, r.q3], np.quantile(v, [0.25, 0.5, 0.75]))
    assert charts.box_outliers(df, "x", "y", hue="h").columns == ["x", "h", "y"]
    one = charts.box_data(df, None, "y").collect()
    assert len(one) == 1 and one[0].n == 4 * 41 + 2
    whole = charts.violin_data(df, "x", "y", gridsize=20, hue="h").collect()
    part = charts.violin_data(df.where("h = 2"), "x", "y", gridsize=20).collect()
    assert len(whole) == 80
    want = {(r.x, r.point): r.density for r in part}
    assert all(abs(r.density - want[r.x, r.point]) < 1e-12 for r in whole if r.h == 2)
    assert len(charts.violin_data(df, None, "y", gridsize=20).collect()) == 20
    assert len(charts.histogram_curve(df.where("x IS NOT NULL"), "y", "x").collect()) == 400
