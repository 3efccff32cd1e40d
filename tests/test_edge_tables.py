"""Hand-written edge tables: renames, constants, ties, NaN, leading nulls, mixed text."""

import math

import pytest
from pyspark.sql import functions as F

from washframe.functions.names import standard_name, standard_names
from washframe.operators import coerce, columns, dedup, missing, outliers, profile, strings, transforms
from washframe.operators.ordered_fill import fill_bfill, fill_ffill


def test_standard_names_rules_and_collisions(spark):
    assert standard_name("Is-OK?") == "is_ok"
    assert standard_name("1st") == "col_1st"
    assert standard_name("$$") == "col_"
    assert standard_name("  Mkt  Segment ") == "mkt_segment"
    assert standard_name("camelCase") == "camelcase"
    names = standard_names(["a b", "a_b", "1st", "$$", "Is-OK?"])
    assert list(names.values()) == ["a_b", "a_b_2", "col_1st", "col_", "is_ok"]
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], "`a b` long, a_b long, `1st` long, `$$` long, `Is-OK?` long")
    out = columns.standardize_columns(df)
    assert out.columns == ["a_b", "a_b_2", "col_1st", "col_", "is_ok"]
    assert out.collect()[0] == (1, 2, 3, 4, 5)


@pytest.fixture
def const(spark):
    return spark.createDataFrame([(2.0, None, 1.0), (2.0, None, 2.0), (2.0, None, 4.0)],
                                 "v double, w double, x double")


def test_zero_range_and_zero_std(const):
    n = transforms.normalize(const, ["v", "x"]).collect()
    assert [r.v for r in n] == [0.0, 0.0, 0.0]
    assert [r.x for r in n] == [0.0, 1 / 3, 1.0]
    s = transforms.standardize(const, ["v"]).collect()
    assert [r.v for r in s] == [0.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        transforms.min_max_scale(const, ["x"], (1, 1))
    with pytest.raises(ValueError):
        transforms.apply_transformation(const, ["x"], "cube")


def test_constant_columns_and_all_null(const):
    assert set(columns.constant_columns(const)) == {"v", "w"}
    assert columns.constant_columns(const, keep_all_null=True) == ["v"]
    assert columns.remove_constant_columns(const).columns == ["x"]
    assert columns.drop_empty_columns(const).columns == ["v", "x"]


def test_correlation_with_constant_column_under_ansi(const):
    rows = {(r.x, r.y): r.corr for r in profile.correlation_matrix(const).collect()}
    assert rows[("v", "x")] is None          # constant: no division error, null
    assert rows[("w", "x")] is None          # all-null column
    assert rows[("x", "x")] == 1.0
    assert rows[("v", "v")] is None


def test_mode_ties_pick_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "s string")
    assert missing.column_modes(df, ["s"]) == {"s": "a"}
    assert [r.s for r in missing.fill_mode(df).collect()][-1] == "a"


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    rows, miss = columns.fit_null_counts(df)
    assert miss == {"x": 2}
    assert [r.x for r in missing.fill_median(df, ["x"]).collect()] == [1.0, 2.0, 2.0, 3.0]
    assert [r.x for r in missing.fill_mean(df, ["x"]).collect()] == [1.0, 2.0, 2.0, 3.0]
    assert missing.drop_null_rows(df).count() == 2


def test_leading_null_ffill_bfill(spark):
    df = spark.createDataFrame([(1, None), (2, "2024-01-02"), (3, None), (4, "2024-01-04"), (5, None)],
                               "k long, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    ff = {r.k: r.t for r in fill_ffill(df, ["t"], ["k"], blocks=3).collect()}
    assert ff[1] is None and ff[3] == ff[2] and ff[5] == ff[4]
    bf = {r.k: r.t for r in fill_bfill(df, ["t"], ["k"], blocks=3).collect()}
    assert bf[1] == bf[2] and bf[3] == bf[4] and bf[5] is None


def test_mixed_text_conversion(spark):
    mixed = spark.createDataFrame([("1",), ("2",), ("x",)], "s string")
    assert coerce.detect_types(mixed) == {"s": "string"}
    clean = spark.createDataFrame([("1",), ("2",), (None,)], "s string")
    assert coerce.detect_types(clean) == {"s": "long"}
    assert coerce.detect_and_convert(clean).dtypes == [("s", "bigint")]
    # B1 repair: numbers never become timestamps, text never becomes all-missing
    num = spark.createDataFrame([(1.5,), (2.5,)], "v double")
    assert coerce.detect_and_convert(num).dtypes == [("v", "double")]


def test_number_text_guard(spark):
    df = spark.createDataFrame([("$1,200",), ("-3.5",), ("abc",), ("12%",), (None,)], "s string")
    got = [r.s for r in coerce.clean_number_text(df, ["s"]).collect()]
    assert got == [1200.0, -3.5, None, 12.0, None]     # B2: letters-only is null, not ''


def test_strip_unicode_whitespace(spark):
    df = spark.createDataFrame([("\t a b　",), (" x\n",), (None,)], "s string")
    assert [r.s for r in strings.strip_whitespace(df).collect()] == ["a b", "x", None]
    assert [r.s for r in strings.clean_strings(spark.createDataFrame([(" AbC ",)], "s string")).collect()] == ["abc"]


def test_dedup_null_equals_null_and_idempotent(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, float("nan")), (2, None)], "a long, b double")
    once = dedup.drop_duplicates(df)
    assert once.count() == 2
    assert dedup.drop_duplicates(once).count() == 2
    dc = dedup.duplicate_count(df).collect()[0]
    assert (dc.total_rows, dc.distinct_rows, dc.duplicate_rows) == (4, 2, 2)


def test_dedup_keep_first_by_order(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, "z")], "k string, o long, v string")
    got = {r.k: (r.o, r.v) for r in dedup.drop_duplicates(df, ["k"], ["o"]).collect()}
    assert got == {"a": (1, "y"), "b": (2, "z")}


def test_outliers_nulls_never_outliers(spark):
    vals = [float(i % 5) for i in range(60)] + [1000.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r.x for r in outliers.outliers_to_median(df, ["x"], 3.0).collect()]
    assert got[-1] is None                      # B5
    assert got[-2] == 2.0                       # median of all values incl. the outlier
    capped = [r.x for r in outliers.cap_iqr(df, ["x"]).collect()]
    assert max(v for v in capped if v is not None) <= 4.0 + 1.5 * 2.0 + 1e-9


def test_log_sqrt_shifts(spark):
    df = spark.createDataFrame([(-2.0,), (0.0,), (3.0,)], "x double")
    lg = [r.x for r in transforms.log_transform(df, ["x"]).collect()]
    assert lg == pytest.approx([math.log(1.0), math.log(3.0), math.log(6.0)])
    sq = [r.x for r in transforms.sqrt_transform(df, ["x"]).collect()]
    assert sq == pytest.approx([0.0, math.sqrt(2.0), math.sqrt(5.0)])


def test_require_columns(spark):
    df = spark.createDataFrame([(1,)], "a long")
    assert columns.require_columns(df, ["a"]) is df
    with pytest.raises(ValueError):
        columns.require_columns(df, ["b"])
    with pytest.raises(ValueError):
        columns.require_columns(df.where("a > 5"), ["a"])


def test_format_parse_keeps_wall_time_in_any_session_zone(spark):
    """A wall time inside a daylight-saving gap keeps its value; bad text is null."""
    from washframe.operators.coerce import _has_zone, to_timestamp
    assert not _has_zone("yyyy-MM-dd'T'HH:mm") and _has_zone("yyyy-MM-dd HH:mmXXX")
    df = spark.createDataFrame([("2024-03-10 02:30:00",), ("10/03/2024 01:15:00",), ("junk",), (None,)], "s string")
    prev = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        got = [r.t for r in df.select(to_timestamp(df.s, ["yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss"])
                                      .alias("t")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev)
    assert [str(t) if t else None for t in got] == ["2024-03-10 02:30:00", "2024-03-10 01:15:00", None, None]
