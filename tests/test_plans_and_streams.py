"""Cleaning plan options, the report, file sources, and streaming apply."""

import os

import pytest
import tempfile

from pyspark.sql import functions as F

from washframe.plans.cleaning import CleaningOptions, clean_data
from washframe.sources import files
from washframe.sources.tables import load_table
from washframe.streaming.fitted import StreamCleaner, dedup_stream, read_stream, run_to_table

from conftest import SF_SMALL


def _staff(spark):
    rows = [(1, "Ann ", 30, 5000, "Sales", "2020-01-05", " NYC"),
            (2, "Bob", None, 5200, "N/A", "2021-02-10", "LA"),
            (2, "Bob", None, 5200, "N/A", "2021-02-10", "LA"),
            (3, "Cy", 41, 99000, "Sales", "bad", "NYC"),
            (4, "Di", 35, 5100, "Ops", "2019-07-01", "NYC"),
            (5, "Ed", 29, 4900, None, "2018-03-03", "LA")] + \
           [(10 + i, f"P{i}", 30 + i % 7, 5000 + i * 10, "Ops", "2020-06-01", "SF") for i in range(40)]
    return spark.createDataFrame(rows, "ID long, `Full Name` string, Age long, `Salary ($)` long, "
                                       "Department string, `Join Date` string, City string")


def test_clean_data_all_steps(spark):
    res = clean_data(_staff(spark), CleaningOptions(custom_na_values=["N/A"], order_by=["ID"]))
    df = res.df
    assert df.columns == ["id", "full_name", "age", "salary", "department", "join_date", "city"]
    assert res.rows_removed == 1
    assert res.original_shape == (46, 7) and res.cleaned_shape == (45, 7)
    pdf = df.toPandas()
    assert pdf.isna().sum().drop("join_date").sum() == 0
    assert pdf.loc[pdf.id == 3, "join_date"].isna().all()        # bad date -> missing
    assert set(pdf.city) == {"NYC", "LA", "SF"}                   # stripped
    assert "removed_duplicates" in res.log.names()
    rep = res.report(spark).collect()
    assert [r.step_no for r in rep] == list(range(1, len(rep) + 1))
    assert res.summary()["missing_values_filled"] == 5          # 2 ages + 3 departments


def test_clean_data_release_scratch(spark):
    res = clean_data(_staff(spark), CleaningOptions(order_by=["ID"]))
    assert len(res.scratch) == 1
    path = res.scratch[0]
    assert path.startswith(spark.sparkContext.getCheckpointDir().rstrip("/"))
    local = path.removeprefix("file:")
    assert os.path.isdir(local)
    assert res.df.count() == 45
    res.release()
    assert res.scratch == [] and not os.path.exists(local)


def test_clean_data_flags_off(spark):
    src = _staff(spark)
    res = clean_data(src, CleaningOptions(fill_missing=False, drop_duplicates=False, standardize_columns=False,
                                          fix_datatypes=False, handle_outliers=False, strip_whitespace=False,
                                          fix_dates=False, remove_constant_columns=False, materialize="none"))
    assert res.df.columns == src.columns
    assert res.df.count() == src.count()


def test_csv_round_trip_and_manifest(spark):
    d = tempfile.mkdtemp(prefix="washframe-csv-")
    with open(os.path.join(d, "people.csv"), "w") as fh:
        fh.write('name,age,city,joined,note\nann,30,NYC,2020-01-01,"says ""hi"", ok"\n'
                 'bob,NA,LA,2021-05-06,\ncy,41,,n/a,plain\n')
    df = files.read_csv(spark, os.path.join(d, "people.csv"))
    assert dict(df.dtypes) == {"name": "string", "age": "bigint", "city": "string",
                               "joined": "timestamp_ntz", "note": "string"}
    rows = df.orderBy("name").collect()
    assert rows[0].note == 'says "hi", ok' and rows[1].age is None and rows[2].city is None
    out = files.write_csv(df, os.path.join(d, "out"))
    back = files.read_csv(spark, out, schema=df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    man = {r.file_name: r for r in files.file_manifest(spark, os.path.join(d, "*.csv")).collect()}
    assert man["people.csv"].verdict == "ok" and len(man["people.csv"].sha256) == 64
    small = files.file_manifest(spark, os.path.join(d, "*.csv"), max_bytes=10).collect()[0]
    assert small.verdict == "too_large" and small.sha256 == man["people.csv"].sha256
    wrong = files.file_manifest(spark, os.path.join(d, "*.csv"), expected_sha256={"people.csv": "0"}).collect()[0]
    assert wrong.verdict == "checksum_mismatch"
    top = files.preview(load_table(spark, SF_SMALL, "orders"), ["o_orderkey"]).collect()
    assert len(top) == 5 and [r.o_orderkey for r in top] == sorted(r.o_orderkey for r in top)


def test_stream_apply_equals_batch_apply(spark):
    events = load_table(spark, SF_SMALL, "events")
    dirty = events.withColumn("value", F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("value")))
    cleaner = StreamCleaner.fit(dirty)
    batch = cleaner.transform(dirty)
    stream = read_stream(spark, SF_SMALL, events.schema, glob="events.parquet")
    dstream = stream.withColumn("value", F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("value")))
    got = run_to_table(cleaner.transform(dstream), "test-stream", spark)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    deduped = run_to_table(dedup_stream(stream.unionByName(stream), "ts", "1 hour"), "test-dedup", spark)
    assert deduped.count() == events.count()


def _sequential(df, opt):
    """The plan written as the plain composition of the standalone operators."""
    from washframe.operators import coerce, columns, dedup, missing, outliers, strings
    from washframe.functions.names import standard_names
    order_by = list(opt.order_by or [])
    if opt.standardize_columns:
        mapping = standard_names(df.columns)
        order_by = [mapping.get(c, c) for c in order_by]
        df = columns.standardize_columns(df)
    if opt.fill_missing:
        df = missing.fill_missing(df, order_by=order_by, custom_na_values=opt.custom_na_values)
    if opt.drop_duplicates:
        df = dedup.drop_duplicates(df)
    if opt.fix_datatypes:
        df = coerce.detect_and_convert(df)
    if opt.handle_outliers:
        df = outliers.outliers_to_median(df, threshold=opt.outlier_threshold or 3.0)
    if opt.strip_whitespace:
        df = strings.strip_whitespace(df)
    if opt.fix_dates:
        df = coerce.parse_dates(df, date_columns=opt.date_columns)
    if opt.remove_constant_columns:
        df = columns.remove_constant_columns(df)
    return df


@pytest.mark.parametrize("flags", [
    {},
    {"fill_missing": False},
    {"drop_duplicates": False, "handle_outliers": False},
    {"fix_datatypes": False, "strip_whitespace": False},
    {"fix_dates": False, "remove_constant_columns": False, "standardize_columns": False},
    {"outlier_threshold": 1.5},
])
def test_fused_plan_equals_operator_sequence(spark, flags):
    from washframe.plans.queries_io import dirty_events_frame
    src = dirty_events_frame(spark, SF_SMALL).unionByName(_staff_like_events(spark))
    opt = CleaningOptions(custom_na_values=["N/A"], order_by=["Event ID"], **flags)
    got = clean_data(src, opt).df
    want = _sequential(src, opt)
    assert got.columns == want.columns
    assert dict(got.dtypes) == dict(want.dtypes)
    norm = lambda rows: sorted((tuple("" if v is None else str(v) for v in r) for r in rows))
    assert norm(got.collect()) == norm(want.collect())


def _staff_like_events(spark):
    """A few extra rows with extreme values so outliers exist in the small table."""
    rows = [(100000 + i, None, str(7 + i), "  view ", 1e6 * (i + 1), "web", None, "2024-02-0" + str(i + 1),
             '{"k": 1}') for i in range(3)]
    return spark.createDataFrame(rows, "`Event ID` long, `Event Time` timestamp_ntz, `User-Id` string, "
                                       "`Event Type` string, `Value ($)` double, Source string, Empty string, "
                                       "`Signup Date` string, Props string")


def test_dedup_stream_ntz_marker_ignores_session_time_zone(spark):
    """Two wall times inside a daylight-saving gap stay distinct event times."""
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ'2024-03-10 02:30:00.123456', 'a'), "
                   "(TIMESTAMP_NTZ'2024-03-10 03:30:00.123456', 'a'), "
                   "(TIMESTAMP_NTZ'2024-03-10 03:30:00.123456', 'a') AS t(ts, k)")
    src = os.path.join(tempfile.mkdtemp(prefix="washframe-dst-"), "in")
    df.write.parquet(src)
    prev = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        stream = dedup_stream(read_stream(spark, src, df.schema), "ts", subset=["k"])
        out = run_to_table(stream, "dst", spark).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev)
    assert sorted(str(r.ts) for r in out) == ["2024-03-10 02:30:00.123456", "2024-03-10 03:30:00.123456"]
    assert list(out[0].asDict()) == ["ts", "k"]


def test_stream_clean_reads_a_table_of_part_files(spark, tmp_path):
    """The events table may be a folder of part files, not one file."""
    from washframe.plans.catalog import QUERIES
    events = load_table(spark, SF_SMALL, "events")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    want, got = (QUERIES["stream_clean"](spark, sf).collect() for sf in (SF_SMALL, str(tmp_path)))
    assert len(got) == events.count()
    assert sorted(map(str, got)) == sorted(map(str, want))
