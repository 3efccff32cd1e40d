"""Cleaning CSV files in file order, and the report's columns."""

import datetime as dt
import os

import pytest

from washframe.plans.cleaning import CleaningOptions, clean_csv, clean_data
from washframe.sources import files


def make(path, n=400, name="When"):
    with open(path, "w") as f:
        f.write(f"Key,{name},Note,place_of_row\n")
        for i in range(n):
            when = "" if i % 3 else f"2024-01-{i % 28 + 1:02d} 00:00:00"
            f.write(f'{(i * 7919) % n},{when},"n{i}\nx",p{i}\n')


@pytest.mark.parametrize("split", ["200b", "128m"])
def test_dates_are_filled_in_file_order(spark, tmp_path, split):
    make(os.path.join(tmp_path, "a.csv"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        res = clean_csv(spark, str(tmp_path), CleaningOptions(handle_outliers=False))
        rows = {r.note.split("\n")[0]: r for r in res.df.collect()}
        columns = {r.column_name: r for r in res.column_report().collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert res.df.columns == ["key", "when", "note", "place_of_row"]
    assert len(rows) == 400
    for i in range(400):
        assert rows[f"n{i}"].when == dt.datetime(2024, 1, (i - i % 3) % 28 + 1)
    assert res.original_shape == (400, 4)
    assert (columns["when"].nulls_before, columns["when"].nulls_after) == (266, 0)
    assert columns["key"].original_name == "Key" and not columns["key"].dropped


def test_position_takes_no_part(spark):
    df = spark.createDataFrame([(2, "b", None), (0, "a", 1.0), (1, "a", 1.0), (3, "b", None)], "n int, t string, v double")
    res = clean_data(df, CleaningOptions(position="n", handle_outliers=False, remove_constant_columns=False))
    assert sorted(map(tuple, res.df.collect())) == [("a", 1.0), ("b", 1.0)]
    assert res.rows_removed == 2 and "n" not in res.nulls_before
    assert all("place_of_row" not in s.columns for s in res.log.steps)
    with pytest.raises(ValueError):
        clean_data(df, CleaningOptions(position="absent"))


def test_observed_counts_come_from_the_write(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "x"), (2, None, None), (3, 1.0, "y")], "k int, v double, t string")
    res = clean_data(df, CleaningOptions(fill_missing=False, handle_outliers=False, remove_constant_columns=False))
    seen, watch = res.observed()
    seen.write.parquet(os.path.join(tmp_path, "out"))
    assert res.log_observed(watch) == {"k": 0, "v": 2, "t": 1}
    assert [(s.step, s.count) for s in res.log.steps[-3:]] == [
        ("rows_written", 3), ("missing_left_v", 2), ("missing_left_t", 1)]
    got = {r.column_name: r for r in res.column_report().collect()}
    assert (got["v"].nulls_before, got["v"].nulls_after, got["v"].dtype_before) == (2, 2, "double")


def test_unused_name(spark, tmp_path):
    path = os.path.join(tmp_path, "a.csv")
    with open(path, "w") as f:
        f.write("row_position,x\n1,2\n")
    assert files.unused_name(spark, path) == "row_position_"
