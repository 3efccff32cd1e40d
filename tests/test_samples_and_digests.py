"""Seeded points, bins, single pairs, mixed profiles and streamed digests."""

import datetime as dt
import hashlib
import os

import pytest

from washframe.operators import charts, profile
from washframe.sources import files


def test_max_points_do_not_depend_on_the_partitions(spark):
    rows = [(float(i % 40), float(i % 7), "ab"[i % 5 == 0]) for i in range(900)] + [(1.0, None, "a"), (2.0, 5.0, None)]
    df = spark.createDataFrame(rows, "x double, y double, h string")

    def points(parts, **kw):
        got = charts.scatter_data(df.repartition(parts), "x", "y", **kw)
        return sorted(map(str, got.collect()))

    assert len(points(3)) == 901
    some = points(1, max_points=50)
    assert len(some) == 50 and some == points(7, max_points=50) and some != points(7, max_points=50, seed=1)
    per = points(2, hue="h", max_points=30)
    assert per == points(9, hue="h", max_points=30)
    assert [sum(f"h={h}" in r for r in per) for h in ("'a'", "'b'", "None")] == [30, 30, 1]
    assert sorted(points(4, max_points=5000)) == sorted(points(1))
    copies = spark.createDataFrame([(1.0, 2.0)] * 500, "x double, `y z` double")
    assert charts.scatter_data(copies, "x", "y z", max_points=20).count() == 20
    with pytest.raises(ValueError):
        charts.scatter_data(df, "x", "y", max_points=0)


def test_empty_bins(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (100.0,)], "v double")
    counts = {e: {r.bin: r["count"] for r in charts.histogram_data(df, "v", bins=10, empty_bins=e).collect()}
              for e in (True, False, None)}
    assert counts[True] == counts[None] == {0: 2, **{b: 0 for b in range(1, 9)}, 9: 1}
    assert counts[False] == {0: 2, 9: 1}
    assert charts.create_plot(df, "histogram", "v", bins=10, empty_bins=False).count() == 2


def test_pairs_once(spark):
    df = spark.createDataFrame([(1, 2.0, None), (3, 4.0, 5.0)], "a int, b double, c double")
    both = charts.pair_data(df).collect()
    half = charts.pair_data(df, mirrored=False).collect()
    assert len(both) == 2 * len(half) == 8
    assert sorted(map(tuple, both)) == sorted([tuple(r) for r in half] + [(r.y_name, r.x_name, r.y, r.x) for r in half])


def test_describe_mixed(spark):
    day = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, day, "x", 2.0), (3, day + dt.timedelta(days=2), "y", None)],
                               "`a b` int, t timestamp_ntz, s string, v double")
    got = {r.column_name: r for r in profile.describe_mixed(df).collect()}
    assert set(got) == {"a b", "t", "v"}
    assert (got["a b"].mean, got["a b"].q25, got["a b"].mean_time, got["a b"].position) == (2.0, 1.5, None, 0)
    assert (got["t"].mean, got["t"].mean_time, got["t"].max_time) == (None, day + dt.timedelta(days=1), day + dt.timedelta(days=2))
    assert got["v"]["count"] == 1
    assert profile.describe_mixed(df.select("s")).count() == 0
    assert profile.describe_mixed(df.select("t")).columns == profile.describe_mixed(df.select("v")).columns


def test_files_beyond_the_held_size_are_hashed_in_pieces(spark, tmp_path):
    texts = {"a b.csv": b"x" * 5000, "c%20d.csv": b"y" * 100, "ü.csv": b"z", "e.csv": os.urandom(9 << 20)}
    for name, data in texts.items():
        with open(os.path.join(tmp_path, name), "wb") as f:
            f.write(data)
    want = {name: hashlib.sha256(data).hexdigest() for name, data in texts.items()}
    for held in (2 ** 31 - 1024, 1000, 0):
        rows = files.file_manifest(spark, str(tmp_path), held_bytes=held).collect()
        assert {r.path.rsplit("/", 1)[1]: r.sha256 for r in rows} == want, held
        assert {r.verdict for r in rows} == {"ok"}


def test_sparse_file_of_three_gigabytes(spark, tmp_path):
    path = os.path.join(tmp_path, "big.csv")
    with open(path, "wb") as f:
        f.truncate(3 << 30)
    want = hashlib.sha256()
    for _ in range(3 << 4):
        want.update(bytes(1 << 26))
    row = files.file_manifest(spark, path).first()
    assert (row.size_bytes, row.sha256, row.verdict) == (3 << 30, want.hexdigest(), "too_large")


def _hashes(rows):
    return {r.file_name: r.sha256 for r in rows.collect()}


def test_no_row_holds_a_large_file(spark, tmp_path):
    texts = {"small.csv": b"a,b\n", "large.csv": os.urandom(9 << 20), "larger.csv": bytes(40 << 20)}
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 8 << 20)     # Spark's source fails on more
    try:
        got = _hashes(files.file_manifest(spark, str(tmp_path)))
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert got == {name: hashlib.sha256(data).hexdigest() for name, data in texts.items()}


def test_pieces_of_a_file_that_only_sparks_readers_open(spark, tmp_path):
    data = os.urandom(3_000_001)
    (tmp_path / "a b%20ü.csv").write_bytes(data)
    (tmp_path / "c.csv").write_bytes(b"z")
    mount = "fs.viewfs.mounttable.digests.link./in"       # a setting of the session alone
    spark.conf.set(mount, f"file://{tmp_path}")
    try:
        found = files.file_manifest(spark, "viewfs://digests/in/*.csv", held_bytes=0)
        assert _hashes(found) == {"a b%20ü.csv": hashlib.sha256(data).hexdigest(), "c.csv": hashlib.sha256(b"z").hexdigest()}
        assert found.where(found.sha256 == hashlib.sha256(b"z").hexdigest()).first().file_name == "c.csv"
    finally:
        spark.conf.unset(mount)
