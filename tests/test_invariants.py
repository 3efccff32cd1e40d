"""Invariants on the driver tables: ranges, moments, no nulls left, idempotence."""

import pytest
from pyspark.sql import functions as F

from washframe.operators import charts, dedup, missing, profile, transforms
from washframe.operators.quantiles import column_quantiles
from washframe.plans import dirt
from washframe.report import StepLog
from washframe.sources.tables import load_table

from conftest import SF_SMALL

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@pytest.fixture(scope="module")
def lineitem(spark):
    return load_table(spark, SF_SMALL, "lineitem")


def test_normalize_range_and_standardize_moments(lineitem):
    n = transforms.normalize(lineitem, NUM)
    r = n.agg(*[F.min(c).alias(f"lo_{c}") for c in NUM], *[F.max(c).alias(f"hi_{c}") for c in NUM]).collect()[0]
    for c in NUM:
        assert r[f"lo_{c}"] == pytest.approx(0.0) and r[f"hi_{c}"] == pytest.approx(1.0)
    s = transforms.standardize(lineitem, NUM)
    m = s.agg(*[F.avg(c).alias(f"m_{c}") for c in NUM], *[F.stddev_pop(c).alias(f"s_{c}") for c in NUM]).collect()[0]
    for c in NUM:
        assert m[f"m_{c}"] == pytest.approx(0.0, abs=1e-9) and m[f"s_{c}"] == pytest.approx(1.0)
    sc = transforms.min_max_scale(lineitem, NUM, (-2, 3)).agg(F.min("l_tax"), F.max("l_tax")).collect()[0]
    assert tuple(sc) == pytest.approx((-2.0, 3.0))


def test_fills_leave_no_nulls(spark):
    df = dirt.events_tokens_nulled(spark, SF_SMALL)
    out = missing.fill_missing(df, order_by=["event_id"])
    left = missing.null_counts(out).collect()
    # only the leading gap of the forward-filled timestamp can stay missing
    assert {r.column_name: r.null_count for r in left if r.null_count} == {"ts": 1}
    assert missing.null_counts(missing.fill_median(df, ["value"])).where("column_name = 'value'") \
        .collect()[0].null_count == 0


def test_dedup_idempotent_and_counts_agree(spark):
    df = dirt.events_with_copies(spark, SF_SMALL)
    once = dedup.drop_duplicates(df)
    assert dedup.drop_duplicates(once).count() == once.count()
    dc = dedup.duplicate_count(df).collect()[0]
    ds = profile.data_summary(df).collect()[0]
    assert dc.duplicate_rows == ds.duplicate_rows == df.count() - once.count()


def test_quantiles_monotone_and_approx_close(lineitem):
    probs = [0.1, 0.25, 0.5, 0.75, 0.9]
    exact = column_quantiles(lineitem, NUM, probs)
    approx = column_quantiles(lineitem, NUM, probs, approx=True)
    for c in NUM:
        assert exact[c] == sorted(exact[c])
        lo, hi = lineitem.agg(F.min(c), F.max(c)).collect()[0]
        for e, a in zip(exact[c], approx[c]):
            assert abs(e - a) <= 0.02 * (hi - lo) + 1e-9


def test_describe_matches_profile_pieces(lineitem):
    d = {r.column_name: r for r in profile.describe(lineitem, NUM).collect()}
    cs = {r.name: r for r in profile.column_summary(lineitem.select(*NUM)).collect()}
    for c in NUM:
        assert d[c].mean == pytest.approx(cs[c].mean) and d[c].min == cs[c].min and d[c].max == cs[c].max
        assert d[c].min <= d[c].q25 <= d[c].q50 <= d[c].q75 <= d[c].max


def test_correlation_symmetric_and_bounded(lineitem):
    rows = profile.correlation_matrix(lineitem, NUM).collect()
    m = {(r.x, r.y): r.corr for r in rows}
    for (x, y), v in m.items():
        assert v is None or -1 - 1e-12 <= v <= 1 + 1e-12
        assert m[(y, x)] == v
    low = {(r.x, r.y) for r in charts.heatmap_data(lineitem, NUM).collect()}
    assert len(low) == len(NUM) * (len(NUM) - 1) // 2


def test_step_log_table(spark, tmp_path):
    log = StepLog()
    log.add("a", columns=["x"], count=3)
    log.add("b")
    path = log.append_to(spark, str(tmp_path / "oplog"), run_id="r1")
    log.append_to(spark, path, run_id="r2")
    got = spark.read.parquet(path)
    assert got.count() == 4 and set(got.columns) >= {"step_no", "step", "count", "seconds", "run_id"}


def test_checkpoint_root_requires_shared_folder_on_clusters():
    """A cluster session without spark.checkpoint.dir must not fall back to a
    machine-local temp folder (lost with the executor or driver host)."""
    import pytest
    from washframe.session import checkpoint_root

    class _Conf:
        def get(self, key, default=None):
            return default

    class _Ctx:
        master = "yarn"

        def getCheckpointDir(self):
            return None

        def setCheckpointDir(self, path):
            raise AssertionError("must not register a local folder")

    class _Session:
        sparkContext = _Ctx()
        conf = _Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(_Session())


def test_cluster_sessions_use_a_mounted_checkpoint_folder(spark, tmp_path, monkeypatch):
    """A ``file:`` folder that all machines mount is used; one that loses rows is refused."""
    import pytest
    from washframe import session
    from washframe.operators.charts import box_data

    monkeypatch.delenv("WASHFRAME_SHARED_FILES", raising=False)
    session.checkpoint_root(spark)
    sc = spark.sparkContext
    monkeypatch.setattr(sc, "master", "spark://one:7077")
    monkeypatch.setattr(sc, "_washframe_shared", set(), raising=False)
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "k string, v double")
    assert {r["k"]: r["median"] for r in box_data(df, "k", "v").collect()} == {"a": 2.0, "b": 2.0}
    assert session._shared(spark, f"file://{tmp_path}") == f"file://{tmp_path}"
    assert not list(tmp_path.iterdir())
    monkeypatch.setattr(sc, "_washframe_shared", set())
    monkeypatch.setattr(session, "_rows_seen", lambda spark, path, tasks: tasks - 1)
    with pytest.raises(RuntimeError, match="shared by all machines"):
        session.scratch_path(spark, "x")
