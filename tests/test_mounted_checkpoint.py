"""Queries that need the checkpoint folder, on a session whose master is not local and
whose folder is a mounted one (``file:``)."""

import datetime

import pytest

QUERIES = [
    "box_outliers",
    "box_single",
    "clean_csv",
    "clean_data",
    "cleaning_report",
    "column_report",
    "csv_round_trip",
    "read_csv",
    "read_csv_multiline",
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    day = datetime.datetime(2024, 1, 1)
    events = [(i, day + datetime.timedelta(hours=i), i % 9, ("view", "buy", "click")[i % 3],
               900.0 if i % 40 == 3 else i * 37 % 101 / 4, f'{{"k": {i % 5}}}') for i in range(1, 121)]
    made = {
        "events": (events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"),
        "customer": ([(i, float(i * i % 97)) for i in range(60)] + [(60, 9000.0), (61, None)], "c_custkey long, c_acctbal double"),
        "documents": ([(i, None if i == 7 else f'One, "two"\r. Three, {i}. ', "en") for i in range(30)],
                      "doc_id long, text string, lang string"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{root}/{name}.parquet")
    return str(root)


@pytest.mark.parametrize("name", QUERIES)
def test_query_ends_with_a_mounted_checkpoint_folder(spark, tables, monkeypatch, name):
    from washframe import session
    from washframe.plans.catalog import QUERIES as found

    rows = lambda: sorted(map(repr, found[name](spark, tables).collect()))
    want = rows()
    assert want
    monkeypatch.delenv("WASHFRAME_SHARED_FILES", raising=False)
    assert session.checkpoint_root(spark).startswith("file:")
    monkeypatch.setattr(spark.sparkContext, "master", "spark://one:7077")
    monkeypatch.setattr(spark.sparkContext, "_washframe_shared", set(), raising=False)
    assert rows() == want
