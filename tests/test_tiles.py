"""Wide aggregations in tiles."""

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from washframe.operators.tiles import aggregate_row, cut_tiles
from washframe.plans import cleaning


@given(st.lists(st.integers(1, 12)), st.integers(1, 20))
def test_tiles_cover_all_in_order(weights, tile):
    parts = cut_tiles(weights, tile)
    assert [i for p in parts for i in p] == list(range(len(weights)))
    for p in parts:
        assert len(p) == 1 or sum(weights[i] for i in p) <= tile
    assert all(sum(weights[i] for i in a) + weights[b.start] > tile for a, b in zip(parts, parts[1:]))


def test_tiles_give_what_one_aggregation_gives(spark):
    df = spark.range(100).select(*[(F.col("id") * i).alias(f"c{i}") for i in range(12)])
    aggs = [f(f"c{i}").alias(f"{f.__name__}{i}") for i in range(12) for f in (F.sum, F.max)]
    one = df.groupBy().agg(*aggs).collect()[0].asDict()
    assert aggregate_row(df, aggs, tile=5) == aggregate_row(df, aggs, tile=None) == one
    assert aggregate_row(df, []) == {}


def test_a_tile_reads_its_own_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).select(*[F.col("id").alias(f"c{i}") for i in range(6)]).write.parquet(path)
    part = spark.read.parquet(path).groupBy().agg(F.max("c1"), F.max("c2"))
    assert "ReadSchema: struct<c1:bigint,c2:bigint>" in part._jdf.queryExecution().toString()


def test_cleaning_in_tiles_is_the_same(spark, monkeypatch):
    df = spark.range(400).select(
        F.when(F.col("id") % 7 > 0, F.col("id") % 50).alias("a"), F.when(F.col("id") % 99 == 0, 1e6).otherwise(F.sin("id")).alias("b"),
        F.concat(F.lit(" w"), F.col("id") % 9).alias("s"), (F.col("id") % 30).cast("string").alias("n"), F.lit("x").alias("k"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id % 60)").alias("t"))

    def cleaned(**options):
        r = cleaning.clean_data(df, cleaning.CleaningOptions(order_by=["t"], **options))
        rows = sorted(map(tuple, r.df.collect()), key=repr)
        r.release()
        return rows, r.df.columns, r.log.names(), r.summary()

    whole = cleaned()
    monkeypatch.setattr(cleaning, "TILE", 3)
    assert cleaned() == whole and cleaned(materialize="none") == whole and cleaned(materialize="persist") == whole
