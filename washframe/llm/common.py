"""Small Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from washframe.session import drop_scratch, scratch_path, ship_code

ID_BROADCAST_ROWS = 1_000_000   # id lists up to this counted size are broadcast
ARROW_BYTES = 4 << 20           # bytes of an Arrow batch, of which JVM and worker hold several copies
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_written: list[tuple[SparkSession, str]] = []


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package on the workers' path, in batches of about
    ``ARROW_BYTES`` unless the session sets another size."""
    ship_code(df.sparkSession)
    if df.sparkSession.conf.get(_BATCH_SETTING, None) is None:
        df.sparkSession.conf.set(_BATCH_SETTING, str(ARROW_BYTES))
    return df.mapInArrow(fn, schema)


def byte_slices(batch, column: int, limit: int = 1 << 21):
    """Parts of an Arrow batch with about ``limit`` bytes of a text column each (or one
    longer text), so what is made of them at a time is bounded."""
    import pyarrow.compute as pc
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = (sizes.cumsum() - sizes) // limit
    lo = 0
    for hi in [*(part[1:] != part[:-1]).nonzero()[0] + 1, len(sizes)]:
        if hi > lo:
            yield batch.slice(lo, hi - lo)
        lo = hi


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared checkpoint folder and read it.

    Cuts the lineage: a lost executor costs only the tasks that read the table.
    ``forget`` deletes it; what is left goes when the process ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete tables of ``store`` that no later read needs."""
    for df in frames:
        path = getattr(df, "_scratch", None)
        if path:
            drop_scratch(df.sparkSession, path)
            _written[:] = [x for x in _written if x[1] != path]


@atexit.register
def _at_exit() -> None:
    for spark, path in _written:
        try:
            drop_scratch(spark, path)
        except Exception:  # the session has ended already
            return


def only_ids(df: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose keys are in ``ids`` (distinct, stored). A list of at
    most ``ID_BROADCAST_ROWS`` counted rows is broadcast, so the texts of ``df``
    are filtered in place; a longer one is joined by shuffle."""
    few = ids.count() <= ID_BROADCAST_ROWS
    return df.join(F.broadcast(ids) if few else ids, keys, "left_semi")


def without_ids(df: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose keys are not in ``ids`` (stored); dealt as in ``only_ids``."""
    few = ids.count() <= ID_BROADCAST_ROWS
    return df.join(F.broadcast(ids) if few else ids, keys, "left_anti")


def numbered(df: DataFrame, order: list, name: str, label: str) -> DataFrame:
    """Global positions 0, 1, ... in the given order without a single-task sort:
    range partitions are sorted and stored, and each gets the row count of those
    before it as its offset (one row per partition in the prefix sum)."""
    parts = (df.repartitionByRange(*order).sortWithinPartitions(*order)
             .withColumn("_m", F.monotonically_increasing_id()))
    parts = parts.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.expr("_m & 8589934591"))
    parts = store(parts.drop("_m"), label)
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.selectExpr("_p", "sum(_n) OVER (ORDER BY _p) - _n AS _before")
    return (parts.join(F.broadcast(before), "_p")
            .withColumn(name, F.col("_before") + F.col("_i")).drop("_p", "_i", "_before"))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
