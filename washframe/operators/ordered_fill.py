"""Forward / backward fill along an order, without funnelling rows into one task.

A plain ``last(c, ignorenulls) OVER (ORDER BY o)`` has no partition key, so
Spark runs it in a single task; with ``partition_by`` a hot key (a third of
all rows) still lands in one task. Here the fill is done in two levels:

1. the rows are cut into ``blocks`` contiguous ranges of the sort key
   (partition_by, order_by). The block of a row is a deterministic function of
   its key: boundaries come from a bounded, sorted sample of the key columns,
   and a binary search over them (a compiled comparison tree for up to 64
   boundaries, a search over one constant array of structs beyond) assigns
   the block.
   Being a pure expression, it gives the same block in every branch of the
   plan and on every recomputation (no range exchange, nothing materialised);
2. one aggregation gives, per (block, group), the last (backward: first)
   non-null value of each column (``max_by`` / ``min_by``, partial aggregation);
3. a window over that summary (per group, ordered by block: at most one row
   per block) gives the value carried into each block; only the first (last)
   group of a block can receive a carry, so the carry table has at most
   ``blocks`` rows and is broadcast (its size bound is the block count);
4. the local fill is a window over (block, group), i.e. one block at most.

A hot key spreads over many blocks. Ties of ``order_by`` are broken by a hash
of the whole row (ties make any ordered fill arbitrary; this makes the choice
deterministic), so a hot order value spreads over blocks too. Exact copies of one
row carry equal values: when the sample shows a row that fills a block with its
copies, equal rows are collapsed to (row, number) first (map-side combined) and
expanded after the fill, in chunks that are dealt evenly. Blocks follow the row
count: ``LEAST_BLOCK_ROWS`` or more each, and about ``MOST_BLOCK_ROWS`` where the
shuffle partitions alone would make larger ones.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from washframe.functions.columns import ident, q, sql_literal, value_of

SAMPLE_PER_BLOCK = 64       # sampled keys per block when choosing boundaries
SAMPLE_MAX = 200_000        # keys that a sample has at most on average; all sampled keys reach the driver


LEAST_BLOCK_ROWS = 10_000   # fewer blocks than shuffle partitions below this
MOST_BLOCK_ROWS = 500_000   # more blocks than shuffle partitions above this
CARRY_BROADCAST_BLOCKS = 4_096   # carried rows that are broadcast; more are joined
COPIES_CHUNK = 65_536       # copies of one row that a task expands at a time


def _blocks(df: DataFrame, blocks: int | None, rows: int) -> int:
    if blocks:
        return int(blocks)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(parts, -(-rows // LEAST_BLOCK_ROWS)), -(-rows // MOST_BLOCK_ROWS))


def _key_sql(df: DataFrame, name: str) -> tuple[str, T.DataType]:
    """An order-preserving SQL form of a key column and its type."""
    dt = df.schema[name].dataType
    if isinstance(dt, T.TimestampType):        # compare instants, free of time zones
        return f"unix_micros({ident(name)})", T.LongType()
    if isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
        raise ValueError(f"ordered fill keys must be atomic; {name} is {dt.simpleString()}")
    return ident(name), dt


def _literal(v, dt: T.DataType) -> str:
    if v is None:
        return f"CAST(NULL AS {dt.simpleString()})"
    if isinstance(dt, (T.StringType, T.BooleanType)) or isinstance(v, bool):
        return sql_literal(v)
    if isinstance(dt, T.BinaryType):
        return "X'" + bytes(v).hex() + "'"
    if isinstance(dt, (T.TimestampNTZType, T.DateType)):
        return f"CAST('{v.isoformat()}' AS {dt.simpleString()})"
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return f"CAST('{float(v)!r}' AS {dt.simpleString()})"
    return f"CAST('{v}' AS {dt.simpleString()})"


def _boundaries(keys: DataFrame, n_blocks: int, rows: int | None = None) -> list[tuple]:
    """Sorted, distinct split points of the key from a bounded sample
    (``rows``: the row count when already known). Fewer than ``n_blocks - 1`` mean
    that copies of one key fill a block."""
    if n_blocks <= 1:
        return []
    n = rows if rows is not None else keys.count()
    if n == 0:
        return []
    target = min(SAMPLE_PER_BLOCK * n_blocks, SAMPLE_MAX)
    if n > target:
        keys = keys.sample(fraction=target / n, seed=20240101)
    rows = keys.orderBy(*[F.col(c).asc_nulls_first() for c in keys.columns]).collect()
    if not rows:
        return []
    step = len(rows) / n_blocks
    out: list[tuple] = []
    for i in range(1, n_blocks):
        b = tuple(rows[min(int(i * step), len(rows) - 1)])
        if not out or out[-1] != b:
            out.append(b)
    return out


TREE_MAX_BOUNDS = 64         # up to here a compiled comparison tree; beyond, an array search


def _block_sql(bounds: list[tuple], types: list[T.DataType]) -> str:
    """Number of boundaries <= _key, by binary search.

    Few boundaries: a nested ``CASE`` of struct comparisons (compiled with the
    rest of the stage). More (a cluster's thousands of shuffle partitions): a
    search over one constant array, ceil(log2(blocks + 1)) steps per row, whose
    expression size does not grow with the block count (a comparison tree over
    thousands of boundaries exceeds what code generation compiles)."""
    if not bounds:
        return "0"

    def lit(b):
        return "named_struct(" + ", ".join(
            f"'k{i}', {_literal(v, t)}" for i, (v, t) in enumerate(zip(b, types))) + ")"

    if len(bounds) <= TREE_MAX_BOUNDS:
        def tree(lo: int, hi: int) -> str:
            if lo >= hi:
                return str(lo)
            mid = (lo + hi) // 2
            return f"CASE WHEN _key < {lit(bounds[mid])} THEN {tree(lo, mid)} ELSE {tree(mid + 1, hi)} END"
        return tree(0, len(bounds))

    arr = "array(" + ", ".join(lit(b) for b in bounds) + ")"
    steps = math.ceil(math.log2(len(bounds) + 1))
    mid = "shiftright(acc.lo + acc.hi, 1)"
    return (f"aggregate(sequence(1, {steps}), named_struct('lo', 0, 'hi', {len(bounds)}), "
            f"(acc, i) -> IF(acc.lo >= acc.hi, acc, "
            f"IF(_key < element_at({arr}, {mid} + 1), "
            f"named_struct('lo', acc.lo, 'hi', {mid}), "
            f"named_struct('lo', {mid} + 1, 'hi', acc.hi))), acc -> acc.lo)")


def ordered_fill(df: DataFrame, cols: list[str], order_by: list[str],
                 partition_by: list[str] | None = None, backward: bool = False,
                 blocks: int | None = None, rows: int | None = None) -> DataFrame:
    """Fill nulls of ``cols`` from the nearest earlier (``backward``: later) non-null
    value along ``order_by``, within ``partition_by`` groups. ``rows``: the row
    count of ``df`` if known (saves a counting pass)."""
    if not order_by:
        raise ValueError("an ordered fill needs order_by")
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df
    # positional names inside, so that no column can clash with the helper columns
    names = df.columns
    place = {c.lower(): f"u{i}" for i, c in enumerate(names)} | {c: f"u{i}" for i, c in enumerate(names)}
    unknown = [c for c in (*order_by, *(partition_by or [])) if c not in place and c.lower() not in place]
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")

    def inner(given):
        return [place.get(c, place.get(c.lower())) for c in given]

    n = rows if rows is not None else df.count()
    out = _fill(df.toDF(*[f"u{i}" for i in range(len(names))]), inner(cols), inner(order_by), inner(partition_by or []),
                backward, blocks, n)
    return out.toDF(*names)


def _collapsed(df: DataFrame) -> DataFrame:
    """Distinct rows and the number of their copies."""
    return df.groupBy(*[q(c) for c in df.columns]).agg(F.count("*").alias("_copies"))


def _expanded(df: DataFrame) -> DataFrame:
    """The rows of ``_collapsed`` with their copies, chunks of which are dealt evenly."""
    chunk = F.lit(COPIES_CHUNK)
    chunks = df.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / chunk))))
    size = F.least(chunk.cast("long"), F.col("_copies") - F.col("_chunk") * chunk)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chunks.withColumn("_size", size.cast("int")).repartition(parts)
    return dealt.withColumn("_copy", F.explode(F.array_repeat(F.lit(True), F.col("_size")))).drop(
        "_copies", "_chunk", "_size", "_copy")


def _fill(df: DataFrame, cols: list[str], order_by: list[str], part: list[str], backward: bool, blocks: int | None,
          n: int, collapse: bool = True) -> DataFrame:
    # Ties of the order key are broken by a hash of the whole row, so a hot
    # order value (a third of all rows at one timestamp) spreads over many
    # blocks. Only exact copies still tie, and copies carry equal values.
    hashable = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    ordered = list(order_by) + ["_tb"]
    keys = part + ordered
    base = df.select(*[q(c) for c in df.columns],
                     *[value_of(df, c).alias(f"_f{i}") for i, c in enumerate(cols)],
                     F.xxhash64(*[q(c) for c in hashable]).alias("_tb"))
    key_sql, key_types = zip(*[_key_sql(base, k) for k in keys])
    key_struct = "named_struct(" + ", ".join(f"'k{i}', {s}" for i, s in enumerate(key_sql)) + ")"
    base = base.withColumn("_key", F.expr(key_struct))
    n_blocks = _blocks(df, blocks, n)
    bounds = _boundaries(base.select("_key.*"), n_blocks, n)
    copies = n > n_blocks and len(bounds) < n_blocks - 1
    if copies and collapse and len(hashable) == len(df.columns):
        rows = _collapsed(df)
        return _expanded(_fill(rows, cols, order_by, part, backward, blocks, rows.count(), collapse=False))
    base = base.withColumn("_blk", F.expr(_block_sql(bounds, list(key_types))).cast("int"))

    along = F.struct(*[q(o) for o in ordered])
    pick = F.min_by if backward else F.max_by      # first / last non-null of a block
    summary_aggs = [pick(F.col(f"_f{i}"), F.when(F.col(f"_f{i}").isNotNull(), along)).alias(f"_l{i}")
                    for i in range(len(cols))]
    gkey = F.struct(*[q(p) for p in part]) if part else F.lit(0)
    summary = base.groupBy("_blk", gkey.alias("_g")).agg(*summary_aggs)

    # Value carried into (block, group) from the group's earlier (later) blocks.
    # Backward is forward along the reversed order: running frames only (a
    # "current row .. unbounded following" frame costs O(n^2) per partition).
    blk_order = F.col("_blk").desc() if backward else F.col("_blk").asc()
    w_carry = Window.partitionBy("_g").orderBy(blk_order).rowsBetween(Window.unboundedPreceding, -1)
    carry = [F.last(f"_l{i}", ignorenulls=True).over(w_carry).alias(f"_c{i}") for i in range(len(cols))]
    edge = F.col("_g").desc() if backward else F.col("_g").asc()
    carried = summary.select("_blk", "_g", *carry)
    # Only a block's first (backward: last) group continues across blocks.
    carried = (carried.withColumn("_rank", F.row_number().over(Window.partitionBy("_blk").orderBy(edge)))
               .where(F.col("_rank") == 1).drop("_rank"))
    # One row per block: broadcast while the blocks are few, whatever their values' size
    few = len(bounds) < CARRY_BROADCAST_BLOCKS
    filled = base.withColumn("_g", gkey).join(F.broadcast(carried) if few else carried, on=["_blk", "_g"], how="left")

    order = [q(o).desc_nulls_last() if backward else q(o).asc_nulls_first() for o in ordered]
    w_local = (Window.partitionBy("_blk", "_g").orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fills = {c: F.coalesce(F.last(f"_f{i}", ignorenulls=True).over(w_local), F.col(f"_c{i}"))
             for i, c in enumerate(cols)}
    return filled.select(*[fills[f.name].cast(f.dataType).alias(f.name) if f.name in fills
                           else q(f.name) for f in df.schema.fields])


def fill_ffill(df: DataFrame, cols: list[str], order_by: list[str],
               partition_by: list[str] | None = None, blocks: int | None = None,
               rows: int | None = None) -> DataFrame:
    """Last non-missing value before each row; leading missing values stay missing."""
    return ordered_fill(df, cols, order_by, partition_by, backward=False, blocks=blocks, rows=rows)


def fill_bfill(df: DataFrame, cols: list[str], order_by: list[str],
               partition_by: list[str] | None = None, blocks: int | None = None) -> DataFrame:
    """Next non-missing value after each row; trailing missing values stay missing."""
    return ordered_fill(df, cols, order_by, partition_by, backward=True, blocks=blocks)
