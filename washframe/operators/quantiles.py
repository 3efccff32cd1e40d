"""Exact quantiles (linear interpolation) at any scale.

Spark's exact ``percentile`` / ``median`` keeps a value->count map per group and
merges it in one task, so a global median of a 100 TB column, or of one group
holding a third of the rows, funnels every distinct value through one task.
Here the exact answer is found by narrowing instead:

1. one aggregation per group gives the count and an approximate quantile grid
   (``percentile_approx``: bounded sketch, partial aggregation);
2. each target rank gets a bracket [lo, hi] from the grid; one aggregation
   counts the values below and inside it and builds a finer grid inside;
3. once a bracket holds at most ``resolve_max`` values, the values inside it
   are grouped by value (partial aggregation again) and the exact order
   statistics are read off a running count over that bounded candidate set.

Whole columns (``column_quantiles``) go the same way in wide aggregations, with a
mergeable sketch per column and brackets as literals: no stacking, join or state.

Counts verify every bracket, so the approximate sketch only steers; it never
decides the answer. Results equal numpy / pandas ``linear`` quantiles.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from washframe.functions.columns import ident, q, sql_literal
from washframe.operators.hot_keys import join_groups
from washframe.session import checkpoint_root

GRID = 256               # grid points per approximate pass
ACCURACY = 4_000         # percentile_approx accuracy: rank error <= n / ACCURACY (0.06 grid cell)
RESOLVE_MAX = 1_000_000  # values per group resolved exactly in one task (~100 MB value map)
DIRECT_TOTAL_MAX = 4_000_000  # values of all columns in one exact wide aggregation
BROADCAST_TARGETS = 200_000  # target rows broadcast to the scan; beyond, a shuffle join
SKETCH_K = 4096          # sketch size: rank error about 0.05% of the values
SKETCH_GRID = 1024       # equal rank steps at which a sketch is read
SKETCH_PAD = 2           # steps added at both ends of a bracket
SKETCHES = 64            # sketches of one aggregation
READ_MAX = 200_000       # values of brackets whose distinct values come to the driver at a time
MAX_ROUNDS = 1000   # an error, never a weaker answer


def direct_budget(counts: list[int]) -> list[bool]:
    """Which columns may add an exact ``percentile`` to one shared aggregation:
    each holds at most RESOLVE_MAX values and, in order, their total stays within
    DIRECT_TOTAL_MAX (all value maps of a global aggregation meet in one task).
    The others go through ``column_quantiles``, which chunks them."""
    out, total = [], 0
    for n in counts:
        ok = n is not None and n <= RESOLVE_MAX and total + n <= DIRECT_TOTAL_MAX
        total += n if ok else 0
        out.append(ok)
    return out


class _Names:
    value = "_qv"
    idx = "_qi"


def _grid_probs() -> list[float]:
    return [k / (GRID - 1) for k in range(GRID)]


def _approx_sql(col: str, probs: list[float]) -> Column:
    """percentile_approx over a literal probability array, as one SQL expression."""
    arr = ", ".join(f"CAST({p!r} AS DOUBLE)" for p in probs)
    return F.expr(f"percentile_approx({col}, array({arr}), {ACCURACY})")


def _grid_at(grid: Column, index: Column) -> Column:
    """Grid value at a 0-based index, null when the index falls off the grid."""
    return F.when((index >= 0) & (index <= GRID - 1),
                  F.element_at(grid, (index + 1).cast("int")))


def _bracket(grid: Column, first: Column, last: Column, count: Column):
    """Bracket around ranks [first, last] (0-based) of ``count`` values from a grid."""
    scale = F.lit(GRID - 1) / F.greatest(count - 1, F.lit(1))
    lo = _grid_at(grid, F.floor(first * scale) - 1)
    hi = _grid_at(grid, F.ceil(last * scale) + 1)
    return lo, hi


def _inside(v: Column, lo: Column, hi: Column) -> Column:
    return (lo.isNull() | (v >= lo)) & (hi.isNull() | (v <= hi))


def _attach(long_df: DataFrame, targets: DataFrame, keys: list[str], n_targets: int) -> DataFrame:
    """Rows with the targets of their group; above the broadcast bound hot groups stay unshuffled."""
    return join_groups(long_df, targets, keys, "_n", n_targets, BROADCAST_TARGETS)


def exact_quantiles(long_df: DataFrame, keys: list[str], value: str,
                    probs: list[float], approx: bool = False,
                    resolve_max: int = RESOLVE_MAX, max_group_size: int | None = None) -> DataFrame:
    """Per group of ``keys``: ``_n`` (non-null count) and ``q0..q{m-1}``.

    ``long_df`` holds the key columns and one numeric ``value`` column; null
    values are ignored. With no keys the result is one row. ``approx=True``
    returns ``percentile_approx`` (bounded memory, rank error n/ACCURACY).
    ``max_group_size``: a known upper bound of any group's non-null count (e.g.
    from an earlier count); at most ``resolve_max`` skips the narrowing.
    """
    probs = [float(p) for p in probs]
    if any(p < 0 or p > 1 for p in probs):
        raise ValueError("probabilities must be within [0, 1]")
    nm = _Names()
    data = long_df.select(*[q(k) for k in keys],
                          q(value).cast("double").alias(nm.value))
    data = data.where(F.col(nm.value).isNotNull() & ~F.isnan(nm.value))
    if not keys:
        data = data.withColumn("_qg", F.lit(0))
        keys = ["_qg"]
        drop_key = True
    else:
        drop_key = False
    out_cols = [f"q{i}" for i in range(len(probs))]

    if approx:
        res = data.groupBy(*keys).agg(
            F.count(nm.value).alias("_n"),
            _approx_sql(nm.value, probs).alias("_qa"))
        res = res.select(*keys, "_n", *[F.col("_qa")[i].alias(c) for i, c in enumerate(out_cols)])
        return res.drop("_qg") if drop_key else res

    prob_arr = "array(" + ", ".join(f"CAST({p!r} AS DOUBLE)" for p in probs) + ")"

    def direct(frame: DataFrame) -> DataFrame:
        # Every group holds at most resolve_max values (proven by a count), so
        # Spark's exact percentile map per group is bounded.
        res = frame.groupBy(*keys).agg(
            F.count(nm.value).alias("_n"),
            F.expr(f"percentile({nm.value}, {prob_arr})").alias("_qa"))
        res = res.select(*keys, "_n", *[F.col("_qa")[i].alias(c) for i, c in enumerate(out_cols)])
        return res.drop("_qg") if drop_key else res

    if max_group_size is not None and max_group_size <= resolve_max:
        return direct(data)

    # Round 0: count and coarse grid per group.
    stats = data.groupBy(*keys).agg(
        F.count(nm.value).alias("_n"),
        _approx_sql(nm.value, _grid_probs()).alias("_grid"))
    targets = stats.select(
        *keys, "_n", "_grid",
        F.expr("posexplode(array(" + ", ".join(f"CAST({p!r} AS DOUBLE)" for p in probs) + "))")
         .alias(nm.idx, "_p"))
    targets = (targets
               .withColumn("_pos", F.col("_p") * (F.col("_n") - 1))
               .withColumn("_j0", F.floor("_pos"))
               .withColumn("_j1", F.ceil("_pos")))
    small = F.col("_n") <= resolve_max
    lo, hi = _bracket(F.col("_grid"), F.col("_j0"), F.col("_j1"), F.col("_n"))
    targets = targets.select(
        *keys, nm.idx, "_n", "_pos", "_j0", "_j1",
        F.when(small, F.lit(None)).otherwise(lo).cast("double").alias("_lo"),
        F.when(small, F.lit(None)).otherwise(hi).cast("double").alias("_hi"),
        F.lit(0).cast("long").alias("_base"),
        small.alias("_ready"),
        # last verified bracket (the whole group to begin with)
        F.lit(None).cast("double").alias("_vlo"), F.lit(None).cast("double").alias("_vhi"),
        F.lit(0).cast("long").alias("_vbase"))
    checkpoint_root(data.sparkSession)
    targets = targets.checkpoint(eager=True)

    def tally(t):
        row = t.groupBy().agg(F.expr("count(1) AS n"),
                              F.expr("count_if(NOT coalesce(_ready, false)) AS p")).collect()[0]
        return row["n"], row["p"]

    n_targets, n_pending = tally(targets)
    if n_pending == 0:
        targets.unpersist()
        return direct(data)
    state_cols = [*keys, nm.idx, "_n", "_pos", "_j0", "_j1", "_lo", "_hi", "_base", "_ready",
                  "_vlo", "_vhi", "_vbase"]
    rounds = 0
    while n_pending > 0:
        rounds += 1
        if rounds > MAX_ROUNDS:
            # Brackets shrink or lose endpoint copies every round.
            raise RuntimeError("quantile brackets do not converge")
        pending = targets.where(~F.coalesce(F.col("_ready"), F.lit(False)))
        v, plo, phi = F.col(nm.value), F.col("_lo"), F.col("_hi")
        joined = _attach(data, pending.select(*keys, nm.idx, "_n", "_lo", "_hi"), keys, n_pending)
        # (rows with v == lo / v == hi, and the nearest values strictly inside,
        # let a bracket made of endpoint copies shrink when the grid cannot)
        joined = joined.withColumn("_in_bracket", _inside(v, plo, phi))
        inside = F.col("_in_bracket")
        counted = joined.groupBy(*keys, nm.idx).agg(
            F.count_if(plo.isNotNull() & (v < plo)).alias("_below"),
            F.count_if(inside).alias("_in"),
            F.min(F.when(inside, v)).alias("_mn"), F.max(F.when(inside, v)).alias("_mx"),
            F.count_if(inside & (v == plo)).alias("_eq_lo"), F.count_if(inside & (v == phi)).alias("_eq_hi"),
            F.min(F.when(inside & (v > plo), v)).alias("_after_lo"),
            F.max(F.when(inside & (v < phi), v)).alias("_before_hi"),
            _approx_sql(f"IF(_in_bracket, {nm.value}, NULL)", _grid_probs()).alias("_g2"))
        step = pending.join(counted, on=[*keys, nm.idx], how="left")
        below = F.coalesce(F.col("_below"), F.lit(0))
        inn = F.coalesce(F.col("_in"), F.lit(0))
        ok_lo = below <= F.col("_j0")
        ok_hi = (below + inn) > F.col("_j1")
        ok = ok_lo & ok_hi
        nlo, nhi = _bracket(F.col("_g2"), F.col("_j0") - below, F.col("_j1") - below, inn)
        # Resolution groups the bracket by value: few rows, or one single value
        # (a hot value filling the bracket), are both bounded.
        single = F.col("_mn").isNotNull() & (F.col("_mn") == F.col("_mx"))
        resolved = F.coalesce(ok & ((inn <= resolve_max) | single), F.lit(False))
        # Off the inner grid, the exact min / max inside close the bracket.
        grid_lo = F.coalesce(nlo, F.col("_mn"), F.col("_lo"))
        grid_hi = F.coalesce(nhi, F.col("_mx"), F.col("_hi"))
        # No progress: the bracket is mostly copies of its endpoints. Drop an
        # endpoint's copies unless a target rank lies among them; if both hold a
        # target, only those two values surround the targets (bounded).
        stuck = F.coalesce(ok & ~resolved & (grid_lo == F.col("_lo")) & (grid_hi == F.col("_hi")),
                           F.lit(False))
        keep_lo = (below + F.col("_eq_lo")) > F.col("_j0")
        keep_hi = (below + inn - F.col("_eq_hi")) <= F.col("_j1")
        two_values = stuck & keep_lo & keep_hi
        ready = resolved | two_values
        step = step.select(
            *keys, nm.idx, "_n", "_pos", "_j0", "_j1",
            # failed side: drop that bound; verified & too wide: refine
            F.when(~ok, F.when(ok_lo, F.col("_lo")))
             .when(ready, F.col("_lo"))
             .when(stuck, F.when(keep_lo, F.col("_lo")).otherwise(F.col("_after_lo")))
             .otherwise(grid_lo).alias("_lo"),
            F.when(~ok, F.when(ok_hi, F.col("_hi")))
             .when(ready, F.col("_hi"))
             .when(stuck, F.when(keep_hi, F.col("_hi")).otherwise(F.col("_before_hi")))
             .otherwise(grid_hi).alias("_hi"),
            F.when(ready, below).otherwise(F.lit(0)).cast("long").alias("_base"),
            ready.alias("_ready"),
            F.when(ok, F.col("_lo")).otherwise(F.col("_vlo")).alias("_vlo"),
            F.when(ok, F.col("_hi")).otherwise(F.col("_vhi")).alias("_vhi"),
            F.when(ok, below).otherwise(F.col("_vbase")).cast("long").alias("_vbase"))
        done = targets.where(F.coalesce(F.col("_ready"), F.lit(False))).select(*state_cols)
        # The state refers to itself each round; a reliable checkpoint keeps its
        # plan from growing and survives executor loss.
        new_targets = done.unionByName(step.select(*state_cols)).checkpoint(eager=True)
        _, n_pending = tally(new_targets)
        targets.unpersist()
        targets = new_targets

    # Resolution: candidates inside each bracket, grouped by value.
    bounds = targets.select(*keys, nm.idx, "_n", "_lo", "_hi")
    joined = _attach(data, bounds, keys, n_targets)
    v = F.col(nm.value)
    cand = (joined.where(_inside(v, F.col("_lo"), F.col("_hi")))
            .groupBy(*keys, nm.idx, nm.value).agg(F.count(F.lit(1)).alias("_c")))
    w = (Window.partitionBy(*keys, nm.idx).orderBy(nm.value)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cand = cand.withColumn("_cum", F.sum("_c").over(w))
    cand = cand.join(targets.select(*keys, nm.idx, "_base", "_j0", "_j1", "_pos", "_n"),
                     on=[*keys, nm.idx])
    reach = F.col("_base") + F.col("_cum")
    picked = cand.groupBy(*keys, nm.idx).agg(
        F.first("_n").alias("_n"), F.first("_pos").alias("_pos"), F.first("_j0").alias("_j0"),
        F.min(F.when(reach > F.col("_j0"), v)).alias("_v0"),
        F.min(F.when(reach > F.col("_j1"), v)).alias("_v1"))
    frac = F.col("_pos") - F.col("_j0")
    # as ``percentile`` interpolates, so both paths agree on infinite neighbours
    picked = picked.withColumn("_q", F.when((F.col("_v0") == F.col("_v1")) | (frac == 0), F.col("_v0"))
                               .otherwise((1 - frac) * F.col("_v0") + frac * F.col("_v1")))
    # Groups without any non-null value do not appear.
    res = picked.groupBy(*keys).agg(
        F.first("_n").alias("_n"),
        *[F.max(F.when(F.col(nm.idx) == i, F.col("_q"))).alias(c) for i, c in enumerate(out_cols)])
    return res.drop("_qg") if drop_key else res


def stack_columns(df: DataFrame, cols: list[str], name_col: str = "column",
                  value_col: str = "value", keys: list[str] | None = None) -> DataFrame:
    """Long form (keys..., column name, value as double) of several numeric columns."""
    keys = keys or []
    items = "inline(array(" + ", ".join(
        f"named_struct({sql_literal(name_col)}, {sql_literal(c)}, {sql_literal(value_col)}, "
        f"CAST({ident(c)} AS DOUBLE))" for c in cols) + "))"
    return df.selectExpr(*[ident(k) for k in keys], items)


def column_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                     approx: bool = False, max_group_size: int | None = None
                     ) -> dict[str, list[float | None]]:
    """Exact quantiles of several columns at once; small result on the driver."""
    if not cols:
        return {}
    if approx or (max_group_size is not None and max_group_size <= RESOLVE_MAX):
        # Bounded per column (sketch, or a proven count): wide aggregations, no
        # stacking into long form. Exact value maps of all columns of one
        # aggregation meet in one task, so columns are chunked to keep their
        # total within DIRECT_TOTAL_MAX.
        arr = "array(" + ", ".join(f"CAST({p!r} AS DOUBLE)" for p in probs) + ")"
        fn = (lambda v: f"percentile_approx({v}, {arr}, {ACCURACY})") if approx else \
             (lambda v: f"percentile({v}, {arr})")
        per_chunk = len(cols) if approx else max(1, DIRECT_TOTAL_MAX // max(max_group_size, 1))
        out: dict[str, list[float | None]] = {}
        for start in range(0, len(cols), per_chunk):
            chunk = cols[start:start + per_chunk]
            exprs = [F.expr(fn(f"nanvl(CAST({ident(c)} AS DOUBLE), CAST(NULL AS DOUBLE))") + f" AS q{i}")
                     for i, c in enumerate(chunk)]
            row = df.groupBy().agg(*exprs).collect()[0]
            out.update({c: (list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs))
                        for i, c in enumerate(chunk)})
        return out
    return _select_by_sketch(df, cols, probs)


def _double_sql(c: str) -> str:
    return f"nanvl(CAST({ident(c)} AS DOUBLE), CAST(NULL AS DOUBLE))"


def _literal(x: float) -> str:
    return f"CAST({sql_literal(repr(float(x)))} AS DOUBLE)"   # infinities too


@dataclass
class _Target:
    """The order statistics ``ranks`` (0-based) of a column, closed in by [lo, hi]."""

    column: int
    ranks: tuple[int, int]
    lo: float
    hi: float
    below: int = 0
    found: dict[int, float] = field(default_factory=dict)

    def open(self) -> list[int]:
        return [r for r in set(self.ranks) if r not in self.found]


def _grid_sql(values: list[str]) -> list[str]:
    """Per value expression its count, least, greatest and (null if none) sketch grid."""
    ranks = ", ".join(f"{k / SKETCH_GRID!r}D" for k in range(SKETCH_GRID + 1))
    return [x for i, v in enumerate(values) for x in (
        f"n{i}", f"mn{i}", f"mx{i}", f"IF(n{i} > 0, kll_sketch_get_quantile_double(s{i}, array({ranks})), NULL) AS g{i}")]


def _sketched(df: DataFrame, values: list[str]):
    """One wide aggregation (mergeable sketches, a few kilobytes each) and its row."""
    aggs = [F.expr(x) for i, v in enumerate(values) for x in (
        f"count({v}) AS n{i}", f"min({v}) AS mn{i}", f"max({v}) AS mx{i}", f"kll_sketch_agg_double({v}, {SKETCH_K}) AS s{i}")]
    return df.groupBy().agg(*aggs).selectExpr(*_grid_sql(values)).collect()[0]


def _closed_in(row, i: int, ranks: list[int], below: int) -> tuple[float, float]:
    """Bracket of ranks from a grid over the values behind the ``below`` least ones."""
    n, grid = row[f"n{i}"], row[f"g{i}"]
    at = [(r - below) / max(n - 1, 1) * SKETCH_GRID for r in (min(ranks), max(ranks))]
    first, last = math.floor(at[0]) - SKETCH_PAD, math.ceil(at[1]) + SKETCH_PAD
    return (grid[first] if first > 0 else row[f"mn{i}"]), (grid[last] if last < SKETCH_GRID else row[f"mx{i}"])


def _select_by_sketch(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of columns of any length. A mergeable sketch per column gives a
    bracket for every target; one aggregation with the brackets as literals counts what
    lies below, at and between their ends, so the counts decide and the sketch only
    steers. Brackets with few values inside are read off; others get a sketch of their
    inside. Every pass is wide: no stacking, no join, no stored state."""
    values = [_double_sql(c) for c in cols]
    row = _sketched(df, values)
    targets: list[_Target] = []
    for i in range(len(cols)):
        n = row[f"n{i}"]
        for p in probs if n else ():
            ranks = (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))
            targets.append(_Target(i, ranks, *_closed_in(row, i, list(ranks), 0)))
    todo, bounds = targets, [(row[f"mn{i}"], row[f"mx{i}"]) for i in range(len(cols))]
    for _ in range(MAX_ROUNDS):
        if not todo:
            break
        todo = _narrowed(df, values, bounds, todo)
    else:
        raise RuntimeError("quantile brackets do not converge")
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols}
    at = iter(targets)
    for i, c in enumerate(cols):
        for k, p in enumerate(probs if row[f"n{i}"] else ()):
            t, place = next(at), p * (row[f"n{i}"] - 1)
            v0, v1 = (t.found[r] for r in t.ranks)
            part = place - math.floor(place)
            # as ``percentile`` interpolates, so both paths agree on infinite neighbours
            out[c][k] = v0 if v0 == v1 or part == 0 else (1 - part) * v0 + part * v1
    return out


def _narrowed(df: DataFrame, values: list[str], bounds, todo: list[_Target]) -> list[_Target]:
    """One round: counts, then values or a finer bracket. Gives the targets still open."""
    aggs = []
    for k, t in enumerate(todo):
        v, lo, hi = values[t.column], _literal(t.lo), _literal(t.hi)
        aggs += [F.expr(f"count_if({test}) AS {name}{k}") for name, test in (
            ("b", f"{v} < {lo}"), ("l", f"{v} = {lo}"), ("i", f"{v} > {lo} AND {v} < {hi}"),
            ("h", f"{v} = {hi} AND {lo} < {hi}"))]
    row = df.groupBy().agg(*aggs).collect()[0]
    few, many = [], []
    for k, t in enumerate(todo):
        below, at_lo, inside, at_hi = (row[f"{x}{k}"] for x in "blih")
        t.below = below + at_lo
        for r in t.open():
            if below <= r < t.below:
                t.found[r] = t.lo
            elif t.below + inside <= r < t.below + inside + at_hi:
                t.found[r] = t.hi
        low, high = (min(t.open(), default=below), max(t.open(), default=below))
        if not t.open():
            continue
        if low < below or high >= t.below + inside + at_hi:      # the sketch was off: that side opens up
            t.lo = bounds[t.column][0] if low < below else t.lo
            t.hi = bounds[t.column][1] if high >= t.below + inside + at_hi else t.hi
            many.append((t, None))
        else:
            (few if inside <= READ_MAX else many).append((t, inside))
    # read off: brackets in groups of bounded size
    while few:
        part, total = [], 0
        while few and (not part or total + few[0][1] <= READ_MAX):
            total += few[0][1]
            part.append(few.pop(0)[0])
        _read_off(df, values, part)
    finer = [t for t, inside in many if inside is not None]
    for lo in range(0, len(finer), SKETCHES):
        part = finer[lo:lo + SKETCHES]
        row = _sketched(df, [f"IF({values[t.column]} > {_literal(t.lo)} AND {values[t.column]} < {_literal(t.hi)}, "
                             f"{values[t.column]}, NULL)" for t in part])
        for k, t in enumerate(part):
            t.lo, t.hi = _closed_in(row, k, t.open(), t.below)
    return [t for t, _ in many]


def _read_off(df: DataFrame, values: list[str], part: list[_Target]) -> None:
    """Order statistics of brackets that hold at most ``READ_MAX`` values together:
    their distinct values and counts come to the driver."""
    inside = [f"{values[t.column]} > {_literal(t.lo)} AND {values[t.column]} < {_literal(t.hi)}" for t in part]
    pairs = ", ".join(f"IF({test}, struct({k} AS k, {values[t.column]} AS v), NULL)"
                      for k, (t, test) in enumerate(zip(part, inside)))
    rows = (df.where(" OR ".join(f"({x})" for x in inside)).selectExpr(f"explode(array_compact(array({pairs}))) AS x")
            .groupBy("x.k", "x.v").count().collect())
    for k, t in enumerate(part):
        reach = t.below
        for v, n in sorted((r["v"], r["count"]) for r in rows if r["k"] == k):
            for r in t.open():
                if reach <= r < reach + n:
                    t.found[r] = v
            reach += n
