"""The cleaning pipeline (fixed step order, each step switchable) and its report.

Order: standardize names -> fill missing -> drop duplicates -> detect types ->
outliers to median -> strip whitespace -> parse dates -> remove constant
columns. Each step's ``fit`` reads the previous step's output, so the frame is
cut once after the duplicate removal (the only full shuffle): by default as a
parquet table in the shared ``spark.checkpoint.dir`` folder (lineage cut,
survives executor loss, columnar reads), optionally with an RDD checkpoint or
``persist``.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from washframe.functions.columns import (columns_of_kind, dtype_of, ident, is_datetime, q, value_of,
                                         value_sql)
from washframe.functions.text import guarded_number
from washframe.functions.text import strip_whitespace as strip_expr
from washframe.functions.names import standard_names
from washframe.operators import coerce, columns, missing, outliers, strings
from washframe.operators.quantiles import column_quantiles, direct_budget
from washframe.operators.tiles import TILE, aggregate_row
from washframe.report import StepLog
from washframe.session import checkpoint_root, drop_scratch, materialize, scratch_path

MEDIAN_WEIGHT = 8   # expressions that an exact median counts for when a wide pass is cut


@dataclass
class CleaningOptions:
    fill_missing: bool = True
    drop_duplicates: bool = True
    standardize_columns: bool = True
    fix_datatypes: bool = True
    handle_outliers: bool = True
    strip_whitespace: bool = True
    fix_dates: bool = True
    remove_constant_columns: bool = True
    custom_na_values: list[str] | None = None
    date_columns: list[str] | None = None
    # Datetime patterns of the date columns; by default chosen per column.
    date_formats: list[str] | None = None
    outlier_threshold: float | None = 3.0
    # Row order for forward filling date columns (names before or after renaming).
    order_by: list[str] | None = None
    partition_by: list[str] | None = None
    # A column with the rows' places in their files (``read_csv(position=...)``): the order
    # of fills where ``order_by`` names none. It takes no part in any step and is dropped.
    position: str | None = None
    approx_quantiles: bool = False
    # How the frame is cut after the dedup: a parquet table in the shared
    # checkpoint folder ("table"), an RDD "checkpoint", "persist" or "none".
    materialize: str = "table"


@dataclass
class CleaningResult:
    df: DataFrame
    log: StepLog
    original_shape: tuple[int, int]
    cleaned_shape: tuple[int, int] = (0, 0)
    rows_removed: int = 0
    missing_values_filled: int = 0
    columns_renamed: dict[str, str] = field(default_factory=dict)
    # Missing cells per (renamed) column after NA tokens became null, before any step.
    nulls_before: dict[str, int] = field(default_factory=dict)
    dtypes_before: dict[str, str] = field(default_factory=dict)
    # Scratch tables in the shared checkpoint folder that ``df`` reads from.
    scratch: list[str] = field(default_factory=list)

    def dtypes(self) -> dict[str, str]:
        """Types of the cleaned columns."""
        return dict(self.df.dtypes)

    def nulls_after(self) -> dict[str, int]:
        """Missing cells per cleaned column (one aggregation over the result)."""
        return columns.fit_null_counts(self.df)[1]

    def release(self) -> None:
        """Delete the plan's scratch tables; call once ``df`` has been written
        or is no longer needed (``df`` cannot be read afterwards)."""
        spark = self.df.sparkSession
        while self.scratch:
            drop_scratch(spark, self.scratch.pop())

    def report(self, spark: SparkSession) -> DataFrame:
        """One row per step: step number, name, affected columns, count."""
        return self.log.to_frame(spark)

    def column_report(self) -> DataFrame:
        """One row per column of the input: its name there and after renaming, its type
        before and after (null: dropped), and its missing cells before any step (NA tokens
        count as missing) and after all. What is left missing comes from one aggregation
        over the result."""
        old = {new: name for name, new in self.columns_renamed.items()}
        after, kinds = self.nulls_after(), self.dtypes()
        rows = [(i, old.get(c, c), c, self.dtypes_before[c], kinds.get(c), n, after.get(c), c not in kinds)
                for i, (c, n) in enumerate(self.nulls_before.items())]
        return self.df.sparkSession.createDataFrame(
            rows, "position int, original_name string, column_name string, dtype_before string, dtype_after string, "
                  "nulls_before long, nulls_after long, dropped boolean")

    def observed(self, name: str = "washframe") -> tuple[DataFrame, Observation]:
        """``df`` and an observation that counts its rows and the missing cells of each
        column in whatever pass runs over it next, such as the write: no pass of its own.
        ``log_observed`` puts what it found into the log."""
        watch = Observation(name)
        counts = [F.count_if(value_of(self.df, c).isNull()).alias(f"n{i}") for i, c in enumerate(self.df.columns)]
        return self.df.observe(watch, F.count(F.lit(1)).alias("rows"), *counts), watch

    def log_observed(self, watch: Observation) -> dict[str, int]:
        """Missing cells per column as the finished pass saw them; one log entry each for
        its rows and for the columns that have any."""
        got = watch.get
        found = {c: got[f"n{i}"] for i, c in enumerate(self.df.columns)}
        self.log.add("rows_written", count=got["rows"])
        for c, n in found.items():
            if n:
                self.log.add(f"missing_left_{c}", columns=[c], count=n)
        return found

    def summary(self) -> dict:
        return {"original_shape": self.original_shape, "cleaned_shape": self.cleaned_shape,
                "steps_applied": self.log.names(), "rows_removed": self.rows_removed,
                "missing_values_filled": self.missing_values_filled,
                "columns_renamed": self.columns_renamed}


def _cut(df: DataFrame, how: str, scratch: list[str]) -> DataFrame:
    if how == "table":
        path = scratch_path(df.sparkSession, "plan-cut")
        scratch.append(path)
        return materialize(df, "plan-cut", path)
    if how == "checkpoint":
        checkpoint_root(df.sparkSession)
        return df.checkpoint(eager=True)
    if how == "persist":
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    return df


def clean_data(df: DataFrame, options: CleaningOptions | None = None) -> CleaningResult:
    """Run the enabled steps in the fixed order and log what each did."""
    opt = options or CleaningOptions()
    log = StepLog()
    tokens = opt.custom_na_values if opt.fill_missing else None
    order_by = list(opt.order_by or [])
    partition_by = list(opt.partition_by or [])
    if opt.position and opt.position not in df.columns:
        raise ValueError(f"no column named {opt.position!r}")
    place = None
    if opt.position:        # last, under a name of its own, until the fills are done
        at, n = df.columns.index(opt.position), len(df.columns)
        others = df.columns[:at] + df.columns[at + 1:]
        place = "place_of_row"
        while place in {c.lower() for c in (*others, *standard_names(others).values())}:
            place += "_x"
        df = df.toDF(*[f"u{i}" for i in range(n)])
        df = df.select(*[f"u{i}" for i in range(n) if i != at], f"u{at}").toDF(*others, place)
        order_by = order_by or [place]
    user = [c for c in df.columns if c != place]
    width = len(user)
    if opt.standardize_columns:     # first: names may differ in case only
        result_names = mapping = standard_names(user)
        df = columns.standardize_columns(df, log=log)
        log.steps[-1].columns = [c for c in df.columns if c != place]
        order_by = [mapping.get(c, c) for c in order_by]
        partition_by = [mapping.get(c, c) for c in partition_by]
        user = [c for c in df.columns if c != place]
    else:
        result_names = {}
    # Missing counts are taken once, after NA tokens are read as null (the
    # replacement keeps row and column counts).
    rows, before = columns.fit_null_counts(missing.replace_na_tokens(df, tokens) if tokens else df, user)
    result = CleaningResult(df=df, log=log, original_shape=(rows, width),
                            columns_renamed=result_names, nulls_before=dict(before),
                            dtypes_before={c: t for c, t in df.dtypes if c != place})

    if opt.fill_missing:
        if tokens:
            df = missing.replace_na_tokens(df, tokens)
        empty = [c for c, m in before.items() if rows > 0 and m == rows]
        if empty:
            df = df.drop(*empty)
            for c in empty:
                log.add(f"dropped_empty_column_{c}", columns=[c])
        todo = [c for c in df.columns if before.get(c, 0) > 0]
        dates = [c for c in todo if is_datetime(dtype_of(df, c))]
        df = missing.fill_missing(df, order_by=order_by, partition_by=partition_by,
                                  approx=opt.approx_quantiles,
                                  counts=(rows, {c: before.get(c, 0) for c in df.columns}))
        result.missing_values_filled = sum(before[c] for c in todo)
        for c in todo:
            log.add(f"filled_missing_values_{c}", columns=[c], count=before[c])
    else:
        dates = []
    if place:
        df = df.drop(place)

    # Duplicates go in one shuffle that keeps each distinct row's copy count;
    # the frame is cut there once. Every later decision is a function of the
    # cut rows, so the rest of the plan needs two passes over them:
    #   A: removed rows, forward-fill gaps, type detection, and moments of every
    #      column that can end up numeric (as it is, or as its long / double
    #      conversion);
    #   B: outlier counts and exact medians, and the min / max of each column's
    #      final expression (after outlier replacement, stripping, date parsing)
    #      for the constant-column rule.
    names = df.columns
    if opt.drop_duplicates:
        norm = df.select(*[value_of(df, c).alias(c) for c in names])
        grouped = norm.groupBy(*[q(c) for c in names]).agg(F.count(F.lit(1)).alias("_copies"))
    else:
        grouped = df.withColumn("_copies", F.lit(1).cast("long"))
    grouped = _cut(grouped, opt.materialize, result.scratch)
    df = grouped.drop("_copies")
    threshold = opt.outlier_threshold or 3.0

    text = columns_of_kind(df, "string") if opt.fix_datatypes else []
    candidates: list[tuple[str, str, object]] = []       # (column, kind, value as double)
    if opt.handle_outliers:
        candidates += [(c, "", value_of(df, c).cast("double")) for c in columns_of_kind(df, "numeric")]
        for c in text:
            candidates += [(c, k, guarded_number(q(c), k).cast("double")) for k in ("long", "double")]
    # Wide tables go in tiles of columns, unless every tile would compute the plan anew.
    tile = None if opt.materialize == "none" else TILE
    pass_a = aggregate_row(grouped, [
        F.expr("coalesce(sum(_copies), 0) AS total"), F.expr("count(1) AS kept"),
        *[F.expr(f"coalesce(sum(IF({ident(c)} IS NULL, _copies, 0)), 0) AS g{i}")
          for i, c in enumerate(dates)],
        *coerce.detection_aggs(text, prefix="t_"),
        *[e for j, (_, _, v) in enumerate(candidates) for e in (
            F.count(v).alias(f"mn{j}"), F.avg(v).alias(f"mm{j}"), F.stddev_pop(v).alias(f"ms{j}"))]
    ], tile=tile)
    result.missing_values_filled -= sum(pass_a[f"g{i}"] for i in range(len(dates)))
    if opt.drop_duplicates:
        result.rows_removed = pass_a["total"] - pass_a["kept"]
        rows = pass_a["kept"]
        if result.rows_removed > 0:
            log.add("removed_duplicates", count=result.rows_removed)

    if opt.fix_datatypes:
        types = coerce.decide_types(pass_a, text, prefix="t_")
        for c, kind in types.items():
            if kind in ("long", "double"):
                log.add(f"converted_{c}_to_numeric", columns=[c])
            elif kind == "timestamp":
                log.add(f"converted_{c}_to_datetime", columns=[c])
            elif kind == "boolean":
                log.add(f"converted_{c}_to_boolean", columns=[c])
        df = coerce.convert_types(df, types)
    else:
        types = {}

    # Moments of the numeric columns as they are now (converted or not).
    moments = {}
    for j, (c, kind, _) in enumerate(candidates):
        if kind == "" or types.get(c) == kind:
            moments[c] = (pass_a[f"mn{j}"], pass_a[f"mm{j}"], pass_a[f"ms{j}"])
    live = [c for c in columns_of_kind(df, "numeric") if c in moments and moments[c][2]]
    final_text = columns_of_kind(df, "string")
    date_cols = coerce.date_like_columns(df, opt.date_columns) if opt.fix_dates else []
    date_formats = coerce.fit_date_formats(df, date_cols, opt.date_formats, strip=opt.strip_whitespace)
    date_cols = [c for c in date_cols if c in date_formats]
    bounds_cols = ([f.name for f in df.schema.fields if columns._orderable(f.dataType)]
                   if opt.remove_constant_columns else [])

    def final_value(c):
        v = value_of(df, c)
        if c in final_text and opt.strip_whitespace:
            v = strip_expr(v)
        if c in date_cols:
            v = coerce.to_timestamp(v, date_formats[c].formats)
        return v

    b_aggs, weights = [], []
    direct = (direct_budget([moments[c][0] for c in live]) if not opt.approx_quantiles
              else [False] * len(live))
    for i, c in enumerate(live):
        cnt, mean, std = moments[c]
        v = value_of(df, c).cast("double")
        out = F.abs((v - F.lit(mean)) / F.lit(std)) > F.lit(threshold)
        b_aggs.append(F.count_if(out).alias(f"o{i}"))
        weights += [1, MEDIAN_WEIGHT] if direct[i] else [1]
        if direct[i]:
            b_aggs.append(F.expr(f"percentile(CAST({value_sql(df, c)} AS DOUBLE), 0.5D)").alias(f"p{i}"))
    for i, c in enumerate(bounds_cols):
        v = final_value(c)
        if c in live:      # bounds of the values an outlier replacement keeps
            mean, std = moments[c][1], moments[c][2]
            keep = ~(F.abs((v.cast("double") - F.lit(mean)) / F.lit(std)) > F.lit(threshold))
            v = F.when(keep, v.cast("double"))
        b_aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
        weights += [1, 1]
    pass_b = aggregate_row(df, b_aggs, weights, tile)

    flagged = {c: pass_b[f"o{i}"] for i, c in enumerate(live) if pass_b[f"o{i}"] > 0}
    medians = {c: pass_b[f"p{i}"] for i, c in enumerate(live)
               if c in flagged and f"p{i}" in pass_b}
    rest = [c for c in flagged if c not in medians]
    if rest:
        got = column_quantiles(df, rest, [0.5], approx=opt.approx_quantiles,
                               max_group_size=max(moments[c][0] for c in rest))
        medians.update({c: got[c][0] for c in rest})
    if flagged:
        df = df.select(*[outliers.replaced(value_of(df, c), moments[c][1], moments[c][2], threshold,
                                           medians[c]).alias(c) if c in flagged else q(c)
                         for c in df.columns])
        for c in flagged:
            log.add(f"handled_outliers_{c}", columns=[c], count=flagged[c])
    if opt.strip_whitespace:
        df = strings.strip_whitespace(df, log=log)
    if opt.fix_dates:
        df = coerce.parse_dates(df, date_columns=opt.date_columns, log=log, fitted=date_formats)
    if opt.remove_constant_columns:
        const = []
        for i, c in enumerate(bounds_cols):
            lo, hi = pass_b[f"lo{i}"], pass_b[f"hi{i}"]
            if c in flagged:
                lo = medians[c] if lo is None else min(lo, medians[c])
                hi = medians[c] if hi is None else max(hi, medians[c])
            if columns.is_constant(lo, hi):
                const.append(c)
        if const:
            df = df.drop(*const)
            log.add("removed_constant_columns", columns=const)

    result.df = df
    result.cleaned_shape = (rows, len(df.columns))
    return result


def clean_csv(spark: SparkSession, path, options: CleaningOptions | None = None, **read_options) -> CleaningResult:
    """Read CSV files and clean them; the rows' order in the files is the order of fills
    where the options name none. ``read_options`` are those of ``read_csv``."""
    from washframe.sources.files import read_csv, unused_name
    place = unused_name(spark, path, **read_options)
    df = read_csv(spark, path, position=place, **read_options)
    return clean_data(df, replace(options or CleaningOptions(), position=place))
