"""The small tables behind charts: line, bar, scatter, histogram, heatmap, box,
violin and pair plots. Pixels are the front end's job; these are Spark jobs
whose output is bounded by groups / bins / grid points, not by input rows
(scatter excepted: it is the points).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from washframe.functions.columns import columns_of_kind, q, value_of
from washframe.operators.hot_keys import join_groups
from washframe.operators.profile import correlation_matrix
from washframe.operators.quantiles import column_quantiles, exact_quantiles, stack_columns
from washframe.report import StepLog

Z95 = 1.959963984540054       # two-sided 95% normal quantile
TOP_GROUPS = 20               # bar charts show at most this many x values
PAIR_COLUMNS = 5              # pair plots use at most this many numeric columns
MOST_BINS = 1 << 53           # finer bins cannot be told apart in doubles
SMALL_SIDE_ROWS = 100_000     # per-group tables broadcast up to this many rows


def _with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], n_groups: int) -> DataFrame:
    """``rows`` with the columns of their group (``_n``: its rows); hot groups are not shuffled."""
    return join_groups(rows, groups, keys, "_n", n_groups, SMALL_SIDE_ROWS)


def line_data(df: DataFrame, x: str, y: str, hue: str | None = None) -> DataFrame:
    """mean(y) per x (and hue) with a normal 95% interval mean +/- 1.96 s / sqrt(n)."""
    keys = [x] + ([hue] if hue else [])
    v = value_of(df, y).cast("double")
    agg = df.where(q(x).isNotNull()).groupBy(*[q(k) for k in keys]).agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count(v).alias("n"))
    half = F.lit(Z95) * F.col("std") / F.sqrt(F.col("n"))
    return agg.select(*[q(k) for k in keys], "n", "mean",
                      (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high"))


def group_mean_topn(df: DataFrame, x: str, y: str, n: int = TOP_GROUPS) -> DataFrame:
    """If x has more than ``n`` distinct values, keep rows of the ``n`` x values
    with the largest mean(y) (ties: smaller x first; groups without a mean never
    count among them); else all rows."""
    means = df.groupBy(q(x).alias("_x")).agg(F.avg(value_of(df, y)).alias("_m")) \
              .where(F.col("_x").isNotNull())
    # One top-k job (per-task top n+1, then a merge): n+1 rows answer both
    # "more than n groups?" and "which n".
    top = means.orderBy(F.col("_m").desc_nulls_last(), F.col("_x").asc()).limit(n + 1).collect()
    if len(top) <= n:
        return df
    return df.where(q(x).isin([r["_x"] for r in top[:n] if r["_m"] is not None]))


def bar_data(df: DataFrame, x: str, y: str, hue: str | None = None, n: int = TOP_GROUPS) -> DataFrame:
    """Top-n groups (``group_mean_topn``), then mean and interval per x."""
    return line_data(group_mean_topn(df, x, y, n), x, y, hue)


def scatter_data(df: DataFrame, x: str, y: str, hue: str | None = None, max_points: int | None = None,
                 seed: int = 0) -> DataFrame:
    """Every (x, y) point with both present: a narrow projection, no sampling.

    ``max_points`` (default: all points) keeps that many points of each ``hue`` group
    (points without one are a group), those with the least seeded hash. Equal points are
    counted first and tell their copies apart by number, so the choice depends on the
    points alone: the same for any order, partitioning or machine."""
    cols = list(dict.fromkeys([x, y] + ([hue] if hue else [])))
    rows = df.select(*[value_of(df, c).alias(c) for c in cols]).where(q(x).isNotNull() & q(y).isNotNull())
    if max_points is None:
        return rows
    if max_points < 1:
        raise ValueError("max_points must be 1 or more")
    # no more than max_points copies of a point can be chosen; copies are combined before the shuffle
    inner = rows.toDF(*[f"c{i}" for i in range(len(cols))])
    names = inner.columns
    counted = inner.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("n"), F.lit(max_points).cast("long"))))
    copies = counted.select(*names, copy.alias("copy"))
    group = [f"c{cols.index(hue)}"] if hue else []
    ranked = copies.withColumn("h", F.xxhash64(F.lit(seed), *names, "copy"))
    if not group:
        kept = ranked.orderBy("h", *names, "copy").limit(max_points)        # a top-k on each task, then one merge
    else:       # Spark keeps the first rows of a group on each task before the shuffle
        w = Window.partitionBy(*group).orderBy("h", *names, "copy")
        kept = ranked.withColumn("r", F.row_number().over(w)).where(F.col("r") <= max_points)
    return kept.select(*names).toDF(*cols)


def auto_bin_count(n: int, lo: float, hi: float, q25: float, q75: float) -> int:
    """numpy 'auto': the narrower of the Sturges and Freedman-Diaconis widths."""
    ptp = hi - lo
    if n == 0 or ptp == 0:
        return 1
    if math.isinf(ptp):      # the count does not change with the scale
        lo, hi, q25, q75 = lo / 4, hi / 4, q25 / 4, q75 / 4
        ptp = hi - lo
    sturges = ptp / (math.log2(n) + 1.0)
    fd = 2.0 * (q75 - q25) * n ** (-1.0 / 3.0)
    width = min(fd, sturges) if fd > 0 else sturges
    return max(1, int(min(math.ceil(min(ptp / width, MOST_BINS)), MOST_BINS))) if width > 0 else 1


def histogram_data(df: DataFrame, x: str, bins: int | str = "auto", approx: bool = False,
                   hue: str | None = None, log: StepLog | None = None, empty_bins: bool | None = None) -> DataFrame:
    """Equal-width bins over [min, max] (last bin closed): bin, bin_low, bin_high,
    count and density (count / (n * width)). ``bins='auto'`` follows numpy.
    With ``hue``: the same bins for every category (common bins), counts and
    density per category. Infinite values have no bin and are left out (counted in
    ``log``). There are 2^53 bins at most: doubles tell no more apart. ``empty_bins``:
    whether bins without values are listed (never with ``hue``); by default they are while
    there are no more bins than 100,000 or than rows, as a far tail asks for very many. The
    bins that hold values, and their counts, are the same either way."""
    v = value_of(df, x).cast("double")
    if log is not None:
        log.add("histogram_left_out", columns=[x], count=df.agg(F.count_if(F.abs(v) == math.inf)).first()[0])
    v = F.when(F.abs(v) < F.lit(math.inf), v)
    st = df.agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).collect()[0]
    n, lo, hi = st["n"], st["lo"], st["hi"]
    if n == 0:
        none = df.limit(0).select(*([q(hue).alias(hue)] if hue else []))
        return none.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (
            ("bin", "long"), ("bin_low", "double"), ("bin_high", "double"), ("count", "long"), ("density", "double"))])
    if bins == "auto":
        q25, q75 = column_quantiles(df.select(v.alias("v")), ["v"], [0.25, 0.75], approx=approx, max_group_size=n)["v"]
        k = auto_bin_count(n, lo, hi, q25, q75)
    else:
        k = min(int(bins), MOST_BINS)
    if hi == lo:
        lo, hi = (lo - 0.5, hi + 0.5) if lo - 0.5 < lo else (math.nextafter(lo, -math.inf), math.nextafter(hi, math.inf))
    if math.isinf(hi - lo):      # a range that no double holds: halves of it
        width = 2 * ((hi / 2 - lo / 2) / k)
        at = F.floor((v / 2 - F.lit(lo / 2)) / F.lit(width / 2))
    else:
        width = (hi - lo) / k
        norm = k / (hi - lo)
        at = F.floor((v - F.lit(lo)) * F.lit(norm)) if not math.isinf(norm) else F.floor((v - F.lit(lo)) / F.lit(hi - lo) * k)
    b = F.least(at.cast("double"), F.lit(float(k - 1))).cast("long")

    def edge(bin_):
        if math.isinf(hi - lo):
            return F.lit(2.0) * (F.lit(lo / 2) + bin_ * F.lit(width / 2))
        return F.lit(lo) + bin_ * F.lit(width)

    if hue:
        counts = df.where(v.isNotNull()).groupBy(q(hue).alias(hue), b.alias("bin")) \
                   .agg(F.count(F.lit(1)).alias("count"))
        per = Window.partitionBy(hue)
        return counts.select(
            hue, "bin", edge(F.col("bin")).alias("bin_low"),
            F.when(F.col("bin") == k - 1, F.lit(hi))
             .otherwise(edge(F.col("bin") + 1)).alias("bin_high"),
            "count", (F.col("count") / (F.sum("count").over(per) * F.lit(width))).alias("density"))
    counts = df.where(v.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    if empty_bins is None:
        empty_bins = k <= max(SMALL_SIDE_ROWS, n)
    if empty_bins:      # the axis is derived from the data: k comes from its statistics
        axis = df.sparkSession.range(k).select(F.col("id").alias("bin"))
        out = axis.join(F.broadcast(counts) if k <= SMALL_SIDE_ROWS else counts, on="bin", how="left")
    else:
        out = counts
    cnt = F.coalesce(F.col("count"), F.lit(0)).cast("long")
    return out.select("bin",
                      edge(F.col("bin")).alias("bin_low"),
                      F.when(F.col("bin") == k - 1, F.lit(hi))
                       .otherwise(edge(F.col("bin") + 1)).alias("bin_high"),
                      cnt.alias("count"),
                      (cnt / F.lit(n * width)).alias("density"))


def heatmap_data(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Correlation pairs of the strict lower triangle (x after y in column order)."""
    return correlation_matrix(df, cols, lower_only=True)


def _box_rows(df: DataFrame, x: str | None, y: str, hue: str | None) -> tuple[DataFrame, dict[str, str]]:
    """Rows with a value and all keys (g0, g1), as doubles, and the keys' names by theirs;
    without keys all rows are the group ``all``."""
    given = [k for k in (x, hue) if k]
    groups = [q(k).alias(f"g{i}") for i, k in enumerate(given)] or [F.lit("all").alias("g0")]
    keys = {f"g{i}": k for i, k in enumerate(given or ["group"])}
    rows = df.select(*groups, value_of(df, y).cast("double").alias("_y")).where(F.col("_y").isNotNull())
    for k in keys:
        rows = rows.where(q(k).isNotNull())
    return rows, keys


def box_data(df: DataFrame, x: str | None, y: str, whis: float = 1.5, approx: bool = False,
             hue: str | None = None) -> DataFrame:
    """Per x (and hue): n, q1, median, q3 (exact linear), whiskers (most extreme
    values within whis * IQR of the box) and the outlier count. Without x: one box."""
    base, names = _box_rows(df, x, y, hue)
    keys = list(names)
    named = [q(k) for k in keys]
    qs = exact_quantiles(base, keys, "_y", [0.25, 0.5, 0.75], approx=approx)
    qs = qs.select(*named, F.col("_n").alias("n"), F.col("q0").alias("q1"), F.col("q1").alias("median"),
                   F.col("q2").alias("q3"))
    qs = qs.withColumn("_lo", F.col("q1") - F.lit(whis) * (F.col("q3") - F.col("q1"))) \
           .withColumn("_hi", F.col("q3") + F.lit(whis) * (F.col("q3") - F.col("q1"))).persist()
    groups = qs.count()
    fences = qs.select(*named, F.col("n").alias("_n"), "_lo", "_hi")
    yv = F.col("_y")
    inside = (yv >= F.col("_lo")) & (yv <= F.col("_hi"))
    w = _with_groups(base, fences, keys, groups).groupBy(*named).agg(
        F.min(F.when(inside, yv)).alias("whisker_low"),
        F.max(F.when(inside, yv)).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"))
    out = qs.drop("_lo", "_hi").join(w, on=keys, how="left")
    return out.toDF(*[names.get(c, c) for c in out.columns])


def box_outliers(df: DataFrame, x: str | None, y: str, whis: float = 1.5, approx: bool = False,
                 hue: str | None = None) -> DataFrame:
    """The rows drawn as outlier points: y beyond the fences of its x (and hue)."""
    base, names = _box_rows(df, x, y, hue)
    keys = list(names)
    qs = exact_quantiles(base, keys, "_y", [0.25, 0.75], approx=approx)
    fences = qs.select(*[q(k) for k in keys], "_n",
                       (F.col("q0") - F.lit(whis) * (F.col("q1") - F.col("q0"))).alias("_lo"),
                       (F.col("q1") + F.lit(whis) * (F.col("q1") - F.col("q0"))).alias("_hi")).persist()
    return (_with_groups(base, fences, keys, fences.count()).where((F.col("_y") < F.col("_lo")) | (F.col("_y") > F.col("_hi")))
            .select(*[q(k).alias(name) for k, name in names.items()], F.col("_y").alias(y)))


def kde_data(df: DataFrame, y: str, by: str | None = None, gridsize: int = 100, cut: float = 2.0,
             fine: float = 8.0) -> DataFrame:
    """Gaussian KDE (Scott bandwidth h = sample std * n^(-1/5)) of y per group on
    ``gridsize`` points over [min - cut*h, max + cut*h].

    Rows are first counted into bins of width h / ``fine`` per group, so the error
    does not depend on the range or tails; every occupied bin, at its mean, then adds
    to the grid points within 8.5 h (beyond that a term is below 1e-15). Output:
    group, point index, grid value, density.
    """
    v = value_of(df, y).cast("double")
    gcol = q(by) if by else F.lit("all")
    base = df.select(gcol.alias("_g"), v.alias("_y")).where(F.col("_y").isNotNull())
    st = base.groupBy("_g").agg(F.count("_y").alias("_n"), F.min("_y").alias("_lo"),
                                F.max("_y").alias("_hi"), F.stddev_samp("_y").alias("_sd"))
    st = st.withColumn("_h", F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))) \
           .where(F.col("_h") > 0).persist()
    groups = st.count()
    span = F.col("_hi") - F.col("_lo")
    wide = F.col("_h") / F.lit(float(fine))
    b = F.floor((F.col("_y") - F.col("_lo")) / wide)
    binned = (_with_groups(base, st, ["_g"], groups)
              .groupBy("_g", "_n", "_lo", "_hi", "_h", b.alias("_b")).agg(F.count(F.lit(1)).alias("_w"), F.avg("_y").alias("_c")))
    start = F.col("_lo") - F.lit(cut) * F.col("_h")
    step = (span + F.lit(2 * cut) * F.col("_h")) / F.lit(gridsize - 1)
    near = binned.select("_g", "_n", "_h", "_w", "_c", start.alias("_s"), step.alias("_st"))
    first = F.greatest(F.lit(0), F.ceil((F.col("_c") - 8.5 * F.col("_h") - F.col("_s")) / F.col("_st"))).cast("int")
    last = F.least(F.lit(gridsize - 1), F.floor((F.col("_c") + 8.5 * F.col("_h") - F.col("_s")) / F.col("_st"))).cast("int")
    # a term of weight 0 per point keeps grid points that no bin reaches
    blank = st.select("_g", "_n", "_h", F.lit(0).cast("long").alias("_w"), F.col("_lo").alias("_c"),
                      start.alias("_s"), step.alias("_st"),
                      F.explode(F.sequence(F.lit(0), F.lit(gridsize - 1))).alias("point"))
    pts = near.where(first <= last).select("*", F.explode(F.sequence(first, last)).alias("point")).unionByName(blank)
    g = F.col("_s") + F.col("point") * F.col("_st")
    contrib = F.col("_w") * F.exp(F.lit(-0.5) * F.pow((g - F.col("_c")) / F.col("_h"), 2))
    dens = pts.groupBy("_g", "point").agg(
        F.first(g).alias("value"), F.sum(contrib).alias("_sum"), F.first("_n").alias("_n"),
        F.first("_h").alias("_h"))
    out = dens.select(F.col("_g").alias(by or "group"), "point", "value",
                      (F.col("_sum") / (F.col("_n") * F.col("_h") * F.lit(math.sqrt(2 * math.pi))))
                      .alias("density"))
    return out


def violin_data(df: DataFrame, x: str | None, y: str, gridsize: int = 100, cut: float = 2.0,
                fine: float = 8.0, hue: str | None = None) -> DataFrame:
    """Density of y per x (and hue): the violin outline. Without x: one violin."""
    keys = [k for k in (x, hue) if k]
    if len(keys) < 2:
        return kde_data(df, y, keys[0] if keys else None, gridsize, cut, fine)
    both = df.where(q(x).isNotNull() & q(hue).isNotNull()).select(
        F.struct(q(x).alias("x"), q(hue).alias("hue")).alias("_by"), value_of(df, y).cast("double").alias("_v"))
    out = kde_data(both, "_v", "_by", gridsize, cut, fine)
    return out.select(F.col("_by.x").alias(x), F.col("_by.hue").alias(hue), "point", "value", "density")


def histogram_curve(df: DataFrame, x: str, hue: str | None = None, gridsize: int = 200) -> DataFrame:
    """The density curve over a histogram: the KDE of x (per hue) from its least to
    its greatest value."""
    return kde_data(df, x, hue, gridsize, cut=0.0)


def pair_columns(df: DataFrame, max_cols: int = PAIR_COLUMNS) -> list[str]:
    return columns_of_kind(df, "numeric")[:max_cols]


def pair_data(df: DataFrame, max_cols: int = PAIR_COLUMNS, hue: str | None = None, mirrored: bool = True) -> DataFrame:
    """Off-diagonal panels of a pair plot: (x_name, y_name, x, y[, hue]) for each
    ordered pair of the first ``max_cols`` numeric columns (rows with both present).
    ``hue`` is kept only when it has fewer than 10 distinct values. ``mirrored=False``
    gives each unordered pair once (x before y in column order), half as many rows: the
    other half of the plot swaps the axes."""
    cols = pair_columns(df, max_cols)
    if not cols:
        raise ValueError("a pair plot needs a numeric column")
    if hue and df.select(q(hue)).distinct().limit(10).count() >= 10:
        hue = None
    items = F.array(*[F.struct(F.lit(a).alias("x_name"), F.lit(b).alias("y_name"),
                               value_of(df, a).cast("double").alias("x"),
                               value_of(df, b).cast("double").alias("y"))
                      for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j or (mirrored and i > j)])
    extra = [q(hue).alias("hue")] if hue else []
    return df.select(*extra, F.inline(items)).where(F.col("x").isNotNull() & F.col("y").isNotNull())


def pair_diagonal(df: DataFrame, max_cols: int = PAIR_COLUMNS, gridsize: int = 100, hue: str | None = None) -> DataFrame:
    """Diagonal panels of a pair plot: the KDE of each of the first numeric columns,
    per ``hue`` if it has fewer than 10 distinct values (rows without one are left out)."""
    cols = pair_columns(df, max_cols)
    if hue and df.select(q(hue)).distinct().limit(10).count() >= 10:
        hue = None
    if not hue:
        return kde_data(stack_columns(df, cols, "column_name", "value"), "value", "column_name", gridsize=gridsize)
    safe = df.where(q(hue).isNotNull()).select(q(hue).alias("h"), *[value_of(df, c).alias(f"v{i}") for i, c in enumerate(cols)])
    long_df = stack_columns(safe, [f"v{i}" for i in range(len(cols))], "name", "value", ["h"])
    out = kde_data(long_df.select(F.struct("name", "h").alias("by"), "value"), "value", "by", gridsize=gridsize)
    named = F.create_map(*[F.lit(x) for i, c in enumerate(cols) for x in (f"v{i}", c)])
    return out.select(named[F.col("by.name")].alias("column_name"), F.col("by.h").alias("hue"), "point", "value", "density")


# chart -> (table of the chart, whether it needs y)
_PLOTS = {
    "line": (line_data, True),
    "bar": (bar_data, True),
    "scatter": (scatter_data, True),
    "histogram": (lambda df, x, y, **options: histogram_data(df, x, **options), False),
    "heatmap": (lambda df, x, y, **options: heatmap_data(df, **options), False),
}
PLOT_TYPES = tuple(_PLOTS)


def create_plot(df: DataFrame, plot_type: str, x_column: str, y_column: str | None = None, **options) -> DataFrame:
    """Chart table by plot type; the heatmap ignores x and y. ``options`` are those of the
    chart's own function (``hue``, ``max_points``, ``empty_bins``, ...)."""
    if plot_type not in _PLOTS:
        raise ValueError(f"no chart named {plot_type!r}; choose one of {', '.join(_PLOTS)}")
    table, needs_y = _PLOTS[plot_type]
    if needs_y and not y_column:
        raise ValueError(f"a {plot_type} chart needs a y column")
    return table(df, x_column, y_column, **options)


def plot_tables(df: DataFrame, plot_type: str, x_column: str, y_column: str | None = None) -> dict[str, DataFrame]:
    """All tables of a chart: a histogram has its density curve beside its bins."""
    tables = {"data": create_plot(df, plot_type, x_column, y_column)}
    if plot_type == "histogram":
        v = value_of(df, x_column).cast("double")
        tables["curve"] = histogram_curve(df.select(F.when(F.abs(v) < F.lit(math.inf), v).alias(x_column)), x_column)
    return tables
