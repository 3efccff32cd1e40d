"""Fitted cleaning applied to streams.

Every ``fit`` in this package returns constants (fill values, detected types,
means / stds / medians, columns to drop); every ``apply`` is a projection. A
``StreamCleaner`` is fitted once on a batch (a snapshot or history table) and
its projection then runs unchanged on a ``readStream`` DataFrame. Duplicate
removal on a stream uses Spark's watermark-bounded
``dropDuplicatesWithinWatermark`` (bounded state); forward fill needs order
across micro-batches and stays batch-only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from washframe.functions.columns import columns_of_kind, dtype_of, ident, is_numeric, q, value_of
from washframe.functions.names import standard_names
from washframe.functions.text import null_if_token, strip_whitespace
from washframe.operators import coerce, columns, missing
from washframe.operators.coerce import converted
from washframe.operators.outliers import _zscore_flags
from washframe.operators.quantiles import column_quantiles
from washframe.session import is_folder, scratch_path


@dataclass
class StreamCleaner:
    rename: dict[str, str] = field(default_factory=dict)
    na_tokens: list[str] = field(default_factory=list)
    drop: list[str] = field(default_factory=list)
    fills: dict[str, object] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)
    outliers: dict[str, tuple[float, float, float]] = field(default_factory=dict)  # mean, std, median
    threshold: float = 3.0
    strip: bool = True

    @classmethod
    def fit(cls, batch: DataFrame, na_tokens=None, standardize: bool = True,
            handle_outliers: bool = True, threshold: float = 3.0, strip: bool = True) -> "StreamCleaner":
        """Learn the projection from a batch DataFrame (a few bounded aggregations)."""
        out = cls(na_tokens=list(na_tokens or []), threshold=threshold, strip=strip)
        df = batch
        if standardize:
            out.rename = standard_names(df.columns)
            df = columns.standardize_columns(df)
        if out.na_tokens:
            df = missing.replace_na_tokens(df, out.na_tokens)
        rows, miss = columns.fit_null_counts(df)
        out.drop = [c for c, m in miss.items() if rows > 0 and m == rows]
        df = df.drop(*out.drop)
        numeric = [c for c in df.columns if is_numeric(dtype_of(df, c)) and miss[c] > 0]
        text = [c for c in columns_of_kind(df, "string") if miss[c] > 0]
        if numeric:
            out.fills.update(missing.fit_medians(df, numeric))
        if text:
            out.fills.update(missing.column_modes(df, text))
        df = missing._apply_fills(df, out.fills, as_double=set(numeric))
        out.types = {c: k for c, k in coerce.detect_types(df).items() if k != "string"}
        df = coerce.convert_types(df, out.types)
        if handle_outliers:
            # Same rule as the batch operator: columns with outliers in the fit batch.
            st, flagged = _zscore_flags(df, columns_of_kind(df, "numeric"), threshold)
            if flagged:
                med = column_quantiles(df, list(flagged), [0.5],
                                       max_group_size=max(st[c]["count"] for c in flagged))
                out.outliers = {c: (st[c]["mean"], st[c]["std_pop"], med[c][0]) for c in flagged}
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """The fitted projection; works on batch and streaming DataFrames alike."""
        if self.rename:
            df = df.select(*[q(c).alias(self.rename.get(c, c)) for c in df.columns])
        text = set(columns_of_kind(df, "string"))
        cols = []
        for c in df.columns:
            if c in self.drop:
                continue
            v = value_of(df, c)
            if c in text and self.na_tokens:
                v = null_if_token(v, self.na_tokens)
            if c in self.fills and self.fills[c] is not None:
                dt = T.DoubleType() if is_numeric(dtype_of(df, c)) else dtype_of(df, c)
                v = F.coalesce(v.cast(dt), F.lit(self.fills[c]).cast(dt))
            kind = self.types.get(c)
            if kind is not None:
                v = converted(v, kind)
            if c in self.outliers:
                mean, std, med = self.outliers[c]
                v = v.cast("double")
                v = F.when(F.abs((v - F.lit(mean)) / F.lit(std)) > F.lit(self.threshold),
                           F.lit(med)).otherwise(v)
            if self.strip and c in text and kind is None:
                v = strip_whitespace(v)
            cols.append(v.alias(c))
        return df.select(*cols)


def read_stream(spark: SparkSession, directory: str, schema: T.StructType,
                glob: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """A parquet file stream over ``directory`` with a fixed schema; ``glob`` picks files
    by name, or is the name of a folder there whose files are read."""
    reader = spark.readStream.schema(schema)
    folder = f"{directory.rstrip('/')}/{glob}"
    if glob and is_folder(spark, folder):
        directory = folder
    elif glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(directory)


def dedup_stream(df: DataFrame, event_time: str, delay: str = "10 minutes",
                 subset: list[str] | None = None) -> DataFrame:
    """Duplicate removal with state bounded by the watermark.

    Watermarks need a TIMESTAMP column; a TIMESTAMP_NTZ event time is read as
    UTC into a helper column. It is built from the wall-clock fields, not by a
    cast (a cast uses the session time zone, where a daylight-saving gap maps
    two wall times to one instant), so it is one-to-one with the event time
    and does not change which rows are duplicates.
    """
    if isinstance(df.schema[event_time].dataType, T.TimestampNTZType):
        c = ident(event_time)
        df = df.withColumn("_event_time", F.expr(
            f"make_timestamp(year({c}), month({c}), day({c}), hour({c}), minute({c}), "
            f"date_part('SECOND', {c}), 'UTC')"))
        marker = "_event_time"
    else:
        marker = event_time
    marked = df.withWatermark(marker, delay)
    keys = (list(subset) + [marker]) if subset else None
    out = marked.dropDuplicatesWithinWatermark(keys) if keys else marked.dropDuplicatesWithinWatermark()
    return out.drop("_event_time") if marker == "_event_time" else out


def run_to_table(stream: DataFrame, label: str, spark: SparkSession) -> DataFrame:
    """Run a stream over all available input into parquet in the shared
    checkpoint folder (exactly-once file sink), then read the result as a batch."""
    out = scratch_path(spark, f"{label}-out")
    ckpt = scratch_path(spark, f"{label}-ckpt")
    query = (stream.writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(out)
