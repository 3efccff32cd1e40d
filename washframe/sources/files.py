"""File sources and sinks: CSV in and out, preview, and a file manifest.

CSV is read with every column as text; NA tokens become null and one
aggregation detects the column types (no ``inferSchema`` pass, and a stray
token can no longer turn a number column into text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from washframe.functions.columns import q
from washframe.functions.text import DEFAULT_NA_TOKENS
from washframe.operators.coerce import detect_and_convert
from washframe.operators.missing import replace_na_tokens
from washframe.sources.digests import streamed_digests
from washframe.sources.split_csv import PLAIN_OPTIONS, can_split, read_records

# Declared upload limits of the service being re-expressed.
ALLOWED_EXTENSIONS = ("csv", "xlsx", "xls")
MAX_FILE_BYTES = 100 * 1024 * 1024

HELD_BYTES = 8 << 20      # files that a task may hold whole

TIMESTAMP_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def read_csv(spark: SparkSession, path: str, na_tokens=None, detect: bool = True,
             schema=None, multi_line: bool = True, position: str | None = None, **options) -> DataFrame:
    """Header row, quoted fields with doubled quotes, NA tokens -> null, detected types.

    ``schema`` skips detection; its cells are null only for the ``na_tokens`` that
    are named (without a schema the usual tokens hold). Quoted newlines and blanks
    around cells are kept, and large files are split over tasks (``split_csv``);
    options that change where records end (comments, other encodings, escapes or line
    ends, no header) are left to Spark's reader, one task a file. ``multi_line=False``
    is for files without quoted newlines: Spark's reader, split at line ends.
    ``position`` adds a long column of that name: the row's place 0, 1, ... over all
    files in the order of their paths, an order for fills.
    """
    if multi_line and can_split(options):
        return _read_split(spark, path, na_tokens, detect, schema, position, options)
    if position:
        raise ValueError("positions need multi_line and plain options")
    reader = (spark.read.option("header", True).option("escape", '"')
              .option("multiLine", multi_line).option("mode", "PERMISSIVE")
              .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    for key, val in options.items():
        reader = reader.option(key, val)
    if schema is not None and na_tokens is None:
        return reader.schema(schema).csv(path)
    if schema is not None:
        text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
        cells = replace_na_tokens(reader.schema(text).csv(path), na_tokens)
        return cells.select(*[q(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])
    df = reader.csv(path)
    df = replace_na_tokens(df, DEFAULT_NA_TOKENS if na_tokens is None else na_tokens)
    return detect_and_convert(df) if detect else df


_PLAIN = {"escape": '"', "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def header_names(spark: SparkSession, path, **options) -> list[str]:
    """Column names of CSV files, of which Spark reads one record."""
    return spark.read.options(header=True, multiLine=True, **{**_PLAIN, **options}).csv(path).columns


def unused_name(spark: SparkSession, path, schema=None, **options) -> str:
    """A column name that CSV files do not have."""
    plain = {k: v for k, v in options.items() if k.lower() in {p.lower() for p in PLAIN_OPTIONS}}
    taken = {c.lower() for c in header_names(spark, path, **plain)}
    return next(name for name in ("row_position" + "_" * i for i in range(len(taken) + 1)) if name not in taken)


def _read_split(spark, path, na_tokens, detect, schema, position, options) -> DataFrame:
    plain = {**_PLAIN, **options}
    lower = {k.lower(): v for k, v in options.items()}
    if schema is None:
        names = header_names(spark, path, **options)
    else:
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        names = schema.names
    if position in names:
        raise ValueError(f"the files have a column named {position!r} already")
    rows = read_records(spark, path, lower.get("sep", lower.get("delimiter", ",")), lower.get("quote", '"'))
    typed = schema is not None and na_tokens is None
    kinds = [f.dataType.simpleString() if typed else "string" for f in schema.fields] if schema else ["string"] * len(names)
    record = F.from_csv("value", ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)), {**plain, "multiLine": "true"})
    place = [F.col("position").alias(position)] if position else []
    df = rows.select("position", record.alias("r")).select(
        *[F.col(f"r.c{i}").alias(name) for i, name in enumerate(names)], *place)
    if typed:
        return df
    if schema is not None:
        df = replace_na_tokens(df, na_tokens)
        return df.select(*[q(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields],
                         *([q(position)] if position else []))
    df = replace_na_tokens(df, DEFAULT_NA_TOKENS if na_tokens is None else na_tokens)
    return detect_and_convert(df) if detect else df


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Header, no index; a directory of part files (one per partition)."""
    (df.write.mode(mode).option("header", True).option("escape", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .option("timestampFormat", TIMESTAMP_TEXT).option("timestampNTZFormat", TIMESTAMP_TEXT)
       .csv(path))
    return path


def preview(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows along ``order_by`` (a top-k, not a full sort)."""
    return df.orderBy(*order_by).limit(n)


def file_manifest(spark: SparkSession, path: str, allowed=ALLOWED_EXTENSIONS,
                  max_bytes: int = MAX_FILE_BYTES, expected_sha256: dict | None = None,
                  held_bytes: int = HELD_BYTES) -> DataFrame:
    """One row per file: name, size, modification time, SHA-256 and verdicts.

    Every file is hashed, whatever its size: small ones (below ``held_bytes``) by the
    binary-file source, which holds a file several times over, larger ones in pieces
    inside a task (``streamed_digests``). The size limit shows in ``size_ok`` and the
    verdict. Spark's listing leaves empty files out.
    """
    listing = (spark.read.format("binaryFile").load(path)
               .select("path", "length", "modificationTime"))
    small = F.col("length") < held_bytes
    hashed = (spark.read.format("binaryFile").load(path).where(small)
              .select("path", F.sha2("content", 256).alias("sha256")))
    if listing.where(~small).limit(1).count():
        hashed = hashed.unionByName(streamed_digests(listing.where(~small)))
    out = listing.join(hashed, on="path", how="left")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    out = out.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"),
        "path", F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified"), "sha256",
        ext.alias("extension"),
        ext.isin(list(allowed)).alias("extension_ok"),
        (F.col("length") <= max_bytes).alias("size_ok"))
    if expected_sha256:
        pairs = [F.lit(x) for kv in expected_sha256.items() for x in kv]
        expected = F.element_at(F.create_map(*pairs), F.col("file_name"))
        out = out.withColumn("sha256_ok", F.coalesce(expected.isNull() | (expected == F.col("sha256")), F.lit(False)))
    else:
        out = out.withColumn("sha256_ok", F.lit(True))
    verdict = (F.when(~F.col("extension_ok"), F.lit("bad_extension"))
               .when(~F.col("size_ok"), F.lit("too_large"))
               .when(~F.col("sha256_ok"), F.lit("checksum_mismatch"))
               .otherwise(F.lit("ok")))
    return out.withColumn("verdict", verdict)
