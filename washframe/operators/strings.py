"""Text cleaning: Unicode whitespace stripping and lower-casing (pure projections)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washframe.functions.columns import columns_of_kind, q
from washframe.functions.text import strip_whitespace as strip_expr
from washframe.report import StepLog


def strip_whitespace(df: DataFrame, cols: list[str] | None = None,
                     log: StepLog | None = None) -> DataFrame:
    """Both ends of every text cell, all Unicode whitespace; nulls stay null."""
    text = set(columns_of_kind(df, "string"))
    cols = set(cols if cols is not None else text) & text
    if log is not None:
        log.add("stripped_whitespace", columns=sorted(cols))
    return df.select(*[strip_expr(q(c)).alias(c) if c in cols else q(c) for c in df.columns])


def clean_strings(df: DataFrame, cols: list[str] | None = None, strip: bool = True,
                  lowercase: bool = True) -> DataFrame:
    """Strip and/or lower-case text columns. Missing stays missing (not the text 'nan')."""
    text = set(columns_of_kind(df, "string"))
    cols = set(cols if cols is not None else text) & text

    def clean(c):
        v = q(c)
        if strip:
            v = strip_expr(v)
        if lowercase:
            v = F.lower(v)
        return v.alias(c)
    return df.select(*[clean(c) if c in cols else q(c) for c in df.columns])
