"""Type coercion and detection for text columns (numbers, timestamps).

Detection is one aggregation over all text columns: per column, how many
non-null cells parse as integer / number / timestamp. A column converts only
when every non-null cell parses (or ``min_ratio`` of them), and only text
columns are tried: numbers never become timestamps.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from washframe.functions.columns import columns_of_kind, q
from washframe.functions.text import (DOUBLE_GUARD_PATTERN, INTEGER_TEXT_PATTERN, NUMBER_TEXT_PATTERN,
                                     number_from_text)
from washframe.functions.text import strip_whitespace as strip_expr
from washframe.report import StepLog


BOOLEAN_TEXT_PATTERN = r"^\s*(?i:true|false)\s*$"
# A time of day with a zone or offset behind it names an instant.
ZONED_TEXT_PATTERN = r":[0-9.]+\s*(Z|UTC|[-+][0-9]{1,2}(:?[0-9]{2})?)\s*$"
# Tried in this order for a column whose format is not given; ISO comes first.
DATE_FORMATS = ("M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy/M/d", "M/d/yyyy H:mm:ss",
                "d/M/yyyy H:mm:ss", "M/d/yyyy H:mm", "d/M/yyyy H:mm", "d.M.yyyy H:mm:ss", "MMM d, yyyy", "d MMM yyyy")


def to_number(c: Column) -> Column:
    """Unparseable text -> null; only whole numbers in plain notation parse."""
    return F.when(c.rlike(DOUBLE_GUARD_PATTERN), c.try_cast("double"))


def _utc_wall(instant: Column) -> Column:
    """An instant as its wall time in UTC, whatever the session's time zone."""
    micros = F.unix_micros(instant)
    day = F.floor(micros / F.lit(86_400_000_000)).cast("int")
    secs = ((micros - day.cast("long") * F.lit(86_400_000_000)).cast("decimal(20,0)") / F.lit(1_000_000)).cast(
        "decimal(18,6)")
    return F.lit(dt.datetime(1970, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(days=day, secs=secs)


# What a cell must look like before a parser of the pattern letter sees it: nothing that
# the parser accepts is left out, and nearly all that it would refuse is.
_FIELD_SHAPES = {
    "yyyy": r"[-+]?[0-9]{4,}", "M": r"0*(?:[1-9]|1[0-2])", "MM": r"(?:0[1-9]|1[0-2])", "MMM": r"\p{L}+\.?", "MMMM": r"\p{L}+",
    "d": r"0*(?:[1-9]|[12][0-9]|3[01])", "dd": r"(?:0[1-9]|[12][0-9]|3[01])", "H": r"0*(?:1?[0-9]|2[0-3])",
    "HH": r"(?:[01][0-9]|2[0-3])", "h": r"0*(?:[1-9]|1[0-2])", "hh": r"(?:0[1-9]|1[0-2])", "a": r"\p{L}+",
    "m": r"0*[1-5]?[0-9]", "mm": r"[0-5][0-9]", "s": r"0*[1-5]?[0-9]", "ss": r"[0-5][0-9]",
}
# Year and month at least: bare numbers are no dates.
ISO_SHAPE = r"^\s*[0-9]{4,6}-[0-9]{1,2}"
MIN_DATE_SHARE = 0.5   # share of a column's cells that must parse for it to become a timestamp


def cell_shape(fmt: str) -> str | None:
    """Regular expression of the cells that a datetime pattern can parse; None if it
    has fields whose texts are not known here."""
    out = ""
    for quoted, letters, other in re.findall(r"'([^']*)'|([A-Za-z]+)|([^A-Za-z'])", fmt):
        if letters:
            for run in re.finditer(r"(.)\1*", letters):
                shape = rf"[0-9]{{{len(run[0])}}}" if run[1] == "S" else _FIELD_SHAPES.get(run[0])
                if shape is None:
                    return None
                out += shape
        elif other in "[]#{}":
            return None
        else:
            out += re.escape(quoted or other)
    return f"^{out}$"


_ZONE_LETTERS = re.compile(r"[VzOXxZ]")


def _has_zone(fmt: str) -> bool:
    """Whether a datetime pattern has zone / offset fields (outside quoted text)."""
    return bool(_ZONE_LETTERS.search(re.sub(r"'[^']*'", "", fmt)))


def _parse_one(c: Column, fmt: str | None, only_test: bool = False) -> Column:
    """One format (None: ISO), tried on cells of its shape only, as a parser's refusal
    costs an exception. Without zone fields the text is a wall time and is parsed
    straight to TIMESTAMP_NTZ (a parse in the session time zone would move a
    wall time inside a daylight-saving gap); ``to_timestamp_ntz`` raises on bad
    text under ANSI, so it runs only where ``try_to_timestamp`` succeeds (CASE
    evaluates the branch lazily). With zone fields the text names an instant.
    ``only_test`` gives some value where the cell parses, by one parse."""
    if fmt is None:
        return F.when(c.rlike(ISO_SHAPE), to_timestamp(c))
    lit, shape = F.lit(fmt), cell_shape(fmt)
    if only_test:
        parsed = F.try_to_timestamp(c, lit)
    elif _has_zone(fmt):
        parsed = _utc_wall(F.try_to_timestamp(c, lit))
    elif not re.search("[HhkKmsSanNA]", re.sub(r"'[^']*'", "", fmt)):
        parsed = F.try_to_date(c, fmt).cast("timestamp_ntz")   # no time of day: parsed once
    else:
        parsed = F.when(F.try_to_timestamp(c, lit).isNotNull(), F.to_timestamp_ntz(c, lit))
    if shape is None:
        return parsed
    marks = set(re.sub("'[^']*'", "", fmt))   # finding a character is far cheaper than a match
    fits = [c.contains(m) for m in "/-.:," if m in marks] + [~c.contains(m) for m in "/:" if m not in fmt]
    return F.when(reduce(lambda a, b: a & b, [*fits, c.rlike(shape)]), parsed)


def to_timestamp(c: Column, formats: list[str | None] | None = None) -> Column:
    """Unparseable text -> null. ISO forms by default; ``formats`` are tried in order
    (None among them: ISO dates). Text with an offset or zone becomes its UTC wall time."""
    if not formats:
        return F.when(c.rlike(ZONED_TEXT_PATTERN), _utc_wall(c.try_cast("timestamp"))).otherwise(
            c.try_cast("timestamp_ntz"))
    return F.coalesce(*[_parse_one(c, fmt) for fmt in formats])


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Text columns in ``cols`` become double; unparseable cells become null."""
    text = set(columns_of_kind(df, "string"))
    return df.select(*[to_number(q(c)).alias(c) if c in cols and c in text else q(c)
                       for c in df.columns])


def coerce_datetime(df: DataFrame, cols: list[str], formats: list[str] | None = None) -> DataFrame:
    text = set(columns_of_kind(df, "string"))
    return df.select(*[to_timestamp(q(c), formats).alias(c) if c in cols and c in text else q(c)
                       for c in df.columns])


def clean_number_text(df: DataFrame, cols: list[str]) -> DataFrame:
    """``$1,200`` -> 1200.0; text that is not number-shaped becomes null."""
    text = set(columns_of_kind(df, "string"))
    return df.select(*[number_from_text(q(c)).alias(c) if c in cols and c in text else q(c)
                       for c in df.columns])


def detection_aggs(cols: list[str], clean_numbers: bool = False,
                   formats: list[str] | None = None, prefix: str = "") -> list[Column]:
    """Per text column: non-null, integer-shaped, number and timestamp counts
    (named ``{prefix}n{i}`` / ``i`` / ``d`` / ``t``), for one aggregation."""
    exprs = []
    for i, c in enumerate(cols):
        v = q(c)
        # Numbers and ISO times begin with a digit, a sign, a point or white space, booleans
        # with one of four letters: one look at the first character spares the rest.
        first = F.ascii(v)
        digit, letter = first.between(1, 57), first.between(1, 32) | first.isin(*map(ord, "TtFf"))
        number = digit | first.isin(*map(ord, "IiNn"))     # infinity, nan
        as_num = number_from_text(v) if clean_numbers else to_number(v)
        numbers = as_num.isNotNull() & (v.rlike(NUMBER_TEXT_PATTERN) if clean_numbers else number)
        times = to_timestamp(v, formats).isNotNull()
        exprs += [
            F.count(v).alias(f"{prefix}n{i}"),
            F.count_if(digit & v.rlike(INTEGER_TEXT_PATTERN) & v.try_cast("long").isNotNull()).alias(f"{prefix}i{i}"),
            F.count_if(numbers if clean_numbers else number & as_num.isNotNull()).alias(f"{prefix}d{i}"),
            F.count_if(times if formats else digit & times).alias(f"{prefix}t{i}"),
            F.count_if(letter & v.rlike(BOOLEAN_TEXT_PATTERN)).alias(f"{prefix}b{i}"),
        ]
    return exprs


def decide_types(row, cols: list[str], min_ratio: float = 1.0, clean_numbers: bool = False,
                 prefix: str = "") -> dict[str, str]:
    """Type per column from the ``detection_aggs`` counts: all non-null values
    (or ``min_ratio`` of them) must parse."""
    out = {}
    for i, c in enumerate(cols):
        n, ints, nums, times, truths = (row[f"{prefix}{k}{i}"] for k in "nidtb")
        need = n * min_ratio
        if n == 0:
            out[c] = "string"
        elif ints >= need and ints > 0 and not clean_numbers:
            out[c] = "long"
        elif nums >= need and nums > 0:
            out[c] = "double"
        elif times >= need and times > 0:
            out[c] = "timestamp"
        elif truths >= need and truths > 0:
            out[c] = "boolean"
        else:
            out[c] = "string"
    return out


def detect_types(df: DataFrame, cols: list[str] | None = None, min_ratio: float = 1.0,
                 clean_numbers: bool = False, formats: list[str] | None = None) -> dict[str, str]:
    """Per text column the detected type: ``long``, ``double``, ``timestamp``, ``boolean`` or ``string``."""
    text = columns_of_kind(df, "string")
    cols = [c for c in (cols if cols is not None else text) if c in text]
    if not cols:
        return {}
    row = df.agg(*detection_aggs(cols, clean_numbers, formats)).collect()[0]
    return decide_types(row, cols, min_ratio, clean_numbers)


def converted(v: Column, kind: str, clean_numbers: bool = False,
              formats: list[str] | None = None) -> Column:
    """The conversion of a text column to a detected kind."""
    if kind == "long":
        return v.try_cast("long")
    if kind == "double":
        return number_from_text(v) if clean_numbers else to_number(v)
    if kind == "timestamp":
        return to_timestamp(v, formats)
    if kind == "boolean":
        return v.try_cast("boolean")
    return v


def convert_types(df: DataFrame, types: dict[str, str], clean_numbers: bool = False,
                  formats: list[str] | None = None) -> DataFrame:
    return df.select(*[converted(q(c), types.get(c, "string"), clean_numbers, formats).alias(c)
                       for c in df.columns])


def detect_and_convert(df: DataFrame, cols: list[str] | None = None, min_ratio: float = 1.0,
                       clean_numbers: bool = False, formats: list[str] | None = None,
                       log: StepLog | None = None) -> DataFrame:
    """Fit (one aggregation) + apply (projection) of ``detect_types``."""
    types = detect_types(df, cols, min_ratio, clean_numbers, formats)
    if log is not None:
        for c, kind in types.items():
            if kind in ("long", "double"):
                log.add(f"converted_{c}_to_numeric", columns=[c])
            elif kind == "timestamp":
                log.add(f"converted_{c}_to_datetime", columns=[c])
            elif kind == "boolean":
                log.add(f"converted_{c}_to_boolean", columns=[c])
    return convert_types(df, types, clean_numbers, formats)


def date_like_columns(df: DataFrame, date_columns: list[str] | None = None) -> list[str]:
    """Text columns named like dates or times, plus any listed explicitly."""
    text = columns_of_kind(df, "string")
    named = [c for c in text if "date" in c.lower() or "time" in c.lower()]
    extra = [c for c in (date_columns or []) if c in text and c not in named]
    return named + extra


@dataclass(frozen=True)
class DateFit:
    """Formats of a date column, in the order in which its cells are tried."""

    formats: list[str | None]
    unparsed: int
    tie: bool = False    # month-first and day-first parse as many cells; month-first goes first


def fit_date_formats(df: DataFrame, cols: list[str], formats: list[str] | None = None, strip: bool = False,
                     min_share: float = MIN_DATE_SHARE) -> dict[str, DateFit]:
    """Formats per text column, from one aggregation that counts every candidate's
    successes. A column's cells are tried by all candidates that parse any of them, the
    one that parses most first (earlier ones on a tie), so month-first or day-first is
    decided by the values, and a column of mixed formats keeps them all. A column of
    whose cells less than ``min_share`` parse, or none, is left out. ``formats`` given
    are used together, as they are."""
    if not cols:
        return {}
    tried = list(formats) if formats else [None, *DATE_FORMATS]
    flags, aggs = [], []
    for i, c in enumerate(cols):
        v = strip_expr(q(c)) if strip else q(c)
        flags.append(v.isNotNull().alias(f"n{i}"))
        flags += [_parse_one(v, f, only_test=True).isNotNull().alias(f"f{i}_{j}") for j, f in enumerate(tried)]
        names = [f"f{i}_{j}" for j in range(len(tried))]
        aggs += [F.count_if(n).alias(n) for n in (f"n{i}", *names)]
        aggs.append(F.count_if(F.expr(" OR ".join(names))).alias(f"any{i}"))
    row = df.select(*flags).agg(*aggs).collect()[0]
    out = {}
    for i, c in enumerate(cols):
        hits = [row[f"f{i}_{j}"] for j in range(len(tried))]
        order = range(len(tried)) if formats else sorted((j for j in range(len(tried)) if hits[j]), key=lambda j: (-hits[j], j))
        found, n = row[f"any{i}"], row[f"n{i}"]
        if found and found >= min_share * n:
            by = dict(zip(tried, hits))
            tie = not formats and any(by[f] and by[f] == by.get(f.replace("M", "?").replace("d", "M").replace("?", "d"))
                                      for f in DATE_FORMATS if f[0] == "M" and f[1] != "M")
            out[c] = DateFit([tried[j] for j in order], n - found, tie)
    return out


def parse_dates(df: DataFrame, date_columns: list[str] | None = None, formats: list[str] | None = None,
                log: StepLog | None = None, fitted: dict[str, DateFit] | None = None,
                min_share: float = MIN_DATE_SHARE) -> DataFrame:
    """Text columns named like dates (or listed) become timestamps; cells that no
    format of the column parses become null (counted in the log); a column of which
    less than ``min_share`` parses stays text. ``fitted`` skips the fit."""
    cols = [c for c in date_like_columns(df, date_columns)]
    fitted = fit_date_formats(df, cols, formats, min_share=min_share) if fitted is None else fitted
    if log is not None:
        for c in cols:
            if c in fitted:
                tie = ", month-first by a tie" if fitted[c].tie else ""
                log.add(f"parsed_{c}_as_datetime", columns=[c], detail=f"{fitted[c].unparsed} cells not parsed{tie}")
    return df.select(*[to_timestamp(q(c), fitted[c].formats).alias(c) if c in cols and c in fitted else q(c)
                       for c in df.columns])
