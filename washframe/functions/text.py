"""Text expressions: whitespace stripping, NA tokens, number-shaped text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tokens a default pandas CSV read treats as missing.
DEFAULT_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# The characters Python's str.strip() removes -- ASCII controls
# \t \n \v \f \r, the separators \x1c-\x1f, space, NEL \x85, and the Unicode
# space separators (\p{Z}: no-break space, ogham mark, en quad .. hair space,
# line and paragraph separators, narrow no-break space, medium mathematical
# space, ideographic space).
WHITESPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                    "\u2028\u2029\u202f\u205f\u3000")
# The same set as a regex class (used where only regexes are available).
WHITESPACE_CLASS = r"[\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]"
STRIP_PATTERN = rf"^{WHITESPACE_CLASS}+|{WHITESPACE_CLASS}+$"

# Text that looks like one formatted number: optional sign / currency, digits
# with optional thousands commas, optional decimals, optional trailing percent.
NUMBER_TEXT_PATTERN = r"^\s*[-+]?[$€£¥]?\s*-?[0-9][0-9,]*(\.[0-9]+)?\s*%?\s*$"
# Everything but digits, point and minus is removed before parsing.
NON_NUMBER_CHARS = r"[^0-9.\-]"

INTEGER_TEXT_PATTERN = r"^\s*[-+]?[0-9]+\s*$"

# The whole text of a plain number. A cast alone also takes suffixed literals
# (``12D``, ``7F``), which are codes, not numbers; and a failed cast is expensive
# (an exception per value), so the shape is checked first.
LONG_GUARD_PATTERN = INTEGER_TEXT_PATTERN
DOUBLE_GUARD_PATTERN = (r"^\s*[-+]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?"
                        r"|(?i:inf|infinity|nan))\s*$")


def guarded_number(c: Column, kind: str) -> Column:
    """``try_cast`` to long / double, skipped for text that cannot parse."""
    pattern = LONG_GUARD_PATTERN if kind == "long" else DOUBLE_GUARD_PATTERN
    return F.when(c.rlike(pattern), c.try_cast(kind))


def strip_whitespace(c: Column) -> Column:
    """Both ends, all Unicode whitespace. Plain ``trim`` removes only ' '; trim
    with a character set touches only the ends (a regex would scan whole texts)."""
    return F.trim(c, F.lit(WHITESPACE_CHARS))


def null_if_token(c: Column, tokens) -> Column:
    """Exact cell match of any token becomes null (no trimming, case-sensitive)."""
    tokens = list(tokens)
    if not tokens:
        return c
    return F.when(c.isin(tokens), F.lit(None).cast("string")).otherwise(c)


def number_from_text(c: Column) -> Column:
    """``$1,200`` -> 1200.0; text that is not number-shaped -> null."""
    cleaned = F.regexp_replace(c, NON_NUMBER_CHARS, "")
    return F.when(c.rlike(NUMBER_TEXT_PATTERN), cleaned.try_cast("double"))
