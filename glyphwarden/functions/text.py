"""Text functions as Column expressions; Python only for NFC, fenced blocks and spans, over Arrow."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .codepoints import EXOTIC_SET, INVISIBLE_SET, WHITE_SET
from .spans import without_fences

#: An alphabetic word with inner apostrophes and hyphens; \w is spelled out because Java's is ASCII.
WORD = r"[\p{L}\p{Nl}\p{No}]+(?:['’-][\p{L}\p{Nl}\p{No}]+)*"


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once: a Column used twice is otherwise computed twice, in a lambda once an element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_invisible(c: Column) -> Column:
    return F.regexp_replace(c, f"[{INVISIBLE_SET}]", "")


def normalize_whitespace(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), f"[{EXOTIC_SET}]", " ")


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(c: Column) -> Column:
    """Spark has no normalize(): only texts that are not ASCII go to Python."""
    plain = ~c.rlike(r"[^\x00-\x7F]")
    return F.when(plain, c).otherwise(_nfc(F.when(~plain, c)))


def clean(c: Column) -> Column:
    return strip_invisible(nfc(normalize_whitespace(c)))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def white_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"[^{WHITE_SET}]+"), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WHITE_SET}]+|[{WHITE_SET}]+$", "")


def occurrences(c: Column, part: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(part)))) / len(part)).cast("int")


def matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def in_list(tokens: Column, values) -> Column:
    """How many tokens are among fixed values."""
    return F.size(F.filter(tokens, lambda t: t.isin(*sorted(values))))


def printable_ratio(c: Column) -> Column:
    """Share of characters that Python calls printable, with newline and tab."""
    hidden = F.regexp_count(c, F.lit(r"[\p{Cc}\p{Cf}\p{Cn}\p{Co}\p{Cs}\p{Zl}\p{Zp}\p{Zs}&&[^ \n\t]]"))
    return F.when(F.length(c) > 0, (F.length(c) - hidden) / F.length(c)).otherwise(0.0)


@F.pandas_udf(StringType())
def _without_fences(s: pd.Series) -> pd.Series:
    return s.map(without_fences, na_action="ignore")


def prose_only(c: Column) -> Column:
    """The text with fenced blocks blanked, line by line; only texts with a fence go to Python."""
    has = c.rlike(r"(?m)^\s*(?:```|~~~)")
    return F.when(~has, c).otherwise(_without_fences(F.when(has, c)))


def preview(c: Column, n: int) -> Column:
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n - 3), F.lit("...")))


def unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def steps(n: Column, *table: tuple[int, float]) -> Column:
    """The value of the highest step that n reaches, 0 below the first."""
    out = None
    for least, value in sorted(table, reverse=True):
        out = F.when(n >= least, value) if out is None else out.when(n >= least, value)
    return out.otherwise(0.0)


def estimate_tokens(c: Column) -> Column:
    return F.ceil(F.length(c) / 4)
