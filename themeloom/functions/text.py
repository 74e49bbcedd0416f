"""Column expressions on text; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 characters that count as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove white space, Unicode included, at both ends."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def is_blank(c: Column | str) -> Column:
    return strip(c) == ""


def digest(c: Column | str) -> Column:
    """32 bytes standing for a text of any length as a grouping key."""
    return F.unhex(F.sha2(col(c).cast("binary"), 256))


def estimate_tokens(c: Column | str) -> Column:
    """Four code points per token, rounded down."""
    return F.floor(F.length(col(c)) / 4).cast("bigint")


def token_counter(encode: Callable[[str], list]) -> Callable[[Column | str], Column]:
    """An exact counter from a tokenizer's ``encode``, run on Arrow batches."""
    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else len(encode(t))).astype("Int64")

    return lambda c: count(col(c))


def lines(c: Column | str) -> Column:
    """The stripped lines of a text as an array."""
    return F.transform(F.split(col(c), "\n"), strip)


def after(c: Column, mark: str) -> Column:
    """The part after the first ``mark``; null if there is none."""
    place = F.instr(c, mark)
    return F.when(place > 0, F.substring(c, place + len(mark), F.length(c)))


def before(c: Column, mark: str) -> Column:
    """The part before the first ``mark``; the whole text if there is none."""
    return F.substring_index(c, mark, 1)


def names(entries: Column | str) -> Column:
    """The theme names of an array of (theme, confidence)."""
    return F.transform(col(entries), lambda e: e["theme"])
