"""Column expressions shared by operators and plans; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


BLANKS = r"[\s\u00A0\u2000-\u200B\u3000\uFEFF]"


def number(c: Column | str) -> Column:
    """c as double with NaN and infinities turned into null."""
    c = F.col(c) if isinstance(c, str) else c
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def symbol(c: Column | str) -> Column:
    """Capitals without outer blanks; blanks are any white space or control characters."""
    c = F.col(c) if isinstance(c, str) else c
    return F.upper(F.regexp_replace(c, rf"^{BLANKS}+|{BLANKS}+$", ""))


def day(c: Column | str) -> Column:
    """UTC calendar day, independent of the session's time zone."""
    return F.expr("date '1970-01-01'") + day_number(c)


def day_number(c: Column | str) -> Column:
    """Whole UTC days since 1970-01-01."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(86_400_000_000)).cast("int")


def week_number(days: Column) -> Column:
    """Number of the Monday-based week holding a day number (1970-01-01 was a Thursday)."""
    return F.floor((days + 3) / 7).cast("int")


def date_text(days: Column) -> Column:
    """yyyy-MM-dd of a day number."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM-dd")


def fiscal_period(c: Column | str) -> Column:
    """A fiscal period however spelled as 'yyyy-Qn' or 'yyyy-FY'; null when no year can be read.

    Two-digit years are read as 20yy. A period without a quarter is the full year.
    """
    c = F.col(c) if isinstance(c, str) else c
    t = F.regexp_replace(F.upper(c), r"[\s _./'-]+", "")
    ahead = F.regexp_extract(t, r"(?:^|[^0-9])([1-4])Q", 1)
    behind = F.regexp_extract(t, r"Q(?:TR)?([1-4])", 1)
    quarter = F.when(ahead != "", ahead).when(behind != "", behind)
    long_year = F.regexp_extract(t, r"((?:19|20)\d\d)", 1)
    short_year = F.regexp_extract(t, r"(?:[1-4]Q|FY|Q[1-4]FY|^)(\d\d)(?:$|Q|FY)", 1)
    tail_year = F.regexp_extract(t, r"Q[1-4](\d\d)$", 1)
    year = (
        F.when(long_year != "", long_year)
        .when(short_year != "", F.concat(F.lit("20"), short_year))
        .when(tail_year != "", F.concat(F.lit("20"), tail_year))
    )
    return F.when(year.isNotNull(), F.concat(year, F.lit("-"), F.coalesce(F.concat(F.lit("Q"), quarter), F.lit("FY"))))


def date_range(c: Column | str, since: str | None = None, until: str | None = None) -> Column:
    """Whether a timestamp lies in the UTC days since to until, both included; an end that isn't given is open.

    Compares the column itself with fixed times, so the condition reaches a scan.
    """
    c = F.col(c) if isinstance(c, str) else c
    at = lambda d, more: F.lit(d).cast("timestamp") + F.expr(f"interval {more} days")
    out = F.lit(True)
    if since:
        out = out & (c >= at(since, 0))
    if until:
        out = out & (c < at(until, 1))
    return out
