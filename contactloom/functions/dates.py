"""Dates of reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _day(c: Column) -> Column:
    """yyyy-mm-dd or dd.mm.yyyy, else null."""
    iso = F.when(F.regexp_like(c, F.lit("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))
    dotted = F.when(F.regexp_like(c, F.lit("^[0-9]{2}\\.[0-9]{2}\\.[0-9]{4}$")), F.try_to_timestamp(c, F.lit("dd.MM.yyyy")))
    return F.to_date(F.coalesce(iso, dotted))


def date_range(c: Column) -> Column:
    """Z3: struct of the first and last day of a day, range, month or year; nulls if unreadable."""
    t = F.trim(c)
    parts = F.split(t, "[ \\t]*(?:–|—|\\.\\.\\.?|(?<=[0-9]{4})-(?=[0-9]{2}\\.)|[ \\t]-[ \\t])[ \\t]*", 2)
    a, b = _day(F.get(parts, F.lit(0))), _day(F.get(parts, F.lit(1)))
    year = F.when(F.regexp_like(t, F.lit("^[0-9]{4}$")), F.to_date(F.concat(t, F.lit("-01-01"))))
    month = F.when(F.regexp_like(t, F.lit("^[0-9]{4}-[0-9]{2}$")), F.to_date(F.try_to_timestamp(F.concat(t, F.lit("-01")), F.lit("yyyy-MM-dd"))))
    one = _day(t)
    return F.struct(
        F.coalesce(one, F.when(b.isNotNull(), F.least(a, b)), month, year).alias("first"),
        F.coalesce(one, F.when(a.isNotNull(), F.greatest(a, b)), F.last_day(month), F.date_add(F.add_months(year, 12), -1)).alias("last"),
    )
