"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_from_parts(year: Column, month: Column, day: Column) -> Column:
    """Date of year, month?, day?; an impossible day falls back to the first of January."""
    text = F.format_string("%04d-%02d-%02d", year, F.coalesce(month, F.lit(1)), F.coalesce(day, F.lit(1)))
    return F.when(year.isNotNull(), F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.make_date(year, F.lit(1), F.lit(1))))


def iso_date(c: Column) -> Column:
    """Date of an ISO string, null when it is not one."""
    return F.try_to_date(c, "yyyy-MM-dd")


def publication_year(by_type: Column) -> Column:
    """Year by kind of publication: electronic, print, collection, else any."""
    return F.coalesce(
        F.try_element_at(by_type, F.lit("epub")), F.try_element_at(by_type, F.lit("ppub")),
        F.try_element_at(by_type, F.lit("collection")), F.try_element_at(F.map_values(by_type), F.lit(1)),
    )
