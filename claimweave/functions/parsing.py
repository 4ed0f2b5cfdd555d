"""Typed values out of free text. Text that does not parse gives NULL, never an error."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_amount(text: Column) -> Column:
    """decimal(18,2) of what is left after dropping everything but digits, points and minus signs."""
    return F.regexp_replace(text, "[^0-9.-]", "").try_cast("decimal(18,2)")


# Date formats in the order they are tried, with their shape. Testing the shape first keeps the parser from failing on
# most rows, which is far slower than a successful parse.
_DATE_FORMATS = (("__-__-____", "dd-MM-yyyy"), ("____-__-__", "yyyy-MM-dd"))


def parse_date(*texts: Column) -> Column:
    """First text that is a day-month-year or year-month-day date."""
    return F.coalesce(*[
        F.when(text.like(shape), F.try_to_date(text, fmt)) for text in texts for shape, fmt in _DATE_FORMATS
    ])
