"""Date-format labels and conversion of date text to ISO form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellwarden import constants as C
from cellwarden.functions.text import strip


def date_format_label(c) -> Column:
    """Name of the first date format the stripped value matches, or null."""
    s = strip(c)
    label = F.lit(None).cast("string")
    for name, pattern in reversed(C.DATE_FORMATS):
        label = F.when(s.rlike(pattern), F.lit(name)).otherwise(label)
    # Every format is 6 to 10 characters long; other values skip the regexes.
    return F.when(F.length(s).between(6, 10), label)


def to_iso_date(c) -> Column:
    """``YYYY-MM-DD`` for a recognised and unambiguous date, else null.

    The day comes first unless the second number is above 12. A two-digit
    year is ambiguous and gives no value.
    """
    s = strip(c)
    label = date_format_label(c)
    parts = F.split(s, r"[/.\-]")
    first, second, third = (F.try_element_at(parts, F.lit(i)) for i in (1, 2, 3))
    day_first = F.concat_ws("-", third, F.lpad(second, 2, "0"), F.lpad(first, 2, "0"))
    month_first = F.concat_ws("-", third, F.lpad(first, 2, "0"), F.lpad(second, 2, "0"))
    year_first = F.concat_ws("-", first, second, third)
    names = [name for name, _ in C.DATE_FORMATS]
    # The second number is a day when it cannot be a month.
    swapped = second.try_cast("int") > 12
    text = (
        F.when(label == names[0], F.when(swapped, month_first).otherwise(day_first))
        .when(label.isin(names[1], names[2]), day_first)
        .when(label.isin(names[3], names[4]), year_first)
    )
    return F.date_format(text.try_cast("date"), "yyyy-MM-dd")
