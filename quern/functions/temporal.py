"""Year intervals: parsing, Allen relations, plausibility.  Years are inclusive, negative is BC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = "struct<start:int,end:int,approximate:boolean>"


def _range(start: Column, end: Column, approximate: bool = False) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(approximate).alias("approximate"))


def parse_date(text: Column) -> Column:
    """Year interval of a written date, or null: centuries (AD, BC), decades, circa, ranges, BC, AD, plain years, EDTF years."""
    t = F.lower(F.trim(text))
    n = lambda p, g=1: F.try_to_number(F.nullif(F.regexp_extract(t, p, g), F.lit("")), F.lit("99999999")).cast("int")
    century_bc = r"^(?:the )?(\d{1,2})(?:st|nd|rd|th) century (?:bc|bce)$"
    century = r"^(?:the )?(\d{1,2})(?:st|nd|rd|th) century(?: (?:ad|ce))?$"
    decade = r"^(?:the )?(\d{1,3}0)s$"
    circa = r"^(?:c\.|ca\.|circa|about|approx\.?)\s*(\d{1,4})$"
    span = r"^(\d{1,4})\s*[-–—/]\s*(\d{1,4})$"
    bc = r"^(\d{1,4})\s*(?:bc|bce)$"
    ad = r"^(?:ad\s*)?(\d{1,4})(?:\s*(?:ad|ce))?$"
    edtf = r"^(\d{4})([~?%])$"
    edtf_part = r"^(\d{4})-\d{2}(?:-\d{2})?$"
    unknown = r"^(\d{2,3})(x{1,2})$"
    head = n(unknown)
    width = F.when(F.length(F.regexp_extract(t, unknown, 2)) == 2, 100).otherwise(10)
    return F.coalesce(
        F.when(t.rlike(century_bc), _range(-100 * n(century_bc), -(100 * (n(century_bc) - 1) + 1))),
        F.when(t.rlike(century), _range(100 * (n(century) - 1) + 1, 100 * n(century))),
        F.when(t.rlike(decade), _range(n(decade), n(decade) + 9)),
        F.when(t.rlike(circa), _range(n(circa), n(circa), True)),
        F.when(t.rlike(span), _range(n(span, 1), n(span, 2))),
        F.when(t.rlike(bc), _range(-n(bc), -n(bc))),
        F.when(t.rlike(ad), _range(n(ad), n(ad))),
        F.when(t.rlike(edtf), _range(n(edtf), n(edtf), True)),
        F.when(t.rlike(edtf_part), _range(n(edtf_part), n(edtf_part))),
        F.when(t.rlike(unknown) & (F.length(t) == 4), _range(head * width, head * width + width - 1)),
    )


def before(a: Column, b: Column) -> Column:
    return a["end"] < b["start"]


def after(a: Column, b: Column) -> Column:
    return a["start"] > b["end"]


def during(a: Column, b: Column) -> Column:
    return (a["start"] >= b["start"]) & (a["end"] <= b["end"])


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] <= b["end"]) & (b["start"] <= a["end"])


def meets(a: Column, b: Column) -> Column:
    return a["end"] + 1 == b["start"]


def equals(a: Column, b: Column) -> Column:
    return (a["start"] == b["start"]) & (a["end"] == b["end"])


def midpoint(a: Column) -> Column:
    return (a["start"] + a["end"]) / 2


def span_years(a: Column) -> Column:
    return a["end"] - a["start"] + 1


def contains(a: Column, year: Column) -> Column:
    return (year >= a["start"]) & (year <= a["end"])


def plausibility(a: Column, context: Column, scale: float = 100.0) -> Column:
    """1 where the intervals overlap, else exp(-gap / scale)."""
    if scale <= 0:
        raise ValueError("scale must be positive")
    gap = F.when(before(a, context), context["start"] - a["end"]).otherwise(a["start"] - context["end"])
    return F.when(overlaps(a, context), F.lit(1.0)).otherwise(F.exp(-gap / F.lit(float(scale))))
