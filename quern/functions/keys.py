"""Column expressions for keys that people and programs spell differently."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks that may surround a key: ASCII white space, NEL, no-break and ideographic space.
_EDGE = r"^[\s\u0085   -​    　﻿]+|[\s\u0085   -​    　﻿]+$"


def strip(col: Column) -> Column:
    """The text without blanks at its ends."""
    return F.regexp_replace(col, _EDGE, "")


def key(col: Column) -> Column:
    """Keys that differ only in case or in blanks around them name the same thing; empty is null."""
    return F.nullif(F.lower(strip(col)), F.lit(""))


def path_key(col: Column) -> Column:
    """One spelling for all paths that lead to the same file.

    Percent escapes, backslashes, doubled slashes, ``.`` and ``..`` steps, letter case and blanks
    at the ends are resolved; blanks inside stay.  A broken escape leaves the text as it is.
    """
    raw = strip(col)
    plain = F.coalesce(F.try_url_decode(F.regexp_replace(raw, r"\+", "%2B")), raw)
    p = F.regexp_replace(F.lower(strip(plain)), r"\\", "/")
    p = F.regexp_replace(p, r"/+", "/")
    for _ in range(2):  # neighbouring dot steps share a slash
        p = F.regexp_replace(p, r"(^|/)\./", "$1")
    for _ in range(3):
        p = F.regexp_replace(p, r"(^|/)(?!\.\./)[^/]+/\.\./", "$1")
    p = F.regexp_replace(p, r"^/+|/+$", "")
    return F.nullif(p, F.lit(""))
