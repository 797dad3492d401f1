"""String predicates and trims shared by the message contracts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace of the contracts: Unicode white space and the four separators
# U+001C to U+001F.  Spark's trim() only knows the blank.
_SPACE = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    # Only blanks, control characters and characters beyond ASCII can be white
    # space, so most values are done after a look at both ends.
    first, last = F.substring(c, 1, 1), F.substring(c, -1, 1)
    suspect = (first <= " ") | (last <= " ") | (first > "~") | (last > "~")
    return F.when(
        suspect, F.regexp_replace(c, rf"(?U)\A{_SPACE}+|{_SPACE}+\z", "")).otherwise(c)


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def strip_slashes(c: Column) -> Column:
    return F.regexp_replace(c, r"\A/+|/+\z", "")


# A final line feed passes the id patterns of the contracts.
def is_id(c: Column, max_length: int) -> Column:
    return (F.length(c) <= max_length) & c.rlike(r"\A[a-zA-Z0-9_-]+\n?\z")


def is_trace_id(c: Column, max_length: int) -> Column:
    return (F.length(c) == 0) | (
        (F.length(c) <= max_length) & c.rlike(r"\A[a-fA-F0-9_-]+\n?\z"))


def is_bucket_name(c: Column) -> Column:
    return c.rlike(r"\A[a-z0-9][a-z0-9.-]{1,61}[a-z0-9]\n?\z")


def contains_any(c: Column, needles) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | c.contains(needle)
    return found


def has_control_char(c: Column) -> Column:
    return c.rlike(r"[\x00-\x1f]")
