"""Three levels of absence: SQL null, a string that encodes null, and text without a digit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strings that encode null (fixed values), by the operator that uses them.
PRESENCE = ("[null]", '[""]', "")
IMPACT = ("[null]", '[""]', '["NULL"]', '["null"]')
UNIFIED = ("[null]", '[""]', '["NULL"]', '["null"]', "")


def null_if_encoded(c: Column, sentinels: tuple[str, ...] = UNIFIED) -> Column:
    """Null where the string only encodes null."""
    return F.when(~c.isin(*sentinels), c)


def present_strict(c: Column) -> Column:
    """Not null and, as a string, not one of the encodings of null."""
    return c.isNotNull() & ~F.coalesce(c.cast("string").isin(*PRESENCE), F.lit(False))


def present_sql(c: Column) -> Column:
    return c.isNotNull()


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def usable(c: Column) -> Column:
    """Has a digit; null is not usable."""
    return F.coalesce(F.length(digits_only(c)) > 0, F.lit(False))
