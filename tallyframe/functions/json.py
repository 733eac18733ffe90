"""Fields of JSON in strings, with a guard for strings that are none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Places of a record's attributes (fixed values).
PATHS = {"primary": "$.primary", "freeform": "$[0].freeform", "locality": "$[0].locality", "region": "$[0].region"}


def is_json(c: Column) -> Column:
    """False for null as well."""
    return F.coalesce(F.try_parse_json(c).isNotNull(), F.lit(False))


def field(c: Column, path: str, otherwise: str = "raw") -> Column:
    """The value at a path as text; of a string that is no JSON the string itself ('raw') or null ('null')."""
    return F.when(is_json(c), F.get_json_object(c, path)).otherwise(c if otherwise == "raw" else F.lit(None).cast("string"))
