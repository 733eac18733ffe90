"""Pairs of records of one id that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_stream(flat: DataFrame, time: str, within: str = "1 hour", key: str = "id", name: str = "name", order: str = "position", provider: str = "provider") -> DataFrame:
    """key, alt_name, alt_provider, base_name, base_provider, alt_time, base_time for every two records of an id at most `within` apart.

    On a stream, records may arrive in any order and late by `within`; each pair comes out once, when its second
    record arrives, and records that can have no partner any more leave the state (a join of the stream with itself
    whose watermark follows from the bound on time). On a table it gives the same pairs at once. Sides follow the
    order of pair_up; records without id or time, with a blank name, or equal in position, name and provider give none.
    """
    seen = flat.select(F.col(key), F.col(time).cast("timestamp").alias("t"), F.struct(F.col(order).alias("o"), F.col(name).alias("n"), F.col(provider).alias("p")).alias("r"))
    seen = seen.where((F.trim(F.coalesce("r.n", F.lit(""))) != "") & F.col(key).isNotNull()).withWatermark("t", within)
    side = lambda s: seen.select(F.col(key).alias(f"{s}_id"), F.col("t").alias(f"{s}_time"), F.col("r").alias(s))
    near = F.expr(f"base_time >= alt_time - INTERVAL {within} AND base_time <= alt_time + INTERVAL {within}")
    pairs = side("alt").join(side("base"), (F.col("alt_id") == F.col("base_id")) & (F.col("alt") < F.col("base")) & near)
    return pairs.select(F.col("alt_id").alias(key), F.col("alt.n").alias("alt_name"), F.col("alt.p").alias("alt_provider"), F.col("base.n").alias("base_name"), F.col("base.p").alias("base_provider"), "alt_time", "base_time")
