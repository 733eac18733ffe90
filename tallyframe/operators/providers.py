"""Sources as JSON in a string: explode, count contributors, pick the provider of each side, pair them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.profile import both_sides, share_of_all

ENTRY = "array<struct<dataset:string,property:string>>"
EXISTENCE = "/properties/existence"


def exploded(df: DataFrame, column: str, key: str = "id") -> DataFrame:
    """key, dataset, property: one row per entry with a dataset."""
    entries = F.from_json(F.coalesce(F.col(column), F.lit("[]")), ENTRY)
    return df.select(key, F.inline(entries)).where("dataset IS NOT NULL")


def contributing(long: DataFrame) -> DataFrame:
    return long.where(F.col("property").isNull() | (F.col("property") != EXISTENCE))


def by_side(alt: DataFrame, base: DataFrame) -> DataFrame:
    return alt.withColumn("side", F.lit("alt")).unionByName(base.withColumn("side", F.lit("base")))


def property_values(df: DataFrame, alt: str = "sources", base: str = "base_sources") -> DataFrame:
    return by_side(exploded(df, alt), exploded(df, base)).groupBy("side", "property").agg(F.count("*").alias("entry_count"))


def entries(column: str) -> Column:
    """The entries of a row that have a dataset."""
    return F.filter(F.from_json(F.coalesce(F.col(column), F.lit("[]")), ENTRY), lambda x: x["dataset"].isNotNull())


def counts_for(x: Column) -> Column:
    return x["property"].isNull() | (x["property"] != EXISTENCE)


def contributors(df: DataFrame, alt: str = "sources", base: str = "base_sources") -> DataFrame:
    """Histogram per side: how many rows with entries have so many contributing ones; counted within the row."""
    sides = both_sides(df.select(entries(alt).alias("a"), entries(base).alias("b")), "a", "b").where(F.size("value") > 0)
    return sides.groupBy("side", F.size(F.filter("value", counts_for)).cast("long").alias("attr_contributors")).agg(F.count("*").alias("row_count"))


def provider_counts(df: DataFrame, alt: str = "sources", base: str = "base_sources") -> DataFrame:
    """Distinct rows per side and provider, with the ratio of all rows."""
    total = df.agg(F.count("*").alias("n"))
    counts = contributing(by_side(exploded(df, alt), exploded(df, base))).groupBy("side", "dataset").agg(F.countDistinct("id").alias("row_count"))
    return counts.crossJoin(F.broadcast(total)).select("side", "dataset", "row_count", (F.col("row_count") / F.col("n")).alias("ratio"))  # one row


def primary(column: str) -> Column:
    """The provider of a row: its first contributing entry by (property, nulls last; dataset), found within the row."""
    keys = F.transform(F.filter(entries(column), counts_for), lambda x: F.struct(x["property"].isNull().alias("last"), x["property"].alias("property"), x["dataset"].alias("dataset")))
    return F.array_min(keys)["dataset"]


def pairings(df: DataFrame, alt: str = "sources", base: str = "base_sources") -> DataFrame:
    """Cross-tabulation of base and alt providers, 'none' where there is none: one scan and one aggregation."""
    own = lambda c, name: F.coalesce(primary(c), F.lit("none")).alias(name)
    return share_of_all(df.groupBy(own(base, "base_provider"), own(alt, "alt_provider")).agg(F.count("*").alias("row_count")))
