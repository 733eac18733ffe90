"""Coverage, disagreement and distributions: each report is one scan and one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import nulls


def counted(df: DataFrame, columns: list[str], measures: dict, key: str = "column_name") -> DataFrame:
    """One row per column with its measures (name -> condition on a column): one aggregation, then a row each."""
    aggs = [F.count_if(test(F.col(c))).alias(f"{c}__{m}") for c in columns for m, test in measures.items()]
    wide = df.agg(F.count("*").alias("__rows"), *aggs)
    rows = F.array(*[F.struct(F.lit(c).alias(key), *[F.col(f"{c}__{m}").alias(m) for m in measures], F.col("__rows").alias("total_rows")) for c in columns])
    return wide.select(F.inline(rows))


def coverage(df: DataFrame, strict: bool = True, prefix: str = "base_") -> DataFrame:
    """column_name, side, present, total_rows, ratio for every column."""
    test = nulls.present_strict if strict else nulls.present_sql
    out = counted(df, df.columns, {"present": test})
    side = F.when(F.col("column_name").startswith(prefix), "base").otherwise("alt")
    return out.select("column_name", side.alias("side"), "present", "total_rows", (F.col("present") / F.col("total_rows")).alias("ratio"))


def conflicts(df: DataFrame, attributes: list[str], prefix: str = "base_") -> DataFrame:
    """Per attribute: presence by side, both, conflicts, the four-way breakdown and the decision pressure."""
    aggs = []
    for a in attributes:
        x, y = F.col(a), F.col(prefix + a)
        for name, test in {
            "alt_present": x.isNotNull(),
            "base_present": y.isNotNull(),
            "both_present": x.isNotNull() & y.isNotNull(),
            "conflict": x != y,
            "alt_only": x.isNotNull() & y.isNull(),
            "base_only": x.isNull() & y.isNotNull(),
            "neither": x.isNull() & y.isNull(),
        }.items():
            aggs.append(F.count_if(test).alias(f"{a}__{name}"))
    names = ["alt_present", "base_present", "both_present", "conflict", "alt_only", "base_only", "neither"]
    wide = df.agg(F.count("*").alias("__rows"), *aggs)
    rows = F.array(*[F.struct(F.lit(a).alias("attribute"), *[F.col(f"{a}__{n}").alias(n) for n in names], F.col("__rows").alias("total_rows")) for a in attributes])
    out = wide.select(F.inline(rows))
    return out.withColumn("decision_pressure", (F.col("conflict") + F.col("alt_only") + F.col("base_only")) / F.col("total_rows"))


def null_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """How null is written: a count of each encoding, and of anything that holds the word."""
    return counted(
        df,
        columns,
        {
            "sql_null": lambda c: c.isNull(),
            "empty_string": lambda c: c == "",
            "json_null": lambda c: c == "[null]",
            "json_empty": lambda c: c == '[""]',
            "json_word": lambda c: c.isin('["NULL"]', '["null"]'),
            "holds_word": lambda c: F.lower(c).contains("null"),
        },
    )


def status(a: Column, b: Column) -> Column:
    """both_null, base_only, alt_only, agree or conflict."""
    return F.when(a.isNull() & b.isNull(), "both_null").when(a.isNull(), "base_only").when(b.isNull(), "alt_only").when(a == b, "agree").otherwise("conflict")


def null_impact(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows by status before and after unifying encoded nulls."""
    x, y = F.col(a), F.col(b)
    moved = df.select(status(x, y).alias("before"), status(nulls.null_if_encoded(x, nulls.IMPACT), nulls.null_if_encoded(y, nulls.IMPACT)).alias("after"))
    return share_of_all(moved.groupBy("before", "after").agg(F.count("*").alias("row_count")))


def share_of_all(counts: DataFrame, n: str = "row_count") -> DataFrame:
    """Adds each count's ratio of the sum over a small table of counts."""
    return counts.withColumn("ratio", F.col(n) / F.sum(n).over(Window.partitionBy()))


def share_of(counts: DataFrame, *by: str, n: str = "row_count") -> DataFrame:
    """Adds each count's ratio of the sum within its partition."""
    return counts.withColumn("ratio", F.col(n) / F.sum(n).over(Window.partitionBy(*by)))


def both_sides(df: DataFrame, a: str, b: str, *keep: str) -> DataFrame:
    """Long form in one scan: side, value."""
    sides = F.array(F.struct(F.lit("alt").alias("side"), F.col(a).alias("value")), F.struct(F.lit("base").alias("side"), F.col(b).alias("value")))
    return df.select(*keep, F.inline(sides))


def distribution(df: DataFrame, by: list[str], within: list[str] | None = None) -> DataFrame:
    """Counts by some columns with the ratio of the table or of a partition."""
    counts = df.groupBy(*by).agg(F.count("*").alias("row_count"))
    return share_of(counts, *within) if within else share_of_all(counts)


def conform(df: DataFrame, defaults: dict, renames: dict[str, str] | None = None) -> DataFrame:
    """Inputs of many writers in one form: old names become new ones where the new one is missing, missing columns are
    added, and nulls filled, all with the defaults."""
    for old, new in (renames or {}).items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})


def top_values(df: DataFrame, column: str, n: int = 15) -> DataFrame:
    """The n most frequent values, of equals the smaller first."""
    return df.groupBy(column).agg(F.count("*").alias("row_count")).orderBy(F.desc("row_count"), F.asc_nulls_first(column)).limit(n)
