"""Phone equivalence in stages: symmetric rules on digit strings, a monotone report, classes and confidence."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import nulls
from tallyframe.functions.once import once
from tallyframe.operators.order_stats import medians, percentiles
from tallyframe.operators.profile import both_sides, share_of, share_of_all

Rule = Callable[[Column, Column], Column]


def tail(c: Column, start: int) -> Column:
    """The string from a 1-based position on."""
    return F.substring(c, start, 1 << 20)


def either(rule: Rule) -> Rule:
    return lambda a, b: rule(a, b) | rule(b, a)


def longer(by: int, rule: Rule) -> Rule:
    return lambda a, b: (F.length(a) == F.length(b) + by) & rule(a, b)


def no_trunk(cc: int) -> Rule:
    """One has a country code of cc digits, the other a leading 0 in its place."""
    return either(longer(cc - 1, lambda a, b: b.startswith("0") & (F.length(a) > cc) & (F.length(b) >= 2) & (tail(a, cc + 1) == tail(b, 2))))


def national(cc: int) -> Rule:
    return either(longer(cc, lambda a, b: (F.length(a) > cc) & (F.length(b) >= 1) & (tail(a, cc + 1) == b)))


RULES: dict[str, Rule] = {
    "S2_digits_only": lambda a, b: a == b,
    "S3_us_11v10_leading1": either(lambda a, b: (F.length(a) == 11) & a.startswith("1") & (F.length(b) == 10) & (tail(a, 2) == b)),
    "S4_generic_1digit_cc": either(longer(1, lambda a, b: tail(a, 2) == b)),
    "S5_trunk0_vs_cc2": no_trunk(2),
    "S6_trunk0_vs_cc3": no_trunk(3),
    "S7_cc2_vs_national": national(2),
    "S8_cc3_vs_national": national(3),
    "S9_cc2_then0_vs_cc2": either(longer(1, lambda a, b: (F.substring(a, 3, 1) == "0") & (F.substring(a, 1, 2) == F.substring(b, 1, 2)) & (tail(a, 4) == tail(b, 3)))),
}
SEVEN_EIGHT: Rule = lambda a, b: (F.length(a) == F.length(b)) & (((F.substring(a, 1, 1) == "7") & (F.substring(b, 1, 1) == "8")) | ((F.substring(a, 1, 1) == "8") & (F.substring(b, 1, 1) == "7"))) & (tail(a, 2) == tail(b, 2))
#: The set of the confidence report: no separate rule for one country, and the 7 or 8 trunk rule besides.
CONFIDENCE_RULES: dict[str, Rule] = {k: r for k, r in RULES.items() if k != "S3_us_11v10_leading1"} | {"trunk_7_or_8": SEVEN_EIGHT}


def with_digits(df: DataFrame, a: str = "phones", b: str = "base_phones") -> DataFrame:
    """Adds alt_raw, base_raw (encoded nulls unified), their digits and both_usable."""
    out = once(df, {"alt_raw": nulls.null_if_encoded(F.col(a)), "base_raw": nulls.null_if_encoded(F.col(b))})
    out = once(out, {"alt_digits": nulls.digits_only(F.col("alt_raw")), "base_digits": nulls.digits_only(F.col("base_raw"))})
    has = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    return out.withColumn("alt_usable", has("alt_digits")).withColumn("base_usable", has("base_digits")).withColumn("both_usable", F.col("alt_usable") & F.col("base_usable"))


def first_stage(rules: dict[str, Rule] = RULES) -> Column:
    """The first stage that makes the digits equal, counted from 2; null where none does or a side is unusable."""
    a, b = F.col("alt_digits"), F.col("base_digits")
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules.values(), 2))):
        out = F.when(rule(a, b), k).otherwise(out)
    return F.when(F.col("both_usable"), out)


def staged_report(df: DataFrame, rules: dict[str, Rule] = RULES) -> DataFrame:
    """stage, both_usable_count, conflict_count, conflict_rate, improvement: one aggregation, a row per stage."""
    staged = once(with_digits(df), {"at": first_stage(rules)})
    open_after = [F.count_if(F.col("both_usable") & (F.col("at").isNull() | (F.col("at") > k))).alias(f"c{k}") for k in range(2, len(rules) + 2)]
    wide = staged.agg(F.count_if("both_usable").alias("n"), F.count_if(F.col("both_usable") & (F.col("alt_raw") != F.col("base_raw"))).alias("c1"), *open_after)
    names = ["S0_null_normalization", "S1_raw_string", *rules]
    rows = [F.struct(F.lit(k).alias("o"), F.lit(s).alias("stage"), F.col("n").alias("both_usable_count"), (F.col(f"c{k}") if k else F.lit(None).cast("long")).alias("conflict_count")) for k, s in enumerate(names)]
    out = wide.select(F.inline(F.array(*rows)))
    prev = F.lag("conflict_count").over(Window.orderBy("o"))  # a row per stage
    better = F.when(prev == 0, F.lit(0.0)).otherwise((prev - F.col("conflict_count")) / prev)
    return out.select("stage", "both_usable_count", "conflict_count", (F.col("conflict_count") / F.when(F.col("both_usable_count") != 0, F.col("both_usable_count"))).alias("conflict_rate"), better.alias("improvement"))


def residual(df: DataFrame, rules: dict[str, Rule] = RULES) -> DataFrame:
    """Pairs that no stage resolves, and pairs with one usable side."""
    staged = once(with_digits(df), {"at": first_stage(rules)})
    kind = F.when(F.col("both_usable"), "both_present").when(F.col("alt_usable"), "alt_only").when(F.col("base_usable"), "base_only")
    return staged.where(F.col("at").isNull() & (F.col("alt_usable") | F.col("base_usable"))).select("id", kind.alias("residual_type"), "alt_raw", "base_raw", "alt_digits", "base_digits")


def classify(df: DataFrame, rules: dict[str, Rule] = CONFIDENCE_RULES) -> DataFrame:
    """Adds conflict_class: both_missing, alt_only, base_only, resolved or true_conflict."""
    a, b = F.col("alt_digits"), F.col("base_digits")
    equal = reduce(lambda x, y: x | y, [r(a, b) for r in rules.values()])
    kind = F.when(~F.col("alt_usable") & ~F.col("base_usable"), "both_missing").when(~F.col("base_usable"), "alt_only").when(~F.col("alt_usable"), "base_only").when(equal, "resolved").otherwise("true_conflict")
    return once(with_digits(df), {"conflict_class": kind})


def features(df: DataFrame, a: str = "phones", b: str = "base_phones") -> DataFrame:
    """Long form: side, value, digits and format flags of usable phones."""
    long = both_sides(df.select("id", nulls.null_if_encoded(F.col(a)).alias("a"), nulls.null_if_encoded(F.col(b)).alias("b")), "a", "b", "id").withColumn("digits", nulls.digits_only(F.col("value")))
    bare = F.regexp_replace("value", r'^\[\s*"?(.*?)"?\s*\]$', "$1")
    n = F.length("digits")
    bucket = F.when(n < 7, "<7").when(n <= 9, "7-9").when(n == 10, "10").when(n == 11, "11").when(n <= 15, "12-15").otherwise(">15")
    return long.where(n > 0).select("id", "side", "digits", n.cast("long").alias("digit_len"), F.col("value").contains("+").alias("has_plus"), F.col("value").contains("(").alias("has_parens"), F.col("value").contains("-").alias("has_hyphen"), bare.rlike("^[0-9]+$").alias("pure_numeric"), bucket.alias("len_bucket"))


def structure(df: DataFrame) -> DataFrame:
    """Per side: usable phones and how many show each format flag."""
    flags = ["has_plus", "has_parens", "has_hyphen", "pure_numeric"]
    return features(df).groupBy("side").agg(F.count("*").alias("usable"), *[F.count_if(f).alias(f) for f in flags], F.min("digit_len").alias("min_len"), F.max("digit_len").alias("max_len"))


def length_distribution(df: DataFrame) -> DataFrame:
    return share_of(features(df).groupBy("side", "len_bucket").agg(F.count("*").alias("row_count")), "side")


def higher_side(a: Column, b: Column) -> Column:
    return F.when(a > b, "alt").when(b > a, "base").otherwise("tied")


def confidence_summary(df: DataFrame) -> DataFrame:
    """Per class: counts, means, median gap, and which side is more confident."""
    a, b = F.col("confidence"), F.col("base_confidence")
    rows = classify(df)
    out = rows.groupBy("conflict_class").agg(
        F.count("*").alias("row_count"),
        F.avg(a).alias("avg_alt"),
        F.avg(b).alias("avg_base"),
        F.avg(a - b).alias("avg_diff"),
        F.count_if(a > b).alias("alt_higher"),
        F.count_if(b > a).alias("base_higher"),
        F.count_if(a == b).alias("tied"),
    )
    return out.join(F.broadcast(medians(rows, ["conflict_class"], F.abs(a - b), "median_gap")), "conflict_class")  # five classes


def confidence_percentiles(df: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Per side and class: the confidences at shares of the rows."""
    return percentiles(both_sides(classify(df), "confidence", "base_confidence", "conflict_class"), ["side", "conflict_class"], F.col("value"), shares)


def confidence_detail(df: DataFrame) -> DataFrame:
    a, b = F.col("confidence"), F.col("base_confidence")
    open_rows = classify(df).where(F.col("conflict_class").isin("true_conflict", "alt_only", "base_only"))
    return open_rows.select("id", "conflict_class", "alt_digits", "base_digits", a.alias("alt_confidence"), b.alias("base_confidence"), (a - b).alias("confidence_diff"), F.abs(a - b).alias("confidence_gap"), higher_side(a, b).alias("higher_side"))


def confidence_histogram(df: DataFrame) -> DataFrame:
    """side, conflict_class, hundredths, row_count, ratio of the side and class."""
    long = both_sides(classify(df), "confidence", "base_confidence", "conflict_class")
    counts = long.groupBy("side", "conflict_class", F.floor(F.col("value") * 100 + 0.5).cast("long").alias("hundredths")).agg(F.count("*").alias("row_count"))
    return share_of(counts, "side", "conflict_class")


# Bands of confidence in hundredths (fixed values): exact ones, then lower ends.
EXACT_BANDS = {100: "1.00", 99: "0.99", 98: "0.98", 77: "0.77"}
LOWER_ENDS = ((95, "0.97 – 0.95"), (92, "0.94 – 0.92"), (89, "0.91 – 0.89"), (86, "0.88 – 0.86"), (78, "0.85 – 0.78"), (60, "0.76 – 0.60"))


def band(hundredths: Column) -> Column:
    out = F.when(hundredths.isNull(), "0.59 – 0.00")
    for k, name in EXACT_BANDS.items():
        out = out.when(hundredths == k, name)
    for k, name in LOWER_ENDS:
        out = out.when(hundredths >= k, name)
    return out.otherwise("0.59 – 0.00")


def confidence_bands(df: DataFrame) -> DataFrame:
    long = both_sides(classify(df), "confidence", "base_confidence", "conflict_class")
    counts = long.groupBy("side", "conflict_class", band(F.floor(F.col("value") * 100 + 0.5)).alias("bucket")).agg(F.count("*").alias("row_count"))
    return share_of(counts, "side", "conflict_class")


def class_counts(df: DataFrame) -> DataFrame:
    return share_of_all(classify(df).groupBy("conflict_class").agg(F.count("*").alias("row_count")))
