"""Exact order statistics by radix selection: which values stand at given places, for all groups and places at once.

A value becomes a long of the same order. Its leading bits are counted by group, the counts (of at most
2**22 buckets a group) are added up in order, and only the buckets in which a wanted place lies are opened
by their next bits. After three levels the buckets are single values. What one task sorts is the buckets
of one opened bucket, however many rows or distinct values a group has.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits that each level opens, 64 in all.
LEVELS = (22, 21, 21)


def sortable(x: Column) -> Column:
    """A double as a long of the same order: both zeros are 0, infinities come after all numbers, NaN last."""
    a = F.abs(x)
    guess = F.greatest(F.least(F.floor(F.log2(a)).cast("int"), F.lit(1023)), F.lit(-1022))
    scaled = lambda e: a * F.pow(F.lit(2.0), -e)  # noqa: E731  exact, as is every step by a power of two
    e = F.when(scaled(guess) < 1, guess - 1).when(scaled(guess) >= 2, guess + 1).otherwise(guess)
    normal = (e + 1023).cast("long") * (1 << 52) + ((scaled(e) - 1) * float(1 << 52)).cast("long")
    tiny = (a * float(2.0**537) * float(2.0**537)).cast("long")  # below the least normal number: steps of 2**-1074
    inf = F.lit(2047 << 52)
    size = F.when(F.isnan(x), inf + 1).when(a == float("inf"), inf).when(a < 2.0**-1022, tiny).otherwise(normal)
    return F.when(x < 0, -size).otherwise(size)


def selected(counts: DataFrame, by: list[str], places: Callable[[Column], list[Column]], keep: list[str]) -> DataFrame:
    """by, _i, _k, _left, _tied and `keep` of the rows (by, _k, _n) at the places of each group; places count from 1.

    places: from a group's total to the wanted places; one outside of the group gives no row. _left: the place
    among the _tied rows of equal _k. Columns of `keep` are functions of _k.
    """
    # null-safe, as a plain equality would filter nulls below the counts and so make them differ from level to level
    low, same = 64, lambda a, b: reduce(lambda x, y: x & y, [F.col(f"o.{c}").eqNullSafe(F.col(f"c.{c}")) for c in by], a.eqNullSafe(b))
    opened: DataFrame | None = None
    for bits in LEVELS:
        low -= bits
        at = F.shiftright("_k", low) if low else F.col("_k")
        if opened is None:
            hist = counts.groupBy(*by, at.alias("_p")).agg(F.sum("_n").alias("_n"), *[F.max(c).alias(c) for c in keep])
            inside, total = Window.partitionBy(*by), F.sum("_n").over(Window.partitionBy(*by))
            wanted = F.array(*[F.struct(F.lit(i).alias("i"), p.cast("long").alias("r")) for i, p in enumerate(places(total))])
        else:
            rows = opened.alias("o").join(counts.alias("c"), same(F.shiftright("c._k", low + bits), F.col("o._p")))
            hist = rows.groupBy(*[F.col(f"c.{c}") for c in by], F.col("o._p").alias("_up"), (F.shiftright("c._k", low) if low else F.col("c._k")).alias("_p")).agg(F.sum("c._n").alias("_n"), F.first("o._w").alias("_w"), *[F.max(f"c.{c}").alias(c) for c in keep])
            inside, wanted = Window.partitionBy(*by, "_up"), F.col("_w")
        before = F.sum("_n").over(inside.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
        placed = hist.select(*by, "_p", "_n", *keep, before.alias("_b"), wanted.alias("_w"))
        here = F.filter("_w", lambda w: (w.r > F.col("_b")) & (w.r <= F.col("_b") + F.col("_n")))
        moved = F.transform(here, lambda w: F.struct(w.i.alias("i"), (w.r - F.col("_b")).alias("r")))
        opened = placed.select(*by, "_p", "_n", *keep, moved.alias("_w")).where(F.size("_w") > 0)
    return opened.select(*by, F.col("_p").alias("_k"), F.col("_n").alias("_tied"), *keep, F.explode("_w").alias("_w")).select(*by, F.col("_w.i").alias("_i"), "_k", F.col("_w.r").alias("_left"), "_tied", *keep)


def order_statistics(df: DataFrame, by: list[str], value: Column, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Per group, `n` (values that are not null) and a column for each place: the value that stands there.

    places: name -> from n to the place, from 1; outside of 1 to n it is null. Groups without values keep a row.
    """
    # nulls are counted as none, so all levels read the same counts and their exchange is reused
    counts = df.select(*by, value.cast("double").alias("_v")).groupBy(*by, "_v").agg(F.count("_v").alias("_n"))
    found = selected(counts.withColumn("_k", sortable(F.col("_v"))), by, lambda n: [p(n) for p in places.values()], ["_v"])
    wide = found.groupBy(*by).agg(*[F.max(F.when(F.col("_i") == i, F.col("_v"))).alias(name) for i, name in enumerate(places)])
    groups = counts.groupBy(*by).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"))
    if not by:
        return groups.join(wide)  # one row each
    on = reduce(lambda x, y: x & y, [F.col(f"g.{c}").eqNullSafe(F.col(f"w.{c}")) for c in by])
    return groups.alias("g").join(wide.alias("w"), on, "left").select("g.*", *[f"w.{name}" for name in places])


def medians(df: DataFrame, by: list[str], value: Column, name: str = "median") -> DataFrame:
    """The exact median of a value by group, the mean of the two middle ones; null where a group has no value."""
    low, high = (lambda n: F.floor((n + 1) / 2)), (lambda n: F.floor(n / 2) + 1)
    out = order_statistics(df, by, value, {"_low": low, "_high": high})
    return out.select(*by, ((F.col("_low") + F.col("_high")) / 2).alias(name))


def percentiles(df: DataFrame, by: list[str], value: Column, shares: dict[str, float]) -> DataFrame:
    """Per group the least value that at least a share of the values doesn't exceed; shares from 0 (least) to 1 (greatest)."""
    return order_statistics(df, by, value, {name: (lambda n, p=p: F.greatest(F.ceil(n * p), F.lit(1))) for name, p in shares.items()}).drop("n")


def digest_order(key: Column, salt: str) -> Column:
    """The leading 60 bits of the key's salted md5."""
    return F.conv(F.substring(F.md5(F.encode(F.concat(key.cast("string"), F.lit(salt)), "UTF-8")), 1, 15), 16, 10).cast("long")


def exact_split(df: DataFrame, key: str, fraction: float = 0.6, cap: int | None = None, sub: float | None = None, salt: str = "42", name: str = "part") -> DataFrame:
    """Adds `name`: rows in the order of their salted digest, cut at exact places.

    Of n rows the first floor(fraction * n) are for training, of which those after the first `cap` are spare; of the
    others the first floor(sub * their number) are fit and the rest tune (all train where sub is None); the remaining
    rows are test. Rows of one key go by a hash of the whole row; a row's exact copies stay together, on the side
    of the last of them that is inside, so only copies can move a size. A null key counts as an empty text.
    """
    digest, row = digest_order(F.coalesce(F.col(key).cast("string"), F.lit("")), salt), F.xxhash64(*[F.col(c) for c in df.columns])

    def places(n: Column) -> list[Column]:
        train = F.floor(n * fraction)
        kept = F.least(train, F.lit(cap)) if cap is not None else train
        return [F.floor(kept * sub) if sub is not None else kept, kept, train]

    edges = selected(df.select(digest.alias("_k"), F.lit(1).alias("_n")), [], places, [])
    first = lambda i, c: F.max(F.when(F.col("_i") == i, F.col(c)))
    # one row, of nulls where a part is empty
    cuts = edges.agg(*[first(i, c).alias(f"_{c}{i}") for i in range(3) for c in ("_k", "_left", "_tied")])
    marked = df.withColumns({"_d": digest, "_h": row})
    # keys whose rows lie on both sides of a cut are cut again, by the hash of the row
    split = edges.where("_left < _tied").select("_i", "_k", "_left")
    tied = marked.select("_d", "_h").join(F.broadcast(split.withColumnRenamed("_k", "_e")), F.col("_d") == F.col("_e"))  # three rows at most
    inner = selected(tied.select("_i", "_left", F.col("_h").alias("_k"), F.lit(1).alias("_n")).withColumnsRenamed({"_i": "_c", "_left": "_l"}), ["_c", "_l"], lambda n: [F.col("_l")], [])
    inner = inner.groupBy().agg(*[F.max(F.when(F.col("_c") == i, F.col("_k"))).alias(f"_row{i}") for i in range(3)])
    both = marked.join(F.broadcast(cuts)).join(F.broadcast(inner))
    inside = lambda i: F.coalesce((F.col("_d") < F.col(f"__k{i}")) | ((F.col("_d") == F.col(f"__k{i}")) & ((F.col(f"__left{i}") == F.col(f"__tied{i}")) | (F.col("_h") <= F.col(f"_row{i}")))), F.lit(False))
    part = F.when(inside(0), "fit" if sub is not None else "train").when(inside(1), "tune").when(inside(2), "spare").otherwise("test")
    return both.select(*df.columns, part.alias(name))
