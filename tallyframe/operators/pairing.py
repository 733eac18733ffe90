"""From flat records to pairs: all unordered pairs of records of one id, in blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Records of an id that are kept together; those of an id with more are dealt into blocks.
BLOCK = 512
#: Blocks of an id grow once there are SPREAD of them, as every record goes to each block of its id; to LARGE records and HEAVY bytes of names.
SPREAD, LARGE, HEAVY = 64, 4096, 4 << 20


def dealt(flat: DataFrame, key: str, name: str, order: str, provider: str, block: int) -> DataFrame:
    """id, lo, hi, own, r: every record in each piece of work that it takes part in.

    Records are counted by id first. An id with more than `block` is dealt into blocks by a hash, and any two blocks
    (or a block with itself) are one piece. Blocks of an id with more than SPREAD * block records hold more than `block`,
    LARGE and HEAVY at most, so a piece stays bounded whatever the id's number.
    """
    kept = flat.where(F.trim(F.coalesce(F.col(name), F.lit(""))) != "")
    kept = kept.select(F.col(key).alias("id"), F.struct(F.col(order).alias("o"), F.col(name).alias("n"), F.col(provider).alias("p")).alias("r"))
    counts = kept.groupBy("id").agg(F.count("*").alias("c"), F.sum(F.octet_length("r.n")).alias("bytes")).where("c > 1")
    held = F.greatest(F.lit(block), F.least(F.ceil(F.col("c") / SPREAD), F.lit(LARGE), F.floor(F.col("c") * HEAVY / F.col("bytes"))))
    blocks = F.ceil(F.col("c") / held).cast("int")
    own = F.pmod(F.xxhash64("r"), F.col("blocks")).cast("int")
    # ids of many records are few: a small side is broadcast at run time, a skewed partition of a larger join is split
    placed = kept.join(counts.select("id", blocks.alias("blocks")), "id").select("id", "r", own.alias("own"), "blocks")
    each = placed.select("id", "r", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return each.select("id", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "r")


def pair_up(flat: DataFrame, key: str = "id", name: str = "name", order: str = "position", provider: str = "provider", block: int = BLOCK) -> DataFrame:
    """key, alt_name, alt_provider, base_name, base_provider for every two records of an id, in their order.

    Blank names go first; ids with one record left, and records without id, give no pair. Records of one position go
    by name and provider; equal records pair like others. An id's pairs are quadratic in its records, as they are the
    result; the work is cut into triangles and rectangles of a block of records a side.
    """
    rows = dealt(flat, key, name, order, provider, block)
    groups = rows.groupBy("id", "lo", "hi").agg(F.collect_list(F.struct("r", "own")).alias("x"))
    of = lambda block: F.transform(F.filter("x", lambda e: e.own == F.col(block)), lambda e: e.r)
    sides = groups.select("id", (F.col("lo") == F.col("hi")).alias("alone"), of("lo").alias("left"), of("hi").alias("right"))
    # a select of its own: beside the generator they would be made again for every record
    first = sides.select("id", "alone", "left", "right", F.posexplode("left").alias("i", "a"))
    others = F.when(F.col("alone"), F.slice("left", F.col("i") + 2, F.size("left"))).otherwise(F.col("right"))
    pairs = first.select("id", "a", F.explode(others).alias("b"))
    ordered = F.col("a") <= F.col("b")
    pick = lambda x, y, k: F.when(ordered, F.col(f"{x}.{k}")).otherwise(F.col(f"{y}.{k}"))
    return pairs.select(F.col("id").alias(key), pick("a", "b", "n").alias("alt_name"), pick("a", "b", "p").alias("alt_provider"), pick("b", "a", "n").alias("base_name"), pick("b", "a", "p").alias("base_provider"))
