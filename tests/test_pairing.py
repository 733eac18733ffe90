"""Pairs of records against combinations in plain Python."""

from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import pairing


def plain(rows):
    by = defaultdict(list)
    for i, o, n, p in rows:
        if i is not None and n is not None and n.strip(" "):
            by[i].append((o is not None, o or 0, n, p is not None, p or "", n, p))
    return Counter((i, a[5], a[6], b[5], b[6]) for i, rs in by.items() for a, b in combinations(sorted(rs), 2))


@pytest.mark.parametrize("block", [1, 3, 512])
def test_all_pairs_of_a_hot_id(spark, block):
    rows = [("hot" if k % 2 else f"i{k % 30}", k * 7919 % 100, f"n{k % 50}", [None, "x", "y"][k % 3]) for k in range(160)]
    rows += [("one", 1, "alone", "x"), (None, 1, "a", "x"), (None, 2, "b", "x"), ("blank", 1, " ", "x"), ("blank", 2, None, "x"), ("blank", 3, "left", "x")]
    rows += [("same", 1, "twin", "x")] * 4 + [("same", None, "twin", None)]
    flat = spark.createDataFrame(rows, "id string, position int, name string, provider string")
    got = Counter(tuple(r) for r in pairing.pair_up(flat, block=block).collect())
    assert got == plain(rows)
    assert pairing.pair_up(flat.limit(0)).count() == 0


def test_pieces_are_bounded_whatever_an_id_holds(spark):
    flat = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id")).alias("id"), F.col("id").alias("position"), F.lit("n").alias("name"), F.lit("p").alias("provider"))
    sizes = pairing.dealt(flat, "id", "name", "position", "provider", 256).groupBy("id", "lo", "hi").count()
    top = sizes.agg(F.max("count"), F.count("*")).first()
    assert top[0] < 2 * 256 * 1.3 and top[1] == 40 * 41 / 2


def test_copies_of_a_record_are_bounded(spark, monkeypatch):
    """Blocks grow with an id, within a number of records and bytes; before, a record of 4,000 with blocks of 4 went to 1,000 blocks."""
    flat = spark.range(4_000).select(F.lit(-1).alias("id"), F.col("id").alias("position"), F.rpad(F.col("id").cast("string"), 100, "n").alias("name"), F.lit("p").alias("provider"))
    blocks = lambda: pairing.dealt(flat, "id", "name", "position", "provider", 4).groupBy("own").count().count()
    assert pairing.dealt(flat, "id", "name", "position", "provider", 4).count() == 4_000 * pairing.SPREAD == 4_000 * blocks()
    monkeypatch.setattr(pairing, "LARGE", 40)
    assert blocks() == 100
    monkeypatch.setattr(pairing, "HEAVY", 1_000)
    assert blocks() == 400


def test_pairs_of_grown_blocks(spark):
    rows = [("hot", k * 7919 % 500, f"n{k % 50}", ["x", None][k % 2]) for k in range(600)]
    got = pairing.pair_up(spark.createDataFrame(rows, "id string, position int, name string, provider string"), block=2)
    assert Counter(tuple(r) for r in got.collect()) == plain(rows)
