"""Radix selection against sorted lists."""

import math
import random
import statistics
import struct

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import order_stats as O


def numbers(n, seed):
    rng = random.Random(seed)
    out = [0.0, -0.0, math.inf, -math.inf, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, 1.0, math.nextafter(1, 0), math.nextafter(1, 2), 2.0, math.nextafter(2, 0), 0.1, 0.3]
    while len(out) < n:
        x = struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0]
        if not math.isnan(x):
            out += [x, rng.randrange(50) / 100, 2.0 ** rng.randrange(-1074, 1024), math.nextafter(2.0 ** rng.randrange(-1022, 1024), rng.choice([0, math.inf]))]
    return out


def test_keys_have_the_order_of_the_values(spark):
    xs = numbers(4000, 1)
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", O.sortable(F.col("x")).alias("k")).collect()
    for r in rows:
        bits = struct.unpack("q", struct.pack("d", abs(r["x"])))[0]
        assert r["k"] == (bits if r["x"] >= 0 else -bits)
    nan = spark.sql("SELECT double('NaN') AS x").select(O.sortable(F.col("x"))).first()[0]
    assert nan > max(r["k"] for r in rows)


@pytest.mark.parametrize("levels", [(22, 21, 21), (8,) * 8])
def test_statistics_of_groups(spark, monkeypatch, levels):
    monkeypatch.setattr(O, "LEVELS", levels)
    rng = random.Random(2)
    groups = {"a": numbers(500, 3), None: [rng.randrange(5) / 4 for _ in range(301)], "b": [7.0], "none": [None, None], "two": [1.0, 4.0, None]}
    rows = [(g, x, 1) for g, xs in groups.items() for x in xs]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double, _n int")
    shares = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r["g"]: r for r in O.percentiles(df, ["g"], F.col("x"), shares).collect()}
    middle = {r["g"]: r["m"] for r in O.medians(df, ["g"], F.col("x"), "m").collect()}
    for g, xs in groups.items():
        xs = sorted(x for x in xs if x is not None)
        assert middle[g] == (statistics.median(xs) if xs else None)
        for name, p in shares.items():
            assert got[g][name] == (xs[max(1, math.ceil(len(xs) * p)) - 1] if xs else None)
    whole = O.order_statistics(df, [], F.col("x"), {"low": lambda n: F.lit(1), "out": lambda n: n + 1}).collect()
    assert [(r["n"], r["low"], r["out"]) for r in whole] == [(sum(x is not None for xs in groups.values() for x in xs), -math.inf, None)]
    assert O.medians(df.where("false"), ["g"], F.col("x")).count() == 0


def parts(df):
    out = {}
    for r in df.groupBy("part").count().collect():
        out[r["part"]] = r["count"]
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 7, 500])
def test_splits_have_exact_sizes(spark, n):
    df = spark.range(n).withColumn("x", F.lit("v"))
    train = math.floor(n * 0.6)
    kept = min(train, 40)
    want = {"fit": math.floor(kept * 0.75), "tune": kept - math.floor(kept * 0.75), "spare": train - kept, "test": n - train}
    out = O.exact_split(df, "id", 0.6, 40, 0.75)
    assert parts(out) == {k: v for k, v in want.items() if v} and out.columns == ["id", "x", "part"]
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(out) == rows(O.exact_split(df.repartition(5), "id", 0.6, 40, 0.75))
    assert parts(O.exact_split(df, "id", 0.6)) == {k: v for k, v in {"train": train, "test": n - train}.items() if v}


def test_a_hot_key_is_cut_by_row_and_copies_stay_together(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 700, F.lit(1)).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    assert parts(O.exact_split(df, "k", 0.5)) == {"train": 500, "test": 500}
    same = spark.range(10).select(F.lit(None).cast("string").alias("k"))
    assert parts(O.exact_split(same, "k", 0.5)) == {"train": 10}


def test_no_window_sorts_raw_values(spark, capsys):
    df = spark.range(100).select(F.lit("g").alias("g"), F.rand(1).alias("x"))
    O.medians(df, ["g"], F.col("x")).explain("formatted")
    plan = capsys.readouterr().out
    assert "Window" in plan and all("_v" not in line.split("orderBy")[-1] for line in plan.splitlines() if "Arguments" in line and "specifiedwindowframe" in line.lower())
