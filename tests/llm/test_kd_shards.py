import zlib
from collections import Counter

from pyspark.sql import functions as F

from tallyframe.llm import kd_shards as K
from tallyframe.llm.common import Cut
from tests.llm.helpers import AWKWARD, docs


def check(rows, texts, shards):
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]] or ""
        assert r["size"] == len(t.encode()) + 16 and r["text_crc32"] == zlib.crc32(t.encode()) and 0 <= r["shard"] < shards
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_near_equal_bytes_with_a_hot_source_and_copies(spark):
    texts = ["x" * (i % 97) for i in range(1500)] + ["copy"] * 1500
    df = docs(spark, texts).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("doc_id") % 7)))
    rows = K.shard_documents(df.withColumn("node", F.lit("clash")), 7).collect()
    check(rows, texts, 7)
    sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(7)]
    assert max(sizes) <= 1.03 * sum(sizes) / 7 and min(sizes) >= 0.97 * sum(sizes) / 7


def test_awkward_rows(spark):
    df = docs(spark, AWKWARD).withColumn("source", F.when(F.col("doc_id") > 3, F.col("source"))).withColumn("lang", F.lit(None).cast("string"))
    check(K.shard_documents(df, 4).collect(), AWKWARD, 4)
    assert K.shard_documents(docs(spark, []), 4).count() == 0
    repeated = docs(spark, ["same"] * 9).withColumn("doc_id", F.lit(5).cast("long"))
    assert K.shard_documents(repeated, 3).count() == 9


def test_median_search_opens_intervals_and_groups_only_when_heavy():
    s = K.Search(0, 5.0, 100.0)
    s.step([(3, 4), (9, 4)])
    assert s.cut is None and s.lo == 9 << (K.BITS - K.FIRST_BITS)
    s.step([(1, 1), (2, 3)])
    assert s.left == 5 and s.cut is None
    s.step([(7, 3)])
    s.step([(0, 3)])
    assert s.cut is None and s.shift == 11 and s.bits == K.ROW_BITS  # three per cent of a shard: opened
    light = K.Search(0, 1.0, 1000.0)
    for _ in range(4):
        light.step([(0, 3)])
    assert light.cut == 0 and light.lo == 0  # cut at the nearer end of the group


def test_copies_stay_together_and_repeated_rows_are_cut(spark, monkeypatch):
    monkeypatch.setattr(K, "HEAVY", 300)  # both ways of joining are in use
    texts = [f"text {i} " + "x" * (i * 37 % 400) for i in range(900)] + [f"copy {i % 40 if i % 3 else 0}" for i in range(200)]
    df = docs(spark, texts).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 5)).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "de").otherwise("en"))
    rows = K.shard_documents(df, 5).collect()
    check(rows, texts, 5)
    where = {}
    for r in rows:
        where.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert sum(len(x) > 1 for x in where.values()) <= 4  # a cut at most goes through one group each
    mass = docs(spark, ["same"] * 4000).withColumn("doc_id", F.lit(5).cast("long"))
    sizes = Counter(r["shard"] for r in K.shard_documents(mass, 4).collect())
    assert len(sizes) == 4 and max(sizes.values()) <= 1.05 * min(sizes.values())


def test_tree_against_one_made_in_memory(spark):
    """Every leaf's rows are what cutting the same coordinates at weighted medians in memory gives, cut for cut."""
    texts = [f"{i} " + "word " * (i * 7919 % 50) for i in range(600)]
    df = docs(spark, texts).withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") * F.col("doc_id")) % 7))
    cut = Cut(spark)
    base = cut(K.coordinates(df))
    placed = K.kd_leaves(cut(K.scaled(K.together(base, cut), 0, 599)), 6, cut).collect()
    rows = [(r["size"], tuple(r[d] for d in K.DIMENSIONS), r["node"]) for r in placed]

    def leaves(part, low, shards):
        if shards == 1:
            assert {r[2] for r in part} == {low}
            return
        bins = {d: Counter() for d in range(len(K.DIMENSIONS))}
        for r in part:
            for d in bins:
                bins[d][r[1][d] >> (K.BITS - K.FIRST_BITS)] += r[0]
        dim, half = K.widest({d: sorted(b.items()) for d, b in bins.items()}), shards // 2
        below, above = [r for r in part if r[2] < low + half], [r for r in part if r[2] >= low + half]
        assert max(r[1][dim] for r in below) < min(r[1][dim] for r in above)
        goal, got = sum(r[0] for r in part) * half / shards, sum(r[0] for r in below)
        assert abs(got - goal) <= max(r[0] for r in part)
        leaves(below, low, half)
        leaves(above, low + half, shards - half)

    leaves(rows, 0, 6)
