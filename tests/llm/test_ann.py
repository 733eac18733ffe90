import numpy as np
import pytest

from tallyframe.llm import ann as A


def brute(x, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    d[q] = np.inf
    return np.lexsort((np.arange(len(x)), d))[:k], d


def test_rotation_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(A.hadamard(x), axis=1), np.linalg.norm(x, axis=1))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_and_exact_distances(spark, sf):
    vectors = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = vectors.orderBy("vec_id").select("vec_id", "embedding").collect()
    x, at = np.array([r["embedding"] for r in rows], dtype=np.float64), {r["vec_id"]: i for i, r in enumerate(rows)}
    ids = np.array([r["vec_id"] for r in rows])
    found = A.op3_cross_polytope(spark, f"/root/testdata/{sf}").toPandas()
    hits = 0
    for q, g in found.groupby("query_id"):
        best, d = brute(x, at[q])
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 11))
        assert np.allclose([d[at[v]] for v in g.vec_id], g.score, rtol=0, atol=1e-12)
        assert list(zip(g.score, g.vec_id)) == sorted(zip(g.score, g.vec_id))
        hits += len(set(ids[best]) & set(g.vec_id))
    assert hits / len(found) >= 0.9


def test_awkward_vectors(spark):
    good = [(i, [float(i % 5), 1.0, 2.0], "t") for i in range(0, 40)]
    bad = [(100, None, "t"), (200, [0.0, 0.0, 0.0], "t"), (300, [1.0, None, 2.0], "t"), (400, [1.0, float("nan"), 2.0], "t"), (500, [float("inf"), 1.0, 1.0], "t"), (600, [1.0], "t"), (None, [1.0, 1.0, 1.0], "t")]
    df = spark.createDataFrame([*good, *bad, good[3]], "vec_id long, embedding array<float>, t string")
    rows = A.nearest(df, df.where("vec_id % 10 = 0")).collect()
    assert {r["query_id"] for r in rows} == {0, 10, 20, 30} and not {r["vec_id"] for r in rows} & {100, 200, 300, 400, 500, 600}
    own = sorted(((r["rank"], r["vec_id"], r["score"]) for r in rows if r["query_id"] == 0))
    assert [v for _, v, _ in own[:7]] == [5, 10, 15, 20, 25, 30, 35] and all(s == 0 for *_, s in own[:7])
    few = A.nearest(df.where("vec_id < 4"), df.where("vec_id = 0")).collect()
    assert len(few) == 3
    assert A.nearest(df.limit(0), df.limit(0)).count() == 0


def spied(monkeypatch):
    """The settings of the searches that follow: (hashes, probes)."""
    made, plain = [], A.search
    monkeypatch.setattr(A, "search", lambda index, wanted, hashes, probes, *more: made.append((hashes, probes)) or plain(index, wanted, hashes, probes, *more))
    return made


def unit(n, width=64, seed=8):
    x = np.random.default_rng(seed).normal(size=(n, width))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")


def test_recall_holds_with_fine_buckets(spark, monkeypatch):
    """Vectors without any structure, and vectors about centres, both hashed."""
    made = spied(monkeypatch)
    centres = unit(40, seed=1)
    for x in (unit(16_000), unit(16_000) * 0.6 + centres[np.arange(16_000) % 40]):
        df = frame(spark, x)
        found = A.nearest(df, df.where("vec_id % 100 = 0"), target=8).toPandas()
        assert len(found) == 1600
        hits = sum(len(set(brute(x, q)[0]) & set(g.vec_id)) for q, g in found.groupby("query_id"))
        assert hits / len(found) >= 0.9
    assert len(made) == 2 and all(h.axes for h, _ in made)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_every_table_is_hashed(spark, monkeypatch, sf):
    made = spied(monkeypatch)
    A.op3_cross_polytope(spark, f"/root/testdata/{sf}")
    assert made and all(h.axes and probes >= 1 for h, probes in made)


def test_a_search_is_what_the_same_hashes_give_in_memory(spark, monkeypatch):
    """Given hashes and probes: the nearest among exactly the vectors of the probed buckets, whatever the chunks."""
    from tallyframe.llm.common import Cut

    x = unit(3000, 24)
    df, cut, hashes, probes = frame(spark, x), Cut(spark), A.Hashes(24, 256, 2), 6
    index = cut(A.distinct_vectors(A.clean(df), 11))
    wanted = A.clean(df.where("vec_id % 100 = 0")).select(A.F.col("vec_id").alias("query_id"), "vector")
    for chunk, block in ((4096, 1024), (7, 3)):
        monkeypatch.setattr(A, "CHUNK", chunk)
        monkeypatch.setattr(A, "BLOCK", block)
        got = {}
        for r in A.search(index, wanted, hashes, probes, 10, cut).orderBy("rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        own = [hashes.probes(x, t, 1)[:, 0] for t in range(2)]
        for q in range(0, 3000, 100):
            held = np.any([np.isin(own[t], hashes.probes(x[q : q + 1], t, probes)[0]) for t in range(2)], axis=0)
            order, _ = brute(x, q, 3000)
            assert got.get(q, []) == [i for i in order.tolist() if held[i] and i != q][:10]


def test_copies_make_no_buckets(spark, monkeypatch):
    made, plain = [], A.Hashes
    monkeypatch.setattr(A, "Hashes", lambda width, buckets, *more: made.append(buckets) or plain(width, buckets, *more))
    x = np.random.default_rng(2).normal(size=(1000, 8))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(np.tile(x, (20, 1)).tolist())], "vec_id long, embedding array<double>")
    A.nearest(df, df.where("vec_id % 100 = 0"), target=5).count()
    assert 1 < max(made) <= 1000 / 5 * 2**0.5


def test_repeated_rows_push_out_no_id(spark):
    rows = [(i, [1.0, 2.0]) for i in range(64) for _ in range(12 if i < 32 else 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = A.nearest(df, df.where("vec_id = 63")).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == list(range(10))
