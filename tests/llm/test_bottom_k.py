import random

import numpy as np
import pytest

from tallyframe.llm import bottom_k as B
from tallyframe.llm import ngram_join as J
from tests.llm.helpers import docs
from tests.llm.test_ngram_join import brute, corpus


def families(seed):
    """Texts longer than both sketches, in groups about the threshold, and short ones whose sketch is the whole set."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    out = []
    for size in (30, 45, 60, 80, 100, 200, 300, 700):
        base = [word() for _ in range(size)]
        for _ in range(25):
            x = list(base)
            for _ in range(int(size * rng.uniform(0, 0.09))):
                x[rng.randrange(size)] = word()
            out.append(" ".join(x))
    return out


@pytest.mark.parametrize(("k", "seed"), [(2, 1), (2, 2), (5, 3)])
def test_against_brute_force(spark, monkeypatch, k, seed):
    monkeypatch.setattr(J, "BLOCK", 16)
    texts = corpus(seed) + families(seed)
    got = B.near_duplicates(docs(spark, texts).selectExpr("*", "1 AS kept", "2 AS n", "3 AS sig"), k).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(texts, k, 80, 100)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got) and len(got) == len(texts)


def test_overlap_is_never_more_than_linked_sets_share():
    rng = np.random.default_rng(8)
    bound = J.Bound(80, 100)
    for n in (1, 4, 5, 50, 51, 60, 64, 65, 80, 200, 2000):
        for _ in range(60):
            x = np.unique(rng.integers(0, 1 << 62, n))
            y = x[rng.permutation(len(x))[: max(1, bound.need(len(x)))]]
            y = np.unique(np.append(y, rng.integers(0, 1 << 62, max(0, int(len(y) / 0.8) - len(x)))))
            both, union = len(np.intersect1d(x, y)), len(np.union1d(x, y))
            if 100 * both >= 80 * union:
                shared = len(np.intersect1d(x[: B.K], y[: B.K]))
                assert shared >= B.overlap(len(x), bound) and shared >= B.overlap(len(y), bound)


def test_bound_of_a_sample():
    from math import comb

    for size in (8, 64, 256):
        least = B.least_of_sample(size, 80, 100)
        assert sum(comb(size, i) * 0.8**i * 0.2 ** (size - i) for i in range(least)) <= B.CHANCE
    assert B.least_of_sample(64, 80, 100) > 15 and B.least_of_sample(256, 80, 100) > 140 and B.least_of_sample(64, 100, 100) == 64


def test_long_texts_that_share_single_values_are_no_pairs(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(150)]
    base = rng.choices(words, k=3000)
    texts = [" ".join(rng.choices(words, k=3000)) for _ in range(40)] + [" ".join(base), " ".join([*base[:2950], *rng.choices(words, k=50)])]
    made, estimated = [], B.estimated
    monkeypatch.setattr(B, "estimated", lambda pairs, *more: made.append(pairs.count()) or estimated(pairs, *more))
    got = B.near_duplicates(docs(spark, texts), 2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(texts, 2, 80, 100)
    assert made[2] == 0  # of all pairs inside blocks


def test_marks_never_part_linked_sets_and_part_others_of_any_size():
    rng = np.random.default_rng(5)
    bound = J.Bound(80, 100)
    one = lambda x, y: B.near(np.array([len(x)]), np.array([len(y)]), B.marks_of(x, bound).view(np.uint64)[None], B.marks_of(y, bound).view(np.uint64)[None], bound)[0]
    for n in (1, 5, 64, 640, 799, 800, 801, 900, 1000, 1001, 3000, 20000):
        for side in (0.5, 1.0):  # what is in one set only is dealt evenly, or all in one
            for _ in range(20):
                both = rng.integers(0, 1 << 64, n, dtype=np.uint64)
                only = rng.integers(0, 1 << 64, n // 4, dtype=np.uint64)
                mine = rng.random(len(only)) < side
                x, y = np.unique(np.append(both, only[mine])), np.unique(np.append(both, only[~mine]))
                assert one(x, y) and one(y, x)
        if n >= 64:
            assert not one(x, np.unique(rng.integers(0, 1 << 64, len(x), dtype=np.uint64)))


@pytest.mark.parametrize("block", [5, 1024])
def test_a_pair_that_shares_many_lists_is_made_once(spark, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK", block)
    rng = np.random.default_rng(6)
    bound = J.Bound(80, 100)
    base = np.unique(rng.integers(0, 1 << 64, 300, dtype=np.uint64))
    sets = {i: np.delete(base, i) for i in range(12)}
    marks = spark.createDataFrame([(i, len(x), B.marks_of(x, bound).tolist()) for i, x in sets.items()], "id long, n int, bits array<long>")
    rows = spark.createDataFrame([(sig, i, 0, i // 2, 12) for sig in range(30) for i in sets], "sig long, id long, first long, component long, c long")
    got = sorted((r["a"], r["b"]) for r in B.apart_in_lists(rows, marks, bound).collect())
    assert got == [(a, b) for a in range(12) for b in range(a + 1, 12) if a // 2 != b // 2]


def test_nothing_and_rows_without_id(spark):
    assert B.near_duplicates(docs(spark, [])).count() == 0
    rows = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "A b\tC"), (3, None), (4, "")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0), r["n_shingles"], r["component_id"], r["kept"]) for r in B.near_duplicates(rows, 2).collect())
    assert got == [(0, 2, None, None), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True)]


def test_query_on_whole_documents_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    ids = [r["doc_id"] for r in rows]
    want = {ids[i]: (n, ids[c], i == c) for i, (n, c) in brute([r["text"] for r in rows], 2, 80, 100).items()}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in B.op13_bottom_k(spark, sf).collect()} == want
