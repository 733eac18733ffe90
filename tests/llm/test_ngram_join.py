import random
from collections import defaultdict
from itertools import combinations

import pytest

from tallyframe.llm import ngram_join as J
from tests.llm.helpers import AWKWARD, docs


def brute(texts, k, part, whole):
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(zip(*[w[j:] for j in range(k)], strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    low = {i: i for i in sets}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    common = defaultdict(int)
    for ids in where.values():
        for p in combinations(ids, 2):
            common[p] += 1
    for (a, b), n in common.items():
        if whole * n >= part * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            low[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed):
    """Near copies of one text in a large group, boilerplate that many share, exact copies, short and long texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefg", k=rng.randint(2, 6)))
    base, passage, line = [word() for _ in range(120)], [word() for _ in range(60)], [word() for _ in range(12)]
    out = list(AWKWARD)
    for _ in range(150):
        x = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
            x[rng.randrange(len(x))] = word()
        out.append(" ".join(x))
    for _ in range(120):
        out.append(" ".join([*passage[rng.randrange(6) :], *[word() for _ in range(rng.choice([0, 1, 2, 3, 4, 40]))]]))
    for _ in range(60):
        out.append(" ".join(line * rng.randint(1, 5)) + rng.choice(["", " x", " Y z"]))
    out += [" ".join(word() for _ in range(rng.randint(1, 300))) for _ in range(60)]
    return out + out[-20:]


@pytest.mark.parametrize(("k", "part"), [(3, 90), (5, 80)])
def test_against_brute_force(spark, monkeypatch, k, part):
    monkeypatch.setattr(J, "RARE", 8)  # the frequent class is then in use at this size
    monkeypatch.setattr(J, "BLOCK", 16)
    texts = corpus(k)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_components(docs(spark, texts).withColumnRenamed("lang", "n"), k, part, 100).collect()}
    assert got == brute(texts, k, part, 100)


def test_prefixes_never_miss_a_link():
    import numpy as np

    rng = np.random.default_rng(3)
    bound, tokens = J.Bound(80, 100), np.sort(rng.integers(0, 1 << 40, 400))
    counts = rng.integers(40, 4000, 400)
    low = np.sort((tokens & J.LOW) - (1 << 31))
    for n in (2, 5, 10, 11, 19, 20, 47, 100, 300):
        for _ in range(20):
            x = np.sort(rng.choice(np.concatenate([tokens, rng.integers(0, 1 << 40, 200)]), n, replace=False))
            y = x.copy()
            while True:
                z = y.copy()
                z[rng.integers(len(z))] = rng.integers(0, 1 << 40)
                z = np.unique(z)
                i = len(np.intersect1d(x, z))
                if 100 * i < 80 * (len(x) + len(z) - i):
                    break
                y = z
            if len(np.setdiff1d(x, y)):
                assert len(np.intersect1d(J.signatures_of(x, low, counts, bound), J.signatures_of(y, low, counts, bound)))


def test_nothing_to_join(spark):
    assert J.jaccard_components(docs(spark, [])).count() == 0
    rows = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert sorted(((r["doc_id"] or 0), r["component_id"]) for r in J.jaccard_components(rows).collect()) == [(0, None), (1, 1), (1, 1)]
    assert J.drop_near_copies(docs(spark, ["a b c d e f", "a b c d e f", None, ""])).count() == 3


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    from pyspark.sql import functions as F

    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "a"), (2, text, "b"), (2, text, "c"), (None, text, "d"), (7, "other words are here and there now", "e"), (7, "other words are here and there now", "e"), (None, "quite different words that stand for themselves", "f"), (None, None, "g"), (None, None, "h"), (9, "", "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    left = sorted(r["_row"] for r in J.drop_near_copies(df).collect())
    assert left == ["a", "e", "f", "g", "h", "i"]
    assert J.drop_near_copies(df.where(F.lit(False))).count() == 0


def test_query_on_whole_documents_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    ids = [r["doc_id"] for r in rows]
    want = {ids[i]: (n, ids[c]) for i, (n, c) in brute([r["text"] for r in rows], 3, 90, 100).items()}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.op7_ngram_jaccard(spark, sf).collect()} == want
