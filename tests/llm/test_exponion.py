import hashlib
import math
from collections import defaultdict

import numpy as np

from tallyframe.llm import exponion as X


def plain(rows, parts=8, entries=16, rounds=6):
    """The contract word by word, over all entries and in Python integers; one width."""
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    w = len(kept[0][1]) // parts
    cut = lambda v: [v[p * w : p * w + w] for p in range(parts)]
    first = {}
    for i, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        first.setdefault(i, v)
    books = [list(b) for b in zip(*[cut(v) for v in list(first.values())[:entries]], strict=True)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        got = [defaultdict(list) for _ in range(parts)]
        for _, v, _ in kept:
            for p, x in enumerate(cut(v)):
                got[p][near(x, books[p])[1]].append(x)
        books = [[[sum(c) // len(c) for c in zip(*got[p][k], strict=True)] if got[p][k] else e for k, e in enumerate(books[p])] for p in range(parts)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = []
    for i, v, lab in kept:
        best = [near(x, books[p]) for p, x in enumerate(cut(v))]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), lab))
    total = defaultdict(int)
    for _, _, e, lab in out:
        total[lab] += e
    return sorted(((i, c, e, total[lab], sha) for i, c, e, lab in out), key=repr)


def got(df):
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect()), key=repr)


SCHEMA = "vec_id long, embedding array<double>, label int"


def test_query_against_plain_python(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got(X.op11_exponion_codes(spark, sf)) == plain(rows)


def test_ties_repeats_and_rows_that_go(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), (rng.integers(-3, 4, 16) / 2048).tolist(), [None, 1, 2][i % 3]) for i in rng.integers(0, 60, 160)]
    rows += [(None, [0.0] * 16, None), (-5, None, 1), (-6, [math.nan] * 16, 1), (-7, [None] * 16, 1), (-8, [math.inf] + [0.0] * 15, 1), rows[0], rows[0]]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS code", "1 AS v", "2 AS sums", "3 AS salt")
    assert got(X.compressed(df)) == plain(rows)
    assert got(X.compressed(df.repartition(7))) == plain(rows)
    few = rows[:5]
    assert got(X.compressed(spark.createDataFrame(few, SCHEMA))) == plain(few)


def test_widths_saturation_and_nothing(spark):
    rows = [(1, [], 1), (2, [0.5], 1), (3, [0.25, -0.25, 1e300], None), (4, [0.5], 2), (5, [-1e300, 1e300, 0.0], None)]
    out = {r["vec_id"]: r for r in X.compressed(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sorted(out) == [1, 2, 3, 4, 5] and out[1]["code"] == "00" * 8 and out[1]["error"] == 0
    assert out[2]["codebooks_sha256"] == out[4]["codebooks_sha256"] != out[3]["codebooks_sha256"]
    assert X.compressed(spark.createDataFrame([], SCHEMA)).count() == 0
    assert X.compressed(spark.createDataFrame([(None, [1.0] * 8, None)], SCHEMA)).count() == 1


def test_search_inside_the_radius_equals_search_over_all():
    rng = np.random.default_rng(9)
    for w in (1, 2, 8):
        entries, x = rng.integers(-9, 10, (16, w)), rng.integers(-12, 13, (500, w))
        entries[3] = entries[11]
        d = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        index, least = X.Entries(entries).nearest(x, rng.integers(0, 16, 500))
        assert (index == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()
