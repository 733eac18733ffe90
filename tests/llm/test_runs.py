import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tallyframe.llm import runs as R
from tests.llm.helpers import AWKWARD, docs


def smallest_period(w):
    """By the failure function."""
    fail = [0] * len(w)
    k = 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = fail[k - 1]
        k += w[i] == w[k]
        fail[i] = k
    return len(w) - fail[-1]


def plain_runs(w):
    """Every period, every stretch, from the definition."""
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and j > i and smallest_period(w[i : j + q]) == q:
                out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out)


def plain(doc_id, text, plant=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None and plant else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def cases():
    rng = random.Random(5)
    for n in range(14):
        yield [0] * n
    for _ in range(400):
        w = [rng.randrange(rng.choice([2, 3, 30])) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            unit = [rng.randrange(4) for _ in range(rng.randrange(1, 9))]
            at, size = rng.randrange(len(w) + 1), rng.randrange(4, 60)
            w[at:at] = (unit * 60)[:size]
        yield w
    tm = [0]
    while len(tm) < 4096:
        tm += [1 - x for x in tm]
    yield tm  # prefix hashes modulo a power of two take unequal parts of it for equal
    yield tm * 5


def test_runs_are_those_of_the_definition(monkeypatch):
    each = [w for w in cases() if len(w) <= 4096]
    first = np.cumsum([0, *map(len, each)])
    want = [(first[t] + s, size, q) for t, w in enumerate(each) for s, size, q in (plain_runs(w) if len(w) < 1000 else [])]
    codes = np.asarray([x for w in each for x in w], np.int64)
    assert R.runs_of(codes, first) == sorted(want)  # a sequence without cubes has no runs
    monkeypatch.setattr(R, "GRID", 37)
    assert R.runs_of(codes[: first[60]], first[:61]) == sorted(r for r in want if r[0] < first[60])


def test_false_equalities_are_redone_on_words():
    class Blind(R.Hashed):
        def equal(self, at, q, size):
            return super().equal(at, q, size) | (size % 3 == 2)

    each = [w for w in cases() if len(w) < 300]
    first = np.cumsum([0, *map(len, each)])
    codes = np.asarray([x for w in each for x in w], np.int64)
    assert R.runs_of(codes, first, Blind) == R.runs_of(codes, first)


def test_long_periodic_text_is_quick():
    w = np.tile(np.arange(5), 40_000)
    assert R.runs_of(w, np.array([0, len(w)])) == [(0, len(w), 5)]


@pytest.mark.parametrize("plant", [True, False])
def test_awkward_rows(spark, plant):
    texts = [*[(t or "")[:600] if t else t for t in AWKWARD], "a b a b a b a b", "x x x x x", "x x x x x x", "la la la la la la du du du du du du", "a\x1cb c " * 9]
    ids = [None, -7, *range(100, 160)]
    rows = [(i, t, 1, "s") for i in ids for t in texts]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int, runs_sha256 string")
    got = sorted((tuple(r) for r in R.periodic_runs(df, plant).collect()), key=repr)
    assert got == sorted((plain(i, t, plant) for i, t, _, _ in rows), key=repr)
    assert R.periodic_runs(docs(spark, [])).count() == 0
    long = R.periodic_runs(docs(spark, AWKWARD), False).where("n_runs > 0").drop("runs_sha256", "collapsed_sha256").collect()
    assert [tuple(r) for r in long] == [(4, 1, 0, 30_000, 1, 30_000_000)]


def test_query_against_plain_python(spark):
    sf = "/root/testdata/sf0.01"
    got = sorted(tuple(r) for r in R.op12_harmonic_runs(spark, sf).collect())
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: r["text"] for r in rows if len(r["text"] or "") < 20_000}
    assert len(got) == len(rows) and sum(1 for g in got if g[1]) > 50
    assert [g for g in got if g[0] in want] == sorted(plain(i, t) for i, t in want.items())
