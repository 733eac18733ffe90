"""Periodic run detection: a harmonic grid whose extensions are all searched at once on prefix hashes.

A run of period q is a longest stretch whose words q apart are equal, of length max(LEAST, TIMES * q) at
least, q being its smallest period. Its words that equal the word q further on are a stretch of at least
step(q) = max(LEAST - q, (TIMES - 1) * q), so one of them stands on a multiple of step(q). For all texts
of a slice, all periods and all multiples (n log n pairs in all) the pair (i, i + q) is kept if its words are
equal, and how far the equality goes on and back is found for all kept pairs at the same time by binary
search on prefix hashes. Hashes can only make a stretch too long: each distinct stretch is verified word by word,
and where that fails the period is redone on the words themselves. Stretches found under several
periods keep the smallest, which is the run's own.

It is a map over rows: no shuffle, memory bounded by the slice (about 4 MB of text, or one longer text) and
by GRID pairs.

Cases: null, empty and blank texts have no words, no runs and the digests of nothing; a null doc_id plants
nothing (there is no decimal to hash); repeated rows are computed each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import map_columns, table, text_of, word_codes

LEAST, TIMES = 6, 4
#: Pairs of the grid that are looked at together.
GRID = 1 << 20
BASE = np.uint64(0xD1342543DE82EF95)


class Hashed:
    """Prefix hashes of a sequence of words, modulo 2**64."""

    def __init__(self, codes: np.ndarray):
        x = codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        self.powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(x), BASE, np.uint64))])
        self.prefix = np.concatenate([[np.uint64(0)], np.cumsum((x ^ (x >> np.uint64(31))) * self.powers[:-1])])

    def equal(self, at: np.ndarray, q: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether `size` words from `at` hash like those q further on; equal words always do."""
        p = self.prefix
        return (p[at + size] - p[at]) * self.powers[q] == p[at + q + size] - p[at + q]

    def reach(self, at: np.ndarray, q: np.ndarray, least: int, most: np.ndarray, way: int) -> np.ndarray:
        """The largest size, `least` (known) to `most`, for which the words from `at` on (way 1) or before it (-1) are equal."""
        low, high = np.full(len(at), least, np.int64), most.astype(np.int64)
        rest = np.flatnonzero(low < high)
        while len(rest):
            mid = (low[rest] + high[rest] + 1) >> 1
            good = self.equal(at[rest] if way > 0 else at[rest] - mid, q[rest], mid)
            low[rest], high[rest] = np.where(good, mid, low[rest]), np.where(good, high[rest], mid - 1)
            rest = rest[low[rest] < high[rest]]
        return low


def step(q: np.ndarray) -> np.ndarray:
    return np.maximum(LEAST - q, (TIMES - 1) * q)


def grid(first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, place) of all pairs, in blocks; first: where each text's words begin, and their end."""
    sizes = np.diff(first)
    periods = np.where(sizes >= LEAST, sizes // TIMES, 0)
    text = np.repeat(np.arange(len(sizes)), periods)
    q = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    each = -(-(sizes[text] - q) // step(q))
    ends = np.cumsum(each)
    lo = 0
    while lo < len(q):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - each[lo] + GRID, side="right")))
        n = each[lo:hi]
        owner = np.repeat(np.arange(lo, hi), n)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        yield text[owner], q[owner], first[text[owner]] + k * step(q[owner])
        lo = hi


def exact(codes: np.ndarray, lo: int, hi: int, q: int) -> list[tuple[int, int, int]]:
    """(start, length, q) of the long stretches of period q between lo and hi, by comparing words."""
    same = np.concatenate([[False], codes[lo : hi - q] == codes[lo + q : hi], [False]])
    edges = np.flatnonzero(same[1:] != same[:-1])
    return [(lo + a, b - a + q, q) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= step(np.int64(q))]


def runs_of(codes: np.ndarray, first: np.ndarray, hashed: type[Hashed] = Hashed) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of the texts in `codes`, sorted; text t holds codes[first[t]:first[t + 1]]."""
    h, found = hashed(codes), [np.empty((0, 3), np.int64)]
    for text, q, at in grid(first):
        near = np.flatnonzero(codes[at] == codes[at + q])
        text, q, at = text[near], q[near], at[near]
        on = h.reach(at, q, 1, first[text + 1] - at - q, 1)
        back = h.reach(at, q, 0, at - first[text], -1)
        long = on + back >= step(q)
        found.append(np.unique(np.stack([at - back, on + back + q, q], axis=1)[long], axis=0))
    out: dict[tuple[int, int], int] = {}
    redo = set()
    for start, size, q in np.unique(np.concatenate(found), axis=0).tolist():
        if (start, size) in out:  # a smaller period has been verified
            continue
        if np.array_equal(codes[start : start + size - q], codes[start + q : start + size]):
            out[start, size] = q
        else:
            redo.add((int(np.searchsorted(first, start, side="right")) - 1, q))
    for t, q in redo:
        for start, size, q in exact(codes, int(first[t]), int(first[t + 1]), q):
            out[start, size] = min(q, out.get((start, size), q))
    return sorted((start, size, q) for (start, size), q in out.items())


def planted(codes: np.ndarray, first: np.ndarray, ids: list) -> np.ndarray:
    """The words with the contract's repeats: of every tenth document (by crc32 of its id) the end repeats a stretch."""
    out = codes.copy()
    for i, lo, hi in zip(ids, first[:-1].tolist(), first[1:].tolist(), strict=True):
        h = 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and hi > lo:
            g, n = h // 10, hi - lo
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            out[lo + a : hi] = codes[lo + a + np.arange(n - a) % p]
    return out


def collapsed(codes: np.ndarray, words: pa.Array, first: np.ndarray, runs: list[tuple[int, int, int]]) -> pa.Array:
    """Each text's words that no run holds after its first period, joined by a space."""
    edges = np.zeros(len(codes) + 1, np.int64)
    for start, size, q in runs:
        edges[start + q] += 1
        edges[start + size] -= 1
    kept = np.cumsum(edges)[:-1] == 0
    bounds = np.concatenate([[0], np.cumsum(kept)])[first]
    return pc.binary_join(pa.ListArray.from_arrays(bounds.astype(np.int32), words.take(pa.array(codes[kept]))), pa.scalar(" ", words.type))


def summary(runs: list[tuple[int, int, int]]) -> tuple:
    """n_runs, start, length, period, exponent_milli of the greatest, digest of all."""
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
    sha = hashlib.sha256(lines.encode()).hexdigest()
    if not runs:
        return 0, None, None, None, None, sha
    s, n, q = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
    return len(runs), s, n, q, 1000 * n // q, sha


COLUMNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """The runs of every whole text of docs (doc_id, text); plant: with the contract's repeats put in first."""

    def run(ids: pa.Array, texts: pa.Array) -> list:
        codes, words, first = word_codes(texts)
        if plant:
            codes = planted(codes, first, ids.to_pylist())
        runs = runs_of(codes, first)
        own: list[list] = [[] for _ in range(len(texts))]
        for t, (start, size, q) in zip(np.searchsorted(first, [r[0] for r in runs], side="right") - 1, runs, strict=True):
            own[t].append((start - int(first[t]), size, q))
        shas = [hashlib.sha256(s.encode()).hexdigest() for s in collapsed(codes, words, first, runs).to_pylist()]
        return [ids, *(list(c) for c in zip(*map(summary, own), strict=True)), shas]

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return map_columns(chosen, run, COLUMNS, rows=1000, raw=True)


def op12_harmonic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), plant=True)
