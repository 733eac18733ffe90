"""MinHash near-dedup: bottom-k sketches from one hash function, inverted lists, union sketches, exact Jaccard.

A document's set holds the hashes of its shingles; equal sets are one class. Its sketch is its K smallest hashes.
1. Lists. Of a linked pair, at least `overlap(n)` hashes are in both sketches: for sets whose union fits a
   sketch this is the threshold itself, for others the bound below which the count of a random sample falls
   with a chance under CHANCE (Hoeffding's, which holds for draws without replacement). So a class of whose
   values fewer occur elsewhere has no partner and leaves, and of the others, c in number, only the
   c - overlap + 1 that fewest classes retain go to inverted lists: two linked classes still meet in
   one, and values that a large share of the corpus retains make no long lists.
2. Estimates. Classes of one list that are not yet in one component (three rounds, as in the n-gram join:
   first holders, firsts of lists, the rest in blocks) are compared by size and by the union's sketch, the K
   smallest hashes of both sketches: too few of them in both, again by that bound, rule a pair out. Inside
   blocks, where pairs are not yet rows, marks of the sets come first, of two kinds by size. Parities differ in
   no more places than the sets in hashes, so they rule out what a sample of K must let pass, and never a link;
   they say nothing of sets of more than about 1,100 hashes. From LONG on each place keeps a bit of its smallest
   hash: places whose smallest hash is in both sets agree, and half of the others, by that bound once more.
   Lists of one first holder are one piece of work, from which a pair comes once, however many lists it shares.
3. What is left is compared on full sets, in integers; only documents of these pairs are read again.

A link is lost only if a hash behaves worse than one draw in 1e15; the tests compare with brute force.

Cases: as in the n-gram join, whose classes and rounds are used: null, empty and blank texts have no words, size
0 and no links; fewer words than k are one shingle; repeated rows are one class; a row without doc_id has
no component and kept null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import ngram_join
from tallyframe.llm.common import Cut, map_columns, table, text_of
from tallyframe.llm.ngram_join import K1, SET_BYTES, Bound, full_sets, jaccard_components, linked_groups, mixed, parity, shingle_sets, signed, verified

#: Hashes of a sketch.
K = 64
CHANCE = 1e-15
#: Places of each kind of mark; sets of at least LONG hashes are compared by the bits of smallest hashes.
PLACES = 512
LONG = 800
#: Pairs of rows that are compared at a time.
AT_ONCE = 1 << 18


@cache
def least_of_sample(size: int, part: int, whole: int) -> int:
    """The count below which a sample of `size` from a union falls, for a pair over the threshold, with chance CHANCE."""
    t = part / whole

    def unlikely(x: int) -> bool:
        a = x / size
        if a >= t:
            return False
        return size * ((a * math.log(a / t) if a else 0.0) + ((1 - a) * math.log((1 - a) / (1 - t)) if t < 1 else math.inf)) >= -math.log(CHANCE)

    return next((x for x in range(size) if not unlikely(x)), size)


def overlap(n: int, bound: Bound) -> int:
    """How many hashes the sketch of a set of n shares with that of any partner."""
    if n * bound.whole // bound.part <= K:
        return bound.need(n)  # both sketches hold their whole sets
    return min(bound.need(n), least_of_sample(K, bound.part, bound.whole))


def smallest_bits(x: np.ndarray) -> np.ndarray:
    """The lowest bit of the smallest hash of each of PLACES places, which are ranges of the sorted hashes x; 0 without one."""
    at = (x >> np.uint64(64 - PLACES.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    bits = np.zeros(PLACES, dtype=np.uint8)
    bits[at[first]] = x[first] & np.uint64(1)
    return np.packbits(bits).view(np.int64)


def marks_of(x: np.ndarray, bound: Bound) -> np.ndarray:
    """Parity and bits of smallest hashes, PLACES each; zeros for the kind that no partner of a possible size is compared by."""
    out = np.zeros((2, PLACES // 64), dtype=np.int64)
    if bound.part * len(x) < bound.whole * LONG:
        out[0] = np.bitwise_xor.reduce(parity(x).reshape(-1, PLACES // 64), axis=0)
    if len(x) >= LONG:
        out[1] = smallest_bits(x)
    return out.ravel()


def near(n_i: np.ndarray, n_j: np.ndarray, marks_i: np.ndarray, marks_j: np.ndarray, bound: Bound) -> np.ndarray:
    """Which pairs, of sizes that may link, their marks do not rule out."""
    half = PLACES // 64
    long = np.minimum(n_i, n_j) >= LONG
    differ = np.bitwise_count(np.where(long[:, None], marks_i[:, half:] ^ marks_j[:, half:], marks_i[:, :half] ^ marks_j[:, :half])).sum(axis=1).astype(np.int64)
    most = PLACES - least_of_sample(PLACES, bound.whole + bound.part, 2 * bound.whole)
    return np.where(long, differ <= most, (bound.whole + bound.part) * differ <= (bound.whole - bound.part) * (n_i + n_j))


def sketches(docs: DataFrame, k: int, bound: Bound) -> DataFrame:
    """doc_id, n, two sums that name the set, m = overlap(n), the sketch and the marks."""

    def run(ids: pa.Array, texts: pa.Array) -> list:
        rows = []
        for x in shingle_sets(texts, k):
            n = len(x)
            rows.append((n, int(signed(x.sum(keepdims=True))[0]), int(signed(mixed(x + K1).sum(keepdims=True))[0]), overlap(n, bound), signed(x[:K]), marks_of(x, bound)))
        return [ids, *(list(c) for c in zip(*rows, strict=True))]

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return map_columns(chosen, run, "doc_id long, n long, fp_a long, fp_b long, m int, prefix array<long>, bits array<long>", rows=1000, raw=True, size=SET_BYTES)


def estimated(pairs: DataFrame, marks: DataFrame, bound: Bound) -> DataFrame:
    """Pairs (a, b) that sizes and the sketch of the union, from marks (id, n, s), do not rule out."""
    size = lambda x: marks.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"))
    side = lambda x: marks.select(F.col("id").alias(x), F.col("s").alias(f"s_{x}"))
    sized = pairs.join(size("b"), "b").join(size("a"), "a").where((bound.whole * F.col("n_a") >= bound.part * F.col("n_b")) & (bound.whole * F.col("n_b") >= bound.part * F.col("n_a")))
    both = sized.join(side("b"), "b").join(side("a"), "a")
    seen = both.withColumns({"common": F.array_intersect("s_a", "s_b"), "union": F.sort_array(F.array_union("s_a", "s_b"))})
    last = F.element_at("union", F.least(F.size("union"), F.lit(K)))
    whole = (F.col("n_a") <= K) & (F.col("n_b") <= K)
    inside = F.size(F.filter("common", lambda x: x <= last))
    enough = F.when(whole, bound.whole * F.size("common") >= bound.part * F.size("union")).otherwise(inside >= least_of_sample(K, bound.part, bound.whole))
    return seen.where(enough).select("a", "b")


def near_in_lists(g: pa.RecordBatch, piece: np.ndarray, bound: Bound) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b), each once, of rows of one piece that share a list, are apart and near."""
    part, whole = bound.part, bound.whole
    ids, comp, n, own, lo, hi = (g[c].to_numpy() for c in ("id", "component", "n", "own", "lo", "hi"))
    n = n.astype(np.int64)
    marks = g["bits"].flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)  # bitwise_count takes absolute values of signed numbers
    at = np.repeat(np.arange(len(ids)), pc.list_value_length(g["sigs"]).to_numpy())
    sig = g["sigs"].flatten().to_numpy()
    order = np.lexsort((sig, piece[at]))
    at, sig = at[order], sig[order]
    starts = np.append(0, np.flatnonzero((np.diff(sig) != 0) | (np.diff(piece[at]) != 0)) + 1)
    sizes = np.diff(np.append(starts, len(at)))
    after = np.repeat(starts + sizes, sizes) - np.arange(len(at)) - 1  # entries of the list behind each entry
    ends = np.cumsum(after)
    out, x = [np.empty((0, 2), dtype=np.int64)], 0
    while x < len(at):
        y = max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + AT_ONCE, side="right")))
        i = np.repeat(np.arange(x, y), after[x:y])
        j = i + 1 + np.arange(len(i)) - np.repeat(ends[x:y] - after[x:y] - (ends[x] - after[x]), after[x:y])
        i, j = at[i], at[j]
        may = (comp[i] != comp[j]) & (whole * n[i] >= part * n[j]) & (whole * n[j] >= part * n[i]) & ((lo[i] == hi[i]) | (own[i] != own[j]))
        i, j = i[may], j[may]
        may = near(n[i], n[j], marks[i], marks[j], bound)
        i, j = ids[i[may]], ids[j[may]]
        out.append(np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)], axis=1), axis=0))
        x = y
    return tuple(np.unique(np.concatenate(out), axis=0).T)


def apart_in_lists(rows: DataFrame, marks: DataFrame, bound: Bound) -> DataFrame:
    """Pairs of rows (sig, id, first, component, c) that share a list but no component, as far as marks (id, n, bits) let them pass.

    c is the list's size. Lists of more than BLOCK rows are cut into blocks. A piece of work is two blocks of all lists with
    one first holder: near copies share most of their lists and these their first, so a class is one row of a piece and a pair
    is made once a piece, not once a list. Numbers of blocks are powers of two, so that lists of similar sizes share their pieces.
    """
    blocks = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(F.col("c") / F.lit(ngram_join.BLOCK))).cast("double"))).cast("int")
    held = rows.join(marks, "id").groupBy("id", "first", "component", "n", blocks.alias("blocks")).agg(F.collect_list("sig").alias("sigs"), F.first("bits").alias("bits"))
    own = F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int")
    placed = held.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    keyed = placed.select("first", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "sigs", "own", "id", "component", "n", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in chain(batches, [None]):
            ready = rest if batch is None else batch if rest is None else pa.concat_batches([rest, batch])
            if ready is None or not ready.num_rows:
                continue
            key = np.stack([ready[c].to_numpy().astype(np.int64) for c in ("first", "lo", "hi")], axis=1)
            piece = np.append(0, np.cumsum((key[1:] != key[:-1]).any(axis=1)))
            end, rest = ready.num_rows, None
            if batch is not None:  # the last piece may go on in the next batch
                end = int(np.searchsorted(piece, piece[-1]))
                rest = ready.slice(end)
            if end:
                a, b = near_in_lists(ready.slice(0, end), piece[:end], bound)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    ordered = keyed.repartition("first", "lo", "hi").sortWithinPartitions("first", "lo", "hi")
    return ordered.mapInArrow(run, "a long, b long")


def list_components(docs: DataFrame, classes: DataFrame, k: int, bound: Bound, cut: Cut) -> DataFrame:
    """(id, component) of the class representatives that have links."""
    tokens = classes.select("id", "n", "m", F.explode("prefix").alias("t"))
    often = tokens.groupBy("t").agg(F.count("*").alias("c")).where("c > 1")
    held = tokens.join(often, "t").groupBy("id", "n", "m").agg(F.collect_list(F.struct("c", "t")).alias("l")).where(F.size("l") >= F.col("m"))
    sigs = cut(held.select(F.explode(F.slice(F.sort_array("l"), F.lit(1), F.size("l") - F.col("m") + 1)["t"]).alias("sig"), "id", "n"))
    # the upper halves of the hashes, in their order: hashes are sorted without a sign
    upper = F.transform("prefix", lambda x: (F.shiftrightunsigned(x, 32) - F.lit(1 << 31)).cast("int"))
    marks = cut(classes.join(sigs.select("id").distinct(), "id", "left_semi").select("id", F.col("n").cast("int").alias("n"), "bits", upper.alias("s")))

    def link(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs)
        few = cut(full_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), k).select("id", "h"))
        return verified(pairs, few, bound, cut)

    out = linked_groups(sigs, bound, lambda pairs: estimated(pairs, marks, bound), lambda rows: apart_in_lists(rows, marks.select("id", "n", "bits"), bound).distinct(), link, cut)
    cut.drop(marks)
    return out


def near_duplicates(docs: DataFrame, k: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text): one of each component is kept."""
    found = jaccard_components(docs, k, part, whole, sketches, list_components)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op13_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2, part=80, whole=100)
