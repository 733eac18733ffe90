"""N-gram Jaccard join: token-combination prefixes over word shingles, exact components of all links.

Tokens are 64-bit hashes of shingles (k consecutive words, A-Z lower-cased); equal sets are one class.
1. Filter. A partner shares at least need(n) tokens, so of the missing(n) + m tokens with the smallest
   hashes at least m are shared. Classes of which fewer than m such tokens occur in any other class
   can't have a partner and leave; counts are exact, by one shuffle of these short prefixes.
2. Index. Tokens that more than F of the remaining classes hold are the frequent class (F is raised by
   powers of two until the list has at most FREQUENT tokens; the list alone is broadcast). Rare tokens
   come first in the global order, frequent ones by rising count. Prefixes are extended to
   missing + c + 1 tokens: partners share c + 1 of them, so either a rare token, indexed alone, or,
   of the frequent ones dealt into c classes by hash, two of one class, indexed as a combination. c
   grows with the set, so a set makes signatures in proportion to its prefix; near a step of c a set
   is indexed under both values.
3. Verify exactly, in three rounds, never within a component: each class with the smallest id that
   shares a signature; then with the first of each signature it shares; then all pairs that are still
   in different components, compared in blocks by size and parity sketch before one is written. No pair
   inside a linked group is made, so a group of near copies costs rows in proportion to its size.

Cases: null, empty and blank texts have no words, size 0, no links; with fewer words than k the whole
sequence is the one shingle; repeated rows are one class; rows that share a doc_id share their
component; a row without doc_id has no component (null); an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import Cut, clear_of, listed, map_columns, ready, table, text_of, word_codes
from tallyframe.llm.components import components

#: Longest list of frequent tokens (12 bytes each with their counts, sent to every executor).
FREQUENT = 1 << 18
RARE = 32
LOW = (1 << 32) - 1
#: Words of 64 bits of the filter by which texts of remaining classes are found again (fixed size, 8 MB).
BLOOM_WORDS = 1 << 20
#: Places of the parity sketch. Sketches of two sets differ in no more places than the sets in tokens.
PARITY = 2048
#: Bytes of text that sets are made of at a time: hashes of all words and shingles of a slice stand in memory together.
SET_BYTES = 1 << 20
#: Rows of a signature's group that one piece of work compares with as many others.
BLOCK = 1024

K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * K2
    x = (x ^ (x >> np.uint64(27))) * K3
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each whole text."""
    codes, words, first = word_codes(texts)
    each = np.fromiter((xxhash.xxh64_intdigest(w.encode().lower()) for w in listed(words)), np.uint64, len(words))
    h = each[codes]
    n = max(0, len(h) - k + 1)
    grams = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        grams = mixed(grams * K1 + h[j : j + n])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        else:
            x = np.full(min(1, b - a), b - a, dtype=np.uint64)
            for j in range(a, b):
                x = mixed(x * K1 + h[j : j + 1])
            out.append(x)
    return out


class Bound:
    """Integer arithmetic of the threshold part / whole."""

    def __init__(self, part: int, whole: int):
        self.part, self.whole = part, whole

    def need(self, n: int) -> int:
        return -(-self.part * n // self.whole)

    def missing(self, n: int) -> int:
        return n - self.need(n)

    def filter_share(self, n: int) -> int:
        return 1 + self.missing(n) // 2

    def deals(self, n: int) -> set[int]:
        """Numbers of hash classes under which a set of n tokens is indexed: its own and its smallest partner's."""
        return {1 << max(0, (self.missing(m) // 2).bit_length() - 1) for m in (n, self.need(n)) if m}


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def parity(x: np.ndarray) -> np.ndarray:
    odd = np.bincount((mixed(x) & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def fingerprints(docs: DataFrame, k: int, bound: Bound) -> DataFrame:
    """doc_id, n, two sums that name the set, the m of the filter and its prefix of 32-bit tokens."""

    def run(ids: pa.Array, texts: pa.Array) -> list:
        rows = []
        for x in shingle_sets(texts, k):
            n = len(x)
            m = bound.filter_share(n)
            prefix = x[: bound.missing(n) + m]
            rows.append((n, int(signed(x.sum(keepdims=True))[0]), int(signed(mixed(x + K1).sum(keepdims=True))[0]), m, prefix.astype(np.uint32).view(np.int32)))
        return [ids, *(list(c) for c in zip(*rows, strict=True))]

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return map_columns(chosen, run, "doc_id long, n long, fp_a long, fp_b long, m int, prefix array<int>", rows=1000, raw=True, size=SET_BYTES)


def bloom_of(ids: DataFrame) -> np.ndarray:
    """A filter of fixed size over ids: what reaches the driver is at most BLOOM_WORDS rows."""
    word = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(BLOOM_WORDS))
    bit = F.expr("shiftleft(CAST(1 AS BIGINT), CAST(pmod(xxhash64(id, 12), 64) AS INT))")
    got = ids.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(BLOOM_WORDS, dtype=np.int64)
    out[got["w"].to_numpy()] = got["b"].to_numpy()
    return out


def full_sets(docs: DataFrame, remaining: DataFrame, k: int) -> DataFrame:
    """id, h, bits of the remaining classes' representatives, from their whole texts.

    h: the sorted tokens. bits: the parity of the tokens that fall on each of PARITY places. The filter
    lets a few other documents pass; they cost work and change nothing, as every row is a document of its
    own in what follows, so the sets need not be shuffled to take them out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bloom_of(remaining))

    def run(ids: pa.Array, w: pa.Array, b: pa.Array, texts: pa.Array) -> list:
        hit = shared.value[w.to_numpy()] >> b.to_numpy() & 1 == 1
        at = pa.array(np.flatnonzero(hit))
        sets = shingle_sets(texts.take(at), k)
        return [ids.take(at), [signed(x) for x in sets], [parity(x) for x in sets]]

    plain = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), text_of(docs).alias("text"))
    word, bit = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(BLOOM_WORDS)), F.pmod(F.xxhash64("id", F.lit(12)), F.lit(64))
    return map_columns(plain.select("id", word.alias("w"), bit.alias("b"), "text"), run, "id long, h array<long>, bits array<long>", rows=1000, raw=True, size=SET_BYTES)


def frequent_tokens(sets: DataFrame, cut: Cut) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, counts) of the frequent class, sorted by token.

    Tokens are counted by their lower 32 bits: the class may be any function of the token, and tokens
    that meet there only make both look more frequent.
    """
    low = sets.select(F.explode("h").alias("h")).select((F.col("h").bitwiseAND(F.lit(LOW)) - F.lit(1 << 31)).cast("int").alias("t"))
    counts = cut(low.groupBy("t").agg(F.count("*").alias("n")).where(F.col("n") > RARE))
    steps = counts.select(F.floor(F.log2(F.col("n"))).cast("int").alias("e")).groupBy("e").agg(F.count("*").alias("c")).collect()
    least, total = RARE + 1, 0
    for r in sorted(steps, key=lambda r: -r["e"]):
        total += r["c"]
        if total > FREQUENT:
            least = max(least, 1 << (r["e"] + 1))
            break
    got = counts.where(F.col("n") >= least).toArrow()
    cut.drop(counts)
    t, n = got["t"].to_numpy(), got["n"].to_numpy()
    order = np.argsort(t)
    return t[order], n[order]


def signatures_of(h: np.ndarray, tokens: np.ndarray, counts: np.ndarray, bound: Bound) -> np.ndarray:
    """The signatures of one sorted set."""
    n = len(h)
    if len(tokens):
        t = (h & LOW) - (1 << 31)
        at = np.minimum(np.searchsorted(tokens, t), len(tokens) - 1)
        df = np.where(tokens[at] == t, counts[at], 0)
        order = np.lexsort((h, df))
        h, df = h[order], df[order]
    else:
        df = np.zeros(n, dtype=np.int64)
    out = [np.empty(0, dtype=np.uint64)]
    for c in bound.deals(n):
        size = min(n, bound.missing(n) + c + 1)
        rare = int(np.searchsorted(df[:size], 1))
        out.append(h[:rare].view(np.uint64))
        often = h[rare:size].view(np.uint64)
        deal = mixed(often) & np.uint64(c - 1)
        for d in np.unique(deal):
            x = np.sort(often[deal == d])
            i, j = np.triu_indices(len(x), 1)
            out.append(mixed(mixed(x[i] * K1 + x[j]) + np.uint64(c)))
    return np.unique(np.concatenate(out))


def signature_rows(sets: DataFrame, tokens: np.ndarray, counts: np.ndarray, bound: Bound) -> DataFrame:
    """sig, id, n"""
    shared = sets.sparkSession.sparkContext.broadcast((tokens, counts))  # at most FREQUENT entries

    def run(ids: list, hs: list) -> list:
        found = [signatures_of(np.asarray(h, dtype=np.int64), *shared.value, bound) for h in hs]
        return [np.concatenate([signed(x) for x in found]), np.repeat(np.asarray(ids, dtype=np.int64), [len(x) for x in found]), np.repeat([len(h) for h in hs], [len(x) for x in found])]

    return map_columns(sets.select("id", "h"), run, "sig long, id long, n long", rows=200)


def plausible(pairs: DataFrame, sets: DataFrame, bound: Bound) -> DataFrame:
    """Pairs (a, b) that sizes and parity sketches do not rule out; no pair over the threshold is ruled out."""
    marks = sets.select("id", F.size("h").alias("n"), "bits")
    side = lambda s: marks.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    apart = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    total = F.col("n_a") + F.col("n_b")
    sized = (bound.whole * F.col("n_a") >= bound.part * F.col("n_b")) & (bound.whole * F.col("n_b") >= bound.part * F.col("n_a"))
    return both.where(sized & ((bound.whole + bound.part) * apart <= (bound.whole - bound.part) * total)).select("a", "b")


def held(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (id, h) that a filter of fixed size over ids lets pass: all of ids, and few others while it isn't full."""
    shared = rows.sparkSession.sparkContext.broadcast(bloom_of(ids))

    def run(ids: pa.Array, w: pa.Array, b: pa.Array, h: pa.Array) -> list:
        at = pa.array(np.flatnonzero(shared.value[w.to_numpy()] >> b.to_numpy() & 1 == 1))
        return [ids.take(at), h.take(at)]

    word, bit = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(BLOOM_WORDS)), F.pmod(F.xxhash64("id", F.lit(12)), F.lit(64))
    return map_columns(rows.select("id", word.alias("w"), bit.alias("b"), "h"), run, "id long, h array<long>", rows=2000, raw=True)


def linked(pairs: DataFrame, sets: DataFrame, bound: Bound, cut: Cut) -> DataFrame:
    """Those of the plausible pairs (a, b) that reach the threshold on their whole sets."""
    pairs = cut(pairs)
    few = cut(held(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), sets))
    return verified(pairs, few, bound, cut)


def verified(pairs: DataFrame, few: DataFrame, bound: Bound, cut: Cut) -> DataFrame:
    """Those of the pairs (a, b) whose sets (id, h) reach the threshold; both written tables are dropped."""
    left = pairs.join(few.select(F.col("id").alias("b"), F.col("h").alias("h_b")), "b")
    both = left.join(few.select(F.col("id").alias("a"), F.col("h").alias("h_a")), "a")
    common = F.size(F.array_intersect("h_a", "h_b"))
    measured = both.select("a", "b", common.alias("i"), (F.size("h_a") + F.size("h_b")).alias("s"))
    out = cut(measured.where(bound.whole * F.col("i") >= bound.part * (F.col("s") - F.col("i"))).select("a", "b"))
    cut.drop(pairs, few)
    return out


def parity_marks(sets: DataFrame) -> DataFrame:
    """id, n and half of the places of the parity sketch: parities of coarser places are sums of the finer ones.

    Half of them tells sets of up to about 5,000 tokens apart; a quarter let all pairs of 2,500 and more pass.
    """
    half = PARITY // 128
    folded = [F.col("bits")[i].bitwiseXOR(F.col("bits")[i + half]) for i in range(half)]
    return sets.select("id", F.size("h").alias("n"), F.array(*folded).alias("bits"))


def parity_near(bound: Bound) -> Callable[[int, np.ndarray, np.ndarray, pa.ListArray], np.ndarray]:
    """Which rows j of a group parity sketches do not rule out as partners of row i."""

    def near(i: int, j: np.ndarray, n: np.ndarray, marks: pa.ListArray) -> np.ndarray:
        bits = marks.flatten().to_numpy().view(np.uint64).reshape(len(n), -1)  # bitwise_count takes absolute values of signed numbers
        differ = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1)
        return (bound.whole + bound.part) * differ.astype(np.int64) <= (bound.whole - bound.part) * (n[i] + n[j])

    return near


def apart_in_groups(rows: DataFrame, marks: DataFrame, bound: Bound, near: Callable[[int, np.ndarray, np.ndarray, pa.ListArray], np.ndarray]) -> DataFrame:
    """Plausible pairs of rows (sig, id, component, c) that share a signature but no component.

    c is the group's size. Groups of more than BLOCK rows are cut into blocks, and each two blocks are one
    piece of work; pairs are compared by size and by marks (id, n, bits) where they stand, and only those that
    `near` lets pass are written.
    """
    part, whole = bound.part, bound.whole
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(5)), blocks).cast("int")
    placed = rows.join(marks, "id").select("sig", "id", "component", "n", "bits", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    keyed = placed.select("sig", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "component", "n", "bits")

    def compare(g: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        ids, comp, n, own = (g[c].to_numpy() for c in ("id", "component", "n", "own"))
        cross = g["lo"][0] != g["hi"][0]
        out_a, out_b = [], []
        for i in range(len(ids) - 1):
            j = np.arange(i + 1, len(ids))
            j = j[(comp[j] != comp[i]) & (whole * n[i] >= part * n[j]) & (whole * n[j] >= part * n[i]) & ((own[j] != own[i]) if cross else True)]
            if len(j):
                j = j[near(i, j, n, g["bits"])]
                out_a.append(np.minimum(ids[i], ids[j]))
                out_b.append(np.maximum(ids[i], ids[j]))
        return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (ids[:0], ids[:0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in chain(batches, [None]):
            whole_rows = rest if batch is None else batch if rest is None else pa.concat_batches([rest, batch])
            if whole_rows is None or not whole_rows.num_rows:
                continue
            key = np.stack([whole_rows[c].to_numpy().astype(np.int64) for c in ("sig", "lo", "hi")], axis=1)
            starts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1])
            ends = np.append(starts[1:], len(key))
            rest = None
            if batch is not None:  # the last group may go on in the next batch
                rest = whole_rows.slice(starts[-1])
                starts, ends = starts[:-1], ends[:-1]
            found = [compare(whole_rows.slice(x, y - x)) for x, y in zip(starts.tolist(), ends.tolist(), strict=True) if y - x > 1]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1)], ["a", "b"])

    ordered = keyed.repartition("sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi", "id")
    return ordered.mapInArrow(run, "a long, b long").distinct()


Pairs = Callable[[DataFrame], DataFrame]


def linked_groups(sigs: DataFrame, bound: Bound, likely: Pairs, apart: Pairs, link: Pairs, cut: Cut) -> DataFrame:
    """(id, component) of ids that links reach, from a written table (sig, id, n), which is dropped.

    Pairs (a, b) that share a signature are looked at in three rounds. `likely` thins them, `link` writes those that
    are links; `apart` makes pairs of rows (sig, id, first, component, c) that share a signature and no component.
    """
    firsts = sigs.groupBy("sig").agg(F.min("id").alias("first"), F.min_by("n", "id").alias("m"), F.count("*").alias("c")).where("c > 1").select("sig", "first", "m")
    near = (F.col("first") < F.col("id")) & (bound.whole * F.col("n") >= bound.part * F.col("m")) & (bound.whole * F.col("m") >= bound.part * F.col("n"))
    shared = cut(sigs.join(firsts, "sig").select("sig", "id", "first", near.alias("near")))
    cut.drop(sigs)

    # round one: the smallest id that shares a signature and is of a size to be a partner
    one = cut(shared.where("near").groupBy(F.col("id").alias("b")).agg(F.min("first").alias("a")).select("a", "b"))
    parts = [link(likely(one))]
    before = found = components(parts[0], cut)
    # round two: the first of each signature, if in another component
    name = lambda side: found.select(F.col("id").alias(side), F.col("component").alias(f"c_{side}"))
    stars = shared.where("near").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    stars = stars.join(name("a"), "a", "left").join(name("b"), "b", "left").where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")
    two = likely(stars.join(one, ["a", "b"], "left_anti"))
    parts.append(link(two))
    found = components(reduce(DataFrame.unionByName, parts), cut)
    # round three: all pairs that are still apart
    at = shared.join(name("id"), "id", "left").select("sig", "id", "first", F.coalesce("c_id", "id").alias("component"))
    split = at.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("c")).where("lo <> hi").select("sig", "c")
    three = likely(apart(at.join(split, "sig")))
    parts.append(link(three))
    out = components(reduce(DataFrame.unionByName, parts), cut)
    cut.drop(shared, one, before, found, *parts)
    return out


def class_components(docs: DataFrame, classes: DataFrame, k: int, bound: Bound, cut: Cut) -> DataFrame:
    """(id, component) of the class representatives that have links."""
    tokens = classes.select("id", "m", F.explode("prefix").alias("t"))
    often = tokens.groupBy("t").agg(F.count("*").alias("c")).where("c > 1").select("t")
    remaining = cut(tokens.join(often, "t", "left_semi").groupBy("id", "m").agg(F.count("*").alias("c")).where(F.col("c") >= F.col("m")).select("id"))
    sets = cut(full_sets(docs, remaining, k))
    rows = signature_rows(sets, *frequent_tokens(sets, cut), bound)
    sigs = cut(rows)
    cut.drop(remaining)
    in_groups = lambda rows: apart_in_groups(rows, parity_marks(sets), bound, parity_near(bound))
    out = linked_groups(sigs, bound, lambda pairs: plausible(pairs, sets, bound), in_groups, lambda pairs: linked(pairs, sets, bound, cut), cut)
    cut.drop(sets)
    return out


def jaccard_components(docs: DataFrame, k: int = 5, part: int = 80, whole: int = 100, prints_of: Callable[..., DataFrame] = fingerprints, find: Callable[..., DataFrame] = class_components) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text).

    prints_of names each set and gives what the filter of `find` reads; find links the classes of equal sets.
    """
    spark = ready(docs.sparkSession)
    cut, bound = Cut(spark), Bound(part, whole)
    wide = cut(prints_of(docs, k, bound))
    prints = cut(wide.select("doc_id", "fp_a", "fp_b", "n"))
    key = ["fp_a", "fp_b", "n"]
    more = [c for c in wide.columns if c not in ("doc_id", *key)]
    classes = wide.where("n > 0 AND doc_id IS NOT NULL").groupBy(*key).agg(F.min("doc_id").alias("id"), F.min_by(F.struct(*more), "doc_id").alias("x"))
    classes = cut(classes.select(*key, "id", "x.*"))
    cut.drop(wide)
    found = find(docs, classes, k, bound, cut)
    named = cut(classes.join(found, "id", "left").select(*key, F.coalesce("component", "id").alias("component_id")))
    cut.drop(classes, found)
    out = prints.select("doc_id", *key).join(named, key, "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, part=90, whole=100)


#: Numbers of rows without an id of their own start here.
ROWS_FROM = 1 << 62


def drop_near_copies(docs: DataFrame, k: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """One row of each component stays: the one with the smallest doc_id that no other row has.

    Rows without doc_id and rows that share one are numbered for this, come after the others and count as
    documents of their own, so of equal ones a single row stays. Rows without words have no links and all
    stay. Columns pass through whatever their names.
    """
    row, count = clear_of(docs, "_row", "_count")
    cut = Cut(ready(docs.sparkSession))
    plain = docs.withColumn(row, F.col("doc_id").cast("long"))
    odd = cut(plain.groupBy(row).agg(F.count("*").alias(count)).where((F.col(count) > 1) | F.col(row).isNull() | (F.col(row) >= ROWS_FROM)).select(row))
    if not odd.isEmpty():
        own = odd.select(F.col(row).alias(count))
        some = plain.join(own, F.col(row).eqNullSafe(F.col(count)), "left_semi")
        some = cut(some.withColumn(row, F.monotonically_increasing_id() + F.lit(ROWS_FROM)))
        plain = plain.where(F.col(row).isNotNull()).join(odd, row, "left_anti").select(*some.columns).unionByName(some)
    found = jaccard_components(plain.select(F.col(row).alias("doc_id"), "text"), k, part, whole)
    going = found.where("component_id <> doc_id").select(F.col("doc_id").alias(row))
    return plain.join(going, row, "left_anti").select(*docs.columns)
