"""Vector code compression: product codes by Lloyd rounds whose assignments are found by exponion search.

Components become integers, vectors are cut into PARTS parts, and each part position has a codebook of at
most ENTRIES entries. A part starts at its previous entry a, at squared distance d. An entry e that is as
near lies within |e - a| <= |e - x| + |x - a| <= 2 sqrt(d), so of the entries sorted by their distance from
a only those with squared distance <= 4 d are looked at. All distances are integers and ties go to the
lower index, so the codes are those of a search over all entries.

Every round is one pass: the table with the new codes is written, and each task adds one row with its sums
(ENTRIES * PARTS counts and component sums), of which the next codebooks are made. Only these reach the driver.

Cases: vectors that are null or hold null or non-finite components are dropped; vectors of unlike widths have
codebooks of their own; a width that PARTS doesn't divide is filled up with zeros; an empty vector has code 0
and error 0; a null vec_id counts as the largest; of repeated vec_ids the smallest vector starts an entry and
every row is coded; fewer vec_ids than ENTRIES give fewer entries; components saturate where squared
distances would leave a long (beyond about 2**15 in 64 dimensions); a label's error that leaves it is null;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import Cut, ready, slices, table

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096.0
#: Rows that share a label meet their label's sum in this many places.
SALTS = 64

CODED = "vec_id long, label long, v array<int>, codes binary, error long, sums array<long>"


def part_width(width: int) -> int:
    return -(-width // PARTS)


def integers(x: np.ndarray, width: int) -> np.ndarray:
    """(rows, PARTS, part width) of floor(SCALE * x), zeros at the end."""
    w = part_width(width)
    limit = min(2**31 - 1, isqrt(2**58 // max(1, w)))
    out = np.zeros((len(x), PARTS * w), dtype=np.int64)
    out[:, :width] = np.clip(np.floor(SCALE * x), -limit, limit)
    return out.reshape(len(x), PARTS, w)


class Entries:
    """The codebook of one part position, with the entries around each entry sorted by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = ((entries[:, None] - entries[None]) ** 2).sum(axis=2)
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row, lower index first, from `start` on."""
        d = ((x - self.entries[start]) ** 2).sum(axis=1)
        best, least, radius = start.copy(), d.copy(), 4 * d
        active = np.arange(len(x))
        for r in range(len(self.entries)):
            active = active[self.apart[start[active], r] <= radius[active]]
            if not len(active):
                break
            j = self.order[start[active], r]
            dj = ((x[active] - self.entries[j]) ** 2).sum(axis=1)
            better = (dj < least[active]) | ((dj == least[active]) & (j < best[active]))
            at = active[better]
            best[at], least[at] = j[better], dj[better]
        return best, least


def assigned(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """The table with every part's nearest entry and the rows' errors; one row a task holds its counts and sums."""
    parts, m, w = books.shape
    shared = ready(coded.sparkSession).sparkContext.broadcast(books)  # PARTS * ENTRIES entries of one part each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Entries(b) for b in shared.value]
        counts, sums = np.zeros((parts, m), np.int64), np.zeros((parts, m, w), np.int64)
        names, kinds = ["vec_id", "label", "v", "codes", "error", "sums"], [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.int64(), pa.list_(pa.int64())]
        for batch in batches:
            for lo, n in slices(batch.columns, 1 << 14):
                rows = batch.slice(lo, n)
                x = rows["v"].flatten().to_numpy().astype(np.int64).reshape(n, parts, w)
                codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8).reshape(n, parts).astype(np.int64)
                error = np.zeros(n, np.int64)
                for p in range(parts):
                    codes[:, p], d = search[p].nearest(x[:, p], codes[:, p])
                    error += d
                    counts[p] += np.bincount(codes[:, p], minlength=m)
                    order = np.argsort(codes[:, p], kind="stable")
                    used, first = np.unique(codes[order, p], return_index=True)
                    sums[p][used] += np.add.reduceat(x[order, p], first)
                packed = pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([rows["vec_id"], rows["label"], rows["v"], packed, pa.array(error), pa.nulls(n, kinds[-1])], names)
        if counts.any():
            flat = np.concatenate([counts.reshape(-1), sums.reshape(-1)])
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds[:-1]), pa.array([flat], kinds[-1])], names)

    return coded.mapInArrow(run, CODED)


def moved(coded: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry's mean, rounded down; unused entries stay. One number for each component reaches the driver."""
    parts, m, w = books.shape
    rows = coded.where("sums IS NOT NULL").select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
    flat = np.zeros(parts * m * (1 + w), np.int64)
    for r in rows:
        flat[r["at"]] = r["x"]
    counts, sums = flat[: parts * m].reshape(parts, m, 1), flat[parts * m :].reshape(books.shape)
    return np.where(counts > 0, sums // np.maximum(counts, 1), books)


def first_entries(coded: DataFrame, w: int) -> np.ndarray:
    """The vectors of the ENTRIES smallest vec_ids, ascending, cut into parts."""
    ids = [r["vec_id"] for r in coded.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(ENTRIES).collect()]
    known = F.col("vec_id").isin([i for i in ids if i is not None])
    chosen = coded.where(known | F.col("vec_id").isNull() if None in ids else known)
    rows = chosen.groupBy("vec_id").agg(F.min("v").alias("v")).orderBy(F.col("vec_id").asc_nulls_last()).collect()
    return np.asarray([r["v"] for r in rows], dtype=np.int64).reshape(len(rows), PARTS, w).transpose(1, 0, 2)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def coded_of_width(rows: DataFrame, width: int, cut: Cut) -> DataFrame:
    """vec_id, label, code, error, codebooks_sha256 of the vectors of one width."""
    w = part_width(width)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, n in slices(batch.columns, 1 << 14):
                part = batch.slice(lo, n)
                x = integers(part["vector"].flatten().to_numpy().reshape(n, width), width).reshape(n, -1).astype(np.int32)
                lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * x.shape[1], x.reshape(-1))
                start = pa.array([bytes(PARTS)] * n, pa.binary())
                yield pa.RecordBatch.from_arrays([part["vec_id"], part["label"], lists, start], ["vec_id", "label", "v", "codes"])

    coded = cut(rows.where(F.size("vector") == width).select("vec_id", "label", "vector").mapInArrow(whole, "vec_id long, label long, v array<int>, codes binary"))
    books = first_entries(coded, w)
    if not books.shape[1]:
        return coded.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit("").alias("codebooks_sha256"))
    for k in range(ROUNDS + 1):
        if k:
            books = moved(coded, books)
        before, coded = coded, cut(assigned(coded.where("codes IS NOT NULL").select("vec_id", "label", "v", "codes"), books))
        cut.drop(before)
    return coded.where("codes IS NOT NULL").select("vec_id", "label", F.lower(F.hex("codes")).alias("code"), "error", F.lit(digest(books)).alias("codebooks_sha256"))


def compressed(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of the rows (vec_id, embedding, label) that can be coded."""
    cut = Cut(ready(vectors.sparkSession))
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.where("embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("vector"))
    rows = rows.where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))
    # a table of embeddings has a few widths, mostly one
    widths = sorted(r["w"] for r in rows.select(F.size("vector").alias("w")).distinct().collect()) or [1]
    out = reduce(DataFrame.unionByName, [coded_of_width(rows, width, cut) for width in widths])
    salted = out.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
    sums = out.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    sums = sums.select(F.col("label").alias("l"), "label_error", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("s"))
    both = salted.join(sums, F.col("label").eqNullSafe(F.col("l")) & (F.col("salt") == F.col("s")))
    return both.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op11_exponion_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
