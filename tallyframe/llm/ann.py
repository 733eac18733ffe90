"""Approximate nearest neighbours: cross-polytope hashing.

Each table turns a unit vector by a fast pseudo-rotation (three rounds of random signs and a Walsh-
Hadamard transform) and takes the nearest signed axis; as many such functions are joined (the last on
fewer coordinates) as make the wanted number of buckets. Queries probe, per table, the buckets with the
least distance to the next axes. Fixed numbers would lose neighbours as n grows, so tables, buckets and
probes are fitted on every table: SAMPLE queries are compared with all vectors, and of the settings that
find GOAL of their neighbours the cheapest is taken, a vector's move to its bucket, a query's to a probed
bucket and a distance having fixed costs. Every table of vectors is hashed; only queries that found fewer
than asked are compared with all vectors, in blocks. Candidates are ranked by
the exact Euclidean distance of the original vectors in double precision, inside their buckets: a bucket
is dealt into groups of about CHUNK vectors and BLOCK queries that all meet each other, so neither a hot
bucket nor a hot vector meets in one task and no pairs
are written. Equal vectors are one entry with their smallest ids (as many as an answer can use).

Recall is measured against brute force in the tests (at least 0.9 at ten neighbours).
Hashing sees directions only; for vectors of unlike norms recall can be lower, distances stay exact.

Cases: vectors that are null, zero, or hold null or non-finite components take no part; vectors of unlike
widths have no distance, so each width is searched on its own; ties go to the smaller vec_id; repeated rows of one vec_id count once; fewer candidates
than ten give fewer rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tallyframe.llm.common import Cut, map_columns, ready, slices, table

#: Settings that are weighed: numbers of tables, buckets from LEAST_BUCKETS to n / TARGET, at most MOST probes a table.
TABLES = (1, 2, 4, 8)
LEAST_BUCKETS = 16
TARGET = 200
MOST = 128
#: Vectors and queries of a bucket that meet in one group.
CHUNK = 4096
BLOCK = 1024
NEAREST = 10
#: Share of the true neighbours of SAMPLE queries that the settings are fitted to.
GOAL = 0.95
SAMPLE = 100
#: Distances that moving a row to a bucket costs.
MOVE = 500
SALTS = 16


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows (width a power of two), scaled to keep lengths."""
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2)
        step *= 2
    return x.reshape(n, width) / math.sqrt(width)


class Hashes:
    """The functions of all tables for vectors of one width; made anew from the seed on every executor."""

    def __init__(self, width: int, buckets: int, tables: int = 1, seed: int = 5):
        self.width, self.tables = width, tables
        self.padded = 1 << max(0, (width - 1).bit_length())
        rng = np.random.default_rng(seed)
        self.axes = []  # coordinates that each function of a table looks at
        left = max(1, buckets)
        while left > 1 and len(self.axes) < 8:
            m = min(self.padded, max(1, 1 << max(0, math.ceil(math.log2(left)) - 1)))
            self.axes.append(m)
            left = math.ceil(left / (2 * m))
        self.signs = rng.choice([-1.0, 1.0], size=(tables, max(1, len(self.axes)), 3, self.padded))

    def turned(self, x: np.ndarray, t: int, f: int) -> np.ndarray:
        for signs in self.signs[t, f]:
            x = hadamard(x * signs)
        return x[:, : self.axes[f]]

    def probes(self, x: np.ndarray, t: int, count: int) -> np.ndarray:
        """The bucket numbers to look at, best first: (rows, up to count)."""
        x = np.pad(x, ((0, 0), (0, self.padded - x.shape[1])))
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        codes, costs = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for f, m in enumerate(self.axes):
            y = self.turned(x, t, f)
            both = np.concatenate([y, -y], axis=1)
            best = np.argsort(-both, axis=1, kind="stable")[:, :count]
            value = np.take_along_axis(both, best, axis=1)
            cost = (value[:, :1] - value) ** 2
            codes = (codes[:, :, None] * (2 * m) + best[:, None, :]).reshape(len(x), -1)
            costs = (costs[:, :, None] + cost[:, None, :]).reshape(len(x), -1)
            keep = np.argsort(costs, axis=1, kind="stable")[:, :count]
            codes, costs = np.take_along_axis(codes, keep, axis=1), np.take_along_axis(costs, keep, axis=1)
        return codes


def clean(df: DataFrame) -> DataFrame:
    """vec_id and vector of the rows that take part; single precision stays single, as it is half to move."""
    single = df.schema["embedding"].dataType.elementType == FloatType()
    v = F.transform("embedding", lambda x: x.cast("float" if single else "double"))
    rows = df.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector"))
    infinite = lambda x: F.abs(x) == F.lit(float("inf"))
    return rows.where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | infinite(x)) & F.exists("vector", lambda x: x != 0))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """entry (smallest id), ids (the smallest `keep` of the equal vectors), vector; salted, then whole."""
    name = rows.withColumn("h", F.xxhash64("vector")).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    part = Window.partitionBy("h", "vector", "salt").orderBy("vec_id")
    first = name.withColumn("r", F.dense_rank().over(part)).where(F.col("r") <= keep).drop("r")
    groups = first.groupBy("h", "vector").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    return groups.select(F.element_at("ids", 1).alias("entry"), F.slice("ids", 1, keep).alias("ids"), "vector")


def vectors_of(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def search(index: DataFrame, wanted: DataFrame, hashes: Hashes, probes: int, k: int, cut: Cut) -> DataFrame:
    """query_id, rank, vec_id, entry, score: the k nearest among what the probed buckets of each query hold."""
    tables, width = hashes.tables, hashes.width

    def codes(ids: list, xs: list) -> list:
        x = np.asarray(xs, dtype=np.float64).reshape(len(ids), width)
        return [ids, np.stack([hashes.probes(x, t, 1)[:, 0] for t in range(tables)], axis=1).tolist()]

    def probed(ids: list, xs: list) -> list:
        x = np.asarray(xs, dtype=np.float64).reshape(len(ids), width)
        got = [hashes.probes(x, t, probes) for t in range(tables)]
        owner = np.repeat(np.arange(tables), [g.shape[1] for g in got])
        return [np.repeat(np.asarray(ids, dtype=np.int64), len(owner)), np.tile(owner, len(ids)), np.concatenate(got, axis=1).reshape(-1)]

    coded = map_columns(index.select("entry", "vector"), codes, "entry long, codes array<long>", rows=2000)
    placed = coded.select("entry", F.posexplode("codes").alias("t", "code"))
    asked = cut(map_columns(wanted, probed, "query_id long, t int, code long", rows=max(1, min(500, (1 << 22) // probes**2))))
    pieces = lambda c, most: F.ceil(F.col(c) / most).cast("long")
    held, sent = placed.groupBy("t", "code").agg(F.count("*").alias("size")), asked.groupBy("t", "code").agg(F.count("*").alias("asks"))
    sizes = cut(held.join(sent, ["t", "code"]).select("t", "code", pieces("size", CHUNK).alias("chunks"), pieces("asks", BLOCK).alias("blocks")))
    part, each = lambda c, n: F.pmod(F.xxhash64(c, F.lit(3)), F.col(n)), lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    inside = placed.join(sizes, ["t", "code"]).join(index, "entry").select("entry", "ids", "vector", "t", "code", part("entry", "chunks").alias("chunk"), each("blocks").alias("block"))
    outside = asked.join(sizes, ["t", "code"]).join(wanted, "query_id").select("query_id", "vector", "t", "code", part("query_id", "blocks").alias("block"), each("chunks").alias("chunk"))

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            x, v = (vectors_of(side["vector"], width) for side in (left, right))
            ids, entries, asks = left["ids"].to_pylist(), left["entry"].to_pylist(), right["query_id"].to_pylist()
            last = min(k, len(x) - 1)
            xx, vv = (x**2).sum(axis=1), (v**2).sum(axis=1)
            for lo in range(0, len(v), 64):
                # squares by one product tell who can be near; slack keeps whom rounding could hide
                rough = xx + vv[lo : lo + 64, None] - 2 * (v[lo : lo + 64] @ x.T)
                sure = np.isfinite(rough).all()
                limit = np.partition(rough, last, axis=1)[:, last] + 1e-9 * (xx.max() + vv[lo : lo + 64])
                for i in range(len(rough)):
                    near = np.flatnonzero(rough[i] <= limit[i]) if sure else np.arange(len(x))
                    d = np.sqrt(((x[near] - v[lo + i]) ** 2).sum(axis=1))
                    q = asks[lo + i]
                    best = sorted((s, int(c), entries[j]) for s, j in zip(d.tolist(), near.tolist()) for c in ids[j] if c != q)[:k]
                    found += [(q, c, e, s) for s, c, e in best]
        columns = list(zip(*found, strict=True)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "entry", "score"])

    key = ["t", "code", "chunk", "block"]
    near = inside.groupBy(*key).cogroup(outside.groupBy(*key)).applyInArrow(rerank, "query_id long, vec_id long, entry long, score double")
    once = near.groupBy("query_id", "vec_id").agg(F.min(F.struct("score", "entry")).alias("b")).select("query_id", "vec_id", "b.entry", "b.score")
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "entry", "score")


def depths(hashes: Hashes, asks: np.ndarray, owner: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """For each neighbour x[i] of query asks[owner[i]]: how many probes a table it takes to meet it; most + 1 if more."""
    out = np.full(len(x), most + 1)
    for t in range(hashes.tables):
        at = hashes.probes(asks, t, most)[owner] == hashes.probes(x, t, 1)
        out = np.minimum(out, np.where(at.any(axis=1), at.argmax(axis=1) + 1, most + 1))
    return out


def neighbours_of_sample(index: DataFrame, asks: np.ndarray, k: int) -> DataFrame:
    """q (the number of the query), vector, score: the k nearest entries other than itself of at most SAMPLE queries.

    The queries go to every task, and each task sends its k nearest of each.
    """
    shared, width = index.sparkSession.sparkContext.broadcast(asks), asks.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        best, rows = np.full((len(v), k), np.inf), np.zeros((len(v), k, width))
        for batch in batches:
            for lo, n in slices(batch.columns, 1 << 14):
                x = vectors_of(batch["vector"].slice(lo, n), width)
                d = np.stack([((x - q) ** 2).sum(axis=1) for q in v])
                d = np.concatenate([best, np.where(d > 0, d, np.inf)], axis=1)
                top = np.argpartition(d, k - 1, axis=1)[:, :k]
                new = np.where((top < k)[:, :, None], np.take_along_axis(rows, np.minimum(top, k - 1)[:, :, None], axis=1), x[np.maximum(top - k, 0)])
                best, rows = np.take_along_axis(d, top, axis=1), new
        q, r = np.nonzero(np.isfinite(best))
        lists = pa.ListArray.from_arrays(np.arange(len(q) + 1, dtype=np.int32) * width, rows[q, r].reshape(-1))
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), lists, pa.array(best[q, r])], ["q", "vector", "score"])

    near = index.select("vector").mapInArrow(run, "q int, vector array<double>, score double")
    return near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("score", "vector"))).where(F.col("r") <= k).drop("r")


def fitted(index: DataFrame, wanted: DataFrame, width: int, n: int, k: int, target: int) -> tuple[Hashes, int]:
    """Hashes and probes that find the share GOAL of the true neighbours of SAMPLE queries at the least cost."""
    asked = wanted.count()
    asks = np.asarray([r["vector"] for r in wanted.orderBy(F.xxhash64("query_id", F.lit(7)), "query_id").limit(SAMPLE).collect()], dtype=np.float64).reshape(-1, width)
    true = neighbours_of_sample(index, asks, k).collect() if len(asks) else []
    if not true:
        return Hashes(width, LEAST_BUCKETS, 1), 1
    x, owner = np.asarray([r["vector"] for r in true], dtype=np.float64), np.asarray([r["q"] for r in true])
    best: tuple[float, Hashes, int] | None = None
    for tables in TABLES:
        buckets = LEAST_BUCKETS
        while buckets <= max(LEAST_BUCKETS, n / target):
            hashes = Hashes(width, buckets, tables)
            depth = np.sort(depths(hashes, asks, owner, x, MOST))
            need = int(depth[math.ceil(GOAL * len(depth)) - 1])
            cost = tables * (n * MOVE + asked * need * (MOVE + n / buckets))
            if need <= MOST and (best is None or cost < best[0]):  # as many probes as LEAST_BUCKETS find everything
                best = (cost, hashes, need)
            buckets <<= 1
    return best[1], best[2]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, target: int = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of vectors (vec_id, embedding) to each query but itself."""
    spark = ready(vectors.sparkSession)
    cut, rows, asked = Cut(spark), clean(vectors), clean(queries)
    # a table of embeddings has a few widths, mostly one
    widths = sorted(r["w"] for r in asked.select(F.size("vector").alias("w")).distinct().collect()) or [1]
    return reduce(DataFrame.unionByName, [nearest_of_width(rows, asked, w, k, target, cut) for w in widths])


def nearest_of_width(rows: DataFrame, asked: DataFrame, width: int, k: int, target: int, cut: Cut) -> DataFrame:
    out = ("query_id", "rank", "vec_id", "score")
    index = cut(distinct_vectors(rows.where(F.size("vector") == width), k + 1))
    n = index.count()  # copies fill no buckets
    wanted = cut(asked.where(F.size("vector") == width).groupBy("vec_id").agg(F.min("vector").alias("vector")).select(F.col("vec_id").alias("query_id"), "vector"))
    hashes, probes = fitted(index, wanted, width, n, k, target)
    found = cut(search(index, wanted, hashes, probes, k, cut).select(*out))
    full = found.where(F.col("rank") == k).select("query_id")
    short = cut(wanted.join(full, "query_id", "left_anti"))
    if short.isEmpty():
        return found
    return found.join(full, "query_id", "left_semi").unionByName(search(index, short, Hashes(width, 1, 1), 1, k, cut).select(*out))


def op3_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))
