"""Sharding [native]: k-d tree partitioning over document metadata.

The cloud of documents (weight: size in bytes) is split again and again at the weighted median of the
widest metadata dimension (size, source, language, id, each on [0, 1) of its own range) until every leaf
is one shard of the target weight; a node of an odd number of shards is split in that proportion. Rows of
equal text are one group and take the metadata of its row with the least id, so they lie at one place. A
dimension's coordinate is a 62-bit number: the metadata value in the high bits, a hash of the text next,
a hash of the row last. A cut goes between groups, unless the group at the median weighs more than
GROUP_LIMIT of a shard: so groups stay whole, and a hot source, a mass of copies or a tied value is still
cut at the right weight.

A level of the tree costs one pass that sums weights by node, dimension and 1/256 of the range, which gives
the widths and the interval with the median, and a pass or two that open this interval into up to 4096 parts,
until the one with the median weighs less than TOLERANCE of a shard. Only these histograms (at most shards *
4096 rows) reach the driver. The passes read a narrow table of coordinates with each row's node; what differs
by node (dimension, interval, cut) is joined from a table of at most one row per shard.

Cases: null text counts as empty; null metadata has the coordinate 0; repeated rows are rows of their own,
of one group, and can be told apart where it must be cut; fewer documents than shards leave shards empty; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import Cut, table, text_of

SHARDS = 40
OVERHEAD = 16
DIMENSIONS = ("by_size", "by_source", "by_lang", "by_id")
VALUE_BITS, TEXT_BITS, ROW_BITS = 16, 24, 22
BITS = VALUE_BITS + TEXT_BITS + ROW_BITS
FIRST_BITS = 8
#: Bits that are left after each step of a search; one step ends where groups begin.
STEPS = (54, 46, 34, ROW_BITS, 11, 0)
TOLERANCE = 2e-3
GROUP_LIMIT = 2e-2
#: One in HEAVY of all rows makes a group of equal texts large.
HEAVY = 1000
#: Documents that one group of the slot numbering holds on average.
RUN = 2000


def hashed(c: Column, bits: int, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(c, F.lit(seed)), 64 - bits)


def coordinates(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the values of all dimensions, and the hashes of text and row."""
    text = text_of(docs)
    size = F.octet_length(text).cast("long") + OVERHEAD
    spread = float(1 << VALUE_BITS) - 1
    values = {
        "by_size": F.least(F.lit(spread), F.log2(size.cast("double")) * (spread / 40)).cast("long"),
        "by_source": F.when(F.col("source").isNotNull(), hashed(F.col("source"), VALUE_BITS, 1)).otherwise(0),
        "by_lang": F.when(F.col("lang").isNotNull(), hashed(F.col("lang"), VALUE_BITS, 2)).otherwise(0),
        "by_id": F.coalesce(F.pmod(F.col("doc_id").cast("long"), F.lit(1 << 50)), F.lit(0)),
    }
    row = hashed(F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.monotonically_increasing_id()), ROW_BITS, 4)
    return docs.select("doc_id", size.alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), *[v.cast("long").alias(k) for k, v in values.items()], F.xxhash64(text, F.lit(3)).alias("text_hash"), row.alias("row_hash"))


def together(base: DataFrame, cut: Cut) -> DataFrame:
    """Gives all rows of one text the values of its row with the least id; only texts that occur again are joined.

    Groups of a thousandth of all rows and more, a thousand at most, are broadcast, so none meets in one task.
    """
    values, key = ("by_source", "by_lang", "by_id"), ["text_hash", "size"]
    groups = cut(base.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("by_id", "by_source", "by_lang")).alias("first")).where("n > 1"))
    heavy = F.col("n") * HEAVY >= base.count()
    large, small = F.broadcast(groups.where(heavy).drop("n")), groups.where(~heavy).drop("n")
    joined = base.join(large, key).unionByName(base.join(large, key, "left_anti").join(small, key, "left"))
    out = cut(joined.select("doc_id", "size", "text_crc32", "by_size", *[F.coalesce(F.col("first")[v], F.col(v)).alias(v) for v in values], "text_hash", "row_hash"))
    cut.drop(groups)
    return out


def scaled(base: DataFrame, least: int, most: int) -> DataFrame:
    """Puts ids on VALUE_BITS of their range and joins value, text hash and row hash into coordinates."""
    width = max(1, most - least + 1)
    on = ((F.col("by_id") - least).cast("double") * ((1 << VALUE_BITS) / width)).cast("long")
    value = lambda d: F.least(F.lit((1 << VALUE_BITS) - 1).cast("long"), F.greatest(F.lit(0).cast("long"), on if d == "by_id" else F.col(d)))
    tail = F.shiftleft(F.shiftrightunsigned("text_hash", 64 - TEXT_BITS), ROW_BITS).bitwiseOR(F.col("row_hash"))
    return base.select("doc_id", "size", "text_crc32", *[F.shiftleft(value(d), TEXT_BITS + ROW_BITS).bitwiseOR(tail).alias(d) for d in DIMENSIONS])


def per_node(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few numbers for each node; at most one row per shard, so it can be broadcast."""
    values = ", ".join("(" + ", ".join(str(x) for x in r) + ")" for r in rows)
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {values} AS t({schema})"))


def chosen(dim: str = "dim") -> Column:
    """The coordinate of the row's own dimension."""
    out = F.col(DIMENSIONS[-1])
    for k, d in reversed(list(enumerate(DIMENSIONS[:-1]))):
        out = F.when(F.col(dim) == k, F.col(d)).otherwise(out)
    return out


def widest(bins: dict[int, list[tuple[int, int]]]) -> int:
    """The dimension of the greatest spread: variance by weight of the values on [0, 1)."""

    def variance(own: list[tuple[int, int]]) -> float:
        w = sum(x for _, x in own)
        mean = sum(b * x for b, x in own) / w
        return sum(x * (b - mean) ** 2 for b, x in own) / w

    return max(bins, key=lambda d: (variance(bins[d]), -d))


class Search:
    """One node's search for its weighted median: an interval that is opened step by step."""

    def __init__(self, dim: int, goal: float, unit: float):
        self.dim, self.goal, self.unit = dim, goal, unit
        self.lo, self.bits, self.left, self.cut = 0, BITS, 0, None

    @property
    def shift(self) -> int:
        """Bits of a part of the interval."""
        return next(b for b in STEPS if b < self.bits)

    def step(self, own: list[tuple[int, int]]) -> None:
        """own: (part, weight), sorted, of the parts of the interval."""
        shift = self.shift
        at, weight = (own[-1][0] + 1, 0) if own else (0, 0)
        for part, w in own:
            if self.left + w > self.goal:
                at, weight = part, w
                break
            self.left += w
        start = self.lo + (at << shift)
        if weight <= self.unit * (GROUP_LIMIT if shift == ROW_BITS else TOLERANCE) or not shift:
            before, after = self.goal - self.left, self.left + weight - self.goal
            self.cut = start if before <= after else start + (1 << shift)
        else:
            self.lo, self.bits = start, shift


def kd_leaves(rows: DataFrame, shards: int, cut: Cut) -> DataFrame:
    """rows with `node`, the number of their leaf, 0 to shards - 1."""
    spark = rows.sparkSession
    placed, sizes, unit = cut(rows.withColumn("node", F.lit(0))), {0: shards}, 0.0
    while open_nodes := [k for k, n in sizes.items() if n > 1]:
        every = F.array(*[F.struct(F.lit(d).alias("dim"), F.shiftright(c, BITS - FIRST_BITS).alias("bin")) for d, c in enumerate(DIMENSIONS)])
        inner = placed.join(per_node(spark, [(k,) for k in open_nodes], "node"), "node")
        found: dict = {k: {d: [] for d in range(len(DIMENSIONS))} for k in open_nodes}
        for r in inner.select("node", "size", F.inline(every)).groupBy("node", "dim", "bin").agg(F.sum("size").alias("w")).collect():
            found[r["node"]][r["dim"]].append((r["bin"], r["w"]))
        searches: dict[int, Search] = {}
        for k in open_nodes:
            total = sum(w for _, w in found[k][0])
            unit = unit or total / shards
            dim = widest(found[k]) if total else 0
            searches[k] = Search(dim, total * (sizes[k] // 2) / sizes[k], unit)
            searches[k].step(sorted(found[k][dim]))
        while todo := {k: s for k, s in searches.items() if s.cut is None}:
            ask = per_node(spark, [(k, s.dim, f"{s.lo}L", f"{1 << s.bits}L", s.shift) for k, s in todo.items()], "node, dim, lo, width, shift")
            offset = chosen() - F.col("lo")
            inside = placed.join(ask, "node").select("node", "size", "width", "shift", offset.alias("x")).where("x >= 0 AND x < width")
            parts: dict = {k: [] for k in todo}
            for r in inside.groupBy("node", F.expr("shiftright(x, shift)").alias("bin")).agg(F.sum("size").alias("w")).collect():
                parts[r["node"]].append((r["bin"], r["w"]))
            for k, s in todo.items():
                s.step(sorted(parts[k]))
        cuts = per_node(spark, [(k, s.dim, f"{s.cut}L", sizes[k] // 2) for k, s in searches.items()], "node, dim, cut, half")
        moved = placed.join(cuts, "node", "left").withColumn("node", F.col("node") + F.when(chosen() >= F.col("cut"), F.col("half")).otherwise(0))
        new = cut(moved.select(*placed.columns))
        cut.drop(placed)
        placed = new
        for k in open_nodes:
            sizes[k + sizes[k] // 2] = sizes[k] - sizes[k] // 2
            sizes[k] //= 2
    return placed


def numbered(placed: DataFrame, shard: str = "shard") -> DataFrame:
    """Takes place (a number that differs by row) and adds slot: 0, 1, ... within each shard, by runs of
    about RUN rows that are counted first."""
    count = placed.select(F.lit(1)).count()
    runs = max(1, -(-count // (RUN * SHARDS)))
    keyed = placed.withColumn("_run", F.pmod(F.xxhash64("place", F.lit(9)), F.lit(runs)).cast("int"))
    sizes = keyed.groupBy(shard, "_run").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(shard, "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = keyed.withColumn("_r", F.row_number().over(Window.partitionBy(shard, "_run").orderBy("doc_id", "place")))
    return own.join(starts, [shard, "_run"]).withColumn("slot", F.col("_start") + F.col("_r") - 1).drop("_run", "_r", "_start", "place")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every document."""
    cut = Cut(docs.sparkSession)
    single = cut(coordinates(docs))
    base = together(single, cut)
    cut.drop(single)
    ends = base.agg(F.min("by_id").alias("a"), F.max("by_id").alias("b")).first()
    rows = scaled(base, ends["a"] or 0, ends["b"] or 0)
    leaves = kd_leaves(rows, shards, cut)
    cut.drop(base)
    return numbered(leaves.select("doc_id", "size", "text_crc32", F.col("node").cast("int").alias("shard"), F.col("by_id").alias("place")))


def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
