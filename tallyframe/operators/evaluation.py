"""Votes, accuracies, confusion, samples and splits, and an adapter for models."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.once import once
from tallyframe.operators.order_stats import percentiles
from tallyframe.operators.profile import share_of_all


def majority_vote(votes: Column, threshold: float = 0.0, favoured: str = "business_type") -> Column:
    """The most frequent vote; null below the share; ties go to the favoured label, else to the first by name."""
    cast = F.filter(votes, lambda v: v.isNotNull())
    labels = F.array_sort(F.array_distinct(cast))
    count = lambda v: F.size(F.filter(cast, lambda x: x == v))
    top = F.array_max(F.transform(labels, count))
    tied = F.filter(labels, lambda v: count(v) == top)
    pick = F.when(F.array_contains(tied, favoured), favoured).otherwise(F.try_element_at(tied, F.lit(1)))
    return F.when((F.size(cast) > 0) & (top / F.size(cast) >= threshold), pick)


def align(models: dict[str, DataFrame], keys: list[str], label: str = "predicted") -> DataFrame:
    """Inner join of the models' predictions on their keys; the first by label stays of repeated keys."""
    parts = [df.groupBy(*keys).agg(F.min(label).alias(f"pred_{name}")) for name, df in models.items()]
    return reduce(lambda a, b: a.join(b, keys), parts)


def votes_of(aligned: DataFrame) -> Column:
    return F.array(*[F.col(c) for c in aligned.columns if c.startswith("pred_")])


def agreement_histogram(aligned: DataFrame) -> DataFrame:
    """Of align(): how many models give the most frequent label, counted over rows, with the ratio."""
    cast = F.filter(votes_of(aligned), lambda v: v.isNotNull())
    top = F.coalesce(F.array_max(F.transform(F.array_distinct(cast), lambda v: F.size(F.filter(cast, lambda x: x == v)))), F.lit(0))
    return share_of_all(aligned.groupBy(top.cast("long").alias("agreeing")).agg(F.count("*").alias("row_count")))


def coverage_at(aligned: DataFrame, truth: str, thresholds: list[float]) -> DataFrame:
    """Per threshold of the majority vote: rows that are answered, their share, and how many of them are right."""
    votes = [majority_vote(votes_of(aligned), x) for x in thresholds]
    wide = once(aligned, {f"v{k}": v for k, v in enumerate(votes)}).agg(F.count("*").alias("n"), *[x for k in range(len(votes)) for x in (F.count(f"v{k}").alias(f"a{k}"), F.count_if(F.col(f"v{k}") == F.col(truth)).alias(f"c{k}"))])
    rows = F.array(*[F.struct(F.lit(x).alias("threshold"), F.col("n").alias("row_count"), F.col(f"a{k}").alias("answered"), F.col(f"c{k}").alias("correct")) for k, x in enumerate(thresholds)])
    out = wide.select(F.inline(rows))
    part = lambda a, b: F.col(a) / F.when(F.col(b) > 0, F.col(b))
    return out.withColumns({"coverage": part("answered", "row_count"), "accuracy": part("correct", "answered")})


def exact_match(df: DataFrame, truth: str, pred: str, mask: Column) -> DataFrame:
    """Of the rows that a condition picks: how many, how many are equal, and the ratio."""
    out = df.agg(F.count_if(mask).alias("masked"), F.count_if(mask & F.col(truth).eqNullSafe(F.col(pred))).alias("matched"))
    return out.withColumn("ratio", F.col("matched") / F.when(F.col("masked") > 0, F.col("masked")))


def recorded(df: DataFrame, predictions: DataFrame, keys: list[str], label: str = "predicted", missing: str = "error") -> DataFrame:
    """Predictions that were made elsewhere, as a table: joined by key, the first by label of repeated keys, `missing` where there is none."""
    once_each = predictions.groupBy(*keys).agg(F.min(label).alias(label))
    return df.join(once_each, keys, "left").withColumn(label, F.coalesce(label, F.lit(missing)))


def accuracy(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """rows, answered, correct, accuracy, abstained."""
    out = df.agg(F.count("*").alias("row_count"), F.count(pred).alias("answered"), F.count_if(F.col(truth) == F.col(pred)).alias("correct"))
    return out.select("*", (F.col("correct") / F.when(F.col("answered") > 0, F.col("answered"))).alias("accuracy"), (F.col("row_count") - F.col("answered")).alias("abstained"))


def class_accuracy(df: DataFrame, truth: str, pred: str) -> DataFrame:
    out = df.groupBy(F.col(truth).alias("label")).agg(F.count("*").alias("row_count"), F.count_if(F.col(truth) == F.col(pred)).alias("correct"))
    return out.withColumn("accuracy", F.col("correct") / F.col("row_count"))


def confusion(df: DataFrame, truth: str, pred: str, classes: list) -> DataFrame:
    """A row per class in the list, a column per predicted class, 0 where nothing was counted."""
    spark = df.sparkSession
    counts = df.groupBy(F.col(truth).cast("string").alias("actual")).agg(*[F.count_if(F.col(pred).cast("string") == str(c)).alias(f"pred_{c}") for c in classes])
    listed = spark.createDataFrame([(str(c),) for c in classes], "actual string")
    return F.broadcast(listed).join(counts, "actual", "left").fillna(0)


def mode(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value, the smallest of equals."""
    return df.groupBy(column).agg(F.count("*").alias("row_count")).orderBy(F.desc("row_count"), column).limit(1)


def hash_order(key: Column, salt: str) -> Column:
    return F.md5(F.encode(F.concat(key, F.lit(salt)), "UTF-8"))


def hash_sample(df: DataFrame, n: int, salt: str, key: str = "id") -> DataFrame:
    """The n rows with the smallest digests: the same rows on any number of partitions."""
    return df.orderBy(hash_order(F.col(key), salt), key).limit(n)


def stratified(df: DataFrame, test: Column, sizes: tuple[int, int], salt: str, key: str = "id") -> DataFrame:
    """Samples of rows that meet a condition and of those that don't, marked in sample_type."""
    yes = hash_sample(df.where(test), sizes[0], salt, key).withColumn("sample_type", F.lit("conflict"))
    no = hash_sample(df.where(~test), sizes[1], salt, key).withColumn("sample_type", F.lit("match"))
    return yes.unionByName(no)


def hash_split(df: DataFrame, key: str, fraction: float, salt: str = "42") -> tuple[DataFrame, DataFrame]:
    """Two parts by digest: narrow, no sort; sizes are near the fraction, membership never changes."""
    point = F.conv(F.substring(hash_order(F.col(key).cast("string"), salt), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.where(point < fraction), df.where(point >= fraction)


def nested_split(df: DataFrame, key: str, fraction: float = 0.6, sub: float = 0.75, cap: int | None = None, salt: str = "42") -> DataFrame:
    """Adds part: train and test by digest; train falls into fit and tune by another; of fit, `cap` rows at most with
    the smallest digests stay fit and the rest are spare. Rows of one key share their part."""
    point = lambda s: F.conv(F.substring(hash_order(F.col(key).cast("string"), s), 1, 8), 16, 10).cast("double") / float(1 << 32)
    out = df.withColumn("part", F.when(point(salt) >= fraction, "test").when(point(salt + "sub") < sub, "fit").otherwise("tune"))
    if cap is None:
        return out
    kept = out.where("part = 'fit'").select(key).distinct().orderBy(hash_order(F.col(key).cast("string"), salt), key).limit(cap).withColumn("_kept", F.lit(True))
    return out.join(kept, key, "left").withColumn("part", F.when((F.col("part") == "fit") & F.col("_kept").isNull(), "spare").otherwise(F.col("part"))).drop("_kept")


def predict(df: DataFrame, predictor: Callable[[pd.DataFrame], pd.DataFrame], schema: str, failed: dict | None = None) -> DataFrame:
    """Applies a model to batches; a batch that fails is retried by row, and rows that fail get the values of `failed`,
    by default null, and keep those of their own columns."""
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                yield predictor(batch)[names]
            except Exception:  # a model's failure is a result of its own
                rows = []
                for k in range(len(batch)):
                    one = batch.iloc[k : k + 1]
                    try:
                        rows.append(predictor(one)[names])
                    except Exception:
                        rows.append(one.assign(**(failed or {})).reindex(columns=names))
                yield pd.concat(rows)

    return df.mapInPandas(run, schema)


def latency(df: DataFrame, seconds: str = "latency_s") -> DataFrame:
    """Rows a minute, and mean, least and greatest latency."""
    return df.agg((60 * F.count("*") / F.sum(seconds)).alias("rows_per_min"), F.avg(seconds).alias("mean_s"), F.min(seconds).alias("min_s"), F.max(seconds).alias("max_s"))


#: Chances that a Poisson count of mean 1 is at most 0, 1, ..., 6, of 2**32.
_POISSON = [math.floor(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * (1 << 32)) for k in range(7)]


def poisson_weight(key: Column, draw: Column, salt: str = "") -> Column:
    """How often a row stands in a resample: a Poisson count of mean 1 from a digest, the same on any engine (7 at most)."""
    u = F.conv(F.substring(F.md5(F.encode(F.concat(key.cast("string"), F.lit(f"#{salt}"), draw.cast("string")), "UTF-8")), 1, 8), 16, 10).cast("long")
    return F.array_size(F.filter(F.array(*map(F.lit, _POISSON)), lambda edge: edge <= u))


def accuracy_interval(df: DataFrame, key: str, truth: str, pred: str, by: list[str] | None = None, draws: int = 200, level: float = 0.95, salt: str = "") -> DataFrame:
    """by, row_count, correct, accuracy, low, high: the share that is right, with the percentiles of its resamples.

    Each resample gives every row a Poisson weight, so all are sums of one aggregation that is combined before its
    shuffle; low and high are the values at the places ceil(n (1 - level) / 2) and ceil(n (1 + level) / 2) of the n
    resamples that drew any row. A null label or prediction is wrong; a null key is a key of its own.
    """
    by = by or []
    right = F.coalesce(F.col(truth) == F.col(pred), F.lit(False)).cast("long")
    weight = poisson_weight(F.coalesce(F.col(key).cast("string"), F.lit("")), F.col("_draw"), salt)
    each = df.select(*by, key, right.alias("_right"), F.explode(F.sequence(F.lit(0), F.lit(draws))).alias("_draw"))
    w = F.when(F.col("_draw") == draws, 1).otherwise(weight)  # the last is the sample itself
    sums = each.select(*by, "_draw", "_right", w.alias("_w")).groupBy(*by, "_draw").agg(F.sum("_w").alias("n"), F.sum(F.col("_w") * F.col("_right")).alias("c"))
    share = F.when(F.col("n") > 0, F.col("c") / F.col("n"))
    own = F.col("_draw") == draws
    edges = percentiles(sums, by, F.when(~own, share), {"low": (1 - level) / 2, "high": (1 + level) / 2})
    base = sums.where(own).select(*by, F.col("n").alias("row_count"), F.col("c").alias("correct"), share.alias("accuracy"))
    if not by:
        return base.join(edges)  # one row each
    on = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by])
    return base.alias("a").join(edges.alias("b"), on).select("a.*", "b.low", "b.high")


def demo_search(candidates: DataFrame, rows: DataFrame, predictor: Callable[[DataFrame, DataFrame], DataFrame], truth: str, key: str = "id", first: int = 50, rungs: int = 3, salt: str = "42") -> DataFrame:
    """Successive halving over candidate sets of demonstrations: rung, candidate, row_count, correct, kept.

    Rung r looks at the first * 2**r rows with the smallest digests, all remaining candidates times rows at once, and
    keeps the better half (rounded up; of equals the smaller candidate). predictor: from candidates (candidate) and
    rows to (candidate, key, predicted); rows that it leaves out or gives null are wrong. Each rung's candidates
    come from the rung before, so dropped ones cost nothing further; all rungs are returned.
    """
    left, out = candidates.select("candidate").distinct(), []
    for r in range(rungs):
        chosen = hash_sample(rows, first << r, salt, key)
        said = predictor(left, chosen).groupBy("candidate", key).agg(F.min("predicted").alias("predicted"))
        right = said.join(chosen.select(F.col(key), F.col(truth).alias("_truth")), key).where(F.col("predicted") == F.col("_truth"))
        scored = left.join(right.groupBy("candidate").agg(F.count("*").alias("correct")), "candidate", "left").withColumn("correct", F.coalesce("correct", F.lit(0)))
        scored = scored.join(F.broadcast(chosen.agg(F.count("*").alias("row_count"))))  # one row
        # candidates are parameters of the search, a few hundred at most
        place, total = F.row_number().over(Window.orderBy(F.desc("correct"), "candidate")), F.count("*").over(Window.partitionBy())
        marked = scored.select(F.lit(r).alias("rung"), "candidate", "row_count", "correct", (place <= F.ceil(total / 2)).alias("kept"))
        out.append(marked)
        left = marked.where("kept").select("candidate")
    return reduce(DataFrame.unionByName, out)


def drawn_demos(train: DataFrame, candidates: DataFrame, size: int, key: str = "id") -> DataFrame:
    """Each candidate's demonstrations: the `size` training rows with the smallest digests of key and candidate."""
    digest = F.md5(F.encode(F.concat(F.col(key).cast("string"), F.lit("#"), F.col("candidate").cast("string")), "UTF-8"))
    each = train.join(F.broadcast(candidates)).withColumn("_d", digest)  # candidates are a parameter
    best = Window.partitionBy("candidate").orderBy("_d", key)
    return each.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= size).drop("_d", "_r")


def nearest_demo(demos: DataFrame, text: str, label: str, key: str = "id") -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A predictor for demo_search: the label of the candidate's demonstration that shares most words with the row, of
    equals the smallest label; none where no word is shared."""
    words = lambda df: F.explode(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), "\\s+")))

    def predictor(candidates: DataFrame, rows: DataFrame) -> DataFrame:
        shown = demos.join(candidates, "candidate").select("candidate", F.col(key).alias("_demo"), F.col(label).alias("_label"), words(demos).alias("w")).where("w <> ''")
        met = rows.select(key, words(rows).alias("w")).join(shown, "w").groupBy("candidate", key, "_demo", "_label").agg(F.count("*").alias("n"))
        return met.groupBy("candidate", key).agg(F.min(F.struct(-F.col("n"), "_label")).alias("b")).select("candidate", key, F.col("b._label").alias("predicted"))

    return predictor
