"""Toxicity: non-negative positive-unlabelled learning on hashed words.

A linear model is trained with numpy from confirmed toxic documents (P) and unlabelled ones (U) by the
class-prior-corrected risk  prior*E_P[l(g)] + max(0, E_U[l(-g)] - prior*E_P[l(-g)]):  where the
bracket turns negative, that step is taken against it. Words enter as presence in BUCKETS hashed
places. U is every document that training may see, whatever its number: one pass counts in how many of
them each place occurs, all places whose share in P differs from that in U by SCREEN standard errors stay,
documents are reduced to these and equal ones are counted, and each training step sums its gradient over
that table in the cluster, in integers, so that the model is the same on any number of partitions. A soft
threshold keeps weights of words that tell nothing at zero. The samples of labelled rows are bounded (SAMPLE_P, SAMPLE_C: the first by a hash of the id); the
class prior comes from all training labels. Scores are computed for every whole text.

Cases: null and empty texts have no words and score the base rate; labels that are null are no labels;
of repeated label rows one toxic row makes a document toxic; repeated documents are scored each; with
no positive example the score is 0 for all; an empty table gives no rows; other columns pass through
`keep_clean` whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import Cut, crc_mod3, listed, map_columns, ready, slices, table, text_of, word_codes

BITS = 18
BUCKETS = 1 << BITS
#: Labelled training rows: positive ones, and those for the calibration of scores.
SAMPLE_P = 4_000
SAMPLE_C = 4_000
THRESHOLD = 0.7
#: Standard errors by which a word's share in P must differ from that in U, and how often P must show a word that speaks for it.
SCREEN = 3.0
LEAST = 3
#: Sums are taken of integers in this unit.
UNIT = float(1 << 30)
STEPS, RATE = 28, 0.35
STRIP = " .,;:!?\"'()[]*#$%&-"


def buckets_of(words: pa.Array) -> np.ndarray:
    """The hashed place of each word in lower case without its outer punctuation; -1 if nothing stays."""
    if not len(words):
        return np.empty(0, np.int64)
    coded = pc.utf8_lower(pc.ascii_trim(words, characters=STRIP)).dictionary_encode()
    places = np.array([zlib.crc32(w.encode()) & BUCKETS - 1 if w else -1 for w in listed(coded.dictionary)], dtype=np.int64)
    return places[coded.indices.to_numpy()]


def presence(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of all distinct pairs, sorted by text."""
    codes, words, first = word_codes(texts)
    buckets = buckets_of(words)[codes]
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    pairs = np.unique((owner << BITS | buckets)[buckets >= 0])
    return pairs >> BITS, pairs & BUCKETS - 1


def arrays_of(owner: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """One array of ints for each of n rows; owner is sorted."""
    return pa.ListArray.from_arrays(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32), values.astype(np.int32))


def featurise(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, kept columns and the sorted distinct buckets of each whole text."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select("doc_id", *keep).schema)

    def run(*columns: pa.Array) -> list:
        return [*columns[:-1], arrays_of(*presence(columns[-1]), len(columns[-1]))]

    return map_columns(docs.select("doc_id", *keep, text_of(docs).alias("text")), run, f"{schema}, buckets array<int>", raw=True)


def reduced(docs: DataFrame, places: np.ndarray, *keep: str) -> DataFrame:
    """Kept columns and, of each whole text (the last column), the sorted numbers of the places that it has."""
    number = np.full(BUCKETS, -1, np.int32)
    number[places] = np.arange(len(places))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)

    def run(*columns: pa.Array) -> list:
        owner, bucket = presence(columns[-1])
        at = number[bucket]
        return [*columns[:-1], arrays_of(owner[at >= 0], at[at >= 0], len(columns[-1]))]

    return map_columns(docs.select(*keep, "text"), run, f"{schema}at array<int>", raw=True)


class Sparse:
    """Rows of distinct buckets in compressed form, over the buckets seen in training only."""

    def __init__(self, rows: list, places: np.ndarray):
        sizes = [len(r) for r in rows]
        flat = np.concatenate([np.asarray(r, dtype=np.int64) for r in rows]) if rows else np.empty(0, np.int64)
        at = np.searchsorted(places, flat)
        hit = (at < len(places)) & (places[np.minimum(at, max(0, len(places) - 1))] == flat) if len(places) else np.zeros(len(flat), bool)
        self.owner, self.at, self.n = np.repeat(np.arange(len(rows)), sizes)[hit], at[hit], len(rows)

    def some(self, rows: np.ndarray) -> Sparse:
        """The rows that are marked."""
        out, number = object.__new__(Sparse), np.cumsum(rows) - 1
        hit = rows[self.owner]
        out.owner, out.at, out.n = number[self.owner[hit]], self.at[hit], int(rows.sum())
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, w[self.at], minlength=self.n)

    def back(self, g: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.at, np.rint(g[self.owner] * UNIT), minlength=width) / UNIT


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def nnpu_risk(g_p: np.ndarray, g_u: np.ndarray, prior: float) -> tuple[float, float]:
    """(positive part, negative part) of the class-prior-corrected risk with the logistic loss."""
    return prior * np.logaddexp(0, -g_p).mean(), np.logaddexp(0, g_u).mean() - prior * np.logaddexp(0, g_p).mean()


class Listed:
    """Unlabelled rows at hand."""

    def __init__(self, rows: list):
        self.rows, self.n = rows, len(rows)

    def shares(self, places: np.ndarray) -> np.ndarray:
        u = Sparse(self.rows, places)
        return u.back(np.ones(u.n), len(places))

    def narrow(self, places: np.ndarray) -> None:
        self.u = Sparse(self.rows, places)

    def step(self, w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
        """Sums over all rows: loss of calling them negative, its gradient by weights and by bias."""
        g = self.u.dot(w) + b
        d = sigmoid(g)
        return np.rint(np.logaddexp(0, g) * UNIT).sum() / UNIT, self.u.back(d, len(w)), np.rint(d * UNIT).sum() / UNIT


class Spread:
    """All unlabelled documents (doc_id, text) of a table, seen through the same sums, taken in the cluster."""

    def __init__(self, docs: DataFrame, cut: Cut):
        self.docs, self.cut, self.n = ready(docs.sparkSession) and docs.select(text_of(docs).alias("text")), cut, 0

    def shares(self, places: np.ndarray) -> np.ndarray:
        """In how many documents each place occurs: every task sends a number for each place at most."""
        places = places.astype(np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(BUCKETS, np.int64), 0
            for batch in batches:
                for lo, k in slices(batch.columns, 4000):
                    total += np.bincount(presence(batch.slice(lo, k).column(0))[1], minlength=BUCKETS)
                n += batch.num_rows
            found = places[total[places] > 0]
            yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1).astype(np.int32)), pa.array(np.append(total[found], n))], ["place", "n"])

        rows = self.docs.mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
        at, n = rows["place"].to_numpy(), rows["n"].to_numpy()
        out = np.zeros(BUCKETS, np.int64)
        out[at[at >= 0]] = n[at >= 0]
        self.n = int(n[at < 0].sum())
        return out[places]

    def narrow(self, places: np.ndarray) -> None:
        """Reduces documents to these places and counts equal ones."""
        patterns = reduced(self.docs, places)
        self.u = self.cut(patterns.groupBy("at").agg(F.count("*").alias("n")))

    def step(self, w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grad, loss, bias = np.zeros(len(w), np.int64), 0, 0
            whole = lambda x: np.rint(x).astype(np.int64)
            for batch in batches:
                for lo, k in slices(batch.columns, 4000):
                    part = batch.slice(lo, k)
                    lists, n = part["at"], part["n"].to_numpy()
                    at, owner = lists.flatten().to_numpy(), np.repeat(np.arange(k), lists.value_lengths().to_numpy())
                    g = np.bincount(owner, w[at], minlength=k) + b
                    d = whole(sigmoid(g) * UNIT) * n
                    np.add.at(grad, at, d[owner])
                    loss, bias = loss + int((whole(np.logaddexp(0, g) * UNIT) * n).sum()), bias + int(d.sum())
            hit = np.flatnonzero(grad)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, [-1, -2]).astype(np.int32)), pa.array(np.append(grad[hit], [loss, bias]))], ["at", "x"])

        sums = self.u.mapInArrow(run, "at int, x long").groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).cast("double").alias("x"))
        rows = sums.toArrow()
        at, x = rows["at"].to_numpy(), rows["x"].to_numpy() / UNIT
        grad = np.zeros(len(w))
        grad[at[at >= 0]] = x[at >= 0]
        return float(x[at == -1].sum()), grad, float(x[at == -2].sum())


def screened(counts: np.ndarray, n_p: int, shares: np.ndarray, n_u: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, share in U) of the words whose shares in P and U differ by SCREEN standard errors."""
    q = (shares + 1.0) / (n_u + 2)
    p = counts / n_p
    apart = np.abs(p - q) / np.sqrt(q * (1 - q) * (1 / n_p + 1 / max(1, n_u)))
    places = np.flatnonzero((apart >= SCREEN) & ((p < q) | (counts >= min(LEAST, n_p))))
    return places, q[places]


def train_nnpu(rows_p: list, unlabelled: list, prior: float, steps: int = STEPS, rate: float = RATE) -> tuple[np.ndarray, np.ndarray, float]:
    """(places, weights, bias) of the linear model, from rows of buckets at hand."""
    every, p, u = np.arange(BUCKETS), Listed(rows_p), Listed(unlabelled)
    places, q = screened(p.shares(every), p.n, u.shares(every), u.n)
    u.narrow(places)
    return places, *descended(Sparse(rows_p, places), u, prior, q, steps, rate)


def descended(p: Sparse, u: Listed | Spread, prior: float, q: np.ndarray, steps: int = STEPS, rate: float = RATE, z: float = 2.0) -> tuple[np.ndarray, float]:
    """(weights, bias) by full-batch Adam with soft thresholding.

    A word's threshold is z standard errors of its pull on the risk under chance, so words that are as
    common in U as in P stay at zero whether P holds thirty documents or thousands.
    """
    n_u, width = max(1, u.n), len(q)
    sparsity = z * prior * np.sqrt(q * (1 - q) * (1 / p.n + 1 / n_u))
    w, b = np.zeros(width), float(np.log(prior / (1 - prior + 1e-9)))
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for step in range(1, steps + 1):
        g_p = p.dot(w) + b
        loss, grad, grad_b = u.step(w, b)
        d_p = sigmoid(g_p)
        if loss / n_u - prior * exact_mean(np.logaddexp(0, g_p)) >= 0:
            up, sign = np.full(p.n, -prior), 1.0  # l'(g) - l'(-g) is -1 for the logistic loss
        else:  # the corrected part is negative: step against it
            up, sign = prior * d_p, -1.0
        grad, grad_b = p.back(up, width) / p.n + sign * grad / n_u, exact_mean(up) + sign * grad_b / n_u
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mb, vb = 0.9 * mb + 0.1 * grad_b, 0.99 * vb + 0.01 * grad_b**2
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        pace = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))  # falls to zero over the second half
        scale = pace / (np.sqrt(v / c2) + 1e-4)
        w = w - scale * m / c1
        w = np.sign(w) * np.maximum(0, np.abs(w) - scale * sparsity)
        b -= pace * mb / c1 / (np.sqrt(vb / c2) + 1e-4)
    return w, b


def exact_mean(x: np.ndarray) -> float:
    """The mean in whole units: the same in any order."""
    return float(np.rint(x * UNIT).sum() / UNIT / len(x))


def calibrate(g: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve from raw scores to chances (Newton's method, smoothed targets)."""
    order = np.lexsort((y, g))  # sums of doubles depend on it
    g, y = g[order], y[order]
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        q = sigmoid(a * g + c)
        d, h = q - t, q * (1 - q) + 1e-9
        ga, gc = (d * g).sum() + 1e-3 * (a - 1), d.sum()
        haa, hac, hcc = (h * g * g).sum() + 1e-3, (h * g).sum(), h.sum()
        det = haa * hcc - hac**2
        if abs(det) < 1e-12:
            break
        a, c = a - np.clip((hcc * ga - hac * gc) / det, -2, 2), c - np.clip((haa * gc - hac * ga) / det, -2, 2)
    return max(0.05, float(a)), float(c)


def training_labels(labels: DataFrame) -> DataFrame:
    """doc_id, toxic (one row per document) of the rows that training may see."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    return known.where(crc_mod3(F.col("doc_id")) != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def first_by_hash(rows: DataFrame, size: int) -> DataFrame:
    """The doc_ids of `size` rows at most, by a hash of the id: the same at any number of partitions."""
    return rows.orderBy(F.xxhash64("doc_id", F.lit(2)), "doc_id").limit(size).select("doc_id")


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The model: places and weights of words, bias, slope and intercept of the calibration, prior."""
    cut = Cut(ready(docs.sparkSession))
    seen = training_labels(labels)
    counts = seen.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    n, n_p = counts["n"], counts["toxic"] or 0
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    nothing = {"weights": {}, "bias": -40.0, "slope": 1.0, "intercept": 0.0, "prior": 0.0}
    if not n_p:
        return nothing
    mark = lambda name: F.lit(True).alias(name)
    in_p, in_c = first_by_hash(seen.where("toxic = 1"), SAMPLE_P).select("doc_id", mark("in_p")), first_by_hash(seen, SAMPLE_C).select("doc_id", mark("in_c"))
    # the samples are bounded by the parameters above, so their ids can be broadcast
    ids = F.broadcast(cut(seen.join(in_p, "doc_id", "left").join(in_c, "doc_id", "left").where("in_p OR in_c")))
    labelled = cut(plain.join(ids, "doc_id").select("toxic", F.coalesce("in_p", F.lit(False)).alias("in_p"), F.coalesce("in_c", F.lit(False)).alias("in_c"), "text"))
    every = np.arange(BUCKETS)
    confirmed = Spread(labelled.where("in_p"), cut)
    counts = confirmed.shares(every)
    if not confirmed.n:
        return nothing
    prior = n_p / n
    free = Spread(plain.where(F.coalesce(crc_mod3(F.col("doc_id")), F.lit(0)) != 1), cut)
    places, q = screened(counts, confirmed.n, free.shares(every), free.n)
    free.narrow(places)
    # of the labelled sample the driver gets the screened places only, as Arrow arrays
    rows = reduced(labelled, places, "toxic", "in_p", "in_c").toArrow().combine_chunks()
    lists = rows["at"].combine_chunks()
    sample = object.__new__(Sparse)
    sample.n, sample.at = rows.num_rows, lists.flatten().to_numpy().astype(np.int64)
    sample.owner = np.repeat(np.arange(sample.n), lists.value_lengths().to_numpy())
    toxic, in_p, in_c = (np.asarray(rows[c].to_pylist()) for c in ("toxic", "in_p", "in_c"))
    w, b = descended(sample.some(in_p), free, prior, q)
    cut.drop(free.u, labelled)
    known = in_c if in_c.any() else np.ones(len(in_c), bool)
    a, c = calibrate(sample.some(known).dot(w) + b, toxic[known])
    keep = np.flatnonzero(w)
    return {"weights": dict(zip(places[keep].tolist(), w[keep].tolist(), strict=True)), "bias": float(b), "slope": a, "intercept": c, "prior": prior}


def score_of(spark: SparkSession, text: Column, model: dict) -> Column:
    """The score of a whole text; only the text goes to Python and only the score comes back."""
    weights = np.zeros(BUCKETS)
    weights[list(model["weights"])] = list(model["weights"].values())
    shared = ready(spark).sparkContext.broadcast(weights)  # BUCKETS doubles, whatever the input
    bias, slope, intercept = model["bias"], model["slope"], model["intercept"]

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        out = [np.empty(0)]
        for lo, n in slices([texts], 4000):
            owner, bucket = presence(texts.slice(lo, n))
            g = np.bincount(owner, shared.value[bucket], minlength=n) + bias
            out.append(sigmoid(slope * g + intercept))
        return pa.array(np.concatenate(out))

    return scored(text)


def score(docs: DataFrame, model: dict, *keep: str) -> DataFrame:
    """doc_id, kept columns, score of each whole text."""
    return docs.select("doc_id", *keep, score_of(docs.sparkSession, text_of(docs), model).alias("score"))


def op2_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (F.coalesce(crc_mod3(F.col("doc_id")), F.lit(0)) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model does not reject, with their columns."""
    return docs.where(score_of(docs.sparkSession, text_of(docs), fit(docs, labels)) < THRESHOLD)
