"""TF-IDF and the regression on it against plain Python and numpy."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tallyframe.operators import ngrams as G
from tallyframe.sources import files

TEXTS = ["Grand Hotel Roma", "grand  hotel", None, "", "a b c", "Café_9 ÉTOILE x1", "Steel works & co", "x", "ab abc abcd", "Grand Hotel Roma Grand Hotel", "été été été", "a1 b2\tc3"]


def plain_grams(text, kind):
    low = (text or "").lower()
    if kind == "word":
        t = re.findall(r"\w\w+", low)
        return t + [f"{a} {b}" for a, b in zip(t, t[1:], strict=False)]
    out = []
    for w in low.split():
        w = f" {w} "
        for n in (3, 4, 5):
            out += [w[i : i + n] for i in range(len(w) - n + 1)]
    return out


def plain_weights(texts, kind, size):
    grams = [Counter(plain_grams(t, kind)) for t in texts]
    total, df = Counter(), Counter()
    for g in grams:
        total.update(g)
        df.update(g.keys())
    vocab = sorted(sorted(total, key=lambda t: (-total[t], t))[:size])
    idf = {t: math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in vocab}
    rows = [{t: n * idf[t] for t, n in g.items() if t in idf} for g in grams]
    norm = [math.sqrt(sum(w * w for w in r.values())) for r in rows]
    return vocab, [{t: w / k for t, w in r.items()} for r, k in zip(rows, norm, strict=True)]


@pytest.mark.parametrize("kind", G.KINDS)
@pytest.mark.parametrize("size", [7, 500])
def test_weights(spark, kind, size):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").withColumns({"term": F.lit("x"), "w": F.lit(1), "grams": F.lit(2)})
    got = {(r["id"], r["term"]): r["weight"] for r in G.tfidf_weights(df, "id", "text", kind, size).collect()}
    want = {(i, t): w for i, r in enumerate(plain_weights(TEXTS, kind, size)[1]) for t, w in r.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert G.tfidf_weights(df.limit(0), "id", "text", kind).count() == 0


@pytest.mark.parametrize("kind", G.KINDS)
def test_probabilities_are_those_of_a_plain_fit(spark, kind, tmp_path):
    """The same objective, minimised by small steps in numpy: probabilities agree to 2e-3."""
    rng = np.random.default_rng(1)
    words = {"stay": ["grand", "hotel", "inn", "roma"], "work": ["steel", "works", "co", "roma"], "eat": ["cafe", "bar", "grill", "grand"]}
    rows = [(i, " ".join(rng.choice(words[k], 3)), k) for i, k in enumerate(["stay"] * 30 + ["work"] * 12 + ["eat"] * 6)]
    df = spark.createDataFrame(rows, "id long, text string, label string")
    model = G.ngram_model(df, "text", "label", kind, 40)
    got = np.asarray([r["p"] for r in model.transform(df).orderBy("id").select(F.expr("probability").alias("p")).collect()])[:, :3]
    vocab, weights = plain_weights([r[1] for r in rows], kind, 40)
    x = np.asarray([[w.get(t, 0.0) for t in vocab] for w in weights])
    names = sorted(words)
    y = np.asarray([names.index(r[2]) for r in rows])
    c = len(rows) / (3 * np.bincount(y))[y]
    w, b = np.zeros((len(vocab), 3)), np.zeros(3)
    for _ in range(30_000):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = c[:, None] * (p - np.eye(3)[y])
        w, b = w - 0.02 * (x.T @ d + w), b - 0.02 * d.sum(axis=0)
    assert np.abs(got - p).max() < 2e-3
    out = G.ngram_predictions(model, df, "label")
    assert out.columns == [*df.columns, "predicted"] and [r["predicted"] for r in out.orderBy("id").collect()] == [names[k] for k in p.argmax(axis=1)]
    files.write_model(model, str(tmp_path / kind))
    assert PipelineModel.load(str(tmp_path / kind)).transform(df).count() == len(rows)


