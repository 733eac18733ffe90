import zlib

import numpy as np

from tallyframe.llm import toxicity as X
from tests.llm.helpers import AWKWARD, docs


def test_risk_is_corrected_and_training_separates():
    rng = np.random.default_rng(0)
    noise = lambda: rng.choice(np.arange(1000, 1400), 30, replace=False)
    p = [np.append(noise(), rng.choice(5, 2)) for _ in range(60)]
    u = [noise() if i % 10 else np.append(noise(), rng.choice(5, 2)) for i in range(600)]
    places, w, b = X.train_nnpu(p, u, 0.1)
    g_p, g_n = X.Sparse(p, places).dot(w) + b, X.Sparse([x for i, x in enumerate(u) if i % 10], places).dot(w) + b
    assert (g_p[:, None] > g_n[None]).mean() > 0.95
    assert X.nnpu_risk(np.array([9.0]), np.array([-9.0]), 0.5)[1] < 0  # what the training steps against


def test_awkward_rows_and_no_positives(spark):
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    d = docs(spark, AWKWARD)
    model = X.fit(d, labels)
    assert {r["score"] for r in X.score(d, model).collect()} == {float(X.sigmoid(np.float64(-40.0)))}
    assert X.keep_clean(d, labels).count() == len(AWKWARD) and X.keep_clean(d.limit(0), labels).count() == 0


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    out = X.op2_toxicity_nnpu(spark, sf)
    rows = out.join(spark.read.parquet(f"{sf}/labels.parquet").dropDuplicates(["doc_id"]), "doc_id").where("held_out").select("toxic", "predicted", "score").toPandas()
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    right = rows[rows.predicted == 1].toxic.mean()
    assert right > 0.85 and (rows.predicted == rows.toxic).mean() > 0.9
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) == bool(h) for i, h in out.select("doc_id", "held_out").limit(50).collect())


def test_sums_over_the_cluster_are_those_in_memory(spark):
    """Counts, reduced rows and sums of a step are the same bit by bit, on any number of partitions; texts without words count too."""
    from tallyframe.llm.common import Cut

    for d in (docs(spark, [*AWKWARD, "bad words", "bad words here", "good words"] * 3), docs(spark, [None, "", " \t"])):
        rows = [r["buckets"] for r in X.featurise(d).collect()]
        places = np.unique(np.asarray([x for r in rows for x in r], dtype=np.int64))
        near = X.Listed(rows)
        for parts in (1, 4, 9):
            far = X.Spread(d.repartition(parts), Cut(spark))
            assert np.array_equal(near.shares(places), far.shares(places)) and near.n == far.n == d.count()
            some = places[::2]
            near.narrow(some)
            far.narrow(some)
            w = np.linspace(-1, 1, len(some))
            for a, b in zip(near.step(w, 0.3), far.step(w, 0.3), strict=True):
                assert np.array_equal(a, b)


def test_the_model_is_that_in_memory_on_any_number_of_partitions(spark):
    """The whole training against the same steps over rows at hand."""
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.zipf(1.3) % 900}"
    texts = [" ".join([*(word() for _ in range(30)), *(["vile", "foul", "nasty"][: rng.integers(1, 4)] if i % 6 == 0 else ["kind"] * (i % 2))]) for i in range(900)]
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(0, 900, 2)], "doc_id long, toxic int")
    models = [X.fit(d.repartition(n), labels) for n in (3, 8)]
    assert models[0] == models[1] and models[0]["weights"]
    seen = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = {r["doc_id"]: r["buckets"] for r in X.featurise(d).collect()}
    known = [i for i in seen if i % 2 == 0]
    positive = [i for i in known if i % 6 == 0]
    places, w, b = X.train_nnpu([rows[i] for i in positive], [rows[i] for i in seen], len(positive) / len(known))
    keep = np.flatnonzero(w)
    assert models[0]["weights"] == dict(zip(places[keep].tolist(), w[keep].tolist(), strict=True)) and models[0]["bias"] == b
    assert models[0]["weights"][zlib.crc32(b"vile") & X.BUCKETS - 1] > 0


def test_columns_with_names_of_its_own_pass(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)], "doc_id long, toxic int")
    texts = [("foul nasty " if i % 2 else "kind gentle ") + f"w{i}" for i in range(150)]
    d = docs(spark, texts).selectExpr("*", "'s' AS score", "1 AS buckets", "2 AS _body")
    out = X.keep_clean(d, labels)
    assert out.columns == d.columns and 0 < out.count() < 150 and {r["score"] for r in out.collect()} == {"s"}


def test_scores_against_plain_python(spark):
    """Every document of a table, scored word by word from the fitted model."""
    import math
    import re

    sf = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    model = X.fit(d, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r["doc_id"]: r["score"] for r in X.score(d, model).collect()}
    for r in d.select("doc_id", "text").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        places = {zlib.crc32(w.encode()) & X.BUCKETS - 1 for x in words if (w := x.strip(X.STRIP).lower())}
        g = model["bias"] + sum(model["weights"].get(p, 0.0) for p in places)
        assert abs(got[r["doc_id"]] - 1 / (1 + math.exp(-(model["slope"] * g + model["intercept"])))) < 1e-9
