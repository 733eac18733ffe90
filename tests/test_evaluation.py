"""Intervals and searches over demonstrations against plain Python."""

import hashlib
import math

from pyspark.sql import functions as F

from tallyframe.operators import evaluation as ev


def weight(key, draw):
    u = int(hashlib.md5(f"{key}#{draw}".encode()).hexdigest()[:8], 16) / (1 << 32)
    k, total = 0, math.exp(-1)
    while k < 7 and math.floor(total * (1 << 32)) <= u * (1 << 32):
        k += 1
        total += math.exp(-1) / math.factorial(k)
    return k


def test_interval_of_an_accuracy(spark):
    rows = [(i, "ab"[i % 2] if i % 11 else None, "x", "x" if i % 3 else (None if i % 2 else "y")) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, g string, truth string, pred string")
    got = {r["g"]: r for r in ev.accuracy_interval(df, "id", "truth", "pred", ["g"], 40, 0.9).collect()}
    assert set(got) == {"a", "b", None}
    for g, r in got.items():
        own = [(i, t == p) for i, x, t, p in rows if x == g]
        shares = []
        for b in range(40):
            w = [weight(i, b) for i, _ in own]
            if sum(w):
                shares.append(sum(x * ok for x, (_, ok) in zip(w, own, strict=True)) / sum(w))
        shares.sort()
        at = lambda q: shares[max(1, math.ceil(len(shares) * q)) - 1]  # noqa: B023, E731
        assert (r["row_count"], r["correct"], r["low"], r["high"]) == (len(own), sum(ok for _, ok in own), at((1 - 0.9) / 2), at((1 + 0.9) / 2))
        assert r["low"] <= r["accuracy"] <= r["high"]
    whole = ev.accuracy_interval(df, "id", "truth", "pred", draws=40).first()
    assert whole["row_count"] == 120 and whole["low"] < whole["accuracy"] < whole["high"]
    assert ev.accuracy_interval(df.limit(0), "id", "truth", "pred", ["g"]).count() == 0


def test_poisson_weights_have_mean_one(spark):
    w = spark.range(20_000).select(ev.poisson_weight(F.col("id"), F.lit(1)).alias("w")).agg(F.avg("w"), F.variance("w")).first()
    assert abs(w[0] - 1) < 0.03 and abs(w[1] - 1) < 0.05


def test_search_over_demonstrations(spark):
    train = [(f"t{i}", f"{'grand hotel' if i % 2 else 'steel works'} n{i}", "stay" if i % 2 else "work") for i in range(40)]
    valid = [(f"v{i}", f"{['hotel', 'works', 'other', ''][i % 4]} m{i} n{i}", "stay" if i % 4 in (0, 2) else "work") for i in range(60)]
    frame = lambda rows: spark.createDataFrame(rows, "id string, text string, label string")
    candidates = spark.range(5).withColumnRenamed("id", "candidate")
    demos = ev.drawn_demos(frame(train), candidates, 3)
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    shown = {c: sorted(train, key=lambda r: (md5(f"{r[0]}#{c}"), r[0]))[:3] for c in range(5)}  # noqa: B023
    assert {(r["candidate"], r["id"]) for r in demos.collect()} == {(c, r[0]) for c, rs in shown.items() for r in rs}

    def says(c, text):
        met = [(-len(set(t.lower().split()) & set(text.lower().split())), lab) for _, t, lab in shown[c]]
        best = min((m for m in met if m[0]), default=None)
        return best and best[1]

    order, left, want = sorted(valid, key=lambda r: (md5(f"{r[0]}42"), r[0])), list(range(5)), []
    for rung in range(3):
        rows = order[: 10 << rung]
        scores = {c: sum(says(c, t) == lab for _, t, lab in rows) for c in left}
        ranked = sorted(left, key=lambda c: (-scores[c], c))  # noqa: B023
        kept = ranked[: math.ceil(len(left) / 2)]
        want += [(rung, c, len(rows), scores[c], c in kept) for c in left]
        left = kept
    got = ev.demo_search(candidates, frame(valid), ev.nearest_demo(demos, "text", "label"), "label", first=10).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_rows_on_which_a_model_fails_get_the_given_label(spark):
    def predictor(batch):
        if (batch["id"] == 2).any():
            raise ValueError("no answer")
        return batch.assign(predicted="fine")

    got = ev.predict(spark.range(5).coalesce(1), predictor, "id long, predicted string", {"predicted": "error"}).collect()
    assert sorted(map(tuple, got)) == [(0, "fine"), (1, "fine"), (2, "error"), (3, "fine"), (4, "fine")]
