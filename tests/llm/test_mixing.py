from pyspark.sql import functions as F

from tallyframe.llm import mixing as M
from tests.llm.helpers import AWKWARD, docs

TARGETS = {"source": {"a": 0.5, "b": 0.3, M.OTHER: 0.2}, "lang": {"en": 0.6, "fr": 0.4}, "topic": {"numeric": 0.1, "list": 0.2, "long": 0.3, "prose": 0.4}}


def test_raking_meets_all_marginals():
    cells = {(s, g, t): 1.0 + i for i, (s, g, t) in enumerate((s, g, t) for s in TARGETS["source"] for g in TARGETS["lang"] for t in TARGETS["topic"])}
    mass = M.rake(cells, TARGETS)
    for k, d in enumerate(M.DIMENSIONS):
        for v, want in TARGETS[d].items():
            assert abs(sum(x for c, x in mass.items() if c[k] == v) - want) < 1e-6


def test_probabilities_spend_the_budget():
    cells = {("a",): 100.0, ("b",): 10.0, ("c",): 50.0}
    p = M.probabilities(cells, {("a",): 0.2, ("b",): 0.7, ("c",): 0.1}, 60.0)
    assert p[("b",)] == 1.0 and abs(sum(p[c] * cells[c] for c in cells) - 60) < 1e-9 and max(p.values()) <= 1


def test_sample_follows_targets(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 20).alias("text"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise("zzz").alias("source"), F.when(F.col("id") % 5 < 4, "en").otherwise("fr").alias("lang"), F.lit(100).cast("long").alias("n_chars"))
    kept = M.mix(df, TARGETS, 0.4).where("m_kept")
    total = kept.count()
    by = {r["m_source"]: r["count"] / total for r in kept.groupBy("m_source").count().collect()}
    assert abs(by["a"] - 0.5) < 0.03 and abs(by["b"] - 0.3) < 0.03 and abs(total / 6000 - 0.4) < 0.03


def test_awkward_rows(spark):
    d = docs(spark, AWKWARD).withColumn("source", F.lit(None).cast("string"))
    out = M.mix(d)
    assert out.count() == len(AWKWARD) and set(r["m_source"] for r in out.collect()) == {M.OTHER}
    assert M.mix(docs(spark, [])).count() == 0


def test_query_reaches_the_targets(spark):
    out = M.op1_mix_ipf(spark, "/root/testdata/sf0.1")
    weight = F.col("m_tokens") * (F.col("copies") if "copies" in out.columns else F.col("kept").cast("long"))
    rows = out.groupBy("m_source", "m_lang", "m_topic").agg(F.sum("m_tokens").alias("n"), F.sum(weight).alias("kept")).collect()
    total = sum(r["kept"] for r in rows)
    assert abs(total / sum(r["n"] for r in rows) - M.BUDGET) < 0.02
    for d, targets in M.TARGETS.items():
        there = {v: w for v, w in targets.items() if any(r[f"m_{d}"] == v and r["n"] for r in rows)}
        for v, w in there.items():
            got = sum(r["kept"] for r in rows if r[f"m_{d}"] == v) / total
            print(d, v, round(w / sum(there.values()), 4), round(got, 4))
            assert abs(got - w / sum(there.values())) < 0.01


def test_zero_targets_drop_and_columns_survive(spark):
    df = docs(spark, ["some words here"] * 30 + [""]).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "de").otherwise("en")).withColumn("_t", F.lit("kept")).withColumn("_topic", F.lit(1)).withColumn("m_prob", F.lit("old"))
    for repeats in (True, False):
        out = M.mix(df.where("text <> ''"), {"lang": {"en": 1.0}}, 0.5, repeats).collect()
        assert {r["lang"] for r in out if r["m_kept"]} == {"en"} and all(r["m_prob"] == 0 for r in out if r["lang"] == "de")
        assert {r["_t"] for r in out} == {"kept"} and {r["_topic"] for r in out} == {1} and len(out) == 30
    empty = M.mix(df.where("text = ''"), {"lang": {"en": 1.0}}).collect()
    assert [r["m_kept"] for r in empty] == [True]  # a cell without tokens


def test_query_against_plain_python(spark):
    """All documents of a table, counted, raked and drawn again without Spark."""
    import hashlib
    import re

    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    cells, of = {}, {}
    for r in rows:
        t = r["text"] or ""
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t))
        topic = "numeric" if len(re.findall("[0-9]", t)) * 50 >= len(t) else "list" if (t.count("\n") + 1) * 120 >= len(t) else "long" if len(t) >= 6000 else "prose"
        c = tuple(v if v in M.TARGETS[d] else M.OTHER for d, v in (("source", r["source"]), ("lang", r["lang"]), ("topic", topic)))
        cells[c] = cells.get(c, 0) + n
        of[r["doc_id"]] = (c, n)
    mass = M.rake({c: float(n) for c, n in cells.items()}, M.TARGETS)
    rate = M.rates({c: float(n) for c, n in cells.items()}, mass, M.BUDGET * sum(cells.values()))
    for r in M.op1_mix_ipf(spark, sf).collect():
        c, n = of[r["doc_id"]]
        x = rate.get(c, 1.0)
        draw = int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:8], 16) / 2**32
        assert (r["m_source"], r["m_lang"], r["m_topic"], r["m_tokens"]) == (*c, n)
        assert r["copies"] == int(x) + (draw < x - int(x)) and r["kept"] == (r["copies"] > 0) and abs(r["prob_ppm"] - min(x, 1) * 1e6) <= 1
