"""Operators on small tables: sources and sinks, models, rules on pairs, forms of many scripts, and sizes of plans."""

import unicodedata

import pytest
import regex
from pyspark.sql import functions as F

from tallyframe.functions import text as t
from tallyframe.operators import evaluation as ev
from tallyframe.operators import extra, names, order_stats, pairing, phones, profile
from tallyframe.plans import registry
from tallyframe.sources import files


def test_files_in_and_out(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x, y"), ("b", 'say "hi"'), ("c", None)], "id string, label string")
    files.write_report(rows, str(tmp_path / "r"))
    back = files.csv(spark, str(tmp_path / "r"), "id string, label string")
    assert sorted(map(tuple, back.collect()), key=str) == [("a", "x, y"), ("b", 'say "hi"'), ("c", None)]
    assert files.csv(spark, str(tmp_path / "r"), "id string, label string", {"label": ("x, y",)}).count() == 1
    files.write_table(rows, str(tmp_path / "t"), "id")
    assert files.parquet(spark, str(tmp_path / "t"), "label").columns == ["label"]
    files.write_program(spark, {"instructions": "é", "demos": [1]}, str(tmp_path / "p"))
    assert files.read_program(spark, str(tmp_path / "p")) == {"instructions": "é", "demos": [1]}
    files.write_text(rows, str(tmp_path / "x"))
    assert files.present(spark, {"p": str(tmp_path / "p"), "x": str(tmp_path / "x"), "none": str(tmp_path / "none")}).keys() == {"p", "x"}
    with pytest.raises(FileNotFoundError):
        files.present(spark, {"none": str(tmp_path / "none")}, 1)


def test_missing_columns_and_names(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id long, actual string")
    out = profile.conform(df, {"correct_answer": "", "note": "-"}, {"actual": "correct_answer"}).orderBy("id").collect()
    assert [tuple(r) for r in out] == [(1, "", "-"), (2, "x", "-")]


def test_medians(spark):
    import statistics

    values = {"a": [1.0, 5.0, 2.0, 2.0], "b": [3.0], "c": [None, None], "d": [1.0, 2.0, 9.0, None]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double")
    got = {r["k"]: r["median"] for r in order_stats.medians(df, ["k"], F.col("v")).collect()}
    assert got == {k: statistics.median(x) if (x := [v for v in vs if v is not None]) else None for k, vs in values.items()}


def test_pairs_of_a_group(spark):
    df = spark.createDataFrame([("1", f"n{i}", i, "p") for i in range(5)] + [("2", "x", 0, "p"), ("1", " ", 9, "p"), (None, "y", 0, "p")], "id string, name string, position int, provider string")
    assert pairing.pair_up(df).count() == 10


def test_relation_and_construction(spark):
    df = spark.createDataFrame([("Roma", "Roma Hotel in Berlin", "hotel in berlin"), ("Roma", "Roma Hotel", "hotel"), ("Roma", "Roma", ""), ("Roma", "Roma xyz", "xyz")], "s string, l string, e string")
    got = df.select(extra.relation(F.col("s"), F.col("l"), F.col("e")).alias("r"), extra.construct(F.col("s"), F.col("l"), F.col("e")).alias("c")).collect()
    assert [tuple(r) for r in got] == [("compound", "Roma Hotel"), ("business", "Roma Hotel"), ("none", None), ("other", None)]


def test_failing_predictors_give_null_rows(spark):
    def predictor(batch):
        if (batch["id"] == 2).any():
            raise ValueError
        return batch.assign(predicted="ok")[["id", "predicted"]]

    got = ev.predict(spark.range(4).coalesce(1), predictor, "id long, predicted string").collect()
    assert sum(r["predicted"] is None for r in got) == 1 and sum(r["predicted"] == "ok" for r in got) == 3


SCRIPTS = ["ローソン いわき下好間店", "ﾛｰｿﾝ", "ガーデン・カフェ", "วัดห้วยปราบ ต. บ่อวิน", "한국 식당", "Ｃａｆé  Roma", "Église & Fils", "日本 料理", "", " ", "Straße 12", "パン屋", "ぱん屋", None, "it's", "①②", "Ǆ café", "a\u0301b"]


def in_python(s):
    fold = t.fold_text(s)
    nc = regex.sub(r"[ \t\n\r\x0b\f]+", " ", regex.sub(r"[^\p{L}\p{N}\p{M} \t\n]", "", fold.lower())).strip(" ")
    kana = "".join(chr(ord(x) - 0x60) if 0x30A1 <= ord(x) <= 0x30F6 else x for x in fold)
    hira = regex.sub(r"[ \t\n\r\x0b\f]+", " ", regex.sub(r"[^\p{L}\p{N}\p{M} \t\n]", "", t.fold_text(kana).lower())).strip(" ")
    return {"nc": nc, "ns": nc.replace(" ", ""), "sorted": " ".join(sorted(nc.split(" "))), "hira": hira}


def test_forms_of_many_scripts(spark):
    """Kana, kanji, Thai, Hangul, wide letters, marks, null and empty names, against Python."""
    df = spark.createDataFrame([(str(i), s, SCRIPTS[-1 - i]) for i, s in enumerate(SCRIPTS)], "id string, alt_name string, base_name string")
    for r in names.with_forms(df).collect():
        for side in ("alt", "base"):
            want = in_python(r[f"{side}_name"]) if r[f"{side}_name"] is not None else dict.fromkeys(("nc", "ns", "sorted", "hira"))
            if r["alt_nc"] and r["alt_nc"] == r["base_nc"]:  # decided by the first form
                want |= {"sorted": None, "hira": None}
            assert {k: r[f"{side}_{k}"] for k in want} == want, r[f"{side}_name"]
    assert {r["stage"] for r in names.staircase(df).collect()} == {*names.STAGES, "S9_typo"}
    marks = {r["mark"]: r["either_rows"] for r in names.unicode_summary(df).collect()}
    has = lambda s, mark: mark in unicodedata.normalize("NFD", s or "")
    assert marks["handakuten"] == sum(has(s, "\u309a") or has(SCRIPTS[-1 - i], "\u309a") for i, s in enumerate(SCRIPTS))


def test_plans_stay_small(spark):
    """Forms are computed once: the optimized plans hold each expression a few times at most."""
    sf = "/root/testdata/sf0.001"
    for name in ("name_subtags", "golden_summary", "compound_scan", "name_tier1_summary", "name_staircase_full", "phone_conf_detail"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert len(plan) < 100_000, (name, len(plan))
    plan = phones.staged_report(registry.phone_pairs(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 4
