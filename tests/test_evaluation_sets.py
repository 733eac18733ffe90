import csv
import json

import pandas as pd
import pytest

from tallyframe.sources import evaluation_sets as e

COLUMNS = {"id": "long", "note": "string", "label": "string"}


def read(spark, paths, **more):
    return e.read_sets(spark, {k: str(p) for k, p in paths.items()}, COLUMNS, ["id", "label"], {"label": ("yes", "no")}, **more)


def test_reasons_order_of_columns_and_missing_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note,label\n1,"two\nlines, ""quoted""",yes\n2,,maybe\n3,x,\nfour,x,no\n5,x,no,more\n6\n7,NULL,no\n')
    (tmp_path / "b.csv").write_text("other,label,id\n.,no,8\n.,None,9\n")
    (tmp_path / "c.csv").write_text("id,note\n10,x\n")
    (tmp_path / "d.csv").write_text("id,note,label\n")
    sets = read(spark, {k: tmp_path / f"{k}.csv" for k in "abcde"})
    assert sets.count() == 10
    assert sorted(map(tuple, e.usable(sets).collect())) == [("a", 1, 'two\nlines, "quoted"', "yes"), ("a", 7, None, "no"), ("b", 8, None, "no")]
    bad = [(r["set_name"], r["reason"], r["raw"]) for r in e.rejected(sets).collect()]
    assert sorted(x[:2] for x in bad) == sorted([("a", "not valid: label"), ("a", "no value: label"), ("a", "not a long: id"), ("a", "malformed"), ("a", "malformed"), ("b", "no value: label"), ("c", "no column: label")])
    assert {x[2] for x in bad if x[1] == "malformed"} == {"5,x,no,more", "6"}
    assert [json.loads(x[2]) for x in bad if x[0] == "c"] == [{"id": "10", "note": "x"}]
    assert e.rejected(sets).count() == 7 and e.rejected(sets).select("set_name").where("set_name = 'a'").count() == 5


def test_too_few_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,note,label\n1,x,yes\n")
    with pytest.raises(FileNotFoundError):
        read(spark, {"a": tmp_path / "a.csv", "b": tmp_path / "b.csv"}, least=2)


def test_same_rows_as_a_plain_reader(spark, tmp_path):
    texts = ["plain", "with, comma", 'with "marks"', "two\nlines", "NA", "n/a", "", "Null", "  spaces  ", "ünï", "back\\slash"]
    with open(tmp_path / "t.csv", "w", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(["id", "note", "label"])
        out.writerows([k, texts[k % 11], ["yes", "no", "maybe", "", "NaN"][k // 11 % 5]] for k in range(220))
    df = pd.read_csv(tmp_path / "t.csv").dropna(subset=["id", "label"])
    want = [(k, None if pd.isna(n) else n, x) for k, n, x in df[df["label"].isin(["yes", "no"])].itertuples(index=False)]
    got = e.usable(read(spark, {"t": tmp_path / "t.csv"})).select("id", "note", "label").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 88
