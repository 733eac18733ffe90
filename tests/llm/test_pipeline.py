import re

import corpus_pipeline as C
from tallyframe.llm.common import Cut, settled
from tests.llm.helpers import AWKWARD


def test_stages_in_order(spark):
    sf = "/root/testdata/sf0.01"
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    names = docs.columns
    for name, stage in C.STAGES[:-1]:
        before = docs.count()
        docs = settled(Cut(spark), lambda stage=stage, docs=docs: stage(spark, docs, sf))
        assert docs.columns == names and 0 < docs.count() <= before
        seen.append(name)
        if name == "private_data":
            assert not [r for r in docs.collect() if re.search(r"[a-z]+\.[0-9]+@mail", r["text"] or "")]
    out = C.STAGES[-1][1](spark, docs, sf).toPandas()
    assert set(out.doc_id) == {r["doc_id"] for r in docs.collect()}
    assert [*seen, C.STAGES[-1][0]] == ["toxicity", "near_copies", "private_data", "mixture", "packing"]


def test_run_on_awkward_and_empty_tables(spark, tmp_path):
    """Null, empty and very long texts, repeated rows, null ids, an extra column with a name of the stages' own."""
    texts = [*AWKWARD, "mail a.b@mail.example or +1 (386) 555-3733 now", *[f"plain words number {i} that stand here" for i in range(40)]]
    rows = [(i if i != 12 else None, t, "en" if i % 2 else None, "src0" if i % 3 else None, None if t is None else len(t), "x") for i, t in enumerate(texts)]
    rows += rows[6:9]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    labels = "doc_id long, quality int, toxic int"
    for name, part in (("full", rows), ("empty", [])):
        sf = str(tmp_path / name)
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(i, 0, 0) for i in range(20)] if part else [], labels).coalesce(1).write.parquet(f"{sf}/labels.parquet")
        out = C.run(spark, sf).collect()
        assert bool(out) == bool(part)
        for r in out:
            assert r["length"] * 4 == len(r["token_bytes"]) and 0 <= r["offset"] <= 2048 - r["length"]
        if part:
            ids = {r["doc_id"] for r in out}
            assert 4 in ids and 7 not in ids  # equal texts: the first stays
