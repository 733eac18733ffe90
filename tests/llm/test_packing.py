import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import packing as P
from tests.llm.helpers import AWKWARD, docs

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_ids_are_the_tokenizers(texts):
    enc = P.encoder(PATH)
    ids, sizes = enc.encode(pa.array(texts, pa.string()))
    for got, text in zip(np.split(ids, np.cumsum(sizes)), [*texts, ""], strict=True):
        assert np.array_equal(got, enc.whole(text))


@given(st.lists(st.integers(1, 2048), max_size=200))
def test_tree_packs_like_plain_first_fit(lengths):
    lengths = sorted(lengths, reverse=True)
    free, want = [], []
    for n in lengths:
        k = next((i for i, f in enumerate(free) if f >= n), len(free))
        if k == len(free):
            free.append(2048)
        want.append((k, 2048 - free[k]))
        free[k] -= n
    bins, offsets = P.first_fit_decreasing(np.array(lengths, dtype=np.int64), 2048)
    assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == want


def test_pieces_cover_documents_and_fill_sequences(spark):
    rows = P.pack_documents(docs(spark, AWKWARD).drop("n_chars").withColumnRenamed("lang", "offset")).toPandas()
    assert set(rows.doc_id) == set(range(len(AWKWARD)))
    for _, g in rows.sort_values("start").groupby("doc_id"):
        assert list(g.start) == list(np.cumsum([0, *g.length[:-1]])) and g.length.sum() == g.doc_tokens.iloc[0]
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == list(np.cumsum([0, *g.length[:-1]])) and g.length.sum() <= 2048
    same = rows[rows.doc_id.isin([6, 7])]
    assert same.ids_crc32.nunique() == 1
    assert P.pack_documents(docs(spark, [])).count() == 0


def test_ids_of_whole_documents_are_the_tokenizers(spark):
    """Every document of a table, as the query encodes it, against the tokenizer itself."""
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    enc = P.WordEncoder(PATH)
    assert enc.known
    enc.memo.limit = 20_000  # emptied on the way
    for lo in range(0, len(texts), 200):
        part = texts[lo : lo + 200]
        ids, sizes = enc.encode(pa.array(part, pa.string()))
        ends = np.cumsum(sizes)
        for text, a, b in zip(part, ends - sizes, ends, strict=True):
            assert np.array_equal(ids[a:b], enc.whole(text))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abzAZéÉßÿ019'.,!-<|> \n\t"), max_size=80), max_size=6))
def test_units_are_the_tokenizers(texts):
    enc = P.encoder(PATH)
    ids, sizes = enc.encode(pa.array(texts, pa.string()))
    assert ids.tolist() == [x for t in texts for x in enc.whole(t).tolist()] and len(sizes) == len(texts)


def test_other_tokenizers_encode_whole_texts():
    enc = P.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["Upper lower", "", "x  y", "it's 42"]
    ids, sizes = enc.encode(pa.array(texts, pa.string()))
    assert not enc.known and ids.tolist() == [x for t in texts for x in enc.whole(t).tolist()] and sizes[1] == 0


def test_query_on_whole_documents_against_the_tokenizer(spark):
    """Every piece of a table: its ids, its place, and full sequences."""
    import zlib

    sf = "/root/testdata/sf0.001"
    rows = P.op4_pack_ffd(spark, sf).toPandas()
    enc = P.encoder(PATH)
    want = {r["doc_id"]: np.append(enc.whole(r["text"] or ""), 1).astype("<u4") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert set(rows.doc_id) == set(want)
    for r in rows.itertuples():
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
    for doc, g in rows.sort_values("start").groupby("doc_id"):
        assert list(g.start) == list(np.cumsum([0, *g.length[:-1]])) and g.length.sum() == len(want[doc])
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == list(np.cumsum([0, *g.length[:-1]])) and g.length.sum() <= 2048
    assert rows.length.sum() / (2048 * rows.sequence_id.nunique()) > 0.98


def test_rows_without_id_and_repeated_rows_use_all_groups(spark):
    from pyspark.sql import functions as F

    same = docs(spark, ["one two three"]).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(2000)))).drop("n")
    for df in (same, same.withColumn("doc_id", F.lit(None).cast("long"))):
        rows = P.pack_pieces(P.token_pieces(df, PATH), 50)
        assert "number" not in rows.columns
        sizes = [r["count"] for r in rows.groupBy(F.shiftright("sequence_id", 32).alias("g")).count().collect()]
        assert len(sizes) == 50 and max(sizes) < 100 and sum(sizes) == 2000
