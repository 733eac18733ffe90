import hashlib
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tallyframe.llm import media as M
from tests.llm.helpers import AWKWARD, docs


@given(st.binary(max_size=30_000))
def test_round_trip(raw):
    payload = M.payload_of(raw)
    parsed = M.parse(M.mux(payload))
    assert M.demux(M.mux(payload), parsed) == payload and not parsed["damaged"]


@given(st.binary(max_size=300))
def test_foreign_bytes_never_raise(raw):
    M.parse(raw)
    M.parse(M.mux(M.payload_of(raw))[: len(raw)])


@pytest.mark.parametrize("lacing", [0, 1, 2, 3])
def test_all_lacings_and_unknown_sizes(lacing):
    frames = [b"a" * 300, b"b" * 300, b"c" * 300] if lacing == 2 else [b"a" * 300, b"b" * 5, b"c" * 700]
    if lacing == 0:
        frames, body = [b"z" * 9], b"z" * 9
    elif lacing == 1:
        body = bytes([2]) + bytes([255, 45]) + bytes([5]) + b"".join(frames)
    elif lacing == 2:
        body = bytes([2]) + b"".join(frames)
    else:
        body = M.lace(frames)[1]
    block = M.element(M.SIMPLE_BLOCK, M.vint(1) + b"\x00\x05" + bytes([0x80 | lacing << 1]) + body)
    group = M.element(M.BLOCK_GROUP, M.element(M.BLOCK, M.vint(2) + b"\xff\xff\x00" + b"q"))
    unknown = M.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7
    file = M.element(M.EBML, b"") + M.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + unknown + M.uint(M.CLUSTER_TIME, 100) + block + group + M.element(M.CUES, b"")
    parsed = M.parse(file)
    assert [file[o : o + n] for *_, o, n in parsed["packets"]] == [*frames, b"q"]
    assert parsed["packets"][0][1] == 105 and parsed["packets"][-1][:2] == (2, 99) and not parsed["damaged"]


def test_query_digests(spark):
    rows = {r["doc_id"]: r for r in M.media_digests(M.mux_texts(docs(spark, AWKWARD))).collect()}
    for i, t in enumerate(AWKWARD):
        payload = M.payload_of((t or "").encode())
        assert rows[i]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and rows[i]["tail_crc32"] == zlib.crc32(payload[-64:])
    assert rows[6]["media_sha256"] == rows[7]["media_sha256"]
    table = M.packets(M.mux_texts(docs(spark, AWKWARD[:4])))
    assert table.count() == 4 and M.packets(M.mux_texts(docs(spark, []))).count() == 0


def test_clashing_columns_and_a_very_long_text(spark):
    from pyspark.sql import functions as F

    long = "é" * 2_000_000
    d = docs(spark, ["a", None, long]).withColumns({"media": F.lit(1), "raw": F.lit(2), "n_bytes": F.lit(3), "payload_sha256": F.lit("x")})
    rows = {r["doc_id"]: r for r in M.media_digests(M.mux_texts(d)).collect()}
    assert [rows[i]["n_bytes"] for i in range(3)] == [1, 0, 4_000_000]
    assert rows[2]["payload_sha256"] == hashlib.sha256(M.payload_of(long.encode())).hexdigest()
