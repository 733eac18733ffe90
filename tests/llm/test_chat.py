import hashlib

from hypothesis import given
from hypothesis import strategies as st

from tallyframe.llm import chat as C

T = C.Template()


@given(st.lists(st.tuples(st.text(max_size=8) | st.sampled_from(["user", "assistant"]), st.text(alphabet="\\# </turn>\n:aé", max_size=40)), max_size=6))
def test_round_trip(turns):
    parser = C.Parser(T)
    text = "".join(s["text"] for role, body in turns for s in T.segments(role, body))
    assert list(parser.feed(text)) == turns and not parser.rest


def test_conversations(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", C.TRAP), (2, 1, "assistant", None), (None, 1, None, "x"), (3, 1, "user", "q"), (3, 1, "user", "q"), (4, None, "judge", "é🙂")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, segments string")
    got = {r["conv_id"]: r for r in C.read_back(C.format_turns(df)).collect()}
    assert got[1]["valid"] and not got[2]["valid"] and not got[3]["valid"] and got[3]["n_turns"] == 2
    assert got[1]["turns_sha256"] == hashlib.sha256(f"user\n{C.TRAP}\nassistant\nb\n".encode()).hexdigest()
    assert got[1]["loss_chars"] == 1 and got[1]["loss_sha256"] == hashlib.sha256(b"b").hexdigest()
    assert got[4]["turns_sha256"] == hashlib.sha256("judge\né🙂\n".encode()).hexdigest() and got[4]["loss_chars"] == 0
    assert got[None]["n_turns"] == 1
    assert C.read_back(C.format_turns(df.limit(0))).count() == 0


def test_very_long_turns_keep_their_text(spark):
    from pyspark.sql import functions as F

    rows = [(1, 0, "user", "q" * 500_000), (1, 1, "assistant", "word " * 200_000), (2, 0, "user", None), (2, 1, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumns({"segments": F.lit("x"), "legal": F.lit(1)})
    got = {r["conv_id"]: r for r in C.read_back(C.format_turns(df)).collect()}
    assert got[1]["loss_sha256"] == hashlib.sha256(("word " * 200_000).encode()).hexdigest() and got[1]["valid"]
    assert got[2]["loss_chars"] == 0 and got[2]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\n\n").hexdigest()
