"""Small tables with every awkward row."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, start=0):
    rows = [(start + i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


AWKWARD = [None, "", " \t\n", "a", "word " * 30_000, "Ünï çødé 日本 🙂", "same text here", "same text here", "x\x00y", "'s 't don't <|endoftext|>"]
