"""TF-IDF of word or character n-grams and a balanced multinomial regression on it.

word: words of two and more letters, digits or underscores in lower case, and pairs of neighbours. char_wb: runs of
3 to 5 characters inside words with a space at either end; a word shorter than n gives none of n. The vocabulary holds
the `size` grams of the greatest number (of equals the first by text), a gram's weight is its count in the text
times ln((1 + texts) / (1 + texts with it)) + 1, and a text's weights have length 1. Null texts count as empty;
texts without a known gram have no weights.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, SQLTransformer, StringIndexer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("word", "char_wb")


def steps(text: str, kind: str) -> dict[str, str]:
    """SQL expressions of the columns on the way to `grams`, the last."""
    low = f"lower(coalesce(`{text}`, ''))"
    if kind == "word":
        return {
            "_toks": f"regexp_extract_all({low}, '([\\\\p{{L}}\\\\p{{N}}_]{{2,}})', 1)",
            "grams": "concat(_toks, filter(zip_with(_toks, slice(_toks, 2, size(_toks)), (a, b) -> concat(a, ' ', b)), x -> x IS NOT NULL))",
        }
    each = ", ".join(f"flatten(transform(filter(_toks, w -> length(w) >= {n}), w -> transform(sequence(1, length(w) - {n - 1}), i -> substr(w, i, {n}))))" for n in (3, 4, 5))
    return {"_toks": f"transform(filter(split({low}, '\\\\s+'), w -> w <> ''), w -> concat(' ', w, ' '))", "grams": f"concat({each})"}


def with_grams(df: DataFrame, text: str, kind: str) -> DataFrame:
    for name, sql in steps(text, kind).items():
        df = df.withColumn(name, F.expr(sql))
    return df.drop("_toks")


def vocabulary(rows: DataFrame, size: int) -> DataFrame:
    """term, total, texts, idf of the `size` most frequent grams of rows (grams); one pass over the texts."""
    mark = lambda c, total, texts: F.transform(c, lambda g: F.struct(g.alias("term"), F.lit(total).alias("total"), F.lit(texts).alias("texts")))
    counts = rows.select(F.inline(F.concat(mark("grams", 1, 0), mark(F.array_distinct("grams"), 0, 1)))).groupBy("term").agg(F.sum("total").alias("total"), F.sum("texts").alias("texts"))
    top = counts.orderBy(F.desc("total"), "term").limit(size)
    n = rows.agg(F.count("*").alias("n"))
    return top.join(F.broadcast(n)).withColumn("idf", F.log((1 + F.col("n")) / (1 + F.col("texts"))) + 1).drop("n")  # n is one row


def tfidf_weights(df: DataFrame, key: str, text: str, kind: str = "word", size: int = 500) -> DataFrame:
    """key, term, weight of every known gram of every text; rows that share a key are one text."""
    rows = with_grams(df, text, kind).select(key, "grams")
    known = F.broadcast(vocabulary(rows, size).select("term", "idf"))  # `size` rows at most
    counts = rows.select(key, F.explode("grams").alias("term")).join(known, "term").groupBy(key, "term", "idf").agg(F.count("*").alias("tf"))
    raw = counts.select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = raw.groupBy(F.col(key).alias("_key")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"))
    return raw.join(norms, F.col(key).eqNullSafe(F.col("_key"))).select(key, "term", (F.col("w") / F.col("_norm")).alias("weight"))


def ngram_model(df: DataFrame, text: str, label: str, kind: str = "word", size: int = 500, c: float = 1.0) -> PipelineModel:
    """The fitted pipeline: grams, counts, weights of length 1, and a regression whose classes weigh the same in sum.

    It minimises c times the weighted log loss over all rows plus half the squared coefficients (not the intercepts),
    by Spark's quasi-Newton steps over sparse rows in the cluster; only the vocabulary, bounded by `size`, is collected.
    """
    sql = [SQLTransformer(statement=f"SELECT *, {x} AS {name} FROM __THIS__") for name, x in steps(text, kind).items()]
    vocab = vocabulary(with_grams(df, text, kind), size).orderBy("term").collect()
    counted = CountVectorizerModel.from_vocabulary([r["term"] for r in vocab] or [" "], inputCol="grams", outputCol="tf")
    idf = ElementwiseProduct(scalingVec=Vectors.dense([r["idf"] for r in vocab] or [1.0]), inputCol="tf", outputCol="tfidf")
    before = [*sql, counted, idf, Normalizer(inputCol="tfidf", outputCol="features", p=2.0)]
    known = df.where(F.col(label).isNotNull())
    indexed = StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc", handleInvalid="keep").fit(known)
    sizes = {r[label]: r["n"] for r in known.groupBy(label).agg(F.count("*").alias("n")).collect()}  # a row per class
    total = sum(sizes.values())
    weights = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, total / (len(sizes) * n))])
    ready = PipelineModel([*before, indexed]).transform(known.withColumn("weight", F.element_at(weights, F.col(label))))
    regression = LogisticRegression(labelCol="y", weightCol="weight", family="multinomial", regParam=1 / (c * total), standardization=False, maxIter=200, tol=1e-6)
    return PipelineModel([*before, indexed, regression.fit(ready)])


def ngram_predictions(model: PipelineModel, df: DataFrame, label: str) -> DataFrame:
    """df with `predicted`, the label that the model gives."""
    indexer = next(s for s in model.stages if hasattr(s, "labels"))
    names = F.array(*map(F.lit, indexer.labels))
    out = model.transform(df.withColumn(label, F.col(label)))
    return out.select(*df.columns, F.try_element_at(names, (F.col("prediction") + 1).cast("int")).alias("predicted"))
