"""From raw documents to packed training sequences: five stages, each written and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
documents. Stages work on all rows that the one before kept.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import Cut, settled, table
from tallyframe.llm.mixing import mix
from tallyframe.llm.ngram_join import drop_near_copies
from tallyframe.llm.packing import groups_of, pack_pieces, token_pieces
from tallyframe.llm.pii import redact
from tallyframe.llm.toxicity import keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled model rejects go."""
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 and more, the first stays."""
    return drop_near_copies(docs, k=5, part=80, whole=100)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by the names of their kinds."""
    return redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the target weights of sources, languages and topics."""
    return mix(docs).where("m_kept").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids, placed in sequences of 2048 tokens."""
    pieces = token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")).withColumn("ids_crc32", F.crc32("token_bytes"))
    return pack_pieces(pieces, groups_of(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_copies", near_copies),
    ("private_data", private_data),
    ("mixture", mixture),
    ("packing", packing),
]

#: Learned models, token ids and packing can't be said in SQL; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = Cut(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, settled(cut, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if k:  # the stage before has been read for the last time
            cut.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
