"""Pair tables made from whole base tables by SQL that reads the same in Spark and in the oracle's engine."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyframe.session import for_session, shared_dir
from tallyframe.sources.files import write_sets

NAME_PAIRS = """
WITH d AS (
  SELECT doc_id, CAST(doc_id % 10 AS INT) AS kind, source,
         trim(split_part(coalesce(text, ''), chr(10), 1)) AS n
  FROM documents
)
SELECT concat('p', lpad(CAST(doc_id AS STRING), 8, '0')) AS id,
  n AS alt_name,
  CASE kind
    WHEN 0 THEN n
    WHEN 1 THEN upper(replace(n, 'ß', 'ss'))
    WHEN 2 THEN translate(n, 'ÄÇÈÉÊÍÑÓÖÜäçèéêíñóöü', 'ACEEEINOOUaceeeinoou')
    WHEN 3 THEN concat(replace(replace(n, '.', ''), ',', ' -'), '!')
    WHEN 4 THEN replace(n, ' ', '')
    WHEN 5 THEN concat(n, ' Hotel')
    WHEN 6 THEN concat(n, ' GmbH')
    WHEN 7 THEN concat(trim(substr(n, length(split_part(n, ' ', 1)) + 1)), ' ', split_part(n, ' ', 1))
    WHEN 8 THEN concat(substr(n, 1, 5), 'x', substr(n, 7))
    ELSE concat(source, ' ', reverse(n))
  END AS base_name
FROM d
"""

PHONE_PAIRS = """
SELECT concat('c', lpad(CAST(c_custkey AS STRING), 8, '0')) AS id,
  CASE CAST(c_custkey % 13 AS INT)
    WHEN 0 THEN NULL WHEN 12 THEN '[""]'
    WHEN 4 THEN concat('["+44', nat, '"]') WHEN 5 THEN concat('["+353', nat, '"]')
    WHEN 6 THEN concat('["+44', nat, '"]') WHEN 7 THEN concat('["+353', nat, '"]')
    WHEN 8 THEN concat('["+490', nat, '"]') WHEN 9 THEN concat('["+7', nat, '"]')
    ELSE concat('["+1', nat, '"]') END AS phones,
  CASE CAST(c_custkey % 13 AS INT)
    WHEN 1 THEN '[null]' WHEN 2 THEN concat('["+1', nat, '"]')
    WHEN 3 THEN concat('["(', substr(nat,1,3), ') ', substr(nat,4,3), '-', substr(nat,7,4), '"]')
    WHEN 4 THEN concat('["0', nat, '"]') WHEN 5 THEN concat('["0', nat, '"]')
    WHEN 6 THEN concat('["', nat, '"]') WHEN 7 THEN concat('["', nat, '"]')
    WHEN 8 THEN concat('["49', nat, '"]') WHEN 9 THEN concat('["8', nat, '"]')
    WHEN 10 THEN concat('["', reverse(nat), '"]') WHEN 12 THEN '["NULL"]'
    ELSE concat('["', nat, '"]') END AS base_phones,
  CASE WHEN c_custkey % 3 = 0 THEN CAST(0.77 AS DOUBLE) ELSE floor(abs(c_acctbal) / 2) / 10000 END AS confidence,
  CAST(CASE WHEN c_custkey % 5 < 3 THEN 1.0 ELSE 0.77 END AS DOUBLE) AS base_confidence,
  concat('[{"dataset":"', lower(c_mktsegment), '","property":""}',
         CASE WHEN c_custkey % 2 = 0 THEN ',{"dataset":"seg","property":"/properties/existence"}' ELSE '' END, ']') AS sources
FROM (SELECT *, CAST(2000000000 + (c_custkey * 7919 + 104729) % 7999999999 AS STRING) AS nat FROM customer) t
"""

# What three models say of each labelled row, as the texts of their files: some without a label, with one that is
# not in use or with a broken number; the file of the third has no labels at all, that of a fourth isn't there.
SET_ROWS = {
    "a": """SELECT CASE WHEN doc_id % 17 = 3 THEN concat('x', CAST(doc_id AS STRING)) ELSE CAST(doc_id AS STRING) END AS doc_id,
  CASE WHEN doc_id % 11 = 0 THEN 'NA' WHEN doc_id % 13 = 0 THEN 'unknown' WHEN quality = 1 THEN 'good' ELSE 'bad' END AS predicted,
  concat('said "', CAST(toxic AS STRING), '",', chr(10), 'then ended') AS note FROM labels""",
    "b": """SELECT concat('n', CAST(quality AS STRING)) AS note, CASE WHEN toxic = 1 THEN 'bad' ELSE 'good' END AS predicted,
  CASE WHEN doc_id % 7 = 0 THEN NULL ELSE CAST(doc_id AS STRING) END AS doc_id, 'more' AS other FROM labels""",
    "c": "SELECT CAST(doc_id AS STRING) AS doc_id, 'c' AS note FROM labels",
}


def set_files(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """The models' CSV files by name, made from all labels."""
    folder = f"{shared_dir(spark)}/sets-{uuid.uuid4().hex}"
    write_sets({name: from_table(spark, sf_dir, sql, "labels") for name, sql in SET_ROWS.items()}, folder)
    for_session(spark, folder)
    return {name: f"{folder}/{name}" for name in (*SET_ROWS, "absent")}


def from_table(spark: SparkSession, sf_dir: str, sql: str, table: str) -> DataFrame:
    """Runs SQL that names one base table over that table's Parquet file."""
    braced = sql.replace("{", "{{").replace("}", "}}").replace(f"FROM {table}", "FROM {source}", 1)
    return spark.sql(braced, source=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, alt_name, base_name: the whole first lines of all documents, and what a second source makes of them."""
    return from_table(spark, sf_dir, NAME_PAIRS, "documents")


def phone_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, phones, base_phones, confidence, base_confidence, sources"""
    return from_table(spark, sf_dir, PHONE_PAIRS, "customer")
