"""Reading and writing: Parquet, CSV with a schema, optional inputs, single-file reports, JSON programs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def csv(spark: SparkSession, path: str, schema: str, valid: dict[str, tuple] | None = None) -> DataFrame:
    """Rows of a CSV file with a header; rows without a required value or outside its valid values go."""
    df = spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')
    for column, values in (valid or {}).items():
        df = df.where(df[column].isNotNull() & df[column].isin(*values))
    return df


def exists(spark: SparkSession, path: str) -> bool:
    """Through Spark's own file systems, so any store will do."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def present(spark: SparkSession, paths: dict[str, str], least: int = 2) -> dict[str, str]:
    """The inputs that are there; an error if fewer than `least` are."""
    found = {k: p for k, p in paths.items() if exists(spark, p)}
    if len(found) < least:
        raise FileNotFoundError(f"{len(found)} of {len(paths)} inputs found, {least} needed")
    return found


def write_report(df: DataFrame, path: str) -> None:
    """A report (a small aggregate) as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')


def write_sets(sets: dict[str, DataFrame], folder: str) -> None:
    """Each relation as CSV files with a header in a folder of its own name; values keep their blanks and line breaks."""
    for name, df in sets.items():
        df.write.mode("overwrite").csv(f"{folder}/{name}", header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_table(df: DataFrame, path: str, *partition: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition).parquet(path)


def write_text(df: DataFrame, path: str) -> None:
    df.selectExpr("concat_ws(' ', *) AS value").coalesce(1).write.mode("overwrite").text(path)


def read_program(spark: SparkSession, path: str) -> dict:
    """A model's JSON program (instructions and demonstrations)."""
    return json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))  # a configuration file


def write_program(spark: SparkSession, program: dict, path: str) -> None:
    """The counterpart of read_program: one JSON text, through Spark's own file systems."""
    spark.createDataFrame([(json.dumps(program, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_model(model, path: str) -> None:
    """A fitted pipeline of pyspark.ml."""
    model.write().overwrite().save(path)
