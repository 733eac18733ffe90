"""Evaluation sets: CSV files of several models as one relation, every row with the reason why it can't be used, or null.

A file that is not there is skipped, an absent column or a bad row is a result. Rows are read by Spark's own
reader, a task a file (values may hold line breaks), so any store will do and nothing passes through the driver
but each file's header.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallyframe.functions.once import once
from tallyframe.sources.files import present

# Texts that stand for no value in an evaluation file (fixed values, those of pandas' reader).
NO_VALUE = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
BROKEN = "_broken"


def read_sets(spark: SparkSession, paths: dict[str, str], columns: dict[str, str], required: list[str], valid: dict[str, tuple] | None = None, least: int = 1) -> DataFrame:
    """set_name, the columns (name -> type), reason and raw, of all files that are there.

    reason: null for a row that can be used, else the first of `malformed` (more or fewer values than the header),
    `no column: x` and `no value: x` of a required column, `not a <type>: x`, `not valid: x`. raw: the row's texts as
    JSON, or the line itself if it is malformed. Columns are found by name, whatever their order; a column that a file
    lacks and that is not required is null, other columns are ignored. Files with a header alone give no rows; fewer
    than `least` files are an error.
    """
    return reduce(DataFrame.unionByName, [_read(spark, name, path, columns, required, valid or {}) for name, path in present(spark, paths, least).items()])


def _read(spark: SparkSession, name: str, path: str, columns: dict[str, str], required: list[str], valid: dict[str, tuple]) -> DataFrame:
    form = {"header": True, "multiLine": True, "escape": '"'}
    head = spark.read.options(**form).csv(path).columns
    schema = StructType([StructField(c, StringType()) for c in [*head, BROKEN]])
    # a row's number of values is only known if the parser reads all of them
    rows = spark.read.options(**form, mode="PERMISSIVE", columnNameOfCorruptRecord=BROKEN, columnPruning=False).schema(schema).csv(path)
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    cell = {c: F.when(~quoted(c).isin(*NO_VALUE), quoted(c)) if c in head else F.lit(None).cast("string") for c in columns}
    typed = {c: cell[c].try_cast(kind) for c, kind in columns.items()}
    tests = [(F.col(BROKEN).isNotNull(), "malformed")]
    tests += [(F.lit(True), f"no column: {c}") for c in required if c not in head]
    tests += [(cell[c].isNull(), f"no value: {c}") for c in required if c in head]
    tests += [(cell[c].isNotNull() & typed[c].isNull(), f"not a {kind}: {c}") for c, kind in columns.items()]
    tests += [(~typed[c].isin(*values), f"not valid: {c}") for c, values in valid.items()]
    reason = F.coalesce(*[F.when(test, why) for test, why in tests])
    raw = F.coalesce(F.col(BROKEN), F.to_json(F.struct(*map(quoted, head))))
    # the reader refuses queries that need nothing but its column of broken rows, so both stay together
    marked = once(rows.select(F.struct(*[v.alias(c) for c, v in typed.items()]).alias("_typed"), reason.alias("_reason"), raw.alias("_raw")), {"_why": F.struct("_reason", "_raw")})
    return marked.select(F.lit(name).alias("set_name"), "_typed.*", F.col("_why._reason").alias("reason"), F.col("_why._raw").alias("raw"))


def usable(sets: DataFrame) -> DataFrame:
    """The rows of read_sets that can be used."""
    return sets.where("reason IS NULL").drop("reason", "raw")


def rejected(sets: DataFrame) -> DataFrame:
    """set_name, reason and raw of the other rows."""
    return sets.where("reason IS NOT NULL").select("set_name", "reason", "raw")
