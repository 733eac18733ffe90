"""Helpers that every operator of this subpackage shares.

Nothing here is specific to one operator: where intermediate tables go, how executors find this
package, and how tables are read.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tallyframe.session import ready

#: White space of word operators: the space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of one slice of a batch in Python; a single longer row is a slice of its own.
SLICE_BYTES = 4 << 20
#: Settings while a table is written: it takes the place of the shuffle files behind it, and Arrow batches stay small.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(2 * SLICE_BYTES)}

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode, where it may be unset, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"{tempfile.gettempdir()}/tallyframe-{spark.sparkContext.applicationId}"
    return folder.rstrip("/")


def delete(spark: SparkSession, *paths: str) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


class Cut:
    """Tables written to the shared folder: they cut lineage and survive the loss of executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/cut-{uuid.uuid4().hex}"
        before = {k: self.spark.conf.get(k) for k in WRITING}
        for k, v in WRITING.items():
            self.spark.conf.set(k, v)
        try:
            df.write.parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        _made.append((self.spark, path))
        out = self.spark.read.schema(df.schema).parquet(path)
        out._cut_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes the tables behind these frames; nothing may read them later."""
        delete(self.spark, *[df._cut_path for df in frames])
        gone = {df._cut_path for df in frames}
        _made[:] = [x for x in _made if x[1] not in gone]


def settled(cut: Cut, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of make(), written; the tables that were written on the way to it are deleted."""
    before = len(_made)
    out = cut(make())
    delete(cut.spark, *[path for _, path in _made[before:-1]])
    del _made[before:-1]
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def crc_mod3(c: Column) -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(F.encode(c.cast("string"), "UTF-8")) % 3


def row_bytes(column: pa.Array) -> np.ndarray:
    """Bytes of each row of a column of texts, binaries or lists of numbers; 8 for others."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
        return np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    if pa.types.is_list(kind):
        return np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64) * 8
    return np.full(len(column), 8, dtype=np.int64)


def slices(columns: Sequence[pa.Array], rows: int, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, rows) of slices of at most `rows` rows and about `size` bytes; at least a row each."""
    ends = np.cumsum(sum(row_bytes(c) for c in columns))
    lo, n = 0, len(ends)
    while lo < n:
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, min(n, lo + rows, int(np.searchsorted(ends, done + size, side="right"))))
        yield lo, hi - lo
        lo = hi


def map_columns(df: DataFrame, fn: Callable[..., Sequence], schema: str, rows: int = 4000, raw: bool = False, size: int = SLICE_BYTES) -> DataFrame:
    """Applies fn to slices of all columns, bounded in rows and bytes; fn returns the columns of `schema`.

    Arrow carries the rows, so null ids stay exact integers; slices bound the Python objects alive.
    raw: fn gets Arrow arrays instead of lists.
    """
    ready(df.sparkSession)
    fields = StructType.fromDDL(schema).fields
    names, kinds = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, n in slices(batch.columns, rows, size):
                part = batch.slice(lo, n)
                out = fn(*[c if raw else c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([c.cast(t) if isinstance(c, pa.Array) else pa.array(c, type=t, from_pandas=False) for c, t in zip(out, kinds, strict=True)], names)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def clear_of(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until no column of df has them (letter case aside)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def word_codes(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words (runs without ASCII white space) of whole texts: their codes, the distinct words, each text's first word.

    Null texts have no words.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    flat, bounds = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    full = np.asarray(pc.binary_length(flat)) > 0  # leading and trailing white space makes empty words
    first = np.concatenate([[0], np.cumsum(full)])[bounds - bounds[0]]
    coded = (flat if full.all() else flat.filter(pa.array(full))).dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary, first


def on_lines(words: pa.Array) -> str:
    """Words (no null, no white space inside), a line each; many times faster than a Python list of scalars."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words.cast(pa.string())), "\n")[0].as_py()


def listed(words: pa.Array) -> list[str]:
    return on_lines(words).split("\n") if len(words) else []
