"""The driver's entry points, with and without the training-data operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_llm_parts(tmp_path):
    for name in ("__spark_entry__.py", "tallyframe"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    copy = tmp_path / "tallyframe"
    copy.mkdir()
    for p in (ROOT / "tallyframe").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (copy / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'phone_staged' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})


def test_streams_count_like_tables(spark, tmp_path):
    from pyspark.sql import functions as F

    from tallyframe.streaming.labels import label_counts

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    live = label_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), F.col("event_type"))
    q = live.writeStream.format("memory").queryName("live_counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(spark.table("live_counts")) == rows(label_counts(events, F.col("event_type")))
