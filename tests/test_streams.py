"""Streams in several micro-batches, with a restart, against the whole table."""

from collections import Counter

from pyspark.sql import functions as F

from tallyframe.streaming.pairs import pair_stream


def test_pairs_of_a_stream_are_those_of_the_table(spark, tmp_path):
    rows = [(f"u{i % 5}", i * 7919 % 97, f"n{i % 13}" if i % 9 else " ", "p", f"2024-01-01 {i % 6:02d}:{i * 7 % 60:02d}:00") for i in range(90)]
    flat = spark.createDataFrame(rows, "id string, position int, name string, provider string, at string").withColumn("at", F.col("at").cast("timestamp"))
    src, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")

    def arrive(k):
        flat.where(F.col("position") % 3 == k).coalesce(1).write.mode("append").parquet(src)

    def run():
        live = spark.readStream.schema(flat.schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = pair_stream(live, "at", "12 hours").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None and not q.isActive

    arrive(0)
    arrive(1)
    run()
    before = spark.read.parquet(out).count()
    arrive(2)
    run()  # goes on from the checkpoint
    run()  # nothing new, nothing twice
    bag = lambda df: Counter(map(tuple, df.collect()))
    whole = bag(pair_stream(flat, "at", "12 hours"))
    assert bag(spark.read.parquet(out)) == whole and 0 < before < sum(whole.values())
    near = pair_stream(flat, "at", "30 minutes").collect()
    assert 0 < len(near) < sum(whole.values()) and all(abs((r["alt_time"] - r["base_time"]).total_seconds()) <= 1800 for r in near)
