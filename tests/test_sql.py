"""Every SQL function against the column that it was made from, and every view against its report."""

from pyspark.sql import functions as F

from tallyframe.plans import sql
from tallyframe.plans.fixtures import name_pairs, phone_pairs

SF = "/root/testdata/sf0.001"
VALUES = ["+49 (30) 12-34", "[null]", '[""]', "", None, "Café  Théatre & Co", "ガーデン", "Starbucks", "Starbcks", "Roma", "Roma Hotel", "it's \\ 'so'", "0151234", "49151234", "Location ", "日本", "ห้อง"]


def test_functions_are_their_columns(spark):
    made = sql.register_functions(spark, "t_")
    df = spark.createDataFrame([(x, y) for x in VALUES for y in VALUES], "a string, b string").withColumn("c", F.col("a"))
    df.createOrReplaceTempView("sql_values")
    each = sql.functions()
    assert made == [f"t_{k}" for k in each] and len(made) > 20
    text = ", ".join(f"t_{k}({', '.join(p.split()[0] for p in v[0].split(', '))}) AS {k}" for k, v in each.items())
    key = lambda r: tuple(map(repr, r))
    got = sorted(map(tuple, spark.sql(f"SELECT a, b, {text} FROM sql_values").collect()), key=key)
    assert got == sorted(map(tuple, df.select("a", "b", *[v[2].alias(k) for k, v in each.items()]).collect()), key=key)


def test_views_are_the_reports(spark):
    made = sql.create_views(phone_pairs(spark, SF), name_pairs(spark, SF), "v_")
    assert len(made) == 2 + len(sql.PHONE_VIEWS) + len(sql.NAME_VIEWS)
    bag = lambda df: sorted(map(repr, df.collect()))
    assert bag(spark.sql("SELECT * FROM v_phone_bands")) == bag(sql.phones.confidence_bands(phone_pairs(spark, SF)))
    assert all(spark.table(v).columns for v in made)
    assert sql.create_views(name_pairs=name_pairs(spark, SF), prefix="w_")[0] == "w_name_pairs"
