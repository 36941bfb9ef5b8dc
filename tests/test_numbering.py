from pyspark.sql import functions as F

from quire.operators.numbering import numbered


def test_numbers_follow_the_order(spark):
    df = spark.range(0, 5000, 1, 7).select("id", (F.col("id") * 7919 % 1000).alias("k"), F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id") % 3).alias("n"))
    rows = numbered(df, "place", F.col("n").desc_nulls_last(), "k", "id").collect()
    want = sorted(rows, key=lambda r: (r.n is None, -(r.n or 0), r.k, r.id))
    assert [r.place for r in want] == list(range(1, 5001))
    plan = numbered(df, "place", "id")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan  # sorted before, and written


def test_no_rows(spark):
    assert numbered(spark.createDataFrame([], "id int"), "place", "id").count() == 0
