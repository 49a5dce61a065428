"""Cases the registered queries' own tables do not hold."""

from pyspark.sql import functions as F

from cairn.operators import cohort, stats
from cairn.sources.tables import read_table


def test_cohens_d_of_one_value_is_zero(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 3.0), ("b", 5.0)], "g string, x double")
    assert stats.cohens_d(df, "x", "g", "a", "b").first().cohen_d == 0.0


def test_cohort_grid_has_every_cell(spark):
    rows = [("2024-01-01", 0, 100.0), ("2024-01-01", 2, 50.0), ("2024-02-01", 0, 100.0)]
    r = spark.createDataFrame(rows, "d string, months_since_first int, retention_pct double") \
        .withColumn("cohort_month", F.to_timestamp("d"))
    got = {(x.cohort, x.period): x.retention_pct for x in cohort.cohort_grid(r).collect()}
    assert got == {("2024-01", "Month 0"): 100.0, ("2024-01", "Month 2"): 50.0,
                   ("2024-02", "Month 0"): 100.0, ("2024-02", "Month 2"): None}
    wide = cohort.cohort_matrix(r, [0, 2])
    assert wide.columns == ["cohort", "Month 0", "Month 2"] and wide.count() == 2


def test_read_table_sees_appended_rows(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    spark.range(10).write.parquet(path)
    assert read_table(spark, str(tmp_path), "t").count() == 10
    spark.range(5).write.mode("append").parquet(path)
    assert read_table(spark, str(tmp_path), "t").count() == 15
