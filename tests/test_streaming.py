from pyspark.sql import functions as F

from gridloom.operators.aggregates import score_table
from gridloom.streaming import score_stream


def test_stream_gives_the_batch_table(spark, tmp_path):
    rows = [("a", 1.0, 1.0, 1.5), ("a", 2.0, 1.0, 9.0), ("b", 0.0, 2.0, 1.0), ("b", 0.0, 2.0, None)]
    df = spark.createDataFrame(rows, "method string, mean double, sd double, truth double")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    run = score_stream(stream, ["method"]).writeStream.outputMode("complete").format("memory").queryName("scores").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert {tuple(r) for r in spark.table("scores").collect()} == {tuple(r) for r in score_table(df, ["method"]).collect()}
    assert spark.table("scores").where(F.col("n") == 2).count() == 1
