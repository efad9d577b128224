from pyspark.sql import functions as F

from taktwerk.streaming import blocks

SF = "/root/testdata/sf0.001"


def test_shift_means_of_a_stream_equal_the_batch(spark, tmp_path):
    out = blocks.shift_means(blocks.read_events(spark, SF))
    query = out.writeStream.outputMode("complete").format("memory").queryName("shifts").option("checkpointLocation", str(tmp_path))
    query.trigger(availableNow=True).start().awaitTermination(90)
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    key = lambda r: (r.series, str(r.shift_start), round(r.m, 6), r.n)
    got, want = spark.table("shifts").collect(), blocks.shift_means(events).collect()
    assert got and sorted(map(key, got)) == sorted(map(key, want))
