from loomspan.streaming.incremental import populate_stream


def test_only_new_rows_are_processed(spark, tmp_path):
    src, sink, ck = (f"file://{tmp_path}/{n}" for n in ("src", "sink", "ck"))
    run = lambda: populate_stream(spark, src, "k long, v double", sink, ck, ["k"], lambda df: df.selectExpr("k", "v * 2 w")).awaitTermination()
    spark.createDataFrame([(1, 1.0), (2, 2.0)], "k long, v double").write.mode("append").parquet(src)
    run()
    spark.createDataFrame([(2, 9.0), (3, 3.0)], "k long, v double").write.mode("append").parquet(src)
    run()
    run()
    assert sorted(tuple(r) for r in spark.read.parquet(sink).collect()) == [(1, 2.0), (2, 4.0), (3, 6.0)]
