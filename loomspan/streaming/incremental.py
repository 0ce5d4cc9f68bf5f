"""Incremental computation of derived tables from arriving files: the streaming form of ``algebra.populate``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def populate_stream(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, pk: list[str], make: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Process all files of ``source`` not seen before, then stop; ``make`` gives rows of the derived table for new rows.

    Keys that the sink already has are left out, so a batch that is tried again after a failure adds nothing twice.
    """
    stream = spark.readStream.schema(schema).parquet(source)

    def add(batch: DataFrame, batch_id: int) -> None:
        rows = make(batch).dropDuplicates(pk)
        path = spark._jvm.org.apache.hadoop.fs.Path(sink)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            rows = rows.join(spark.read.schema(rows.schema).parquet(sink).select(pk), pk, "left_anti")
        rows.write.mode("append").parquet(sink)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
