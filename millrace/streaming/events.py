"""Event streams.  An extension: the same roll-ups over a stream as over a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.runtime import scratch_dir


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events table of a folder as a stream of its file."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame, late: str = "30 days") -> DataFrame:
    """window start, event_type, n, total; events later than ``late`` are dropped by a stream."""
    e = events.withWatermark("ts", late) if events.isStreaming else events.withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n_events"), F.sum("value").alias("total"))
    return g.select(F.unix_micros("w.start").alias("hour_us"), "event_type", "n_events", F.round("total", 4).alias("total"))


def drain(stream: DataFrame) -> DataFrame:
    """Run a stream over what is there now; returns the last state of its rows."""
    spark = stream.sparkSession
    name = f"millrace_{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark)}/{name}"

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows")

    query = stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/rows")


QUERIES = {"stream_hourly": lambda s, d: drain(hourly(event_stream(s, d)))}
ORACLE_SQL = {"stream_hourly": "SELECT epoch_us(date_trunc('hour', ts)) AS hour_us, event_type, count(*) AS n_events, round(sum(value), 4)::DOUBLE AS total FROM events GROUP BY 1, 2"}
