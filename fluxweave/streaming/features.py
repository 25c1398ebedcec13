"""Features kept up from a stream of observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_features(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """The first observation of each (sample, fid) of a stream with an event time `ts`; repeats within the lateness are dropped."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["sample", "fid"])


def windowed_values(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(sample, fid, start, value, n) summed in event-time windows; late rows past the watermark are left out."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "sample", "fid")
    return w.agg(F.sum("value").alias("value"), F.count("*").alias("n")).select("sample", "fid", F.col("window.start").alias("start"), "value", "n")


def keep_up(stream: DataFrame, path: str, checkpoint: str):
    """Appends a stream of features to a Parquet table, exactly once over restarts; runs what is there, then stops."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
