"""An extension: verdict counts of a stream of claims in windows of event time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files


def verdict_windows(verdicts: DataFrame, time: str = "ts", late: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Counts by window and reason; rows later than ``late`` behind the latest are dropped by Spark's watermark."""
    rows = verdicts.withWatermark(time, late).groupBy(F.window(time, length), "reason").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("window.start").alias("start"), "reason", "n")


def repeated_once(claims: DataFrame, key: str = "id", time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """A repeated claim counts once while its first is within the watermark."""
    return claims.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def to_the_end(counted: DataFrame, label: str = "stream") -> DataFrame:
    """The counts of a stream that is read as far as it goes now, written by the executors under the shared folder and read back.

    Each batch writes all counts so far to a folder of its own; the last one's is read.
    """
    spark = counted.sparkSession
    root = f"{files.shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    done: list[str] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch-{number}")
        done.append(f"{root}/batch-{number}")

    running = counted.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(counted.schema).parquet(done[-1]) if done else spark.createDataFrame([], counted.schema)
