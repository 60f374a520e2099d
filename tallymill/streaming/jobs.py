"""Streaming variants: windows with late data, deduplication within a watermark, Silver by micro-batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallymill.session import shared_dir


def read_files(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_totals(events: DataFrame, ts: str, key: str, value: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Count and sum per key and window, tumbling or every ``slide``; state goes once the watermark has passed."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width, slide).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("decimal(18,2)")).cast("double").alias("total"))


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))


def first_seen(events: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """Repeats within the watermark are dropped; state is bounded by it."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def run_once(stream: DataFrame, mode: str = "append", label: str = "stream") -> DataFrame:
    """Drive a stream over what is there into a table in the shared folder, and read that."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/tallymill/{label}-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    else:

        def keep(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{root}/out")

        q = stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def silver_micro_batches(stream: DataFrame, build: Callable[[DataFrame], dict[str, DataFrame]], out: str, checkpoint: str):
    """Silver per batch: each batch's tables go under its id, so a batch that is tried again overwrites itself."""

    def each(batch: DataFrame, number: int) -> None:
        for name, df in build(batch).items():
            df.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
