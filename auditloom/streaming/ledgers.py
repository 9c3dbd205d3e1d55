"""Append-only ledgers as streams: idempotent appends, running decisions and windowed counts with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.scratch import Scratch
from auditloom.sources.sinks import append_once


def stream_table(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet ledger as a stream of its files."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r).parquet(path)


def windowed_counts(events: DataFrame, time: str, keys: list[str], value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, keys, n, total per tumbling window; rows later than the watermark are dropped by the engine."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("w.start").alias("start"), *keys, "n", "total")


def drain(stream: DataFrame, scratch: Scratch, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and gives the rows that it wrote."""
    spark = scratch.spark
    out = f"{scratch.base}/{name}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-progress").outputMode("append").trigger(availableNow=True).start(out)
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def keep(batch: DataFrame, _: int) -> None:
        # complete mode: each batch holds the whole result, the last one stays
        batch.write.mode("overwrite").parquet(out)

    q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}-progress").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def append_stream(stream: DataFrame, path: str, key: list[str], progress: str) -> None:
    """Appends a ledger's new rows once a key, however often they are delivered."""
    q = stream.writeStream.foreachBatch(lambda b, _: append_once(b, path, key)).option("checkpointLocation", progress).trigger(availableNow=True).start()
    q.awaitTermination()


def latest_decision(events: DataFrame, entity: str, rank: Callable[[], object], decision: str, order: str) -> DataFrame:
    """The last decision of the highest stage so far, kept up to date (update or complete mode)."""
    return events.groupBy(entity).agg(F.max(F.struct(rank().alias("stage"), F.col(order).alias("at"), F.col(decision).alias("decision"))).alias("m")).select(entity, "m.stage", "m.decision")
