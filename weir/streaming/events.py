"""Structured Streaming over arriving files: windows with watermarks, and exactly-once appends."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def source(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files that a path names or a folder holds."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def windows(events: DataFrame, width: str, *, slide: str | None = None, late: str = "1 hour", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums by event-time windows; in append and update mode state older than the watermark is dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = timed.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "v")


def tumbling(spark: SparkSession, path: str, width: str) -> DataFrame:
    """Windows of the files that are there, as a stream in complete mode writes them."""
    return _complete(spark, windows(_watched(spark, path), width))


def sliding(spark: SparkSession, path: str, width: str, slide: str) -> DataFrame:
    """Overlapping windows, every ``slide``."""
    return _complete(spark, windows(_watched(spark, path), width, slide=slide))


def running(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """Each user's number of events and greatest value so far, as state that outlives a batch; the newest row of each user."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, frames, state: GroupState):
        import pandas as pd

        n, top = state.get if state.exists else (0, float("-inf"))
        for f in frames:
            n, top = n + len(f), max(top, float(f["value"].max()))
        state.update((n, top))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "top": [top]})

    events = _watched(spark, path).select("user_id", "value")
    rows = events.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, top double", "n long, top double", "append", GroupStateTimeout.NoTimeout)
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")

    rows.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").foreachBatch(save).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("user_id").agg(F.max_by(F.struct("n", "top"), "epoch").alias("s")).select("user_id", "s.n", "s.top")


def _complete(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """The last result of a stream of aggregates over what is there. Complete mode keeps all windows, so nothing is late here."""
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    result = f"{folder}/out"

    def save(batch: DataFrame, epoch: int) -> None:
        # the epoch names the folder, so a batch that is run again replaces itself
        batch.write.mode("overwrite").parquet(f"{result}/epoch={epoch}")

    q = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").foreachBatch(save).trigger(availableNow=True).start()
    q.awaitTermination()
    done = spark.read.parquet(result)
    return done.where(F.col("epoch") == done.agg(F.max("epoch")).first()[0]).drop("epoch")


def watched(spark: SparkSession, path: str) -> DataFrame:
    """A stream of one Parquet file, or of those that come to match its name."""
    return _watched(spark, path)


def _watched(spark: SparkSession, path: str) -> DataFrame:
    folder, _, name = path.rstrip("/").rpartition("/")
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def append_stream(events: DataFrame, catalog, name: str, checkpoint: str):
    """Append a stream to a managed table; each epoch is one version, kept once by its number."""

    def save(batch: DataFrame, epoch: int) -> None:
        # the newest manifest has the last epoch of each stream, by its checkpoint
        done = catalog._now(name)["options"].get("epochs", {})
        if epoch > done.get(checkpoint, -1):
            catalog.insert(name, batch, options={"epochs": {**done, checkpoint: epoch}})

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start()
