"""The incremental forms: streams of changes to queue rows, windows over queue events, trailing limits.

Offsets and checkpoints are the cursors; watermarks bound the state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHANGES = "ecosystem string, name string, version string, priority string, at timestamp"
QUEUE_EVENTS = "ecosystem string, name string, version string, kind string, at timestamp"


def change_stream(spark: SparkSession, folder: str, schema: str = CHANGES, files_per_trigger: int = 100) -> DataFrame:
    """A stream over JSON lines that arrive in a folder; the number of files for each trigger is the poll's bound."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def first_seen(changes: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each (ecosystem, name, version) once within the watermark."""
    return changes.withWatermark("at", delay).dropDuplicatesWithinWatermark(["ecosystem", "name", "version"])


def gated(changes: DataFrame, watch: DataFrame) -> DataFrame:
    """A stream against a static watch list: watched names are urgent. The list is joined on its key."""
    watched = watch.select("ecosystem", "name").distinct().withColumn("watched", F.lit(True))
    priority = F.when(F.coalesce("watched", F.lit(False)), "high").otherwise(F.coalesce("priority", F.lit("normal")))
    return changes.join(watched, ["ecosystem", "name"], "left").withColumn("priority", priority).drop("watched")


def throughput(events: DataFrame, width: str = "60 minutes", slide: str | None = None, delay: str = "2 hours") -> DataFrame:
    """(window, ecosystem, kind, n) of queue events by event time; late ones count until the watermark has passed."""
    window = F.window("at", width, slide) if slide else F.window("at", width)
    return events.withWatermark("at", delay).groupBy(window, "ecosystem", "kind").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """(session_window, ecosystem, name, n): bursts of activity of a package."""
    return events.withWatermark("at", delay).groupBy(F.session_window("at", gap), "ecosystem", "name").agg(F.count("*").alias("n"))


def latest_state(events: DataFrame) -> DataFrame:
    """The batch form of the queue's state: of each key the kind of its last event."""
    return events.groupBy("ecosystem", "name", "version").agg(F.max(F.struct("at", "kind")).alias("x")).select("ecosystem", "name", "version", F.col("x.kind").alias("status"), F.col("x.at").alias("at"))


RETRY_STATE = "attempts int, status string"
RETRY_OUT = "ecosystem string, name string, version string, status string, attempts int"


def retries(events: DataFrame, most: int = 3, stale_seconds: int = 1800, delay: str = "1 minute") -> DataFrame:
    """The queue as keyed state over a stream of events (claimed, done, failed): claims that go stale and failures wait again until their attempts are used up.

    Claims go stale by event time, once the watermark has passed, so a replay gives the same states.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, frames, state: GroupState):
        attempts, status = state.get if state.exists else (0, "pending")
        if state.hasTimedOut:
            status = "failed" if attempts >= most else "pending"
        else:
            frame = pd.concat(list(frames)).sort_values("at")
            if len(frame):
                for kind in frame["kind"]:
                    if kind == "claimed":
                        attempts, status = attempts + 1, "claimed"
                    elif kind == "done":
                        status = "done"
                    elif kind == "failed":
                        status = "failed" if attempts >= most else "pending"
                at = int(frame["at"].max().timestamp() * 1000)
                if status == "claimed":
                    state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs()) + stale_seconds * 1000)
        state.update((attempts, status))
        yield pd.DataFrame([(*key, status, attempts)], columns=["ecosystem", "name", "version", "status", "attempts"])

    keyed = events.withWatermark("at", delay).groupBy("ecosystem", "name", "version")
    return keyed.applyInPandasWithState(step, RETRY_OUT, RETRY_STATE, "update", GroupStateTimeout.EventTimeTimeout)


def run_once(stream: DataFrame, checkpoint: str, table: str, mode: str = "append", when: Column | None = None) -> None:
    """Everything that has arrived, then stop: the job of a scheduler. Each batch is appended to a table, with its number; a batch that is written again replaces nothing
    twice, as batches that the table already holds are left out. In update mode the last row of a key is its state."""

    def add(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        if not (session.catalog.tableExists(table) and session.table(table).where(F.col("batch") == number).limit(1).count()):
            batch.withColumn("batch", F.lit(number).cast("long")).write.mode("append").saveAsTable(table)

    out = stream.where(when) if when is not None else stream
    query = out.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(add).trigger(availableNow=True).start()
    query.awaitTermination()
