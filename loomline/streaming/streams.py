"""Streaming forms of landing and of session inference."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import shared_folder
from ..params import DEFAULT, Params
from ..sources.landing import raw_log


def drain(stream: DataFrame) -> DataFrame:
    """Run a stream over what is there now into files of the shared checkpoint folder, and read them."""
    spark = stream.sparkSession
    shared = shared_folder(spark)
    path = f"{shared}/{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def deduplicated(stream: DataFrame, key: str = "event_id", time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each key once within the delay; state older than the watermark is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def land(path: str, writer: str | None = None) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function that adds payloads to the landed log; a batch writes its own rows only.

    A batch that was landed before (by its number, under `writer` or else the query that the stream's checkpoint names)
    changes nothing, nor does an empty one. Outside a stream without `writer`, each call is a batch of its own.
    """

    def merge(batch: DataFrame, number: int) -> None:
        name = writer or batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        raw_log(batch.sparkSession, path).upsert(batch, (name, number) if name else None)

    return merge


def streaming_sessions(stream: DataFrame, p: Params = DEFAULT, delay: str = "1 day") -> DataFrame:
    """Actor sessions by event time, given out once the watermark has passed their end.

    A session ends when no event follows within the gap. session_window ends a session strictly before start + gap, so
    the gap is one microsecond longer and an event exactly at the gap still joins, as in the batch form.
    """
    work = stream.where("actor_hash is not null and activity != 'ci_run'").withWatermark("ts", delay)
    grouped = work.groupBy("actor_hash", F.session_window("ts", f"{p.gap_minutes} minutes 1 microsecond")).agg(F.count("*").alias("n_events"), F.max("ts").alias("ended_at"))
    return grouped.select("actor_hash", (F.col("session_window.start") - F.expr(f"INTERVAL {p.lead_in_minutes} MINUTES")).alias("started_at"), "ended_at", "n_events")


def open_sessions(events: DataFrame, closed: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """At the end of a source, the sessions that the watermark has not passed: those of events after an actor's last closed one."""
    work = events.where("actor_hash is not null and activity != 'ci_run'")
    last = closed.groupBy("actor_hash").agg(F.max("ended_at").alias("last_end"))
    rest = work.join(last, "actor_hash", "left").where("last_end is null or ts > last_end")
    grouped = rest.groupBy("actor_hash", F.session_window("ts", f"{p.gap_minutes} minutes 1 microsecond")).agg(F.count("*").alias("n_events"), F.max("ts").alias("ended_at"))
    return grouped.select("actor_hash", (F.col("session_window.start") - F.expr(f"INTERVAL {p.lead_in_minutes} MINUTES")).alias("started_at"), "ended_at", "n_events")
