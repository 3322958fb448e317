"""Queries that run as streams over the files that are there, to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import shared_folder
from ..sources import landing
from ..streaming import streams
from .base import Tables, query
from .normalise_queries import PR
from .normalise_queries import landed as fetched


def streamed_events(t: Tables) -> DataFrame:
    """The `events` table as a stream, with the columns that sessions need."""
    path = f"{t.sf_dir}/events.parquet"
    # as a pattern, since a plain path would have to be a folder
    e = t.spark.readStream.schema(t.spark.read.parquet(path).schema).parquet(f"{t.sf_dir}/event[s].parquet")
    return event_columns(e)


def event_columns(e: DataFrame) -> DataFrame:
    ci = (F.col("event_type") == "error") & (F.col("event_id") % 2 == 1)
    return e.select(F.col("event_id").cast("string").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.when(~ci, F.concat(F.lit("u"), F.col("user_id"))).alias("actor_hash"), F.when(ci, "ci_run").otherwise(F.col("event_type")).alias("activity"))


@query("t1_streamed_dedup", "activity:s n:i", "SELECT CASE WHEN activity = 'ci_run' THEN 'ci_run' ELSE event_type END AS activity, COUNT(*) AS n FROM ev JOIN events ON event_id = id GROUP BY 1")
def _(t: Tables) -> DataFrame:
    twice = streamed_events(t).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return streams.drain(streams.deduplicated(twice)).groupBy("activity").agg(F.count("*").alias("n"))


@query("t1_landed", "entity_id:s version:s", f"SELECT repo || '#' || number AS entity_id, CASE WHEN number % 3 = 1 THEN '0' ELSE '1' END AS version FROM ({PR}) AS p")
def _(t: Tables) -> DataFrame:
    """Two fetches of the payloads as files of a stream, landed in batches, each of them twice."""
    place = f"{shared_folder(t.spark)}/{uuid.uuid4().hex}"
    for shift in (1, 0):  # the later fetch lands first
        fetched(t, shift).withColumn("fetched_at", F.timestamp_add("SECOND", F.lit(shift), "fetched_at")).write.mode("append").parquet(f"{place}/in")
    stream = t.spark.readStream.schema(landing.ENVELOPE).option("maxFilesPerTrigger", 4).parquet(f"{place}/in")
    land = streams.land(f"{place}/raw")

    def twice(batch: DataFrame, number: int) -> None:
        land(batch, number)
        land(batch, number)

    stream.writeStream.foreachBatch(twice).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return landing.raw(t.spark, f"{place}/raw", "github_graphql", "pull_request").withColumn("version", F.split_part("body", F.lit(":"), F.lit(1)))


@query("t2_streamed_sessions", "actor_hash:s started_at:t ended_at:t n_events:i", "SELECT actor_hash, started_at, ended_at, n_events FROM spans WHERE gap_minutes = 480")
def _(t: Tables) -> DataFrame:
    closed = streams.drain(streams.streaming_sessions(streamed_events(t)))
    return closed.unionByName(streams.open_sessions(event_columns(t.raw("events")), closed))
