"""A delivery event log derived from the generic tables, so that every operator has rows to work on.

`events` becomes the main log: a case is a key and a day, the event type an activity. `orders` and `lineitem` become a
second, larger one whose timestamps tie and contradict each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mod(n: int) -> Column:
    return F.col("id") % n


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event with everything the tables below derive from it."""
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    kind = F.col("event_type")
    activity = (
        F.when(kind == "signup", F.when(_mod(3) == 0, "ticket_created").when(_mod(3) == 1, "review_requested").otherwise("ticket_started"))
        .when(kind == "click", "commit")
        .when(kind == "view", F.when(_mod(2) == 0, "review").otherwise("approved"))
        .when(kind == "error", F.when(_mod(2) == 0, "changes_requested").otherwise("ci_run"))
        .otherwise(F.when(_mod(3) == 0, "ticket_resolved").otherwise("merged"))
    )
    case = F.concat(F.lit("K-"), F.col("k"), F.lit("@"), F.date_format("ts", "yyyy-MM-dd"))
    return e.withColumns({"activity": activity, "work_item_id": case})


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, work_item_id, actor_hash (null on CI), activity, ts, duration_s, source, attrs."""
    e = raw_events(spark, sf_dir)
    act, ci = F.col("activity"), F.col("activity") == "ci_run"
    ticket = act.startswith("ticket_")
    attrs = F.struct(
        F.when(ticket, "asf_jira").when(ci, "github_actions").when(act != "commit", "github_graphql").alias("ingest_source"),
        F.when(act == "merged", F.concat(F.lit("u"), (F.col("user_id") + 7) % 150)).alias("authored_by"),
        F.when(ci, F.col("id").cast("string")).alias("run_id"),
        F.when(ci, F.when(_mod(5) == 0, "failure").otherwise("success")).alias("conclusion"),
        F.when(ci, F.when(_mod(4) == 1, 2).otherwise(1)).alias("attempt"),
        F.when(~ticket & ~ci & (act != "commit"), F.col("k").cast("string")).alias("pr_number"),
        F.when(ci, "machine").alias("actor_absent"),
        F.when(act == "commit", F.md5(F.col("id").cast("string"))).alias("sha"),
    )
    return e.select(
        F.col("id").cast("string").alias("event_id"),
        "work_item_id",
        F.when(~ci, F.concat(F.lit("u"), F.col("user_id"))).alias("actor_hash"),
        "activity",
        "ts",
        F.when(ci, F.round(F.col("value") * 60, 3)).alias("duration_s"),
        F.when(ticket, "jira").otherwise("github").alias("source"),
        attrs.alias("attrs"),
    )


def work_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per case with its attributes; a tenth of the cases has no component."""
    e = raw_events(spark, sf_dir)
    closing = F.col("activity").isin("merged", "ticket_resolved")
    cases = e.groupBy("work_item_id", "k").agg(
        F.min("ts").alias("opened_at"),
        F.max(F.when(closing, F.col("ts"))).alias("closed_at"),
        F.min(F.when(F.col("activity") == "ticket_created", F.col("ts"))).alias("jira_created_at"),
    )
    k = F.col("k")
    return cases.select(
        "work_item_id",
        F.concat(F.lit("org/r"), k % 2).alias("repo"),
        F.when(k % 10 != 9, F.concat(F.lit("c"), k % 10)).alias("component"),
        F.concat(F.lit("e"), k % 7).alias("epic"),
        F.floor(F.datediff("opened_at", F.lit("2024-01-01")) / 14).cast("int").alias("sprint"),
        F.when(F.col("jira_created_at").isNotNull(), "jira").when(k % 3 == 0, "pr").otherwise("commit").alias("case_source"),
        F.when(F.col("jira_created_at").isNotNull(), F.concat(F.lit("PRJ-"), k)).alias("jira_key"),
        F.concat(F.lit("type"), k % 3).alias("issue_type"),
        F.when(k % 4 != 3, F.concat(F.lit("p"), k % 4)).alias("priority"),
        "opened_at",
        "closed_at",
        "jira_created_at",
    )


def actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """actor_hash, role_band (every fifth actor has none), first_seen."""
    bands = F.array(*[F.lit(b) for b in ("junior", "mid", "senior", "staff")])
    seen = read(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("first_seen"))
    return seen.select(F.concat(F.lit("u"), F.col("user_id")).alias("actor_hash"), F.when(F.col("user_id") % 5 < 4, F.element_at(bands, (F.col("user_id") % 5 + 1).cast("int"))).alias("role_band"), "first_seen")


def ci_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, work_item_id (every seventh run is unattributed), repo, ts, runner_minutes, conclusion, attempt."""
    e = raw_events(spark, sf_dir).where("activity = 'ci_run'")
    return e.select(
        F.col("id").cast("string").alias("run_id"),
        F.when(_mod(7) != 0, F.col("work_item_id")).alias("work_item_id"),
        F.concat(F.lit("org/r"), F.col("k") % 2).alias("repo"),
        "ts",
        F.round("value", 3).alias("runner_minutes"),
        F.when(_mod(5) == 0, "failure").otherwise("success").alias("conclusion"),
        F.when(_mod(4) == 1, 2).otherwise(1).alias("attempt"),
    )


def calendar_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meeting_id, work_item_id, ts, duration_min, attendee_count: one for every event."""
    e = raw_events(spark, sf_dir)
    return e.select(F.concat(F.lit("m"), F.col("id")).alias("meeting_id"), "work_item_id", "ts", F.when(_mod(100) == 7, 30.0).otherwise(45.0).alias("duration_min"), (2 + _mod(5)).cast("int").alias("attendee_count"))


def ai_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """usage_id, work_item_id, ts, tokens_in, tokens_out: one for every event."""
    e = raw_events(spark, sf_dir)
    return e.select(F.concat(F.lit("a"), F.col("id")).alias("usage_id"), "work_item_id", "ts", (1000 + _mod(977) * 40).alias("tokens_in"), (200 + _mod(331) * 15).alias("tokens_out"))


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second log: a case is an order, a line a merge on its ship date or, if returned, a request for changes."""
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    opened = orders.select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("event_id"), F.col("o_orderkey").alias("case"), F.lit(None).cast("string").alias("actor_hash"), F.lit("commit").alias("activity"), F.col("o_orderdate").alias("ts"))
    act = F.when(F.col("l_returnflag") == "R", "changes_requested").when(F.col("l_linestatus") == "F", "merged").otherwise("review")
    lined = lines.select(
        F.concat(F.lit("l"), F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber"), F.lit("-"), F.col("l_partkey"), F.lit("-"), F.col("l_suppkey")).alias("event_id"),
        F.col("l_orderkey").alias("case"),
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("actor_hash"),
        act.alias("activity"),
        F.col("l_shipdate").alias("ts"),
    )
    return opened.unionByName(lined).select("event_id", F.concat(F.lit("O-"), F.col("case")).alias("work_item_id"), "actor_hash", "activity", "ts")
