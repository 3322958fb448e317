"""Payloads as connectors would land them, built from the derived events: pull requests, issues, change logs, CI runs and a commit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sample_log import raw_events

#: Whose tickets are valid where.
PROJECTS = (("PRJ", "org/r0"), ("QRS", "org/r1"))


def iso(c: str) -> Column:
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))


def _listed(which: Column, value: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("ts", "id", value.alias("v"))))), lambda x: x["v"])


def _person(bot: Column) -> Column:
    return F.struct(F.when(bot, "Bot").otherwise("User").alias("__typename"), bot.alias("is_bot"), F.when(~bot, F.concat(F.lit("u"), F.col("user_id"))).alias("actor_hash"))


def pull_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One landed pull request per case: entity_id and body."""
    e = raw_events(spark, sf_dir)
    act, k, bot = F.col("activity"), F.col("k"), F.col("user_id") % 10 == 0
    review = F.struct(F.when(act == "approved", "APPROVED").when(act == "changes_requested", "CHANGES_REQUESTED").when(F.col("id") % 6 == 0, "DISMISSED").when(F.col("id") % 6 == 2, "PENDING").otherwise("COMMENTED").alias("state"), iso("ts").alias("submittedAt"), _person(bot).alias("author"))
    asked = F.struct(F.lit("ReviewRequestedEvent").alias("__typename"), iso("ts").alias("createdAt"), _person(bot).alias("actor"), F.struct(F.when(F.col("id") % 2 == 0, F.concat(F.lit("u"), (F.col("user_id") + 3) % 150)).alias("actor_hash"), F.when(F.col("id") % 2 == 1, "team").alias("slug")).alias("requestedReviewer"))
    commit = F.struct(F.struct(F.md5(F.col("id").cast("string")).alias("oid"), iso("ts").alias("authoredDate"), F.struct(_person(bot).alias("user")).alias("author")).alias("commit"))
    reviews = act.isin("review", "approved", "changes_requested")
    merged = F.min(F.when(act == "merged", F.struct("ts", F.col("id"), _person(bot).alias("who"))))
    cases = e.groupBy("work_item_id", "k").agg(
        F.min("ts").alias("opened"), merged.alias("m"), F.min(F.struct("ts", "id", _person(bot).alias("who"))).alias("first"),
        _listed(reviews, review).alias("reviews"), _listed(act == "review_requested", asked).alias("asked"), _listed(act == "commit", commit).alias("commits"),
    )
    number = k * 100 + F.dayofmonth("opened")
    text = F.concat(F.lit("see QRS-"), k, F.lit(" and KIP-"), k % 9)
    body = F.struct(
        F.concat(F.lit("org/r"), k % 2).alias("repo"), number.alias("number"), F.when(k % 3 == 0, F.concat(F.lit("PRJ-"), k, F.lit(": fix"))).otherwise("small fix").alias("title"), F.when(k % 5 == 0, text).otherwise("").alias("body"),
        F.when(k % 7 == 0, F.concat(F.lit("QRS-"), k, F.lit("-branch"))).otherwise("topic").alias("headRefName"), iso("opened").alias("createdAt"), F.when(F.col("m").isNotNull(), iso("m.ts")).alias("mergedAt"), F.when(F.col("m").isNotNull(), iso("m.ts")).alias("closedAt"),
        F.struct(F.md5(F.concat(F.lit("merge"), F.col("m.id"))).alias("oid")).alias("mergeCommit"), F.col("first.who").alias("author"), F.col("m.who").alias("mergedBy"), F.struct(F.concat(F.lit("M"), k % 4).alias("title")).alias("milestone"),
        F.array(F.lit("bug"), F.concat(F.lit("C"), k % 10), F.concat(F.lit("c"), (k + 1) % 10)).alias("labels"), F.struct(F.col("reviews").alias("nodes")).alias("reviews"), F.struct(F.col("asked").alias("nodes")).alias("timelineItems"),
        F.struct((F.size("commits") + F.when(k % 11 == 0, 5).otherwise(0)).alias("totalCount"), F.col("commits").alias("nodes")).alias("commits"),
    )
    return cases.select(F.concat_ws("#", F.concat(F.lit("org/r"), k % 2), number.cast("string")).alias("entity_id"), F.to_json(body).alias("body"))


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One landed issue per key: entity_id and body."""
    e = raw_events(spark, sf_dir).where("activity like 'ticket%'")
    keys = e.groupBy("k").agg(F.min("ts").alias("created"))
    key = F.concat(F.when(F.col("k") % 2 == 0, "PRJ-").otherwise("QRS-"), F.col("k"))
    fields = F.struct(
        iso("created").alias("created"), iso("created").alias("updated"), F.array(F.struct(F.concat(F.lit("c"), F.col("k") % 10).alias("name"))).alias("components"),
        F.struct(F.concat(F.lit("type"), F.col("k") % 3).alias("name")).alias("issuetype"), F.struct(F.concat(F.lit("p"), F.col("k") % 4).alias("name")).alias("priority"),
    )
    return keys.select(key.alias("entity_id"), F.to_json(F.struct(key.alias("key"), fields.alias("fields"))).alias("body"))


STATUSES = ("In Progress", "Patch Available", "Triage", "Closed", "Resolved", "reopened")


def changelogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log of each key: entity_id and body; every history changes a status and a field that is no status."""
    e = raw_events(spark, sf_dir).where("activity like 'ticket%'")
    names = F.array(*[F.lit(s) for s in STATUSES])
    item = F.struct(F.lit("status").alias("field"), F.lit("jira").alias("fieldtype"), F.lit("Open").alias("fromString"), F.element_at(names, (F.col("id") % 6 + 1).cast("int")).alias("toString"))
    other = F.struct(F.lit("assignee").alias("field"), F.lit("jira").alias("fieldtype"), F.lit("a").alias("fromString"), F.lit("b").alias("toString"))
    bot = F.col("user_id") % 10 == 0
    who = F.struct(F.when(~bot, F.concat(F.lit("u"), F.col("user_id"))).alias("actor_hash"), bot.alias("is_bot"))
    history = F.struct(F.col("id").cast("string").alias("id"), iso("ts").alias("created"), who.alias("author"), F.array(other, item).alias("items"))
    logs = e.groupBy("k").agg(_listed(F.lit(True), history).alias("histories"))
    key = F.concat(F.when(F.col("k") % 2 == 0, "PRJ-").otherwise("QRS-"), F.col("k"))
    return logs.select(key.alias("entity_id"), F.to_json(F.struct(key.alias("key"), "histories")).alias("body"))


def workflow_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed CI runs: entity_id and body; the head commit is that of a commit event of the same case where there is one."""
    e = raw_events(spark, sf_dir)
    heads = e.where("activity = 'commit'").groupBy("work_item_id").agg(F.min("id").alias("head"))
    runs = e.where("activity = 'ci_run'").join(heads, "work_item_id", "left")
    end = F.expr("timestampadd(SECOND, cast(floor(value * 60) as bigint), ts)")
    body = F.struct(F.col("id"), F.concat(F.lit("org/r"), F.col("k") % 2).alias("repo"), F.when(F.col("head").isNotNull(), F.md5(F.col("head").cast("string"))).alias("head_sha"), iso("ts").alias("run_started_at"), F.concat(F.date_format(end, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("updated_at"), F.when(F.col("id") % 5 == 0, "failure").otherwise("success").alias("conclusion"), F.when(F.col("id") % 4 == 1, 2).otherwise(1).alias("run_attempt"))
    return runs.select(F.col("id").cast("string").alias("entity_id"), F.to_json(body).alias("body"))


def commit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commit records as the log reader gives them: repo and value."""
    e = raw_events(spark, sf_dir).where("activity = 'commit'")
    k, sha = F.col("k"), F.md5(F.col("id").cast("string"))
    subject = F.when(k % 3 == 0, F.concat(F.lit("PRJ-"), k, F.lit(" fix|pipe"))).when(k % 3 == 1, F.concat(F.lit("change (#"), k, F.lit(")"))).otherwise("plain change")
    mail = F.when(k % 4 == 0, F.concat(F.lit("12+u"), F.col("user_id"), F.lit("@users.noreply.github.com"))).when(k % 4 == 1, F.concat(F.lit("U"), F.col("user_id"), F.lit("@apache.org"))).when(k % 4 == 2, F.concat(F.lit("u"), F.col("user_id"), F.lit("@example.org"))).otherwise("")
    time = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    head = F.concat_ws("|", sha, time, time, mail, F.concat(F.lit("Name "), F.col("user_id")), F.lit("p1 p2"), subject)
    lines = F.concat_ws("\n", head, F.concat_ws("\t", (F.col("id") % 9).cast("string"), (F.col("id") % 4).cast("string"), F.concat(F.lit("c"), k % 10, F.lit("/a.py"))), F.concat(F.lit("-\t-\tbin/x.dat")), F.concat_ws("\t", F.lit("1"), F.lit("0"), F.concat(F.lit("c"), k % 10, F.lit("/{old => new}/b.py"))), F.lit(""))
    return e.select(F.concat(F.lit("org/r"), k % 2).alias("repo"), lines.alias("value"))
