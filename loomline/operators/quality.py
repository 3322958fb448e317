"""Checks on an event log. Each gives a table, most of them one row; `verdict` rolls their status up.

A check's row has check, status (PASS, WARN, FAIL or SKIP) and value, a count or share that explains it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import count_if, hours_between, is_in
from ..functions.ranks import with_ranks
from ..params import DEFAULT, Params
from .privacy import identity_columns

SEVERITY = ("SKIP", "PASS", "WARN", "FAIL")


def result(df: DataFrame, check: str, status: Column, value: Column) -> DataFrame:
    """A check's row from a one-row table."""
    return df.select(F.lit(check).alias("check"), status.alias("status"), value.cast("double").alias("value"))


def row_counts(tables: dict[str, DataFrame], required: tuple[str, ...] = (), ceilings: dict[str, int] | None = None) -> DataFrame:
    """Q1: rows of each table; FAIL for an empty required one, or more rows than plausible, or fewer events than cases."""
    out = None
    for name, df in tables.items():
        top = (ceilings or {}).get(name)
        n = F.count("*")
        status = F.when((n == 0) & F.lit(name in required), "FAIL").when(n > top, "FAIL").otherwise("PASS") if top is not None else F.when((n == 0) & F.lit(name in required), "FAIL").otherwise("PASS")
        row = df.agg(F.lit(f"rows:{name}").alias("check"), status.alias("status"), n.cast("double").alias("value"))
        out = row if out is None else out.unionByName(row)
    if {"events", "items"} <= set(tables):
        both = tables["events"].agg(F.count("*").alias("e")).crossJoin(tables["items"].agg(F.count("*").alias("i")))
        out = out.unionByName(result(both, "events_per_item", F.when(F.col("e") < F.col("i"), "FAIL").otherwise("PASS"), F.col("e") / F.nullif(F.col("i"), F.lit(0))))
    return out


def merge_order(events: DataFrame) -> DataFrame:
    """Q2: cases merged before their first commit, or without any; WARN if nothing was merged at all."""
    firsts = events.groupBy("work_item_id").agg(F.min(F.when(F.col("activity") == "merged", F.col("ts"))).alias("m"), F.min(F.when(F.col("activity") == "commit", F.col("ts"))).alias("c"))
    row = firsts.agg(F.count("m").alias("merged"), count_if(F.col("m") < F.col("c")).alias("before"), count_if(F.col("m").isNotNull() & F.col("c").isNull()).alias("without"))
    status = F.when(F.col("merged") == 0, "WARN").when(F.col("before") + F.col("without") > 0, "FAIL").otherwise("PASS")
    return row.select(F.lit("merge_order").alias("check"), status.alias("status"), (F.col("before") + F.col("without")).cast("double").alias("value"), F.col("before").alias("n_before"), F.col("without").alias("n_without_commit"))


def orphan_actors(events: DataFrame, actors: DataFrame) -> DataFrame:
    """Q3: actors of events that are not in the actor table."""
    return events.where("actor_hash is not null").select("actor_hash").distinct().join(actors, "actor_hash", "left_anti")


def missing_sprints(items: DataFrame) -> DataFrame:
    """Q4: cases without a sprint."""
    return items.where("sprint is null").select("work_item_id")


def vocabulary(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Q5: values outside the closed vocabulary, null among them, with their counts."""
    return df.where(F.col(column).isNull() | ~is_in(column, allowed)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def split_valid(df: DataFrame, column: str, allowed: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Q5: rows inside the vocabulary, and the others."""
    ok = F.coalesce(is_in(column, allowed), F.lit(False))
    return df.where(ok), df.where(~ok)


def identity_check(tables: dict[str, DataFrame], exempt: tuple[str, ...] = ()) -> DataFrame:
    """Q6: columns of any table, at any depth, that are named after an identity."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, c) for t, df in tables.items() for c in identity_columns(df) if c not in exempt]
    return spark.createDataFrame(rows, "table_name string, column_name string")


def k_survival(events: DataFrame, items: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Q7: people, cases and events per component and whether it clears the floor, the fallback or neither."""
    joined = events.where("actor_hash is not null").join(items.select("work_item_id", "component"), "work_item_id")
    by = joined.groupBy("component").agg(F.countDistinct("actor_hash").alias("n_actors"), F.countDistinct("work_item_id").alias("n_items"), F.count("*").alias("n_events"))
    return by.withColumn("survives", F.when(F.col("n_actors") >= p.k, "floor").when(F.col("n_actors") >= p.k_fallback, "fallback").otherwise("suppressed"))


def k_verdict(survival: DataFrame) -> DataFrame:
    """Q7: PASS if any component clears the floor, WARN if one clears the fallback."""
    row = survival.agg(count_if(F.col("survives") == "floor").alias("a"), count_if(F.col("survives") != "suppressed").alias("b"))
    return result(row, "k_survival", F.when(F.col("a") > 0, "PASS").when(F.col("b") > 0, "WARN").otherwise("FAIL"), F.col("a"))


def latency_coverage(latency: DataFrame, events: DataFrame, least: float = 0.4) -> DataFrame:
    """Q8: the share of cases with a review latency."""
    row = latency.agg(F.countDistinct("work_item_id").alias("a")).crossJoin(events.agg(F.countDistinct("work_item_id").alias("b")))
    share = F.col("a") / F.nullif(F.col("b"), F.lit(0))
    return result(row, "latency_coverage", F.when(F.coalesce(share, F.lit(0.0)) >= least, "PASS").otherwise("FAIL"), share)


def trainable_windows(events: DataFrame, items: DataFrame, least_items: int = 10, least_windows: int = 8) -> DataFrame:
    """Q9: how many sprints hold enough cases with events."""
    alive = items.where("sprint is not null").join(events.select("work_item_id").distinct(), "work_item_id", "left_semi")
    row = alive.groupBy("sprint").agg(F.count("*").alias("n")).agg(count_if(F.col("n") >= least_items).alias("a"))
    return result(row, "trainable_windows", F.when(F.col("a") >= least_windows, "PASS").otherwise("FAIL"), F.col("a"))


def umbrellas(items: DataFrame, pull_requests: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Q10: cases far longer than the median (strictly over the multiple; no limit if the median is not positive) or with many pull requests.

    pull_requests: work_item_id, n_prs.
    """
    spans = items.select("work_item_id", "case_source", (hours_between("opened_at", "closed_at") / 24).alias("days"))
    median = with_ranks(spans, [], "days", [F.count("*").alias("n")], {"median": (0.5, "between")}).select("median")
    limit = F.when(F.col("median") > 0, F.col("median") * p.umbrella_multiple)
    joined = spans.crossJoin(F.broadcast(median)).join(pull_requests, "work_item_id", "left")
    long, many = F.coalesce(F.col("days") > limit, F.lit(False)), F.coalesce(F.col("n_prs") >= p.umbrella_prs, F.lit(False))
    return joined.where(long | many).select("work_item_id", "case_source", "days", "n_prs", long.alias("over_span"), many.alias("over_prs"))


def verification(log: DataFrame, evidence: DataFrame, runs: DataFrame) -> DataFrame:
    """Q11: the report's counts, one row each."""
    human = ("ci_run", "deploy", "ticket_created")
    a = log.agg(
        F.count("*").alias("events"), count_if(F.col("ts").isNull()).alias("missing_ts"), count_if(F.col("resource").isNull()).alias("missing_actor"),
        count_if(F.col("resource").isNull() & ~is_in("activity", human)).alias("missing_actor_unexplained"), count_if(~F.col("in_window")).alias("before_window"),
    )
    b = evidence.agg(
        F.count("*").alias("cases"), count_if(F.col("n_events") > 0).alias("cases_with_events"), count_if(F.col("has_git") & F.col("has_pr") & F.col("has_jira")).alias("git_pr_jira"),
        count_if(F.col("has_git") & F.col("has_pr") & F.col("has_ci")).alias("git_pr_ci"), count_if(F.col("has_pr") & ~F.col("has_git")).alias("pr_without_git"), count_if(F.col("has_jira") & F.col("has_git")).alias("jira_with_git"), count_if(F.col("has_jira")).alias("jira_cases"),
    )
    c = runs.agg(F.count("*").alias("ci_runs"), count_if(F.col("work_item_id").isNull()).alias("ci_unmatched"))
    row = a.crossJoin(b).crossJoin(c)
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).cast("long").alias("n")) for n in row.columns])).alias("x")).select("x.*")


def evidence_duplicates(events: DataFrame, keys: dict[str, tuple[Column, list[Column]]]) -> DataFrame:
    """Q12: facts that landed more than once: for each kind of evidence, a filter and its natural key."""
    out = None
    for name, (which, key) in keys.items():
        n = events.where(which).groupBy(*[k.alias(f"k{i}") for i, k in enumerate(key)]).agg(F.count("*").alias("n")).where("n > 1")
        row = n.agg(F.lit(name).alias("evidence"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"))
        out = row if out is None else out.unionByName(row)
    return out


def order_violations(events: DataFrame, evidence: DataFrame, repo: Column) -> DataFrame:
    """Q13: cases of one pull request merged before their first commit, and cases that span repositories."""
    prs = events.where("attrs.pr_number is not null").groupBy(F.col("work_item_id").alias("case_id")).agg(F.countDistinct("attrs.pr_number").alias("n_prs"))
    early = evidence.where("merged_at < first_commit_at").join(prs, "case_id", "left").where(F.coalesce("n_prs", F.lit(1)) == 1)
    spanning = events.withColumn("_repo", repo).where("_repo is not null").groupBy("work_item_id").agg(F.countDistinct("_repo").alias("n")).where("n > 1")
    return early.agg(F.lit("merged_before_first_commit").alias("violation"), F.count("*").alias("n")).unionByName(spanning.agg(F.lit("case_spans_repositories").alias("violation"), F.count("*").alias("n")))


def source_anomalies(events: DataFrame, items: DataFrame, evidence: DataFrame) -> DataFrame:
    """Q14: odd but genuine orders, with the worst gap in days: approvals after the merge of the same pull request, events before their case opened, tickets younger than the first commit."""
    days = lambda a, b: F.round(F.max(hours_between(a, b) / 24), 0)
    pr = events.where("attrs.pr_number is not null").select("work_item_id", F.col("attrs.pr_number").alias("pr"), "activity", "ts")
    merged = pr.where("activity = 'merged'").select("work_item_id", "pr", F.col("ts").alias("merged_at"))
    late = pr.where("activity = 'approved'").join(merged, ["work_item_id", "pr"]).where("ts > merged_at")
    early = events.where("coalesce(attrs.ingest_source, '') != 'asf_jira'").join(items.select("work_item_id", "opened_at"), "work_item_id").where("ts < opened_at")
    young = evidence.where("ticket_created_at > first_commit_at")
    rows = [("approved_after_merge", late, days("merged_at", "ts")), ("before_case_opened", early, days("ts", "opened_at")), ("ticket_after_first_commit", young, days("first_commit_at", "ticket_created_at"))]
    out = None
    for name, df, worst in rows:
        row = df.agg(F.lit(name).alias("anomaly"), F.count("*").alias("n"), worst.alias("worst_days"))
        out = row if out is None else out.unionByName(row)
    return out


def null_actor_reasons(events: DataFrame) -> DataFrame:
    """Q15: why events have no actor; `unexplained` must not appear."""
    absent = F.col("attrs.actor_absent")
    reason = F.when(is_in("activity", ("ci_run", "deploy")), "ci").when(F.col("activity") == "ticket_created", "ticket without reporter").when(absent == "bot", "bot").when(absent == "unattributed", "deleted account").otherwise("unexplained")
    return events.where("actor_hash is null").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def verdict(*checks: DataFrame) -> DataFrame:
    """Q16: the worst status of all checks, and how many have each."""
    every = None
    for c in checks:
        c = c.select("check", "status")
        every = c if every is None else every.unionByName(c)
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col("status"))
    return every.agg(F.max_by("status", rank).alias("verdict"), *[count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in SEVERITY])


def guard(candidates: DataFrame, referenced: DataFrame, key: str = "event_id") -> int:
    """Q17: raises unless there is something to remove and none of it is referenced; gives the number of candidates."""
    n = candidates.count()
    if n == 0:
        raise ValueError("nothing to remove")
    if not referenced.where(F.col(key).isNotNull()).join(candidates.select(key), key, "left_semi").isEmpty():
        raise ValueError("rows to remove are referenced by others")
    return n


def evidence_counts(evidence: DataFrame) -> DataFrame:
    """Q18: cases by which kinds of evidence they have together."""
    return evidence.agg(count_if(F.col("has_git") & F.col("has_pr") & F.col("has_jira")).alias("git_pr_jira"), count_if(F.col("has_git") & F.col("has_pr") & F.col("has_ci")).alias("git_pr_ci"), count_if(F.col("has_pr") & ~F.col("has_git")).alias("pr_without_git"))


def orphaned_cases(items: DataFrame, events: DataFrame) -> DataFrame:
    """Q19: cases without events by where they came from; counted, never removed."""
    return items.join(events.select("work_item_id").distinct(), "work_item_id", "left_anti").groupBy("case_source").agg(F.count("*").alias("n"))


def payload_completeness(prs: DataFrame) -> DataFrame:
    """Q20: pull-request payloads whose list of commits was cut short, and what they hold. Reads commits and timelineItems."""
    held = F.coalesce(F.size("commits.nodes"), F.lit(0))
    kinds = {"review_requested": "ReviewRequestedEvent", "reopened": "ReopenedEvent", "force_pushed": "HeadRefForcePushedEvent"}

    def count(kind: str) -> Column:
        return F.sum(F.coalesce(F.size(F.filter("timelineItems.nodes", lambda x: x["__typename"] == kind)), F.lit(0))).cast("long")

    return prs.agg(F.count("*").alias("n_payloads"), count_if(F.col("commits.totalCount") > held).alias("n_truncated"), F.sum(held).cast("long").alias("n_commits"), F.sum(F.coalesce(F.size("reviews.nodes"), F.lit(0))).cast("long").alias("n_reviews"), *[count(k).alias(f"n_{n}") for n, k in kinds.items()])


def tracker_report(issues: DataFrame, events: DataFrame, project: str) -> DataFrame:
    """Q21: distinct keys, those with commits, duplicate payloads, and keys that are not of the project. issues: one row per landed payload, with key."""
    keys = issues.groupBy("key").agg(F.count("*").alias("n"))
    committed = events.where("activity = 'commit'").select(F.col("work_item_id").alias("key")).distinct().withColumn("has", F.lit(1))
    row = keys.join(committed, "key", "left").agg(F.count("*").alias("n_keys"), F.count("has").alias("n_with_commits"), count_if(F.col("n") > 1).alias("n_duplicated"), count_if(~F.col("key").rlike(f"^{project}-[0-9]+$")).alias("n_malformed"))
    return row.withColumn("overlap", F.coalesce(F.try_divide("n_with_commits", "n_keys"), F.lit(0.0)))


def ci_report(runs: DataFrame) -> DataFrame:
    """Q22: runs, mapped ones, repetitions, failures, and minutes."""
    again = F.col("attempt") > 1
    return runs.agg(
        F.count("*").alias("n_runs"), F.count("work_item_id").alias("n_mapped"), count_if(again).alias("n_reruns"), count_if(F.col("conclusion") == "failure").alias("n_failures"),
        F.coalesce(F.sum("runner_minutes"), F.lit(0.0)).alias("total_minutes"), F.coalesce(F.sum(F.when(again, F.col("runner_minutes"))), F.lit(0.0)).alias("rerun_minutes"),
    )
