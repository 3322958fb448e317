"""From landed payloads to the canonical event log: windows, keys, cases, components, events, repairs.

Everything is order independent: where several rows compete, a minimum, maximum or a declared order decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import col, evidence_id, iso_utc, micros
from ..params import DEFAULT, Params
from ..schema import ATTRS, CHANGELOG, ISSUE, PULL_REQUEST

# How states and types become activities.
REVIEW_STATES = (("APPROVED", "approved"), ("CHANGES_REQUESTED", "changes_requested"), ("COMMENTED", "review"), ("DISMISSED", "review"))
TIMELINE = (("ReviewRequestedEvent", "review_requested"), ("ReopenedEvent", "reopened"), ("HeadRefForcePushedEvent", "force_push"))
STATUSES = (
    ("in progress", "ticket_started"), ("patch available", "ticket_in_review"), ("in review", "ticket_in_review"), ("reviewable", "ticket_in_review"),
    ("resolved", "ticket_resolved"), ("closed", "ticket_closed"), ("reopened", "ticket_reopened"), ("open", "ticket_reopened"),
)
RENAMED = (
    ("commit", "commit"), ("pr_opened", None), ("review_requested", "review_requested"), ("review_submitted", "review"), ("changes_requested", "changes_requested"),
    ("approved", "approved"), ("reopened", "reopened"), ("force_push", "force_push"), ("merged", "merged"), ("ci_started", "ci_run"), ("ci_completed", "ci_run"),
    ("ci_rerun", "ci_run"), ("jira_status_changed", None),
)
TICKET = r"(?<![A-Za-z0-9])([A-Z]{2,10}-[0-9]+)(?![0-9])"
LEADING_TICKET = r"^\s*\[?([A-Z]{2,10}-[0-9]+)\]?"
TRAILING_PR = r"\(#([0-9]+)\)\s*$"
EPIC = r"(?<![A-Za-z0-9])((?:KIP|FLIP)-[0-9]+)"
ROOT = "(root)"
CASE_SOURCES = ("ticket_key", "issue", "pr")


def lookup(c: str | Column, pairs: tuple[tuple[str, str | None], ...]) -> Column:
    """A small fixed table as an expression; null for what is not in it."""
    return F.create_map(*[F.lit(x) for k, v in pairs if v is not None for x in (k, v)])[col(c)]


def attrs(**values: Column) -> Column:
    """The attribute struct with the given fields set, as strings."""
    return F.struct(*[values.get(a, F.lit(None)).cast("string").alias(a) for a in ATTRS]).alias("attrs")


def parsed(payloads: DataFrame, schema: str) -> DataFrame:
    """The bodies of landed payloads as columns."""
    return payloads.select("entity_id", F.from_json("body", schema).alias("b")).select("entity_id", "b.*")


def stamp(c: str | Column) -> Column:
    """A timestamp in either offset style, or null."""
    return F.try_to_timestamp(col(c))


def window_filter(prs: DataFrame, cutoff: str) -> DataFrame:
    """Pull requests merged (or, if not merged, created) before the cutoff go; those without dates stay. in_old: created before it all the same."""
    limit, created = F.lit(cutoff).cast("timestamp"), stamp("createdAt")
    last = F.coalesce(stamp("mergedAt"), created)
    return prs.where(~F.coalesce(last < limit, F.lit(False))).withColumn("created_before", F.coalesce(created < limit, F.lit(False)))


def window_counts(prs: DataFrame, cutoff: str) -> DataFrame:
    """How many the filter drops, and how many older ones it keeps."""
    limit, created = F.lit(cutoff).cast("timestamp"), stamp("createdAt")
    out = F.coalesce(F.coalesce(stamp("mergedAt"), created) < limit, F.lit(False))
    return prs.agg(F.count(F.when(out, 1)).alias("n_outside"), F.count(F.when(~out & F.coalesce(created < limit, F.lit(False)), 1)).alias("n_old_kept"))


def ticket_key(prs: DataFrame, projects: DataFrame) -> DataFrame:
    """The first valid key in title, branch or body, and the field it is in. projects(repo, project): whose keys are valid where."""
    prs = prs.join(projects, "repo", "left")

    def first(field: str) -> Column:
        found = F.regexp_extract_all(F.coalesce(F.col(field), F.lit("")), F.lit(TICKET), F.lit(1))
        return F.try_element_at(F.filter(found, lambda k: F.split_part(k, F.lit("-"), F.lit(1)) == F.col("project")), F.lit(1))

    fields = ("title", "headRefName", "body")
    known = prs.withColumns({f"_{f}": first(f) for f in fields})
    source = F.when(F.col("_title").isNotNull(), "title").when(F.col("_headRefName").isNotNull(), "headRefName").when(F.col("_body").isNotNull(), "body").otherwise("none")
    return known.withColumns({"ticket": F.coalesce(*[F.col(f"_{f}") for f in fields]), "key_from": source}).drop(*[f"_{f}" for f in fields], "project")


def resolve_case(prs: DataFrame, commit_cases: DataFrame, use_issues: bool = False) -> DataFrame:
    """A pull request's case: its ticket, a closing issue (if asked for), else repo#number.

    A ticket found only in the body does not count if commits already made a case of the pull request.
    commit_cases: work_item_id of cases that commits made.
    """
    own = F.concat_ws("#", "repo", F.col("number").cast("string"))
    made = commit_cases.select(F.col("work_item_id").alias("_own")).distinct().withColumn("_made", F.lit(True))
    known = prs.withColumn("_own", own).join(made, "_own", "left")
    veto = (F.col("key_from") == "body") & F.col("_made").isNotNull()
    issue = F.lit(None).cast("string")
    if use_issues:
        nodes = F.col("closingIssuesReferences.nodes")
        issue = F.try_element_at(F.transform(nodes, lambda n: F.concat_ws("#", n["repository"]["nameWithOwner"], n["number"].cast("string"))), F.lit(1))
    ticket = F.when(~veto, F.col("ticket"))
    return known.select(*[c for c in prs.columns if c != "ticket"], ticket.alias("ticket"), F.coalesce(ticket, issue, F.col("_own")).alias("work_item_id"), F.when(ticket.isNotNull(), "ticket_key").when(issue.isNotNull(), "issue").otherwise("pr").alias("case_source"))


def commit_case(commits: DataFrame, projects: DataFrame) -> DataFrame:
    """A commit's case: a valid ticket at the beginning of the subject, the pull request at its end, else repo@sha."""
    key = F.nullif(F.regexp_extract("subject", LEADING_TICKET, 1), F.lit(""))
    pr = F.nullif(F.regexp_extract("subject", TRAILING_PR, 1), F.lit(""))
    known = commits.join(projects, "repo", "left").withColumn("ticket", F.when(F.split_part(key, F.lit("-"), F.lit(1)) == F.col("project"), key)).drop("project")
    case = F.coalesce("ticket", F.when(pr.isNotNull(), F.concat_ws("#", F.col("repo"), pr)), F.concat_ws("@", F.col("repo"), F.substring("sha", 1, 12)))
    return known.withColumns({"work_item_id": case, "case_source": F.when(F.col("ticket").isNotNull(), "ticket_key").otherwise("pr")})


def top_folder(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.split_part(path, F.lit("/"), F.lit(1))).otherwise(ROOT)


def component(files: str | Column) -> Column:
    """The top folder of most files, the alphabetically first on ties; `(root)` for files outside folders; null without files."""
    tops = F.transform(col(files), top_folder)
    counted = F.transform(F.array_distinct(tops), lambda t: F.struct((-F.size(F.filter(tops, lambda x: x == t))).alias("n"), t.alias("t")))
    return F.array_min(counted)["t"]


def component_from_labels(prs: DataFrame, known: DataFrame) -> DataFrame:
    """The first label that is a component that commits of the repository know. known(repo, component)."""
    names = known.where("component is not null").select("repo", F.lower("component").alias("_name")).distinct()
    labels = prs.select("repo", "number", F.posexplode("labels").alias("_at", "_label")).withColumn("_name", F.lower("_label"))
    first = labels.join(names, ["repo", "_name"]).groupBy("repo", "number").agg(F.min_by("_name", "_at").alias("component"))
    return prs.drop("component").join(first, ["repo", "number"], "left")


def epic(*texts: str, otherwise: Column | None = None) -> Column:
    """The first proposal named in the texts, else the given column."""
    found = [F.nullif(F.regexp_extract(F.coalesce(F.col(t), F.lit("")), EPIC, 1), F.lit("")) for t in texts]
    return F.coalesce(*found, *([otherwise] if otherwise is not None else []))


def person(c: Column) -> Column:
    """The pseudonym of a person object; null for bots and absent accounts."""
    return F.when(~F.coalesce(c["is_bot"], F.lit(False)), c["actor_hash"])


def absent(c: Column) -> Column:
    """Why a person object has no pseudonym."""
    return F.when(F.coalesce(c["is_bot"], F.lit(False)), "bot").when(c["actor_hash"].isNull(), "unattributed")


def _base(activity: Column, ts: Column, *more: Column) -> Column:
    return evidence_id(F.lit("github_graphql"), F.lit("pull_request"), F.concat_ws("#", F.col("repo"), F.col("number").cast("string")), activity, iso_utc(ts), *more)


def merged_events(prs: DataFrame) -> DataFrame:
    """One event per merged pull request; its actor pressed merge, its author is an attribute."""
    ts = stamp("mergedAt")
    extra = attrs(ingest_source=F.lit("github_graphql"), pr_number=F.col("number"), merge_commit_sha=F.col("mergeCommit.oid"), authored_by=person(F.col("author")), actor_absent=absent(F.col("mergedBy")), repo=F.col("repo"))
    return prs.where(ts.isNotNull()).select(_base(F.lit("merged"), ts).alias("event_id"), "work_item_id", person(F.col("mergedBy")).alias("actor_hash"), F.lit("merged").alias("activity"), ts.alias("ts"), F.lit("github").alias("source"), extra)


def review_events(prs: DataFrame) -> DataFrame:
    """Reviews by state; pending ones, and those of bots and absent accounts, are dropped."""
    r = prs.select("repo", "number", "work_item_id", F.explode("reviews.nodes").alias("r"))
    r = r.withColumns({"activity": lookup("r.state", REVIEW_STATES), "ts": stamp("r.submittedAt"), "actor_hash": person(F.col("r.author"))}).where("activity is not null and ts is not null and actor_hash is not null")
    extra = attrs(ingest_source=F.lit("github_graphql"), pr_number=F.col("number"), review_state=F.col("r.state"), repo=F.col("repo"))
    return r.select(_base(F.col("activity"), F.col("ts"), F.col("actor_hash")).alias("event_id"), "work_item_id", "actor_hash", "activity", "ts", F.lit("github").alias("source"), extra)


def timeline_events(prs: DataFrame) -> DataFrame:
    """Requests for review (the person or team asked is part of the id), reopenings and forced pushes."""
    t = prs.select("repo", "number", "work_item_id", F.explode("timelineItems.nodes").alias("t"))
    target = F.coalesce("t.requestedReviewer.actor_hash", "t.requestedReviewer.slug", F.lit(""))
    t = t.withColumns({"activity": lookup("t.__typename", TIMELINE), "ts": stamp("t.createdAt"), "target": target}).where("activity is not null and ts is not null")
    extra = attrs(ingest_source=F.lit("github_graphql"), pr_number=F.col("number"), requested_reviewer=F.nullif("target", F.lit("")), actor_absent=absent(F.col("t.actor")), repo=F.col("repo"))
    return t.select(_base(F.col("activity"), F.col("ts"), F.col("target")).alias("event_id"), "work_item_id", person(F.col("t.actor")).alias("actor_hash"), "activity", "ts", F.lit("github").alias("source"), extra)


def commit_id(sha: Column, ts: Column) -> Column:
    """The id of a commit event, the same from the commit log and from a pull request."""
    return evidence_id(F.lit("git_local"), F.lit("commit"), sha, F.lit("commit"), iso_utc(ts))


def pr_commit_events(prs: DataFrame) -> DataFrame:
    """Commits listed by pull requests; bots' are dropped."""
    c = prs.select("repo", "number", "work_item_id", F.explode("commits.nodes").alias("n")).select("repo", "number", "work_item_id", "n.commit.*")
    c = c.withColumn("ts", stamp("authoredDate")).where("oid is not null and ts is not null").where(~F.coalesce(F.col("author.user.is_bot"), F.lit(False)))
    extra = attrs(ingest_source=F.lit("github_graphql"), sha=F.col("oid"), pr_number=F.col("number"), actor_absent=absent(F.col("author.user")), repo=F.col("repo"))
    return c.select(commit_id(F.col("oid"), F.col("ts")).alias("event_id"), "work_item_id", person(F.col("author.user")).alias("actor_hash"), F.lit("commit").alias("activity"), "ts", F.lit("github").alias("source"), extra)


def pr_events(prs: DataFrame) -> DataFrame:
    """N7 to N10 together: all events of parsed pull requests whose case is resolved."""
    return merged_events(prs).unionByName(review_events(prs)).unionByName(timeline_events(prs)).unionByName(pr_commit_events(prs))


def commit_events(commits: DataFrame) -> DataFrame:
    """Commits of the log as events. commits: parsed, with repo, work_item_id and actor_hash; those without an actor are bots' and dropped."""
    extra = attrs(ingest_source=F.lit("git_local"), sha=F.col("sha"), repo=F.col("repo"))
    known = commits.where("actor_hash is not null")
    return known.select(commit_id(F.col("sha"), F.col("authored_at")).alias("event_id"), "work_item_id", "actor_hash", F.lit("commit").alias("activity"), F.col("authored_at").alias("ts"), F.lit("github").alias("source"), extra)


def commit_cases(commits: DataFrame) -> DataFrame:
    """Provisional cases of commits: opened by the first of them, with its component."""
    first = F.struct("authored_at", "sha")
    files = component("files")
    return commits.withColumn("_c", files).groupBy("work_item_id", "repo").agg(
        F.min("authored_at").alias("opened_at"), F.min_by("_c", F.when(F.col("_c").isNotNull(), first)).alias("component"), F.min("case_source").alias("case_source"), F.min("ticket").alias("jira_key"), F.min_by("sha", first).alias("source_ref"),
    )


def ticket_events(issues: DataFrame, changelogs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Creation and status changes of issues as events, and the statuses no activity stands for, with counts."""
    created = stamp("fields.created")
    first = issues.where(created.isNotNull()).select(
        evidence_id(F.lit("asf_jira"), F.lit("issue"), "key", F.lit("ticket_created")).alias("event_id"), F.col("key").alias("work_item_id"), F.lit(None).cast("string").alias("actor_hash"),
        F.lit("ticket_created").alias("activity"), created.alias("ts"), F.lit("jira").alias("source"), attrs(ingest_source=F.lit("asf_jira")),
    )
    h = changelogs.join(issues.select("key"), "key", "left_semi").select("key", F.posexplode("histories").alias("_hi", "h")).withColumn("ts", stamp("h.created")).where("ts is not null")
    i = h.select("key", "ts", F.col("h.id").alias("id"), person(F.col("h.author")).alias("actor_hash"), F.posexplode("h.items").alias("at", "i")).where("i.field = 'status'")
    to = F.trim(F.coalesce("i.toString", F.lit("")))
    i = i.withColumns({"to_status": to, "activity": lookup(F.lower(to), STATUSES)})
    moved = i.where("activity is not null").select(
        evidence_id(F.lit("asf_jira"), F.lit("changelog"), "key", F.coalesce("id", iso_utc("ts")), F.col("at").cast("string")).alias("event_id"), F.col("key").alias("work_item_id"), "actor_hash", "activity", "ts",
        F.lit("jira").alias("source"), attrs(ingest_source=F.lit("asf_jira"), from_status=F.col("i.fromString"), to_status=F.col("to_status")),
    )
    return first.unionByName(moved), i.where("activity is null").groupBy("to_status").agg(F.count("*").alias("n"))


def tickets(issues: DataFrame, projects: DataFrame) -> DataFrame:
    """The case of each issue whose project has a repository."""
    known = issues.withColumn("project", F.split_part("key", F.lit("-"), F.lit(1))).join(projects, "project")
    f = F.col("fields")
    return known.select(
        F.col("key").alias("work_item_id"), "repo", F.lit("issue").alias("case_source"), F.col("key").alias("jira_key"), F.try_element_at(f["components"], F.lit(1))["name"].alias("component"),
        f["issuetype"]["name"].alias("issue_type"), f["priority"]["name"].alias("priority"), f["resolution"]["name"].alias("resolution"), f["parent"]["key"].alias("epic"),
        stamp(f["created"]).alias("jira_created_at"), stamp(f["resolutiondate"]).alias("jira_resolved_at"), stamp(f["created"]).alias("opened_at"),
    )


def rejoin_ci(runs: DataFrame, events: DataFrame) -> DataFrame:
    """Runs by their head commit: every commit and merge commit of a case, the least case for one that has several; runs without keep their case."""
    shas = events.where("activity = 'commit'").select(F.col("attrs.sha").alias("head_sha"), "work_item_id").unionByName(events.where("activity = 'merged'").select(F.col("attrs.merge_commit_sha").alias("head_sha"), "work_item_id"))
    one = shas.where("head_sha is not null").groupBy("head_sha").agg(F.min("work_item_id").alias("_case"))
    kept = [c for c in runs.columns if c != "work_item_id"]
    had = F.col("work_item_id") if "work_item_id" in runs.columns else F.lit(None).cast("string")
    return runs.join(one, "head_sha", "left").select(*kept, F.coalesce("_case", had).alias("work_item_id"))


def ci_events(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs of a case as events (one for start and end together), and the runs left over."""
    end = F.expr("timestampadd(MICROSECOND, cast(round(runner_minutes * 60000000) as bigint), ts)")
    extra = attrs(ingest_source=F.lit("github_actions"), run_id=F.col("run_id"), head_sha=F.col("head_sha"), conclusion=F.col("conclusion"), attempt=F.col("attempt"), actor_absent=F.lit("machine"), repo=F.col("repo"), completed_at=iso_utc(end))
    known = runs.where("work_item_id is not null and ts is not null")
    out = known.select(evidence_id(F.lit("github_actions"), F.lit("workflow_run"), "run_id", F.lit("ci_run")).alias("event_id"), "work_item_id", F.lit(None).cast("string").alias("actor_hash"), F.lit("ci_run").alias("activity"), "ts", F.lit("github").alias("source"), extra)
    return out, runs.where("work_item_id is null")


def drop_stale_ci(events: DataFrame, runs: DataFrame) -> DataFrame:
    """CI events whose run is gone, or has lost its case, go."""
    alive = runs.where("work_item_id is not null").select(F.col("run_id").alias("_run")).distinct()
    ci = events.where("activity = 'ci_run'").join(alive, F.col("attrs.run_id") == F.col("_run"), "left_semi")
    return events.where("activity != 'ci_run'").unionByName(ci)


def repair_cases(events: DataFrame, items: DataFrame, runs: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cases named by a ticket of no known project are taken apart.

    Their events go to their pull request or commit, their CI events are dropped and their runs lose the case; cases
    left empty are dropped unless a tracker knows them. Gives events, cases and runs.
    """
    project = F.split_part("work_item_id", F.lit("-"), F.lit(1))
    valid = projects.select(F.col("project").alias("_p")).distinct()
    bad = items.where("case_source = 'ticket_key'").withColumn("_p", project).join(valid, "_p", "left_anti").select("work_item_id", "repo").withColumnRenamed("repo", "_repo")
    known = events.join(bad, "work_item_id", "left")
    target = F.when(F.col("attrs.pr_number").isNotNull(), F.concat_ws("#", "_repo", F.col("attrs.pr_number"))).when(F.col("attrs.sha").isNotNull(), F.concat_ws("@", F.col("_repo"), F.substring("attrs.sha", 1, 12)))
    moved = known.where(~((F.col("activity") == "ci_run") & F.col("_repo").isNotNull())).withColumn("work_item_id", F.when(F.col("_repo").isNotNull(), F.coalesce(target, F.col("work_item_id"))).otherwise(F.col("work_item_id"))).select(*events.columns)
    cleared = runs.join(bad.withColumn("_bad", F.lit(True)), "work_item_id", "left").select(*[F.when(F.col("_bad").isNull(), F.col(c)).alias(c) if c == "work_item_id" else F.col(c) for c in runs.columns])
    empty = bad.select("work_item_id").join(moved.select("work_item_id").distinct(), "work_item_id", "left_anti")
    kept = items.where("jira_created_at is not null").unionByName(items.where("jira_created_at is null").join(empty, "work_item_id", "left_anti"))
    return moved, kept, cleared


def repoint_commits(events: DataFrame, case_by_sha: DataFrame) -> DataFrame:
    """Commit events move to the case of their commit: from a provisional case always, from a pull request only to a ticket. case_by_sha(sha, target, repo)."""
    known = events.join(case_by_sha.withColumnRenamed("repo", "_repo"), F.col("attrs.sha") == F.col("sha"), "left")
    now = F.col("work_item_id")
    provisional = F.startswith(now, F.concat(F.col("_repo"), F.lit("@")))
    shaped = F.startswith(now, F.concat(F.col("_repo"), F.lit("#")))
    move = (F.col("activity") == "commit") & F.col("target").isNotNull() & (F.col("target") != now) & (provisional | (shaped & ~F.contains(F.col("target"), F.lit("#"))))
    return known.withColumn("work_item_id", F.when(F.coalesce(move, F.lit(False)), F.col("target")).otherwise(now)).select(*events.columns)


def merge_cases(prs: DataFrame, open_keeps_case_open: bool = True) -> DataFrame:
    """One case of all its pull requests: opened first, closed last (null if one is open), the component of all files, the strongest source, the first request as reference, the most common epic.

    prs: work_item_id, repo, number, opened_at, closed_at, files, epic, case_source, jira_key.
    """
    strength = F.array_position(F.array(*[F.lit(s) for s in CASE_SOURCES]), F.col("case_source"))
    lead = F.struct(F.col("opened_at").isNull(), "opened_at", "number")
    closed = F.max("closed_at")
    # files are counted by case and folder, so that no case's files are gathered
    folders = prs.select("work_item_id", F.explode("files").alias("file")).groupBy("work_item_id", top_folder(F.col("file")).alias("top")).agg(F.count("*").alias("n"))
    most = folders.groupBy("work_item_id").agg(F.min_by("top", F.struct(-F.col("n"), F.col("top"))).alias("component"))
    merged = prs.groupBy("work_item_id").agg(
        F.min("repo").alias("repo"), F.min("opened_at").alias("opened_at"),
        (F.when(F.count("closed_at") == F.count("*"), closed) if open_keeps_case_open else closed).alias("closed_at"),
        F.mode("epic", True).alias("epic"), F.mode("jira_key", True).alias("jira_key"), F.min_by("case_source", strength).alias("case_source"),
        F.min_by(F.concat_ws("#", "repo", F.col("number").cast("string")), lead).alias("source_ref"), F.count("*").alias("n_prs"),
    )
    return merged.join(most, "work_item_id", "left")


def dedup_events(events: DataFrame, order: Column | None = None) -> DataFrame:
    """One row per event id: the last by the given order (default: the greatest case, then actor)."""
    w = Window.partitionBy("event_id").orderBy(*([order.desc()] if order is not None else []), F.col("work_item_id").desc_nulls_last(), F.col("actor_hash").desc_nulls_last())
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def collapsed_count(before: DataFrame) -> DataFrame:
    """Rows, and how many of them `dedup_events` takes away."""
    return before.groupBy("event_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_collapsed"))


def dedup_runs(runs: DataFrame) -> DataFrame:
    """One row per run: the one with most minutes."""
    rest = [c for c in runs.columns if c != "run_id"]
    best = runs.groupBy("run_id").agg(F.max_by(F.struct(*rest), F.struct("runner_minutes", "attempt", "ts")).alias("b"))
    return best.select("run_id", "b.*").select(*runs.columns)


def dedupe_writers(events: DataFrame, writer_a: Column, writer_b: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of writer A that writer B has too (same case, activity, time, actor; null equals null). Gives the kept rows, the surplus, and
    A's rows left over by activity, with how many of them B has on another case. Commits and merges are never surplus."""
    a = events.where(writer_a & ~F.col("activity").isin("commit", "merged"))
    b = events.where(writer_b).select("work_item_id", "activity", "ts", "actor_hash", F.col("attrs.pr_number").alias("pr")).distinct()
    same = ["work_item_id", "activity", "ts"]
    bb = b.select(*[F.col(c).alias(f"b_{c}") for c in same], F.col("actor_hash").alias("b_actor"))
    match = F.col("actor_hash").eqNullSafe(F.col("b_actor"))
    for c in same:
        match = match & (F.col(c) == F.col(f"b_{c}"))
    surplus = a.join(bb, match, "left_semi")
    left = a.join(bb, match, "left_anti")
    other = b.where("pr is not null").select(F.col("pr").alias("b_pr"), F.col("activity").alias("b_activity"), F.col("ts").alias("b_ts"), F.col("actor_hash").alias("b_actor")).distinct().withColumn("found", F.lit(1))
    elsewhere = left.join(other, (F.col("attrs.pr_number") == F.col("b_pr")) & (F.col("activity") == F.col("b_activity")) & (F.col("ts") == F.col("b_ts")) & F.col("actor_hash").eqNullSafe(F.col("b_actor")), "left")
    leftovers = elsewhere.groupBy("activity").agg(F.count("*").alias("unmatched"), F.count("found").alias("same_pr_other_case"))
    return events.join(surplus.select("event_id"), "event_id", "left_anti"), surplus, leftovers


def purge_before(events: DataFrame, items: DataFrame, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """Events from the cutoff on, and how many cases, by source, lose all they had."""
    limit = F.lit(cutoff).cast(events.schema["ts"].dataType)
    gone = events.groupBy("work_item_id").agg(F.max("ts").alias("last")).where(F.col("last") < limit)
    return events.where(F.col("ts") >= limit), items.join(gone, "work_item_id", "left_semi").groupBy("case_source").agg(F.count("*").alias("n"))


def actors_from_events(events: DataFrame) -> DataFrame:
    """Each actor's first event, provisional band by number of commits, and bucket of tenure by span."""
    n = F.count(F.when(F.col("activity") == "commit", 1))
    by = events.where("actor_hash is not null").groupBy("actor_hash").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), n.alias("n_commits"))
    band = F.when(F.col("n_commits") >= 100, "staff").when(F.col("n_commits") >= 30, "senior").when(F.col("n_commits") >= 8, "mid").otherwise("junior")
    short = micros("last_seen") - micros("first_seen") < 182 * 86_400_000_000
    return by.select("actor_hash", "first_seen", "n_commits", band.alias("role_band"), F.when(short, "lt_6m").otherwise("6m_2y").alias("tenure_bucket"), F.lit("inferred").alias("band_basis"))


def assign_sprints(events: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Sprints of fixed length numbered back from the newest event; a case belongs to its first event's."""
    span = events.agg(micros(F.min("ts")).alias("lo"), micros(F.max("ts")).alias("hi"))
    width = p.sprint_days * 86_400_000_000
    first = events.groupBy("work_item_id").agg(micros(F.min("ts")).alias("t"))
    back = lambda c: F.floor((F.col("hi") - F.col(c)) / width)
    return first.crossJoin(F.broadcast(span)).select("work_item_id", (back("lo") + 1 - back("t")).cast("int").alias("sprint"))


def canonical_activity(df: DataFrame, column: str, p: tuple[tuple[str, str | None], ...] = RENAMED) -> tuple[DataFrame, DataFrame]:
    """Requested names as canonical ones (unknown names stay as they are), and the rows whose name has no counterpart."""
    none = [k for k, v in p if v is None]
    rejected = F.coalesce(F.col(column).isin(*none), F.lit(False))
    return df.where(~rejected).withColumn(column, F.coalesce(lookup(column, p), F.col(column))), df.where(rejected)


def identity_key(email: str = "email", name: str = "name") -> Column:
    """Who an e-mail address stands for: the account of a no-reply address, the local part of an organisation's, else the address; the name if there is none."""
    handle = F.lower(F.trim(F.coalesce(F.col(email), F.lit(""))))
    local, domain = F.split_part(handle, F.lit("@"), F.lit(1)), F.substring_index(handle, "@", -1)
    account = F.when(F.contains(local, F.lit("+")), F.regexp_replace(local, r"^[^+]*\+", "")).otherwise(local)
    return F.when(handle == "", F.lower(F.trim(F.coalesce(F.col(name), F.lit(""))))).when(domain == "users.noreply.github.com", account).when(domain == "apache.org", local).otherwise(handle)


def parse_pull_requests(payloads: DataFrame) -> DataFrame:
    """Landed pull requests as columns."""
    return parsed(payloads, PULL_REQUEST)


def parse_issues(payloads: DataFrame) -> DataFrame:
    """Landed issues as columns."""
    return parsed(payloads, ISSUE)


def parse_changelogs(payloads: DataFrame) -> DataFrame:
    """Landed change logs as columns."""
    return parsed(payloads, CHANGELOG)


def project_table(spark: SparkSession, pairs: tuple[tuple[str, str], ...]) -> DataFrame:
    """The small table of projects and repositories."""
    return spark.createDataFrame(list(pairs), "project string, repo string")
