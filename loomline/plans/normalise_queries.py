"""Queries of landing and normalisation: payloads are built from the derived events, landed, parsed and mapped back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import shared_folder
from ..operators import normalise as n
from ..sources import landing
from ..sources import sample_payloads as payloads
from .base import Tables, query

ISO = "strftime({c}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({c}) % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(epoch_us({c}) % 1000000 AS VARCHAR), 6, '0') END || '+00:00'"


def iso(c: str) -> str:
    return "(" + ISO.format(c=c) + ")"


def prs(t: Tables) -> DataFrame:
    return n.parse_pull_requests(payloads.pull_requests(t.spark, t.sf_dir))


def projects(t: Tables) -> DataFrame:
    return n.project_table(t.spark, payloads.PROJECTS)


def made_by_commits(t: Tables) -> DataFrame:
    """Cases that commits have made: those of every second pull request."""
    return prs(t).where("number % 2 = 0").select(F.concat_ws("#", "repo", F.col("number").cast("string")).alias("work_item_id"))


def resolved(t: Tables) -> DataFrame:
    return n.resolve_case(n.ticket_key(prs(t), projects(t)), made_by_commits(t))


#: Pull requests with their cases, straight from the events.
PR = """
SELECT w, k, opened, number, repo, key_from, CASE WHEN key_from = 'body' AND number % 2 = 0 THEN NULL WHEN key_from = 'title' THEN 'PRJ-' || k WHEN key_from <> 'none' THEN 'QRS-' || k END AS ticket,
  COALESCE(CASE WHEN key_from = 'body' AND number % 2 = 0 THEN NULL WHEN key_from = 'title' THEN 'PRJ-' || k WHEN key_from <> 'none' THEN 'QRS-' || k END, repo || '#' || number) AS work_item_id FROM (
  SELECT work_item_id AS w, k, MIN(ts) AS opened, k * 100 + day(MIN(ts)) AS number, 'org/r' || (k % 2) AS repo,
    CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN 'title' WHEN k % 7 = 0 AND k % 2 = 1 THEN 'headRefName' WHEN k % 5 = 0 AND k % 2 = 1 THEN 'body' ELSE 'none' END AS key_from FROM ev GROUP BY 1, 2)
"""
BASE = "'github_graphql|pull_request|' || repo || '#' || number || '|'"


@query("n1_window_counts", "n_outside:i n_old_kept:i", "SELECT COUNT(*) FILTER (WHERE s < TIMESTAMP '2024-01-10') AS n_outside, COUNT(*) FILTER (WHERE s >= TIMESTAMP '2024-01-10' AND o < TIMESTAMP '2024-01-10') AS n_old_kept FROM (SELECT COALESCE(MIN(ts) FILTER (WHERE activity = 'merged'), MIN(ts)) AS s, MIN(ts) AS o FROM ev GROUP BY work_item_id)")
def _(t: Tables) -> DataFrame:
    return n.window_counts(prs(t), "2024-01-10 00:00:00")


@query("n1_window_filter", "repo:s number:i created_before:b", "SELECT repo, number, opened < TIMESTAMP '2024-01-10' AS created_before FROM (SELECT 'org/r' || (k % 2) AS repo, k * 100 + day(MIN(ts)) AS number, MIN(ts) AS opened, MIN(ts) FILTER (WHERE activity = 'merged') AS m FROM ev GROUP BY work_item_id, k) WHERE COALESCE(m, opened) >= TIMESTAMP '2024-01-10'")
def _(t: Tables) -> DataFrame:
    return n.window_filter(prs(t), "2024-01-10 00:00:00")


@query("n2_ticket_key", "repo:s number:i ticket:s key_from:s", f"SELECT repo, number, CASE key_from WHEN 'title' THEN 'PRJ-' || k WHEN 'none' THEN NULL ELSE 'QRS-' || k END AS ticket, key_from FROM ({PR}) AS p")
def _(t: Tables) -> DataFrame:
    return n.ticket_key(prs(t), projects(t))


@query("n3_resolve_case", "repo:s number:i work_item_id:s case_source:s", f"SELECT repo, number, work_item_id, CASE WHEN ticket IS NOT NULL THEN 'ticket_key' ELSE 'pr' END AS case_source FROM ({PR}) AS p")
def _(t: Tables) -> DataFrame:
    return resolved(t)


def commits(t: Tables) -> DataFrame:
    parsed = landing.parse_commits(payloads.commit_log(t.spark, t.sf_dir))
    return n.commit_case(parsed, projects(t)).withColumn("actor_hash", n.identity_key())


COMMIT = """
SELECT md5(CAST(id AS VARCHAR)) AS sha, 'org/r' || (k % 2) AS repo, k, id, user_id, date_trunc('second', ts) AS tm,
  CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN 'PRJ-' || k WHEN k % 3 = 1 THEN 'org/r' || (k % 2) || '#' || k ELSE 'org/r' || (k % 2) || '@' || substr(md5(CAST(id AS VARCHAR)), 1, 12) END AS work_item_id,
  CASE k % 4 WHEN 0 THEN 'u' || user_id WHEN 1 THEN 'u' || user_id WHEN 2 THEN 'u' || user_id || '@example.org' ELSE 'name ' || user_id END AS actor_hash FROM ev WHERE activity = 'commit'
"""


@query(
    "s4_commit_log",
    "repo:s sha:s authored_at:t email:s name:s subject:s parents:s files:s additions:i deletions:i",
    f"""SELECT repo, sha, tm AS authored_at, CASE k % 4 WHEN 0 THEN '12+u' || user_id || '@users.noreply.github.com' WHEN 1 THEN 'U' || user_id || '@apache.org' WHEN 2 THEN 'u' || user_id || '@example.org' ELSE '' END AS email, 'Name ' || user_id AS name,
    CASE k % 3 WHEN 0 THEN 'PRJ-' || k || ' fix|pipe' WHEN 1 THEN 'change (#' || k || ')' ELSE 'plain change' END AS subject, 'p1,p2' AS parents, 'c' || (k % 10) || '/a.py,bin/x.dat,c' || (k % 10) || '/new/b.py' AS files, id % 9 + 1 AS additions, id % 4 AS deletions FROM ({COMMIT}) AS c""",
)
def _(t: Tables) -> DataFrame:
    return commits(t).withColumns({"files": F.array_join("files", ","), "parents": F.array_join("parents", ",")})


@query("n4_component", "sha:s component:s", f"SELECT sha, 'c' || (k % 10) AS component FROM ({COMMIT}) AS c")
def _(t: Tables) -> DataFrame:
    return commits(t).select("sha", n.component("files").alias("component"))


@query("n5_component_from_labels", "repo:s number:i component:s", f"SELECT repo, number, CASE WHEN k % 10 <> 9 AND k % 10 % 2 = k % 2 THEN 'c' || (k % 10) END AS component FROM ({PR}) AS p")
def _(t: Tables) -> DataFrame:
    return n.component_from_labels(prs(t), t.items.select("repo", "component"))


@query("n6_epic", "repo:s number:i epic:s", f"SELECT repo, number, CASE WHEN k % 5 = 0 THEN 'KIP-' || (k % 9) ELSE 'M' || (k % 4) END AS epic FROM ({PR}) AS p")
def _(t: Tables) -> DataFrame:
    return prs(t).withColumn("epic", n.epic("title", "body", otherwise=F.col("milestone.title")))


EVENT = "event_id:s work_item_id:s actor_hash:s activity:s ts:t"
WHO = "CASE WHEN user_id % 10 <> 0 THEN 'u' || user_id END"
N7 = f"SELECT substr(sha256({BASE} || 'merged|' || {iso('e.ts')}), 1, 24) AS event_id, p.work_item_id, {WHO} AS actor_hash, 'merged' AS activity, e.ts FROM ({PR}) AS p JOIN (SELECT work_item_id AS w, MIN(ts) AS ts, ARG_MIN(user_id, ts) AS user_id FROM ev WHERE activity = 'merged' GROUP BY 1) AS e USING (w)"
N8 = f"""SELECT substr(sha256({BASE} || activity || '|' || {iso('ts')} || '|u' || user_id), 1, 24) AS event_id, p.work_item_id, 'u' || user_id AS actor_hash, activity, ts
FROM ({PR}) AS p JOIN (SELECT work_item_id AS w, id, ts, user_id, activity FROM ev WHERE activity IN ('approved', 'changes_requested') OR activity = 'review' AND id % 6 <> 2) AS e USING (w) WHERE user_id % 10 <> 0"""
N9 = f"""SELECT substr(sha256({BASE} || activity || '|' || {iso('ts')} || '|' || CASE WHEN id % 2 = 0 THEN 'u' || ((user_id + 3) % 150) ELSE 'team' END), 1, 24) AS event_id, p.work_item_id, {WHO} AS actor_hash, activity, ts
FROM ({PR}) AS p JOIN (SELECT work_item_id AS w, id, ts, user_id, activity FROM ev WHERE activity = 'review_requested') AS e USING (w)"""
N10 = f"""SELECT substr(sha256('git_local|commit|' || md5(CAST(id AS VARCHAR)) || '|commit|' || {iso('ts')}), 1, 24) AS event_id, p.work_item_id, 'u' || user_id AS actor_hash, activity, ts
FROM ({PR}) AS p JOIN (SELECT work_item_id AS w, id, ts, user_id, activity FROM ev WHERE activity = 'commit') AS e USING (w) WHERE user_id % 10 <> 0"""


@query("n7_merged_events", EVENT, N7)
def _(t: Tables) -> DataFrame:
    return n.merged_events(resolved(t))


@query("n8_review_events", EVENT, N8)
def _(t: Tables) -> DataFrame:
    return n.review_events(resolved(t))


@query("n9_timeline_events", EVENT, N9)
def _(t: Tables) -> DataFrame:
    return n.timeline_events(resolved(t))


@query("n10_pr_commit_events", EVENT, N10)
def _(t: Tables) -> DataFrame:
    return n.pr_commit_events(resolved(t))


@query("n11_commit_events", EVENT, f"SELECT substr(sha256('git_local|commit|' || sha || '|commit|' || {iso('tm')}), 1, 24) AS event_id, work_item_id, actor_hash, 'commit' AS activity, tm AS ts FROM ({COMMIT}) AS c")
def _(t: Tables) -> DataFrame:
    return n.commit_events(commits(t))


@query("n11_commit_cases", "work_item_id:s repo:s opened_at:t component:s case_source:s jira_key:s", f"SELECT work_item_id, repo, MIN(tm) AS opened_at, 'c' || (ARG_MIN(k, (tm, sha)) % 10) AS component, CASE WHEN work_item_id LIKE 'PRJ-%' THEN 'ticket_key' ELSE 'pr' END AS case_source, CASE WHEN work_item_id LIKE 'PRJ-%' THEN work_item_id END AS jira_key FROM ({COMMIT}) AS c GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return n.commit_cases(commits(t))


KEY = "CASE WHEN k % 2 = 0 THEN 'PRJ-' ELSE 'QRS-' END || k"
MOVED = f"SELECT *, {KEY} AS key, CASE id % 6 WHEN 0 THEN 'ticket_started' WHEN 1 THEN 'ticket_in_review' WHEN 4 THEN 'ticket_resolved' WHEN 3 THEN 'ticket_closed' WHEN 5 THEN 'ticket_reopened' END AS to_activity FROM ev WHERE activity LIKE 'ticket%'"
N12 = f"""SELECT substr(sha256('asf_jira|issue|' || key || '|ticket_created'), 1, 24) AS event_id, key AS work_item_id, NULL AS actor_hash, 'ticket_created' AS activity, MIN(ts) AS ts FROM ({MOVED}) AS a GROUP BY key
UNION ALL SELECT substr(sha256('asf_jira|changelog|' || key || '|' || id || '|1'), 1, 24), key, {WHO}, to_activity, ts FROM ({MOVED}) AS b WHERE to_activity IS NOT NULL"""


def ticketed(t: Tables) -> tuple[DataFrame, DataFrame]:
    return n.ticket_events(n.parse_issues(payloads.issues(t.spark, t.sf_dir)), n.parse_changelogs(payloads.changelogs(t.spark, t.sf_dir)))


@query("n12_ticket_events", EVENT, N12)
def _(t: Tables) -> DataFrame:
    return ticketed(t)[0]


@query("n12_unmapped_statuses", "to_status:s n:i", f"SELECT 'Triage' AS to_status, COUNT(*) AS n FROM ({MOVED}) AS a WHERE to_activity IS NULL HAVING COUNT(*) > 0")
def _(t: Tables) -> DataFrame:
    return ticketed(t)[1]


@query("n12_tickets", "work_item_id:s repo:s component:s issue_type:s priority:s jira_created_at:t", f"SELECT {KEY} AS work_item_id, 'org/r' || (k % 2) AS repo, 'c' || (k % 10) AS component, 'type' || (k % 3) AS issue_type, 'p' || (k % 4) AS priority, MIN(ts) AS jira_created_at FROM ev WHERE activity LIKE 'ticket%' GROUP BY k")
def _(t: Tables) -> DataFrame:
    return n.tickets(n.parse_issues(payloads.issues(t.spark, t.sf_dir)), projects(t))


def runs(t: Tables) -> DataFrame:
    return landing.ci_runs(payloads.workflow_runs(t.spark, t.sf_dir))


RUN = "SELECT r.*, h.head FROM ev r LEFT JOIN (SELECT work_item_id, MIN(id) AS head FROM ev WHERE activity = 'commit' GROUP BY 1) AS h USING (work_item_id) WHERE activity = 'ci_run'"


@query("s5_ci_runs", "run_id:s repo:s head_sha:s ts:t runner_minutes:h conclusion:s attempt:i", f"SELECT CAST(id AS VARCHAR) AS run_id, 'org/r' || (k % 2) AS repo, md5(CAST(head AS VARCHAR)) AS head_sha, ts, ROUND(FLOOR(value * 60) / 60, 3) AS runner_minutes, CASE WHEN id % 5 = 0 THEN 'failure' ELSE 'success' END AS conclusion, CASE WHEN id % 4 = 1 THEN 2 ELSE 1 END AS attempt FROM ({RUN}) AS r")
def _(t: Tables) -> DataFrame:
    return runs(t)


def mapped_runs(t: Tables) -> DataFrame:
    return n.rejoin_ci(runs(t), n.pr_events(resolved(t)))


N13 = f"SELECT r.id, r.k, r.ts, CASE WHEN c.user_id % 10 <> 0 THEN p.work_item_id END AS work_item_id, r.head FROM ({RUN}) AS r LEFT JOIN ev c ON c.id = r.head LEFT JOIN ({PR}) AS p ON p.w = r.work_item_id"


@query("n13_rejoined_ci", "run_id:s work_item_id:s", f"SELECT CAST(id AS VARCHAR) AS run_id, work_item_id FROM ({N13}) AS r")
def _(t: Tables) -> DataFrame:
    return mapped_runs(t)


@query("n14_ci_events", "event_id:s work_item_id:s activity:s ts:t", f"SELECT substr(sha256('github_actions|workflow_run|' || id || '|ci_run'), 1, 24) AS event_id, work_item_id, 'ci_run' AS activity, ts FROM ({N13}) AS r WHERE work_item_id IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return n.ci_events(mapped_runs(t))[0]


@query("n15_without_stale_ci", "activity:s n:i", "SELECT activity, COUNT(*) AS n FROM event_log WHERE activity <> 'ci_run' OR a_run IN (SELECT run_id FROM ci_run WHERE work_item_id IS NOT NULL) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return n.drop_stale_ci(t.events, t.runs).groupBy("activity").agg(F.count("*").alias("n"))


def doubtful(t: Tables) -> DataFrame:
    """Cases as if tickets had named them; only those of one project are valid."""
    return t.items.select("work_item_id", "repo", F.when(F.col("case_source") == "pr", "ticket_key").otherwise(F.col("case_source")).alias("case_source"), F.when(F.col("issue_type") == "type0", F.col("jira_created_at")).alias("jira_created_at"))


REPAIRED = "SELECT e.*, w.repo, w.case_source = 'pr' AS bad FROM event_log e JOIN work_item w USING (work_item_id)"


@query("n16_repaired_events", "work_item_id:s n:i", f"SELECT CASE WHEN bad AND a_pr IS NOT NULL THEN repo || '#' || a_pr WHEN bad AND activity = 'commit' THEN repo || '@' || substr(md5(event_id), 1, 12) ELSE work_item_id END AS work_item_id, COUNT(*) AS n FROM ({REPAIRED}) AS r WHERE NOT (bad AND activity = 'ci_run') GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return n.repair_cases(t.events, doubtful(t), t.runs, projects(t))[0].groupBy("work_item_id").agg(F.count("*").alias("n"))


@query("n16_repaired_runs", "run_id:s work_item_id:s", "SELECT run_id, CASE WHEN COALESCE(case_source, '') <> 'pr' THEN r.work_item_id END AS work_item_id FROM ci_run r LEFT JOIN work_item w USING (work_item_id)")
def _(t: Tables) -> DataFrame:
    return n.repair_cases(t.events, doubtful(t), t.runs, projects(t))[2]


@query("n17_repointed_commits", "event_id:s work_item_id:s", f"SELECT substr(sha256('git_local|commit|' || sha || '|commit|' || {iso('tm')}), 1, 24) AS event_id, CASE WHEN work_item_id LIKE '%@%' OR work_item_id LIKE '%#%' AND k % 2 = 0 THEN CASE WHEN k % 2 = 0 THEN 'TGT-' || k ELSE repo || '#9' || k END ELSE work_item_id END AS work_item_id FROM ({COMMIT}) AS c")
def _(t: Tables) -> DataFrame:
    raw = payloads.raw_events(t.spark, t.sf_dir).where("activity = 'commit'")
    target = raw.select(F.md5(F.col("id").cast("string")).alias("sha"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("TGT-"), F.col("k"))).otherwise(F.concat(F.lit("org/r"), F.col("k") % 2, F.lit("#9"), F.col("k"))).alias("target"), F.concat(F.lit("org/r"), F.col("k") % 2).alias("repo"))
    return n.repoint_commits(n.commit_events(commits(t)), target)


def mergeable(t: Tables) -> DataFrame:
    """Pull requests of one key as one case."""
    known = n.ticket_key(prs(t), projects(t))
    return known.select(F.concat(F.lit("T-"), F.floor(F.col("number") / 100)).alias("work_item_id"), "repo", "number", n.stamp("createdAt").alias("opened_at"), n.stamp("closedAt").alias("closed_at"), F.array(F.concat(F.col("labels")[2], F.lit("/x")), F.lit("top")).alias("files"), F.col("milestone.title").alias("epic"), F.when(F.col("ticket").isNotNull(), "ticket_key").otherwise("pr").alias("case_source"), F.col("ticket").alias("jira_key"))


N18 = f"""SELECT 'T-' || k AS work_item_id, ANY_VALUE(p.repo) AS repo, MIN(opened) AS opened_at, CASE WHEN COUNT(m) = COUNT(*) THEN MAX(m) END AS closed_at, '(root)' AS component, 'M' || (k % 4) AS epic,
CASE WHEN ANY_VALUE(key_from) <> 'none' THEN 'ticket_key' ELSE 'pr' END AS case_source, ARG_MIN(p.repo || '#' || number, (opened, number)) AS source_ref, COUNT(*) AS n_prs
FROM ({PR}) AS p LEFT JOIN (SELECT work_item_id AS w, MIN(ts) AS m FROM ev WHERE activity = 'merged' GROUP BY 1) AS x USING (w) GROUP BY k"""


@query("n18_merged_cases", "work_item_id:s repo:s opened_at:t closed_at:t component:s epic:s case_source:s source_ref:s n_prs:i", N18)
def _(t: Tables) -> DataFrame:
    return n.merge_cases(mergeable(t))


def doubled(t: Tables) -> DataFrame:
    """The log with every third event written twice, the second time on another case."""
    again = t.events.where("cast(event_id as bigint) % 3 = 0").withColumn("work_item_id", F.concat(F.lit("A"), F.col("work_item_id")))
    return t.events.unionByName(again)


@query("n19_deduplicated", "event_id:s work_item_id:s", "SELECT event_id, work_item_id FROM event_log")
def _(t: Tables) -> DataFrame:
    return n.dedup_events(doubled(t))


@query("n19_collapsed_count", "n_rows:i n_collapsed:i", "SELECT COUNT(*) + COUNT(*) FILTER (WHERE CAST(event_id AS BIGINT) % 3 = 0) AS n_rows, COUNT(*) FILTER (WHERE CAST(event_id AS BIGINT) % 3 = 0) AS n_collapsed FROM event_log")
def _(t: Tables) -> DataFrame:
    return n.collapsed_count(doubled(t))


@query("n19_deduplicated_runs", "run_id:s runner_minutes:h attempt:i", "SELECT run_id, runner_minutes + 1 AS runner_minutes, attempt FROM ci_run")
def _(t: Tables) -> DataFrame:
    return n.dedup_runs(t.runs.unionByName(t.runs.withColumn("runner_minutes", F.col("runner_minutes") + 1)))


def written_twice(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A second writer has copied reviews: those of every fourth event on the same case, of every sixth on another one."""
    number = F.col("event_id").cast("bigint")
    copy = t.events.where(F.col("activity").isin("review", "approved", "changes_requested", "merged"))
    same = copy.where(number % 4 == 0).withColumns({"event_id": F.concat(F.lit("b"), "event_id"), "source": F.lit("b")})
    moved = copy.where(number % 6 == 1).withColumns({"event_id": F.concat(F.lit("c"), "event_id"), "source": F.lit("b"), "work_item_id": F.lit("elsewhere")})
    return n.dedupe_writers(t.events.unionByName(same).unionByName(moved), F.col("source") == "b", F.col("source") != "b")


COPIED = "activity IN ('review', 'approved', 'changes_requested') AND CAST(event_id AS BIGINT)"


@query("n20_surplus", "activity:s n:i", f"SELECT activity, COUNT(*) AS n FROM event_log WHERE {COPIED} % 4 = 0 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return written_twice(t)[1].groupBy("activity").agg(F.count("*").alias("n"))


@query("n20_leftovers", "activity:s unmatched:i same_pr_other_case:i", f"SELECT activity, COUNT(*) AS unmatched, COUNT(*) AS same_pr_other_case FROM event_log WHERE {COPIED} % 6 = 1 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return written_twice(t)[2]


@query("n21_purged", "activity:s n:i", "SELECT activity, COUNT(*) AS n FROM event_log WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return n.purge_before(t.events, t.items, "2024-01-05 00:00:00")[0].groupBy("activity").agg(F.count("*").alias("n"))


@query("n21_orphaned_by_purge", "case_source:s n:i", "SELECT case_source, COUNT(*) AS n FROM work_item WHERE work_item_id IN (SELECT work_item_id FROM event_log GROUP BY 1 HAVING MAX(ts) < TIMESTAMP '2024-01-05') GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return n.purge_before(t.events, t.items, "2024-01-05 00:00:00")[1]


N22 = """
SELECT actor_hash, first_seen, c AS n_commits, CASE WHEN c >= 100 THEN 'staff' WHEN c >= 30 THEN 'senior' WHEN c >= 8 THEN 'mid' ELSE 'junior' END AS role_band, CASE WHEN epoch_us(l) - epoch_us(first_seen) < 182 * 86400000000 THEN 'lt_6m' ELSE '6m_2y' END AS tenure_bucket
FROM (SELECT actor_hash, MIN(ts) AS first_seen, MAX(ts) AS l, COUNT(*) FILTER (WHERE activity = 'commit') AS c FROM event_log WHERE actor_hash IS NOT NULL GROUP BY 1)
"""


@query("n22_actors", "actor_hash:s first_seen:t n_commits:i role_band:s tenure_bucket:s", N22)
def _(t: Tables) -> DataFrame:
    return n.actors_from_events(t.events)


N23 = """
SELECT work_item_id, (hi - lo) // 1209600000000 + 1 - (hi - f) // 1209600000000 AS sprint FROM (SELECT work_item_id, epoch_us(MIN(ts)) AS f FROM event_log GROUP BY 1), (SELECT epoch_us(MIN(ts)) AS lo, epoch_us(MAX(ts)) AS hi FROM event_log)
"""


@query("n23_sprints", "work_item_id:s sprint:i", N23)
def _(t: Tables) -> DataFrame:
    return n.assign_sprints(t.events)


NAMES = "CASE event_type WHEN 'signup' THEN 'pr_opened' WHEN 'click' THEN 'ci_started' WHEN 'view' THEN 'review_submitted' WHEN 'error' THEN 'ci_rerun' ELSE 'merged' END"


@query("n24_canonical_names", "activity:s n:i", f"SELECT CASE a WHEN 'ci_started' THEN 'ci_run' WHEN 'ci_rerun' THEN 'ci_run' WHEN 'review_submitted' THEN 'review' ELSE a END AS activity, COUNT(*) AS n FROM (SELECT {NAMES} AS a FROM events) WHERE a <> 'pr_opened' GROUP BY 1")
def _(t: Tables) -> DataFrame:
    named = t.raw("events").select(F.expr(NAMES).alias("activity"))
    return n.canonical_activity(named, "activity")[0].groupBy("activity").agg(F.count("*").alias("n"))


@query("n25_identity_keys", "sha:s actor_hash:s", f"SELECT sha, actor_hash FROM ({COMMIT}) AS c")
def _(t: Tables) -> DataFrame:
    return commits(t)


def landed(t: Tables, shift: int) -> DataFrame:
    """Pull-request payloads with an envelope, fetched some days later."""
    p = payloads.pull_requests(t.spark, t.sf_dir)
    number = F.split_part("entity_id", F.lit("#"), F.lit(2)).cast("int")
    return p.where(number % 3 != shift).select(F.lit("github_graphql").alias("source"), F.lit("pull_request").alias("entity_type"), "entity_id", F.timestamp_add("DAY", number % 5 * (1 if shift else -1), F.lit("2024-03-01").cast("timestamp")).alias("fetched_at"), F.concat(F.lit(f"{shift}:"), F.length("body").cast("string")).alias("body"))


@query("s2_upserted_payloads", "entity_id:s version:s", f"SELECT repo || '#' || number AS entity_id, CASE WHEN number % 3 = 1 THEN '0' WHEN number % 3 = 0 THEN '1' ELSE '1' END AS version FROM ({PR}) AS p")
def _(t: Tables) -> DataFrame:
    log = landing.raw_log(t.spark, f"{shared_folder(t.spark)}/{uuid.uuid4().hex}")
    for fetch in (0, 1):
        log.upsert(landed(t, fetch), ("connector", fetch))
    return log.read(source="github_graphql", entity_type="pull_request").withColumn("version", F.split_part("body", F.lit(":"), F.lit(1)))


@query("s1_read_landed", "entity_id:s version:s", f"SELECT repo || '#' || number AS entity_id, CASE WHEN number % 3 = 1 THEN '0' ELSE '1' END AS version FROM ({PR}) AS p")
def _(t: Tables) -> DataFrame:
    path = f"{shared_folder(t.spark)}/{uuid.uuid4().hex}"
    both = landing.upsert_raw(landed(t, 0), landed(t, 1))
    landing.write_raw(both.unionByName(both.withColumn("entity_type", F.lit("other"))), path)
    return landing.raw(t.spark, path, "github_graphql", "pull_request").withColumn("version", F.split_part("body", F.lit(":"), F.lit(1)))


@query("s6_rewritten_sprints", "sprint:i n:i", "SELECT sprint, COUNT(*) AS n FROM work_item GROUP BY 1")
def _(t: Tables) -> DataFrame:
    path = f"{shared_folder(t.spark)}/{uuid.uuid4().hex}"
    for _ in range(2):  # a rerun leaves the same rows
        landing.write_table(t.items.select("work_item_id", "sprint"), path, ("work_item_id",), "sprint")
    landing.upsert_table(t.items.where("sprint = 0").select("work_item_id", "sprint"), path, ("work_item_id",), "sprint")
    return landing.derived_log(t.spark, path, ("work_item_id",), "sprint").read().groupBy("sprint").agg(F.count("*").alias("n"))


@query("s3_changed_only", "key:s", f"SELECT {KEY} AS key FROM (SELECT k, COUNT(*) AS c FROM ev WHERE activity LIKE 'ticket%' GROUP BY 1) WHERE c % 2 = 1")
def _(t: Tables) -> DataFrame:
    raw = payloads.raw_events(t.spark, t.sf_dir).where("activity like 'ticket%'").groupBy("k").agg(F.count("*").alias("c"))
    key = F.concat(F.when(F.col("k") % 2 == 0, "PRJ-").otherwise("QRS-"), F.col("k"))
    return landing.changed_only(raw.select(key.alias("key"), F.col("c").alias("updated")), raw.where("c % 2 = 0").select(key.alias("key"), F.col("c").alias("updated")))


@query("s7_replaced_by_source", "source:s n:i minutes:h", "SELECT CASE WHEN id % 100 = 7 THEN 'observed' ELSE 'synthetic' END AS source, COUNT(*) AS n, SUM(CASE WHEN id % 100 = 7 THEN 30.0 ELSE 90.0 END) AS minutes FROM ev GROUP BY 1")
def _(t: Tables) -> DataFrame:
    marked = t.meetings.withColumn("source", F.when(F.col("duration_min") == 30, "observed").otherwise("synthetic"))
    new = marked.where("source = 'synthetic'").withColumn("duration_min", F.col("duration_min") * 2)
    return landing.replace_where(marked, new, "source", "synthetic").groupBy("source").agg(F.count("*").alias("n"), F.sum("duration_min").alias("minutes"))


S8 = """
SELECT work_item_id, repo, component, COALESCE(CASE WHEN s % 2 = 0 THEN 'new' || epic END, CASE WHEN s % 3 > 0 THEN epic END) AS priority, opened_at, closed_at FROM (SELECT *, day(opened_at) AS s FROM work_item) WHERE s % 3 > 0 OR s % 2 = 0
"""


@query("s8_upserted_cases", "work_item_id:s repo:s component:s priority:s opened_at:t closed_at:t", S8)
def _(t: Tables) -> DataFrame:
    s = F.dayofmonth("opened_at")
    old = t.items.where(s % 3 > 0).select("work_item_id", "repo", "component", "epic", "case_source", F.col("epic").alias("priority"), "opened_at", "closed_at")
    new = t.items.where(s % 2 == 0).select("work_item_id", "repo", "component", F.concat(F.lit("x"), "epic").alias("epic"), "case_source", F.concat(F.lit("new"), "epic").alias("priority"), F.lit("r1").alias("source_ref"), "opened_at", "closed_at")
    older = new.withColumns({"priority": F.lit("older"), "source_ref": F.lit("r0"), "closed_at": F.lit(None).cast("timestamp_ntz")})
    return landing.upsert_cases(old, new.unionByName(older))
