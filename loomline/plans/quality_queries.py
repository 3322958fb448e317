"""Queries of data quality and privacy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import capacity, normalise, privacy, process, quality
from ..params import ACTIVITIES, Params
from ..sources import sample_payloads as payloads
from .base import Tables, query

CHECK = "check:s status:s value:h"


Q1 = """
SELECT 'rows:events' AS "check", CASE WHEN COUNT(*) = 0 OR COUNT(*) > 5000000 THEN 'FAIL' ELSE 'PASS' END AS status, COUNT(*) AS value FROM event_log UNION ALL SELECT 'rows:items', CASE WHEN COUNT(*) = 0 THEN 'FAIL' ELSE 'PASS' END, COUNT(*) FROM work_item
UNION ALL SELECT 'rows:runs', CASE WHEN COUNT(*) > 500 THEN 'FAIL' ELSE 'PASS' END, COUNT(*) FROM ci_run UNION ALL SELECT 'events_per_item', CASE WHEN (SELECT COUNT(*) FROM event_log) < COUNT(*) THEN 'FAIL' ELSE 'PASS' END, (SELECT COUNT(*) FROM event_log) / COUNT(*) FROM work_item
"""


@query("q1_row_counts", CHECK, f"SELECT * FROM ({Q1}) AS q")
def _(t: Tables) -> DataFrame:
    return quality.row_counts({"events": t.events, "items": t.items, "runs": t.runs}, ("events", "items"), {"events": 5_000_000, "runs": 500})


Q2 = """
SELECT 'merge_order' AS "check", CASE WHEN COUNT(m) = 0 THEN 'WARN' WHEN COUNT(*) FILTER (WHERE m < c OR m IS NOT NULL AND c IS NULL) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, COUNT(*) FILTER (WHERE m < c OR m IS NOT NULL AND c IS NULL) AS value, COUNT(*) FILTER (WHERE m < c) AS n_before, COUNT(*) FILTER (WHERE m IS NOT NULL AND c IS NULL) AS n_without_commit
FROM (SELECT MIN(ts) FILTER (WHERE activity = 'merged') AS m, MIN(ts) FILTER (WHERE activity = 'commit') AS c FROM event_log GROUP BY work_item_id)
"""


@query("q2_merge_order", "check:s status:s value:h n_before:i n_without_commit:i", Q2)
def _(t: Tables) -> DataFrame:
    return quality.merge_order(t.events)


@query("q3_orphan_actors", "actor_hash:s", "SELECT DISTINCT actor_hash FROM event_log WHERE actor_hash NOT IN (SELECT actor_hash FROM actor WHERE role_band IS NOT NULL)")
def _(t: Tables) -> DataFrame:
    return quality.orphan_actors(t.events, t.actors.where("role_band is not null"))


@query("q4_missing_sprints", "work_item_id:s", "SELECT work_item_id FROM work_item WHERE sprint > 1")
def _(t: Tables) -> DataFrame:
    return quality.missing_sprints(t.items.withColumn("sprint", F.when(F.col("sprint") <= 1, F.col("sprint"))))


@query("q5_vocabulary", "value:s n:i", "SELECT a AS value, COUNT(*) AS n FROM (SELECT CASE activity WHEN 'review' THEN 'peeked' WHEN 'merged' THEN NULL ELSE activity END AS a FROM event_log) WHERE a IS NULL OR a = 'peeked' GROUP BY 1")
def _(t: Tables) -> DataFrame:
    broken = t.events.withColumn("activity", F.when(F.col("activity") == "review", "peeked").when(F.col("activity") != "merged", F.col("activity")))
    return quality.vocabulary(broken, "activity", ACTIVITIES)


@query("q6_identity_columns", "table_name:s column_name:s n_rows:i", "SELECT 'supplier' AS table_name, 's_name' AS column_name, (SELECT COUNT(*) FROM supplier) AS n_rows UNION ALL SELECT 'nation', 'n_name', (SELECT COUNT(*) FROM nation)", prelude=False)
def _(t: Tables) -> DataFrame:
    tables = {n: t.raw(n) for n in ("supplier", "nation", "lineitem")}
    sizes = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"))
        sizes = one if sizes is None else sizes.unionByName(one)
    return quality.identity_check(tables).join(sizes, "table_name")


Q7 = """
SELECT *, CASE WHEN n_actors >= {k} THEN 'floor' WHEN n_actors >= {f} THEN 'fallback' ELSE 'suppressed' END AS survives FROM (
  SELECT component, COUNT(DISTINCT actor_hash) AS n_actors, COUNT(DISTINCT work_item_id) AS n_items, COUNT(*) AS n_events FROM event_log JOIN work_item USING (work_item_id) WHERE actor_hash IS NOT NULL GROUP BY 1)
"""
SURVIVAL = Params(k=149, k_fallback=147)


@query("q7_k_survival", "component:s n_actors:i n_items:i n_events:i survives:s", Q7.format(k=149, f=147))
def _(t: Tables) -> DataFrame:
    return quality.k_survival(t.events, t.items, SURVIVAL)


@query("q7_k_verdict", CHECK, f"SELECT 'k_survival' AS \"check\", CASE WHEN COUNT(*) FILTER (WHERE survives = 'floor') > 0 THEN 'PASS' WHEN COUNT(*) FILTER (WHERE survives <> 'suppressed') > 0 THEN 'WARN' ELSE 'FAIL' END AS status, COUNT(*) FILTER (WHERE survives = 'floor') AS value FROM ({Q7.format(k=149, f=147)}) AS s")
def _(t: Tables) -> DataFrame:
    return quality.k_verdict(quality.k_survival(t.events, t.items, SURVIVAL))


Q8 = "SELECT 'latency_coverage' AS \"check\", CASE WHEN s >= 0.4 THEN 'PASS' ELSE 'FAIL' END AS status, s AS value FROM (SELECT (SELECT COUNT(DISTINCT work_item_id) FROM latency) / (SELECT COUNT(DISTINCT work_item_id) FROM event_log) AS s)"
Q9 = "SELECT 'trainable_windows' AS \"check\", CASE WHEN COUNT(*) FILTER (WHERE n >= 10) >= 2 THEN 'PASS' ELSE 'FAIL' END AS status, COUNT(*) FILTER (WHERE n >= 10) AS value FROM (SELECT sprint, COUNT(*) AS n FROM work_item GROUP BY 1)"


@query("q8_latency_coverage", CHECK, Q8)
def _(t: Tables) -> DataFrame:
    return quality.latency_coverage(process.review_latency(t.events), t.events)


@query("q9_trainable_windows", CHECK, Q9)
def _(t: Tables) -> DataFrame:
    return quality.trainable_windows(t.events, t.items, least_windows=2)


Q10 = """
SELECT work_item_id, case_source, days, n_prs, COALESCE(days > lim, false) AS over_span, COALESCE(n_prs >= 8, false) AS over_prs FROM (SELECT work_item_id, case_source, (epoch_us(closed_at) - epoch_us(opened_at)) / 8.64e10 AS days FROM work_item)
LEFT JOIN (SELECT work_item_id, COUNT(*) AS n_prs FROM event_log WHERE a_pr IS NOT NULL GROUP BY 1) USING (work_item_id), (SELECT CASE WHEN QUANTILE_CONT(d, 0.5) > 0 THEN QUANTILE_CONT(d, 0.5) * 1.5 END AS lim FROM (SELECT (epoch_us(closed_at) - epoch_us(opened_at)) / 8.64e10 AS d FROM work_item WHERE closed_at IS NOT NULL))
WHERE days > lim OR n_prs >= 8
"""


@query("q10_umbrellas", "work_item_id:s case_source:s days:h n_prs:i over_span:b over_prs:b", Q10)
def _(t: Tables) -> DataFrame:
    prs = t.events.where("attrs.pr_number is not null").groupBy("work_item_id").agg(F.count("*").alias("n_prs"))
    return quality.umbrellas(t.items, prs, Params(umbrella_multiple=1.5))


Q11 = "SELECT unnest(['events', 'missing_ts', 'missing_actor', 'missing_actor_unexplained', 'before_window', 'cases', 'cases_with_events', 'git_pr_jira', 'git_pr_ci', 'pr_without_git', 'jira_with_git', 'jira_cases', 'ci_runs', 'ci_unmatched']) AS measure, unnest([a, 0, b, 0, c, d, d, e, f, g, h, i, j, l]) AS n FROM (SELECT COUNT(*) AS a, COUNT(*) FILTER (WHERE resource IS NULL) AS b, COUNT(*) FILTER (WHERE NOT in_window) AS c FROM clog), (SELECT COUNT(*) AS d, COUNT(*) FILTER (WHERE has_git AND has_pr AND has_jira) AS e, COUNT(*) FILTER (WHERE has_git AND has_pr AND has_ci) AS f, COUNT(*) FILTER (WHERE has_pr AND NOT has_git) AS g, COUNT(*) FILTER (WHERE has_jira AND has_git) AS h, COUNT(*) FILTER (WHERE has_jira) AS i FROM evidence), (SELECT COUNT(*) AS j, COUNT(*) FILTER (WHERE work_item_id IS NULL) AS l FROM ci_run)"


@query("q11_verification", "measure:s n:i", Q11)
def _(t: Tables) -> DataFrame:
    return quality.verification(t.log, t.evidence, t.runs)


@query("q12_evidence_duplicates", "evidence:s duplicates:i", "SELECT 'commit' AS evidence, 0 AS duplicates UNION ALL SELECT 'ci_run', COUNT(*) FROM ci_run UNION ALL SELECT 'pr_event', COALESCE(SUM(n - 1), 0) FROM (SELECT COUNT(*) AS n FROM event_log WHERE a_ingest = 'github_graphql' GROUP BY a_pr, activity, date_trunc('hour', ts), COALESCE(actor_hash, ''))")
def _(t: Tables) -> DataFrame:
    twice = t.events.unionByName(t.events.where("activity = 'ci_run'").withColumn("event_id", F.concat(F.lit("x"), "event_id")))
    actor = F.coalesce("actor_hash", F.lit(""))
    keys = {
        "commit": (F.col("activity") == "commit", [F.col("attrs.sha")]),
        "ci_run": (F.col("activity") == "ci_run", [F.col("attrs.run_id")]),
        "pr_event": (F.col("attrs.ingest_source") == "github_graphql", [F.col("attrs.pr_number"), F.col("activity"), F.date_trunc("hour", "ts"), actor]),
    }
    return quality.evidence_duplicates(twice, keys)


Q13 = """
SELECT 'merged_before_first_commit' AS violation, COUNT(*) AS n FROM evidence LEFT JOIN (SELECT work_item_id AS case_id, COUNT(DISTINCT a_pr) AS p FROM event_log WHERE a_pr IS NOT NULL GROUP BY 1) USING (case_id) WHERE merged_at < first_commit_at AND COALESCE(p, 1) = 1
UNION ALL SELECT 'case_spans_repositories', COUNT(*) FROM (SELECT work_item_id FROM event_log WHERE actor_hash IS NOT NULL GROUP BY 1 HAVING COUNT(DISTINCT length(actor_hash)) > 1)
"""


@query("q13_order_violations", "violation:s n:i", Q13)
def _(t: Tables) -> DataFrame:
    return quality.order_violations(t.events, t.evidence, F.length("actor_hash").cast("string"))


Q14 = """
SELECT 'approved_after_merge' AS anomaly, COUNT(*) AS n, ROUND(MAX((epoch_us(a.ts) - epoch_us(m.ts)) / 8.64e10), 0) AS worst_days FROM event_log a JOIN event_log m ON m.work_item_id = a.work_item_id AND m.activity = 'merged' AND m.a_pr = a.a_pr WHERE a.activity = 'approved' AND a.ts > m.ts
UNION ALL SELECT 'before_case_opened', COUNT(*), ROUND(MAX((epoch_us(o) - epoch_us(ts)) / 8.64e10), 0) FROM event_log JOIN (SELECT work_item_id, opened_at + INTERVAL 2 HOUR AS o FROM work_item) USING (work_item_id) WHERE ts < o AND COALESCE(a_ingest, '') <> 'asf_jira'
UNION ALL SELECT 'ticket_after_first_commit', COUNT(*), ROUND(MAX((epoch_us(ticket_created_at) - epoch_us(first_commit_at)) / 8.64e10), 0) FROM evidence WHERE ticket_created_at > first_commit_at
"""


@query("q14_source_anomalies", "anomaly:s n:i worst_days:h", Q14)
def _(t: Tables) -> DataFrame:
    late = t.items.withColumn("opened_at", F.col("opened_at") + F.expr("INTERVAL 2 HOURS"))
    return quality.source_anomalies(t.events, late, t.evidence)


@query("q15_null_actor_reasons", "reason:s n:i", "SELECT 'ci' AS reason, COUNT(*) AS n FROM event_log WHERE activity = 'ci_run' UNION ALL SELECT 'unexplained', COUNT(*) FROM event_log WHERE activity = 'merged' UNION ALL SELECT 'ticket without reporter', COUNT(*) FROM event_log WHERE activity = 'ticket_created'")
def _(t: Tables) -> DataFrame:
    return quality.null_actor_reasons(t.events.withColumn("actor_hash", F.when(~F.col("activity").isin("merged", "ticket_created"), F.col("actor_hash"))))


Q16 = f"SELECT CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'WARN') THEN 'WARN' ELSE 'PASS' END AS verdict, COUNT(*) FILTER (WHERE status = 'PASS') AS n_pass, COUNT(*) FILTER (WHERE status = 'WARN') AS n_warn, COUNT(*) FILTER (WHERE status = 'FAIL') AS n_fail FROM (SELECT status FROM ({Q1}) AS a UNION ALL SELECT status FROM ({Q8}) AS b UNION ALL SELECT status FROM ({Q9}) AS c)"


@query("q16_verdict", "verdict:s n_pass:i n_warn:i n_fail:i", Q16)
def _(t: Tables) -> DataFrame:
    rows = quality.row_counts({"events": t.events, "items": t.items, "runs": t.runs}, ("events", "items"), {"events": 5_000_000, "runs": 500})
    return quality.verdict(rows, quality.latency_coverage(process.review_latency(t.events), t.events), quality.trainable_windows(t.events, t.items, least_windows=2))


@query("q17_guarded_purge", "n_candidates:i n_kept:i", "SELECT COUNT(*) FILTER (WHERE ts < TIMESTAMP '2024-01-05') AS n_candidates, COUNT(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-05') AS n_kept FROM event_log")
def _(t: Tables) -> DataFrame:
    old = t.events.where("ts < timestamp_ntz'2024-01-05 00:00:00'")
    n = quality.guard(old, t.costs.select(F.lit(None).cast("string").alias("event_id")))
    return normalise.purge_before(t.events, t.items, "2024-01-05 00:00:00")[0].agg(F.lit(n).alias("n_candidates"), F.count("*").alias("n_kept"))


@query("q18_evidence_counts", "git_pr_jira:i git_pr_ci:i pr_without_git:i", "SELECT COUNT(*) FILTER (WHERE has_git AND has_pr AND has_jira) AS git_pr_jira, COUNT(*) FILTER (WHERE has_git AND has_pr AND has_ci) AS git_pr_ci, COUNT(*) FILTER (WHERE has_pr AND NOT has_git) AS pr_without_git FROM evidence")
def _(t: Tables) -> DataFrame:
    return quality.evidence_counts(t.evidence)


@query("q19_orphaned_cases", "case_source:s n:i", "SELECT case_source, COUNT(*) AS n FROM work_item WHERE work_item_id NOT IN (SELECT work_item_id FROM event_log WHERE activity <> 'commit') GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return quality.orphaned_cases(t.items, t.events.where("activity != 'commit'"))


@query("q20_payload_completeness", "n_payloads:i n_truncated:i n_commits:i n_reviews:i n_review_requested:i n_reopened:i n_force_pushed:i", "SELECT COUNT(DISTINCT work_item_id) AS n_payloads, COUNT(DISTINCT work_item_id) FILTER (WHERE k % 11 = 0) AS n_truncated, COUNT(*) FILTER (WHERE activity = 'commit') AS n_commits, COUNT(*) FILTER (WHERE activity IN ('review', 'approved', 'changes_requested')) AS n_reviews, COUNT(*) FILTER (WHERE activity = 'review_requested') AS n_review_requested, 0 AS n_reopened, 0 AS n_force_pushed FROM ev")
def _(t: Tables) -> DataFrame:
    return quality.payload_completeness(normalise.parse_pull_requests(payloads.pull_requests(t.spark, t.sf_dir)))


@query("q21_tracker_report", "n_keys:i n_with_commits:i n_duplicated:i n_malformed:i overlap:h", "SELECT COUNT(*) AS n_keys, COUNT(*) FILTER (WHERE k % 3 = 0 AND k % 2 = 0 AND c > 0) AS n_with_commits, COUNT(*) FILTER (WHERE k % 4 = 0) AS n_duplicated, COUNT(*) FILTER (WHERE k % 2 = 1) AS n_malformed, COUNT(*) FILTER (WHERE k % 3 = 0 AND k % 2 = 0 AND c > 0) / COUNT(*) AS overlap FROM (SELECT k, COUNT(*) FILTER (WHERE activity = 'commit') AS c, COUNT(*) FILTER (WHERE activity LIKE 'ticket%') AS t FROM ev GROUP BY 1) WHERE t > 0")
def _(t: Tables) -> DataFrame:
    from .normalise_queries import commits

    issues = normalise.parse_issues(payloads.issues(t.spark, t.sf_dir)).select("key")
    twice = issues.where(F.split_part("key", F.lit("-"), F.lit(2)).cast("int") % 4 == 0)
    return quality.tracker_report(issues.unionByName(twice), normalise.commit_events(commits(t)), "PRJ")


@query("q22_ci_report", "n_runs:i n_mapped:i n_reruns:i n_failures:i total_minutes:h rerun_minutes:h", "SELECT COUNT(*) AS n_runs, COUNT(work_item_id) AS n_mapped, COUNT(*) FILTER (WHERE attempt > 1) AS n_reruns, COUNT(*) FILTER (WHERE conclusion = 'failure') AS n_failures, SUM(runner_minutes) AS total_minutes, SUM(runner_minutes) FILTER (WHERE attempt > 1) AS rerun_minutes FROM ci_run")
def _(t: Tables) -> DataFrame:
    return quality.ci_report(t.runs)


SALT = "pepper"


@query("v1_pseudonyms", "c_custkey:i actor_hash:s", f"SELECT c_custkey, substr(sha256(lower(trim(c_name)) || '{SALT}'), 1, 16) AS actor_hash FROM customer", prelude=False)
def _(t: Tables) -> DataFrame:
    return privacy.pseudonymise(t.raw("customer").select("c_custkey", F.concat(F.lit(" "), F.upper("c_name")).alias("login")), "login", SALT)


LOGIN = "CASE s_suppkey % 8 WHEN 0 THEN 'dependabot' WHEN 1 THEN 'Renovate[bot]' WHEN 2 THEN 'apache-x' || s_suppkey || '-bot' WHEN 3 THEN '' WHEN 4 THEN s_name || '[BOT]' ELSE s_name END"


@query("v2_bots", "s_suppkey:i bot:b", "SELECT s_suppkey, s_suppkey % 8 < 5 OR s_suppkey % 3 = 0 AS bot FROM supplier", prelude=False)
def _(t: Tables) -> DataFrame:
    kind = F.when(F.col("s_suppkey") % 3 == 0, "Bot").otherwise("User")
    return t.raw("supplier").select("s_suppkey", privacy.is_bot(F.expr(LOGIN), kind).alias("bot"))


def redacted(documents: DataFrame) -> DataFrame:
    docs = documents.select("doc_id", F.concat(F.lit("by smith and SMITH, not smithy; mail "), "text").alias("text"), F.array(F.lit("smith"), F.lit("smi")).alias("logins"))
    hidden = privacy.redact(docs, "text", "logins", SALT)
    short = F.substring(privacy.pseudonym(F.lit("smith"), SALT), 1, 8)
    return hidden.select("doc_id", F.md5(F.replace("text", short, F.lit("SHORT"))).alias("text_md5"))


@query(
    "v3_redacted_texts",
    "doc_id:i text_md5:s",
    r"SELECT doc_id, md5(regexp_replace('by smith and SMITH, not smithy; mail ', 'smith\b', 'SHORT', 'gi') || regexp_replace(text, '\b[\w.+-]+@[\w-]+\.[\w.-]+\b', '<email-redacted>', 'g')) AS text_md5 FROM documents",
    prelude=False,
)
def _(t: Tables) -> DataFrame:
    return redacted(t.raw("documents"))


@query(
    "v3_redacted_documents",
    "doc_id:i text_md5:s",
    r"SELECT doc_id, md5(regexp_replace('by smith and SMITH, not smithy; mail ', 'smith\b', 'SHORT', 'gi') || regexp_replace(text, '\b[\w.+-]+@[\w-]+\.[\w.-]+\b', '<email-redacted>', 'g')) AS text_md5 FROM documents",
    prelude=False,
)
def _(t: Tables) -> DataFrame:
    return redacted(t.raw("documents"))


def people(t: Tables) -> DataFrame:
    """Pull requests as the interface gives them, with logins."""
    raw = payloads.raw_events(t.spark, t.sf_dir)
    login = F.when(F.col("user_id") % 10 == 0, "codecov").otherwise(F.concat(F.lit("Login"), F.col("user_id")))
    person = F.struct(F.lit("User").alias("__typename"), login.alias("login"))
    reviews = F.struct(F.array(F.struct(F.lit("APPROVED").alias("state"), person.alias("author"))).alias("nodes"))
    labels = F.struct(F.array(F.struct(F.lit("bug").alias("name")), F.struct(F.concat(F.lit("c"), F.col("k")).alias("name"))).alias("nodes"))
    return raw.where("activity = 'merged'").select("id", F.concat(F.lit("by @"), login).alias("title"), F.lit(None).cast("string").alias("body"), person.alias("author"), F.when(F.col("id") % 2 == 0, person).alias("mergedBy"), reviews.alias("reviews"), labels.alias("labels"))


H = f"substr(sha256('login' || user_id || '{SALT}'), 1, 16)"
BOT_HASH = f"substr(sha256('codecov{SALT}'), 1, 8)"


@query("v4_scrubbed_payloads", "id:i title:s author:s merged_by:s reviewer_bot:b labels:s", f"SELECT id, 'by @' || substr(sha256(CASE WHEN user_id % 10 = 0 THEN {BOT_HASH} ELSE substr({H}, 1, 8) END || '{SALT}'), 1, 8) AS title, CASE WHEN user_id % 10 <> 0 THEN {H} END AS author, CASE WHEN user_id % 10 <> 0 AND id % 2 = 0 THEN {H} END AS merged_by, user_id % 10 = 0 AS reviewer_bot, 'bug,c' || k AS labels FROM ev WHERE activity = 'merged'")
def _(t: Tables) -> DataFrame:
    out = privacy.scrub_payload(people(t), SALT)
    return out.select("id", "title", F.col("author.actor_hash").alias("author"), F.col("mergedBy.actor_hash").alias("merged_by"), F.col("reviews.nodes")[0]["author"]["is_bot"].alias("reviewer_bot"), F.array_join("labels", ",").alias("labels"))


def histories(t: Tables) -> DataFrame:
    raw = payloads.raw_events(t.spark, t.sf_dir).where("activity like 'ticket%'")
    item = lambda field, a, b: F.struct(F.lit(field).alias("field"), F.lit("jira").alias("fieldtype"), a.alias("fromString"), b.alias("toString"))
    who = F.struct(F.when(F.col("id") % 2 == 0, F.concat(F.lit("N"), F.col("user_id"))).alias("name"), F.concat(F.lit("m"), F.col("user_id"), F.lit("@x.org")).alias("emailAddress"))
    items = F.array(item("Status", F.lit("Open"), F.lit("Closed")), item("assignee", F.lit("Ann"), F.lit(None).cast("string")), item("Comment", F.lit("secret"), F.lit("more")))
    return raw.select("id", F.array(F.struct(F.col("id").cast("string").alias("id"), F.lit("2024").alias("created"), who.alias("author"), items.alias("items"))).alias("histories"))


@query("v5_scrubbed_changelogs", "id:i author:s status:s assignee:s comment:s dropped:b", f"SELECT id, substr(sha256(CASE WHEN id % 2 = 0 THEN 'n' ELSE 'm' END || user_id || '{SALT}'), 1, 16) AS author, 'Closed' AS status, substr(sha256('ann{SALT}'), 1, 16) AS assignee, NULL AS comment, true AS dropped FROM ev WHERE activity LIKE 'ticket%'")
def _(t: Tables) -> DataFrame:
    h = privacy.scrub_changelog(histories(t), SALT).select("id", F.col("histories")[0].alias("h"))
    i = F.col("h.items")
    return h.select("id", F.col("h.author.actor_hash").alias("author"), i[0]["toString"].alias("status"), i[1]["fromString"].alias("assignee"), i[2]["fromString"].alias("comment"), i[2]["values_dropped"].alias("dropped"))


@query("v6_string_scan", "column_name:s n_matching:i", r"SELECT 'text' AS column_name, COUNT(*) FILTER (WHERE regexp_matches(text, '\b[\w.+-]+@[\w-]+\.[\w.-]+\b')) AS n_matching FROM documents UNION ALL SELECT 'lang', 0 UNION ALL SELECT 'source', 0", prelude=False)
def _(t: Tables) -> DataFrame:
    return privacy.string_scan(t.raw("documents"), privacy.EMAIL)


@query("v7_identity_map", "actor_hash:s source:s first_seen:t n_marks:i", f"SELECT substr(sha256('login' || user_id || '{SALT}'), 1, 16) AS actor_hash, ARG_MIN(CASE WHEN activity LIKE 'ticket%' THEN 'jira' ELSE 'git' END, ts) AS source, MIN(ts) AS first_seen, 16 AS n_marks FROM ev WHERE user_id % 10 <> 0 GROUP BY user_id")
def _(t: Tables) -> DataFrame:
    raw = payloads.raw_events(t.spark, t.sf_dir)
    logins = raw.select(F.when(F.col("user_id") % 10 == 0, "codecov").otherwise(F.concat(F.lit(" LOGIN"), F.col("user_id"))).alias("login"), F.when(F.col("activity").startswith("ticket"), "jira").otherwise("git").alias("source"), F.col("ts").alias("first_seen"))
    return privacy.identity_map(logins, SALT).withColumn("n_marks", F.length("salt_fingerprint"))


@query("v8_suppressed", "component:s n_actors:i hours:h suppressed:b", "SELECT component, n_actors, CASE WHEN n_actors >= 148 THEN hours END AS hours, n_actors < 148 AS suppressed FROM (SELECT component, COUNT(DISTINCT actor_hash) AS n_actors, SUM(hours) AS hours FROM work_session JOIN work_item USING (work_item_id) GROUP BY 1)")
def _(t: Tables) -> DataFrame:
    by = t.work_sessions.join(t.items.select("work_item_id", "component"), "work_item_id").groupBy("component").agg(F.countDistinct("actor_hash").alias("n_actors"), F.sum("hours").alias("hours"))
    return privacy.suppress(by, "n_actors", ["hours"], Params(k=148))


@query("v9_published_capacity", "repo:s component:s n_engineers:i total_items:i", "SELECT repo, component, n_engineers, total_items FROM capacity")
def _(t: Tables) -> DataFrame:
    return privacy.assert_published(capacity.component_capacity(t.items, t.events, t.costs))
