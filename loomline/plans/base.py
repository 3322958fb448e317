"""The tables that queries start from, the SQL that derives the same ones, and the register of queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cost, effort, process, waste
from ..sources import sample_log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Kinds of result columns: text, whole number, four digits, two digits, flag, time.
KINDS = {"s": "string", "i": "bigint", "h": "double", "m": "double", "b": "boolean", "t": "timestamp_ntz"}


class Tables:
    """The tables derived from one set of files, built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return sample_log.read(self.spark, self.sf_dir, name)

    @cached_property
    def events(self) -> DataFrame:
        return sample_log.event_log(self.spark, self.sf_dir)

    @cached_property
    def items(self) -> DataFrame:
        return sample_log.work_items(self.spark, self.sf_dir)

    @cached_property
    def actors(self) -> DataFrame:
        return sample_log.actors(self.spark, self.sf_dir)

    @cached_property
    def rates(self) -> DataFrame:
        return cost.rate_card(self.spark)

    @cached_property
    def runs(self) -> DataFrame:
        return sample_log.ci_runs(self.spark, self.sf_dir)

    @cached_property
    def meetings(self) -> DataFrame:
        return sample_log.calendar_events(self.spark, self.sf_dir)

    @cached_property
    def usage(self) -> DataFrame:
        return sample_log.ai_usage(self.spark, self.sf_dir)

    @cached_property
    def work_sessions(self) -> DataFrame:
        return effort.work_sessions(self.events)

    @cached_property
    def costs(self) -> DataFrame:
        return cost.cost_events(cost.price_sessions(self.work_sessions, self.actors, self.rates), cost.price_ci(self.runs), cost.price_meetings(self.meetings, self.actors, self.rates), cost.price_tokens(self.usage))

    @cached_property
    def case_cost(self) -> DataFrame:
        return cost.case_cost(self.items, self.costs)

    @cached_property
    def log(self) -> DataFrame:
        return process.canonical_log(self.events, self.items, CUTOFF)

    @cached_property
    def evidence(self) -> DataFrame:
        return process.case_evidence(self.log, self.items)

    @cached_property
    def nodes(self) -> DataFrame:
        return process.collapsed_sequence(self.events)

    @cached_property
    def moves(self) -> DataFrame:
        return process.human_transitions(self.nodes)

    @cached_property
    def classes(self) -> DataFrame:
        return process.variant_class(self.events)

    @cached_property
    def by_class(self) -> DataFrame:
        return process.edges_by_class(self.moves, self.classes, self.items, self.case_cost)

    @cached_property
    def edges(self) -> DataFrame:
        return process.edges(self.moves, self.items, self.case_cost)

    @cached_property
    def variants(self) -> DataFrame:
        return process.variants(process.case_paths(self.nodes, self.items, self.case_cost), self.nodes)

    @cached_property
    def pairs(self) -> DataFrame:
        return process.rework_pairs(self.events)

    @cached_property
    def latency_both(self) -> DataFrame:
        return process.review_latency_both(self.events, self.items)

    @cached_property
    def backlog(self) -> DataFrame:
        return process.backlog_time(self.events, self.items)

    @cached_property
    def ci_waste(self) -> DataFrame:
        return waste.ci_waste(self.runs)

    @cached_property
    def spend(self) -> DataFrame:
        return cost.case_spend(self.items, self.costs, self.events)

    @cached_property
    def waste(self) -> DataFrame:
        return waste.waste_by_project(self.pairs, self.actors, self.rates, self.items, self.case_cost, self.latency_both, self.ci_waste)


#: Where the window of the log begins.
CUTOFF = "2024-01-03 00:00:00"


def shaped(df: DataFrame, columns: str) -> DataFrame:
    """Columns by name and kind, in the types and with the digits that results are compared in.

    Values that lie on a tie but for the noise of summation are lifted over it before they are rounded.
    """
    out = []
    for item in columns.split():
        name, kind = item.split(":")
        c = F.col(name).cast(KINDS[kind])
        out.append({"h": F.round(c + 1e-7, 4), "m": F.round(c + 1e-6, 2)}.get(kind, c).alias(name))
    return df.select(*out)


def shaped_sql(sql: str, columns: str) -> str:
    """The same around a SQL query."""
    types = {"s": "VARCHAR", "i": "BIGINT", "h": "DOUBLE", "m": "DOUBLE", "b": "BOOLEAN", "t": "TIMESTAMP"}
    out = []
    for item in columns.split():
        name, kind = item.split(":")
        c = f'CAST("{name}" AS {types[kind]})'
        out.append({"h": f"ROUND({c} + 1e-7, 4)", "m": f"ROUND({c} + 1e-6, 2)"}.get(kind, c) + f' AS "{name}"')
    return f"SELECT {', '.join(out)} FROM ({sql}) AS answer"


def query(name: str, columns: str, sql: str | None = None, prelude: bool = True) -> Callable:
    """Register a query: its result columns, and the SQL for the same rows on the generic tables."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: shaped(f(Tables(spark, sf_dir)), columns)
        if sql is not None:
            ORACLES[name] = (PRELUDE + " " if prelude else "") + shaped_sql(sql, columns)
        return f

    return register


#: The generic tables as the tables above, in SQL. Written from the definitions, not from the Spark code.
PRELUDE = f"""
WITH ev AS (
  SELECT event_id AS id, ts, user_id, value, k, 'K-' || k || '@' || strftime(ts, '%Y-%m-%d') AS work_item_id,
    CASE event_type
      WHEN 'signup' THEN CASE event_id % 3 WHEN 0 THEN 'ticket_created' WHEN 1 THEN 'review_requested' ELSE 'ticket_started' END
      WHEN 'click' THEN 'commit'
      WHEN 'view' THEN CASE event_id % 2 WHEN 0 THEN 'review' ELSE 'approved' END
      WHEN 'error' THEN CASE event_id % 2 WHEN 0 THEN 'changes_requested' ELSE 'ci_run' END
      ELSE CASE event_id % 3 WHEN 0 THEN 'ticket_resolved' ELSE 'merged' END END AS activity
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)),
event_log AS (
  SELECT CAST(id AS VARCHAR) AS event_id, work_item_id, CASE WHEN activity <> 'ci_run' THEN 'u' || user_id END AS actor_hash, activity, ts,
    CASE WHEN activity = 'ci_run' THEN ROUND(value * 60, 3) END AS duration_s,
    CASE WHEN activity LIKE 'ticket%' THEN 'jira' ELSE 'github' END AS source,
    CASE WHEN activity LIKE 'ticket%' THEN 'asf_jira' WHEN activity = 'ci_run' THEN 'github_actions' WHEN activity <> 'commit' THEN 'github_graphql' END AS a_ingest,
    CASE WHEN activity = 'merged' THEN 'u' || ((user_id + 7) % 150) END AS a_author,
    CASE WHEN activity NOT LIKE 'ticket%' AND activity NOT IN ('ci_run', 'commit') THEN CAST(k AS VARCHAR) END AS a_pr,
    CASE WHEN activity = 'ci_run' THEN 'machine' END AS a_absent,
    CASE WHEN activity = 'ci_run' THEN CAST(id AS VARCHAR) END AS a_run
  FROM ev),
work_item AS (
  SELECT work_item_id, 'org/r' || (k % 2) AS repo, CASE WHEN k % 10 <> 9 THEN 'c' || (k % 10) END AS component, 'e' || (k % 7) AS epic,
    date_diff('day', DATE '2024-01-01', CAST(MIN(ts) AS DATE)) // 14 AS sprint,
    CASE WHEN MIN(ts) FILTER (WHERE activity = 'ticket_created') IS NOT NULL THEN 'jira' WHEN k % 3 = 0 THEN 'pr' ELSE 'commit' END AS case_source,
    CASE WHEN MIN(ts) FILTER (WHERE activity = 'ticket_created') IS NOT NULL THEN 'PRJ-' || k END AS jira_key,
    'type' || (k % 3) AS issue_type, CASE WHEN k % 4 <> 3 THEN 'p' || (k % 4) END AS priority, MIN(ts) AS opened_at,
    MAX(ts) FILTER (WHERE activity IN ('merged', 'ticket_resolved')) AS closed_at, MIN(ts) FILTER (WHERE activity = 'ticket_created') AS jira_created_at
  FROM ev GROUP BY work_item_id, k),
actor AS (
  SELECT 'u' || user_id AS actor_hash, CASE user_id % 5 WHEN 0 THEN 'junior' WHEN 1 THEN 'mid' WHEN 2 THEN 'senior' WHEN 3 THEN 'staff' END AS role_band, MIN(ts) AS first_seen
  FROM events GROUP BY user_id),
rate_card AS (
  SELECT role_band, CAST(ROUND(annual * 1.30 / 1840, 2) AS DECIMAL(18,2)) AS hourly
  FROM (VALUES ('junior', 1660000.0::DOUBLE), ('mid', 2953971.0::DOUBLE), ('senior', 4830000.0::DOUBLE), ('staff', 6950000.0::DOUBLE)) AS v(role_band, annual)),
ci_run AS (
  SELECT CAST(id AS VARCHAR) AS run_id, CASE WHEN id % 7 <> 0 THEN work_item_id END AS work_item_id, 'org/r' || (k % 2) AS repo, ts, ROUND(value, 3) AS runner_minutes,
    CASE WHEN id % 5 = 0 THEN 'failure' ELSE 'success' END AS conclusion, CASE WHEN id % 4 = 1 THEN 2 ELSE 1 END AS attempt
  FROM ev WHERE activity = 'ci_run'),
calendar_event AS (
  SELECT 'm' || id AS meeting_id, work_item_id, ts, CASE WHEN id % 100 = 7 THEN 30.0 ELSE 45.0 END::DOUBLE AS duration_min, 2 + id % 5 AS attendee_count
  FROM ev),
ai_usage AS (SELECT 'a' || id AS usage_id, work_item_id, 1000 + (id % 977) * 40 AS tokens_in, 200 + (id % 331) * 15 AS tokens_out FROM ev),
gaps AS (SELECT unnest([90, 240, 480, 1440]) AS gap_minutes),
work AS (SELECT event_id, actor_hash, work_item_id, ts, gap_minutes FROM event_log CROSS JOIN gaps WHERE actor_hash IS NOT NULL AND activity <> 'ci_run'),
breaks AS (
  SELECT *, CASE WHEN epoch_us(ts) - epoch_us(LAG(ts) OVER w) > gap_minutes * 60000000::BIGINT THEN 1 ELSE 0 END AS fresh
  FROM work WINDOW w AS (PARTITION BY gap_minutes, actor_hash ORDER BY ts, event_id)),
numbered AS (SELECT *, SUM(fresh) OVER (PARTITION BY gap_minutes, actor_hash ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS nr FROM breaks),
spans AS (
  SELECT gap_minutes, actor_hash, nr, MIN(ts) - INTERVAL 30 MINUTE AS started_at, MAX(ts) AS ended_at, COUNT(*) AS n_events,
    (epoch_us(MAX(ts)) - epoch_us(MIN(ts) - INTERVAL 30 MINUTE)) / 3.6e9 AS raw_hours
  FROM numbered GROUP BY ALL),
days AS (SELECT *, SUM(raw_hours) OVER (PARTITION BY gap_minutes, actor_hash, CAST(started_at AS DATE)) AS day_hours FROM spans),
swept AS (SELECT *, raw_hours * CASE WHEN day_hours > 10 THEN 10.0 / day_hours ELSE 1.0 END AS hours FROM days),
work_session AS (
  SELECT substr(sha256(actor_hash || '|' || strftime(started_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(started_at) % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(epoch_us(started_at) % 1000000 AS VARCHAR), 6, '0') END || '+00:00|' || work_item_id), 1, 24) AS session_id,
    actor_hash, work_item_id, started_at, ended_at, ROUND(hours * n / n_events, 4) AS hours, n AS n_events
  FROM (SELECT gap_minutes, actor_hash, nr, work_item_id, COUNT(*) AS n FROM numbered WHERE gap_minutes = 480 GROUP BY ALL) JOIN swept USING (gap_minutes, actor_hash, nr)),
blended AS (SELECT CAST(COALESCE(SUM(CAST(hourly AS DOUBLE)) / NULLIF(COUNT(*), 0), 0) AS DECIMAL(18,6)) AS rate FROM actor JOIN rate_card USING (role_band)),
cost_event AS (
  SELECT 'sess:' || session_id AS cost_event_id, work_item_id, actor_hash, hours, CAST(hourly AS DECIMAL(18,6)) AS rate_band, CAST(ROUND(CAST(hours AS DECIMAL(18,4)) * hourly, 2) AS DECIMAL(18,2)) AS cost, 'session_inferred' AS basis
  FROM work_session JOIN actor USING (actor_hash) JOIN rate_card USING (role_band)
  UNION ALL SELECT 'ci:' || run_id, work_item_id, NULL, NULL, NULL, CAST(ROUND(CAST(runner_minutes AS DECIMAL(12,3)) * 0.57126::DECIMAL(10,6), 2) AS DECIMAL(18,2)), 'ci_runner' FROM ci_run WHERE work_item_id IS NOT NULL AND runner_minutes > 0
  UNION ALL SELECT 'meet:' || meeting_id, work_item_id, NULL, attendee_count * duration_min / 60.0, rate, CAST(ROUND(CAST(attendee_count * duration_min / 60.0 AS DECIMAL(18,4)) * rate, 2) AS DECIMAL(18,2)), 'meeting' FROM calendar_event CROSS JOIN blended
  UNION ALL SELECT 'ai:' || usage_id, work_item_id, NULL, NULL, NULL, CAST(ROUND(((tokens_in * 300 + tokens_out * 1500) * 9521)::DECIMAL(30,0) / 10000000000.0, 2) AS DECIMAL(18,2)), 'ai_tokens' FROM ai_usage),
kind_cost AS (SELECT work_item_id, basis, SUM(cost) AS spent, SUM(hours) AS worked, list(actor_hash) AS people FROM cost_event GROUP BY ALL),
kinds AS (SELECT work_item_id, SUM(spent) AS total_cost, SUM(worked) AS total_hours, len(list_distinct(flatten(list(people)))) AS n_actors, map(list(basis), list(spent)) AS by_kind FROM kind_cost GROUP BY ALL),
case_cost AS (
  SELECT i.work_item_id, i.repo, i.component, i.epic, i.sprint, k.total_cost, k.total_hours, COALESCE(k.n_actors, 0) AS n_actors, map_extract(k.by_kind, 'session_inferred')[1] AS labour_cost,
    map_extract(k.by_kind, 'ci_runner')[1] AS ci_cost, map_extract(k.by_kind, 'ai_tokens')[1] AS ai_cost, map_extract(k.by_kind, 'meeting')[1] AS meeting_cost
  FROM work_item AS i LEFT JOIN kinds AS k ON k.work_item_id = i.work_item_id),
ordered AS (SELECT work_item_id, list({{'id': event_id, 'what': activity, 'moment': ts, 'who': actor_hash}} ORDER BY ts, event_id) AS l FROM event_log GROUP BY work_item_id),
spots AS (SELECT work_item_id, l, unnest(range(1, len(l) + 1)) AS i FROM ordered),
clog AS (
  SELECT e.event_id, s.work_item_id AS case_id, e.activity, e.ts, e.actor_hash AS resource, e.duration_s, e.source,
    CASE WHEN e.a_ingest IS NOT NULL THEN e.a_ingest WHEN e.activity = 'commit' THEN 'git_local' ELSE e.source END AS ingest_source,
    i.repo, i.component, i.sprint, i.case_source, i.jira_key, NOT e.ts < TIMESTAMP '{CUTOFF}' AS in_window, s.i AS step, e.a_pr
  FROM spots AS s JOIN event_log AS e ON e.event_id = s.l[s.i].id JOIN work_item AS i ON i.work_item_id = s.work_item_id),
by_source AS (SELECT case_id, ingest_source, COUNT(*) AS n, MIN(ts) AS earliest, MAX(ts) AS newest, SUM(CASE WHEN in_window THEN 0 ELSE 1 END) AS outside FROM clog GROUP BY case_id, ingest_source),
proven AS (SELECT case_id, list(ingest_source) AS by_whom, SUM(n) AS n, MIN(earliest) AS earliest, MAX(newest) AS newest, SUM(outside) AS outside FROM by_source GROUP BY case_id),
seq AS (
  SELECT work_item_id, l[i].id AS event_id, l[i].who AS actor_hash, l[i].what AS activity, l[i].moment AS ts, l[i + 1].what AS next_activity, l[i + 1].moment AS next_ts, l[i + 1].who AS next_actor_hash
  FROM spots),
tr AS (
  SELECT work_item_id, l[i].what AS source_activity, l[i + 1].what AS target_activity, l[i].moment AS source_ts, l[i + 1].moment AS target_ts, epoch_us(l[i + 1].moment - l[i].moment) / 3.6e9 AS gap_hours
  FROM spots WHERE i < len(l)),
firsts AS (SELECT work_item_id, activity, MIN(ts) AS moment FROM event_log GROUP BY ALL),
moments AS (SELECT work_item_id, map(list(activity), list(moment)) AS at FROM firsts GROUP BY work_item_id),
evidence AS (
  SELECT i.work_item_id AS case_id, i.repo, i.component, i.sprint, i.case_source, COALESCE(p.n, 0) AS n_events, p.earliest AS started_at, p.newest AS ended_at,
    list_contains(p.by_whom, 'git_local') AS has_git, list_contains(p.by_whom, 'github_graphql') AS has_pr, list_contains(p.by_whom, 'github_actions') AS has_ci, list_contains(p.by_whom, 'asf_jira') AS has_jira,
    COALESCE(p.outside, 0) AS n_pre_window, map_extract(m.at, 'commit')[1] AS first_commit_at, map_extract(m.at, 'merged')[1] AS merged_at, map_extract(m.at, 'ticket_created')[1] AS ticket_created_at
  FROM work_item AS i LEFT JOIN proven AS p ON p.case_id = i.work_item_id LEFT JOIN moments AS m ON m.work_item_id = i.work_item_id),
cycle AS (
  SELECT case_id AS work_item_id, repo, component, sprint, first_commit_at, merged_at, epoch_us(merged_at - first_commit_at) / 3.6e9 AS cycle_hours
  FROM evidence WHERE merged_at > first_commit_at),
places AS (SELECT work_item_id, l, i FROM spots WHERE i < len(l)),
redone AS (SELECT work_item_id, l[i].moment AS asked, l[i + 1].moment AS redo, unnest(list_filter(l, lambda x: x.what = 'commit' AND x.moment = l[i + 1].moment)) AS hit FROM places WHERE l[i].what = 'changes_requested' AND l[i + 1].what = 'commit'),
rework AS (SELECT work_item_id, asked AS changes_requested_at, redo AS redo_commit_at, epoch_us(redo - asked) / 3.6e9 AS gap_hours, hit.who AS redone_by FROM redone),
answers AS (SELECT DISTINCT work_item_id, ts AS moment FROM event_log WHERE activity IN ('review', 'approved', 'changes_requested')),
asked AS (SELECT DISTINCT work_item_id, ts AS moment FROM event_log WHERE activity = 'review_requested'),
latency AS (
  SELECT asked.work_item_id, asked.moment AS requested_at, answers.moment AS responded_at, epoch_us(answers.moment - asked.moment) / 3.6e9 AS latency_hours
  FROM asked ASOF JOIN answers ON asked.work_item_id = answers.work_item_id AND asked.moment < answers.moment),
since_opened AS (SELECT work_item_id, activity, epoch_us(moment - opened_at) / 3.6e9 AS waited, epoch_us(moment - jira_created_at) / 3.6e9 AS lay, repo, component, priority, issue_type FROM firsts NATURAL JOIN work_item),
latency_both AS (
  SELECT 'requested_to_first_response' AS definition, work_item_id, latency_hours FROM latency
  UNION ALL
  SELECT 'pr_opened_to_first_review' AS definition, work_item_id, waited AS latency_hours FROM since_opened WHERE activity = 'review' AND waited > 0),
backlog AS (SELECT work_item_id, repo, component, lay AS backlog_hours, priority, issue_type FROM since_opened WHERE activity = 'commit' AND lay > 0),
marked AS (SELECT *, CAST(activity IS DISTINCT FROM LAG(activity) OVER (PARTITION BY work_item_id ORDER BY ts, event_id) AS INTEGER) AS fresh_node FROM event_log WHERE activity <> 'ci_run'),
counted AS (SELECT *, SUM(fresh_node) OVER (PARTITION BY work_item_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS node_step FROM marked),
bare_nodes AS (SELECT work_item_id, node_step, ANY_VALUE(activity) AS activity, MIN(ts) AS started_at, MAX(ts) AS ended_at, COUNT(*) AS repeat_count FROM counted GROUP BY work_item_id, node_step),
nodes AS (
  SELECT *, (SELECT COALESCE(SUM(o.repeat_count), 0) FROM bare_nodes AS o WHERE o.work_item_id = n.work_item_id AND o.node_step < n.node_step AND o.activity <> n.activity) AS run_id
  FROM bare_nodes AS n),
human AS (
  SELECT one.work_item_id, one.activity AS source_activity, two.activity AS target_activity, one.started_at AS source_started_at, two.started_at AS target_started_at, epoch_us(two.started_at - one.ended_at) / 3.6e9 AS gap_hours
  FROM nodes AS one LEFT JOIN nodes AS two ON two.work_item_id = one.work_item_id AND two.node_step = one.node_step + 1),
moved AS (SELECT h.*, w.repo FROM human h JOIN work_item w USING (work_item_id) WHERE target_activity IS NOT NULL),
edge_cases AS (SELECT repo, source_activity, target_activity, work_item_id, list(gap_hours) AS gaps FROM moved GROUP BY ALL),
edges AS (
  SELECT e.repo, e.source_activity, e.target_activity, SUM(len(e.gaps)) AS n_transitions, COUNT(*) AS n_cases, list_aggregate(flatten(list(e.gaps)), 'median') AS median_gap_hours, SUM(COALESCE(k.total_cost, 0)) AS case_cost_exposure
  FROM edge_cases AS e LEFT JOIN kinds AS k ON k.work_item_id = e.work_item_id GROUP BY ALL),
labels_of AS (SELECT work_item_id, list(activity || CASE WHEN repeat_count > 1 THEN 'x' || repeat_count ELSE '' END ORDER BY node_step) AS names FROM nodes GROUP BY work_item_id),
case_variant AS (SELECT i.work_item_id, i.repo, array_to_string(n.names, '>') AS variant_key, COALESCE(k.total_cost, 0) AS case_cost FROM work_item AS i JOIN labels_of AS n ON n.work_item_id = i.work_item_id LEFT JOIN kinds AS k ON k.work_item_id = i.work_item_id),
grouped AS (SELECT repo, variant_key, COUNT(*) AS n_cases, SUM(case_cost) AS total_cost FROM case_variant GROUP BY ALL),
repos AS (SELECT repo, MAX(n_cases) AS most, CAST(SUM(total_cost) AS DOUBLE) AS spent FROM grouped GROUP BY ALL),
variants AS (
  SELECT md5(g.repo || '|' || g.variant_key) AS variant_id, g.repo, g.variant_key, g.n_cases, g.total_cost,
    CASE WHEN r.spent <> 0 THEN ROUND(100.0 * CAST(g.total_cost AS DOUBLE) / r.spent, 2) END AS cost_share_pct, g.n_cases = r.most AS is_modal
  FROM grouped AS g JOIN repos AS r ON r.repo = g.repo),
classes AS (
  SELECT work_item_id, CASE WHEN COUNT(*) FILTER (WHERE activity = 'changes_requested') > 0 THEN 'rework_loop' WHEN COUNT(*) FILTER (WHERE activity = 'review') >= 3 THEN 'triple_review' ELSE 'happy_path' END AS variant_class
  FROM event_log GROUP BY 1),
own_moves AS (SELECT *, COUNT(*) OVER (PARTITION BY work_item_id) AS n_own FROM moved),
by_class AS (
  SELECT m.repo, c.variant_class, m.source_activity, m.target_activity, COUNT(*) AS n_transitions, len(list_distinct(list(m.work_item_id))) AS n_cases, SUM(CASE WHEN k.total_cost IS NULL THEN 0 ELSE CAST(k.total_cost AS DOUBLE) / m.n_own END) AS cost_rupees
  FROM own_moves AS m JOIN classes AS c ON c.work_item_id = m.work_item_id LEFT JOIN kinds AS k ON k.work_item_id = m.work_item_id
  GROUP BY m.repo, c.variant_class, m.source_activity, m.target_activity),
class_totals AS (SELECT c.variant_class, COUNT(*) AS n_cases, SUM(CASE WHEN k.total_cost IS NULL THEN 0 ELSE k.total_cost END) AS total_cost FROM classes AS c JOIN work_item AS i ON i.work_item_id = c.work_item_id LEFT JOIN kinds AS k ON k.work_item_id = c.work_item_id GROUP BY c.variant_class),
of_all AS (SELECT SUM(n_cases) AS n_all, CAST(SUM(total_cost) AS DOUBLE) AS cost_all FROM class_totals),
summary AS (
  SELECT variant_class, n_cases, total_cost, n_cases / n_all AS share_of_work_items, CASE WHEN cost_all <> 0 THEN CAST(total_cost AS DOUBLE) / cost_all ELSE 0 END AS share_of_cost
  FROM class_totals CROSS JOIN of_all),
features AS (
  SELECT a.actor_hash, COALESCE(tenure, 0) AS tenure_months, COALESCE(reviews, 0) AS reviews, COALESCE(merged, 0) AS merged, COALESCE(performed, 0) AS merges_performed, COALESCE(n, 0) AS n_events, COALESCE(tracker, false) AS seen_in_tracker
  FROM actor a LEFT JOIN (
    SELECT actor_hash, (epoch_us(MAX(ts)) - epoch_us(MIN(ts))) / 1e6 / 2629746.0 AS tenure, COUNT(*) AS n, COUNT(*) FILTER (WHERE activity IN ('review', 'approved', 'changes_requested')) AS reviews,
      COUNT(*) FILTER (WHERE activity = 'merged') AS performed, BOOL_OR(COALESCE(a_ingest, 'git_local') = 'asf_jira') AS tracker FROM event_log WHERE actor_hash IS NOT NULL GROUP BY 1) s USING (actor_hash)
  LEFT JOIN (SELECT a_author AS actor_hash, COUNT(DISTINCT work_item_id) AS merged FROM event_log WHERE activity = 'merged' GROUP BY 1) m USING (actor_hash)),
shares AS (
  SELECT work_item_id, actor_hash, SUM(spent) AS spent, SUM(reviewed) / GREATEST(SUM(acted), 1) AS reviewing
  FROM (
    SELECT work_item_id, actor_hash, hours AS spent, 0 AS reviewed, 0 AS acted FROM cost_event WHERE basis = 'session_inferred'
    UNION ALL
    SELECT work_item_id, actor_hash, 0, CASE WHEN activity IN ('review', 'approved', 'changes_requested') THEN 1 ELSE 0 END, 1 FROM event_log WHERE actor_hash IS NOT NULL AND activity <> 'ci_run')
  GROUP BY work_item_id, actor_hash),
split AS (SELECT work_item_id, SUM(spent) AS spent, SUM(spent * reviewing) AS on_reviews FROM shares GROUP BY work_item_id),
spend AS (
  SELECT c.work_item_id, c.repo, COALESCE(c.component, 'unassigned') AS component, c.sprint, COALESCE(s.spent - s.on_reviews, 0) AS author_hours, COALESCE(s.on_reviews, 0) AS review_hours, COALESCE(c.total_cost, 0) AS cost, COALESCE(c.labour_cost, 0) AS labour_cost
  FROM case_cost AS c LEFT JOIN split AS s ON s.work_item_id = c.work_item_id),
ci_wasted AS (SELECT *, attempt > 1 AS is_rerun, conclusion = 'failure' AS is_failure FROM ci_run WHERE attempt > 1 OR conclusion = 'failure'),
wasted AS (
  SELECT 'rework' AS waste_type, i.repo, i.component, r.gap_hours AS h, r.gap_hours * CAST(c.hourly AS DOUBLE) AS amount
  FROM rework AS r JOIN work_item AS i ON i.work_item_id = r.work_item_id LEFT JOIN actor AS a ON a.actor_hash = r.redone_by LEFT JOIN rate_card AS c ON c.role_band = a.role_band WHERE r.gap_hours >= 0
  UNION ALL
  SELECT 'meeting', repo, component, 0, CAST(meeting_cost AS DOUBLE) FROM case_cost WHERE meeting_cost > 0
  UNION ALL
  SELECT 'latency', i.repo, i.component, b.latency_hours, NULL FROM latency_both AS b JOIN work_item AS i ON i.work_item_id = b.work_item_id WHERE b.definition = 'pr_opened_to_first_review'
  UNION ALL
  SELECT 'ci', repo, NULL, runner_minutes / 60.0, runner_minutes FROM ci_wasted),
waste_rows AS (
  SELECT waste_type, repo, component, COUNT(*) AS n_items, CASE waste_type WHEN 'latency' THEN median(h) ELSE SUM(h) END AS hours,
    CAST(CASE waste_type WHEN 'ci' THEN CAST(ROUND(CAST(SUM(amount) AS DECIMAL(15,3)) * 0.57126::DECIMAL(10,6), 2) AS DOUBLE) ELSE ROUND(SUM(amount), 2) END AS DECIMAL(18,2)) AS cost
  FROM wasted GROUP BY waste_type, repo, component),
sited AS (SELECT work_item_id, repo, CASE WHEN component IS NULL THEN 'unassigned' ELSE component END AS component, closed_at FROM work_item),
closings AS (SELECT repo, component, date_trunc('week', closed_at) AS week, COUNT(*) AS n FROM sited WHERE closed_at IS NOT NULL GROUP BY ALL),
measures AS (
  SELECT repo, component, 'items' AS measure, CAST(COUNT(*) AS DOUBLE) AS v FROM sited GROUP BY repo, component
  UNION ALL SELECT repo, component, 'closed', COUNT(closed_at) FROM sited GROUP BY repo, component
  UNION ALL SELECT repo, component, 'weeks', epoch_us(MAX(closed_at) - MIN(closed_at)) / 6.048e11 FROM sited GROUP BY repo, component
  UNION ALL SELECT repo, component, 'people', len(list_distinct(list(e.actor_hash))) FROM sited JOIN event_log AS e USING (work_item_id) WHERE e.actor_hash IS NOT NULL GROUP BY repo, component
  UNION ALL SELECT repo, component, 'spread', STDDEV_SAMP(n) / AVG(n) FROM closings GROUP BY repo, component
  UNION ALL SELECT repo, component, 'cost', CAST(SUM(k.total_cost) AS DOUBLE) FROM sited JOIN kinds AS k USING (work_item_id) GROUP BY repo, component
  UNION ALL SELECT repo, component, 'hours', SUM(k.total_hours) FROM sited JOIN kinds AS k USING (work_item_id) GROUP BY repo, component),
measured AS (SELECT repo, component, map(list(measure), list(v)) AS m FROM measures GROUP BY repo, component),
known_measures AS (
  SELECT repo, component, CAST(map_extract(m, 'items')[1] AS BIGINT) AS items, CAST(map_extract(m, 'closed')[1] AS BIGINT) AS closed, CAST(COALESCE(map_extract(m, 'people')[1], 0) AS BIGINT) AS people,
    GREATEST(COALESCE(map_extract(m, 'weeks')[1], 1), 1) AS weeks, COALESCE(map_extract(m, 'spread')[1], 0) AS spread, map_extract(m, 'cost')[1] AS cost, COALESCE(map_extract(m, 'hours')[1], 0) AS hours
  FROM measured),
capacity AS (
  SELECT repo, component, people AS n_engineers, items AS total_items, closed AS closed_items, items - closed AS open_items, weeks AS span_weeks, closed / weeks AS items_per_week, spread AS throughput_cv, people < 5 AS suppressed, CASE WHEN people < 5 THEN NULL ELSE cost END AS cost, hours
  FROM known_measures),
weekly AS (SELECT repo, COALESCE(component, 'unassigned') AS component, CAST(date_trunc('week', ts) AS DATE) AS week, COUNT(DISTINCT case_id) AS delivered FROM clog WHERE activity = 'merged' AND in_window GROUP BY 1, 2, 3)
"""
