"""Queries of process discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import process
from .base import Tables, query


def joined(df: DataFrame) -> DataFrame:
    return df.withColumn("activities", F.array_join("activity_sequence", ">"))


@query("p1_event_log", "event_id:s case_id:s activity:s ts:t resource:s duration_s:h source:s ingest_source:s repo:s component:s sprint:i case_source:s jira_key:s in_window:b step:i", "SELECT * FROM clog")
def _(t: Tables) -> DataFrame:
    return t.log


@query("p2_case_evidence", "case_id:s repo:s component:s sprint:i case_source:s n_events:i started_at:t ended_at:t has_git:b has_pr:b has_ci:b has_jira:b n_pre_window:i first_commit_at:t merged_at:t ticket_created_at:t", "SELECT * FROM evidence")
def _(t: Tables) -> DataFrame:
    return t.evidence


@query("p3_event_sequence", "event_id:s work_item_id:s actor_hash:s activity:s ts:t next_activity:s next_ts:t next_actor_hash:s", "SELECT * FROM seq")
def _(t: Tables) -> DataFrame:
    return process.event_sequence(t.events)


@query("p4_transitions", "work_item_id:s source_activity:s target_activity:s source_ts:t target_ts:t gap_hours:h", "SELECT * FROM tr")
def _(t: Tables) -> DataFrame:
    return process.transitions(t.events)


@query(
    "p5_case_sequence",
    "work_item_id:s repo:s component:s sprint:i activities:s variant_id:s n_events:i started_at:t ended_at:t",
    "SELECT w.work_item_id, w.repo, w.component, w.sprint, string_agg(activity, '>' ORDER BY ts, event_id) AS activities, md5(string_agg(activity, '>' ORDER BY ts, event_id)) AS variant_id, COUNT(*) AS n_events, MIN(ts) AS started_at, MAX(ts) AS ended_at FROM work_item w JOIN event_log USING (work_item_id) GROUP BY 1, 2, 3, 4",
)
def _(t: Tables) -> DataFrame:
    return joined(process.case_sequence(t.events, t.items))


@query("p6_cycle_time", "work_item_id:s repo:s component:s sprint:i first_commit_at:t merged_at:t cycle_hours:h", "SELECT * FROM cycle")
def _(t: Tables) -> DataFrame:
    return process.cycle_time(t.events, t.items)


@query("p7_rework_pairs", "work_item_id:s changes_requested_at:t redo_commit_at:t gap_hours:h redone_by:s", "SELECT * FROM rework")
def _(t: Tables) -> DataFrame:
    return t.pairs


@query("p8_review_latency", "work_item_id:s requested_at:t responded_at:t latency_hours:h", "SELECT * FROM latency")
def _(t: Tables) -> DataFrame:
    return process.review_latency(t.events)


@query("p9_review_latency_both", "definition:s work_item_id:s latency_hours:h", "SELECT * FROM latency_both")
def _(t: Tables) -> DataFrame:
    return t.latency_both


@query("p10_backlog_time", "work_item_id:s repo:s component:s backlog_hours:h priority:s issue_type:s", "SELECT * FROM backlog")
def _(t: Tables) -> DataFrame:
    return t.backlog


@query("p11_collapsed_sequence", "work_item_id:s activity:s run_id:i started_at:t ended_at:t repeat_count:i node_step:i", "SELECT * FROM nodes")
def _(t: Tables) -> DataFrame:
    return t.nodes


@query("p12_human_transitions", "work_item_id:s source_activity:s target_activity:s source_started_at:t target_started_at:t gap_hours:h", "SELECT * FROM human")
def _(t: Tables) -> DataFrame:
    return t.moves


@query("p13_edges", "repo:s source_activity:s target_activity:s n_transitions:i n_cases:i median_gap_hours:h case_cost_exposure:m", "SELECT * FROM edges")
def _(t: Tables) -> DataFrame:
    return t.edges


SIGNIFICANT = """
SELECT * FROM (
  SELECT *, 100.0 * SUM(weight) OVER (ORDER BY weight DESC, repo, source_activity, target_activity ROWS UNBOUNDED PRECEDING) / SUM(weight) OVER () AS running_pct
  FROM (SELECT *, CASE WHEN SUM(case_cost_exposure) OVER () > 0 THEN CAST(case_cost_exposure AS DOUBLE) ELSE CAST(n_transitions AS DOUBLE) END AS weight FROM edges)) WHERE running_pct <= 90
"""


@query("p14_significant_edges", "repo:s source_activity:s target_activity:s weight:m running_pct:h", SIGNIFICANT)
def _(t: Tables) -> DataFrame:
    return process.significant_edges(t.edges)


@query("p15_case_variant", "work_item_id:s repo:s variant_key:s case_cost:m", "SELECT * FROM case_variant")
def _(t: Tables) -> DataFrame:
    return process.case_variant(t.nodes, t.items, t.case_cost)


VARIANT = "variant_id:s repo:s variant_key:s n_cases:i total_cost:m cost_share_pct:m is_modal:b"


@query("p16_variants", VARIANT, "SELECT * FROM variants")
def _(t: Tables) -> DataFrame:
    return t.variants


@query("p17_rare_but_costly", VARIANT, "SELECT * FROM variants WHERE n_cases <= 5 AND cost_share_pct > 0 ORDER BY cost_share_pct DESC, variant_id LIMIT 10")
def _(t: Tables) -> DataFrame:
    return process.rare_but_costly(t.variants)


@query("p18_variant_class", "work_item_id:s variant_class:s", "SELECT * FROM classes")
def _(t: Tables) -> DataFrame:
    return t.classes


@query("p19_edges_by_class", "repo:s variant_class:s source_activity:s target_activity:s n_transitions:i n_cases:i cost_rupees:m", "SELECT * FROM by_class")
def _(t: Tables) -> DataFrame:
    return t.by_class


@query("p20_class_summary", "variant_class:s n_cases:i total_cost:m share_of_work_items:h share_of_cost:h", "SELECT * FROM summary")
def _(t: Tables) -> DataFrame:
    return process.class_summary(t.classes, t.items, t.case_cost)


MAP = """
SELECT source_activity, target_activity, variant_class, frequency, cost_rupees, SUM(cost_rupees) OVER () / all_cost AS coverage FROM (
  SELECT *, SUM(cost_rupees) OVER () AS all_cost, DENSE_RANK() OVER (ORDER BY edge_cost DESC, source_activity, target_activity) AS position FROM (
    SELECT *, ROUND(SUM(cost_rupees) OVER (PARTITION BY source_activity, target_activity), 4) AS edge_cost FROM (
      SELECT source_activity, target_activity, variant_class, SUM(n_transitions) AS frequency, SUM(cost_rupees) AS cost_rupees FROM by_class WHERE source_activity <> 'meeting' AND target_activity <> 'meeting' GROUP BY 1, 2, 3)))
WHERE position <= 20
"""


@query("p21_process_map", "source_activity:s target_activity:s variant_class:s frequency:i cost_rupees:m coverage:h", MAP)
def _(t: Tables) -> DataFrame:
    return process.process_map(t.by_class, 20)


@query("p22_rework_returns", "events:i cases:i", "SELECT COUNT(*) AS events, COUNT(DISTINCT case_id) AS cases FROM clog WHERE activity = 'changes_requested'")
def _(t: Tables) -> DataFrame:
    return process.rework_returns(t.log)


@query("p23_graph_nodes", "activity:s", "SELECT source_activity AS activity FROM edges UNION SELECT target_activity FROM edges")
def _(t: Tables) -> DataFrame:
    return process.graph_nodes(t.edges)


STATS = """
SELECT variant_class, n_cases, share_of_work_items, share_of_cost, COALESCE(share_of_cost / NULLIF(share_of_work_items, 0), 0) AS cost_multiple,
  SUM(CASE WHEN variant_class <> 'happy_path' THEN share_of_work_items ELSE 0 END) OVER () AS off_happy_path, SUM(n_cases) OVER () AS total_items FROM summary
"""


@query("p24_class_statistics", "variant_class:s n_cases:i share_of_work_items:h share_of_cost:h cost_multiple:h off_happy_path:h total_items:i", STATS)
def _(t: Tables) -> DataFrame:
    return process.class_statistics(process.class_summary(t.classes, t.items, t.case_cost))


MERGED = """
SELECT source_activity, target_activity, SUM(frequency) AS frequency, SUM(cost) AS cost_rupees,
  COALESCE(SUM(cost) FILTER (WHERE variant_class = 'happy_path') / NULLIF(SUM(cost), 0), 0) AS share_happy_path, COALESCE(SUM(cost) FILTER (WHERE variant_class = 'rework_loop') / NULLIF(SUM(cost), 0), 0) AS share_rework_loop,
  COALESCE(SUM(cost) FILTER (WHERE variant_class = 'triple_review') / NULLIF(SUM(cost), 0), 0) AS share_triple_review, ARG_MAX(variant_class, (ROUND(cost, 4), frequency, variant_class)) AS dominant_class
FROM (SELECT source_activity, target_activity, variant_class, SUM(n_transitions) AS frequency, SUM(cost_rupees) AS cost FROM by_class GROUP BY 1, 2, 3) GROUP BY 1, 2
"""


@query("p25_merged_edges", "source_activity:s target_activity:s frequency:i cost_rupees:m share_happy_path:h share_rework_loop:h share_triple_review:h dominant_class:s", MERGED)
def _(t: Tables) -> DataFrame:
    return process.merged_edges(t.by_class)


ORDER_LOG = """
WITH log AS (
  SELECT 'o' || o_orderkey AS event_id, 'O-' || o_orderkey AS work_item_id, CAST(NULL AS VARCHAR) AS actor_hash, 'commit' AS activity, o_orderdate AS ts FROM orders
  UNION ALL SELECT 'l' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, 'O-' || l_orderkey, 's' || l_suppkey,
    CASE WHEN l_returnflag = 'R' THEN 'changes_requested' WHEN l_linestatus = 'F' THEN 'merged' ELSE 'review' END, l_shipdate FROM lineitem),
islands AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY work_item_id ORDER BY ts, event_id) - ROW_NUMBER() OVER (PARTITION BY work_item_id, activity ORDER BY ts, event_id) AS run_id FROM log),
first AS (SELECT work_item_id, activity, run_id, MIN(ts) AS started_at, MAX(ts) AS ended_at, COUNT(*) AS n FROM islands GROUP BY 1, 2, 3),
"""


@query(
    "p4_order_transitions",
    "source_activity:s target_activity:s n:i total_gap_hours:m",
    ORDER_LOG + "tr AS (SELECT activity AS source_activity, LEAD(activity) OVER w AS target_activity, (epoch_us(LEAD(ts) OVER w) - epoch_us(ts)) / 3.6e9 AS gap FROM log WINDOW w AS (PARTITION BY work_item_id ORDER BY ts, event_id)) SELECT source_activity, target_activity, COUNT(*) AS n, SUM(gap) AS total_gap_hours FROM tr WHERE target_activity IS NOT NULL GROUP BY 1, 2",
    prelude=False,
)
def _(t: Tables) -> DataFrame:
    from ..sources.sample_log import order_log

    moves = process.transitions(order_log(t.spark, t.sf_dir))
    return moves.groupBy("source_activity", "target_activity").agg(F.count("*").alias("n"), F.sum("gap_hours").alias("total_gap_hours"))


@query("p11_order_collapsed", "activity:s n_nodes:i n_events:i longest:i", ORDER_LOG + "done AS (SELECT 1) SELECT activity, COUNT(*) AS n_nodes, SUM(n) AS n_events, MAX(n) AS longest FROM first GROUP BY 1", prelude=False)
def _(t: Tables) -> DataFrame:
    from ..sources.sample_log import order_log

    nodes = process.collapsed_sequence(order_log(t.spark, t.sf_dir))
    return nodes.groupBy("activity").agg(F.count("*").alias("n_nodes"), F.sum("repeat_count").alias("n_events"), F.max("repeat_count").alias("longest"))


@query(
    "p8_order_latency",
    "n:i total_hours:m",
    ORDER_LOG + "asked AS (SELECT DISTINCT work_item_id, ts FROM log WHERE activity = 'commit'), done AS (SELECT (epoch_us(MIN(a.ts)) - epoch_us(r.ts)) / 3.6e9 AS h FROM asked r JOIN log a ON a.work_item_id = r.work_item_id AND a.ts > r.ts AND a.activity IN ('review', 'changes_requested') GROUP BY r.work_item_id, r.ts) SELECT COUNT(*) AS n, SUM(h) AS total_hours FROM done",
    prelude=False,
)
def _(t: Tables) -> DataFrame:
    from ..sources.sample_log import order_log

    asked = order_log(t.spark, t.sf_dir).withColumn("activity", F.when(F.col("activity") == "commit", "review_requested").otherwise(F.col("activity")))
    return process.review_latency(asked).agg(F.count("*").alias("n"), F.sum("latency_hours").alias("total_hours"))
