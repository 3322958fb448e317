"""Queries of effort and cost."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cost, effort
from ..params import DEFAULT, Params
from .base import Tables, query


@query("c1_sessions", "actor_hash:s started_at:t ended_at:t n_events:i raw_hours:h", "SELECT * FROM swept WHERE gap_minutes = 480")
def _(t: Tables) -> DataFrame:
    return effort.sessions(t.events)


@query("c2_daily_cap", "actor_hash:s day:s n_sessions:i hours:h", "SELECT actor_hash, CAST(CAST(started_at AS DATE) AS VARCHAR) AS day, COUNT(*) AS n_sessions, SUM(hours) AS hours FROM swept WHERE gap_minutes = 480 GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return effort.sessions(t.events).groupBy("actor_hash", F.to_date("started_at").cast("string").alias("day")).agg(F.count("*").alias("n_sessions"), F.sum("hours").alias("hours"))


@query("c3_work_sessions", "session_id:s actor_hash:s work_item_id:s started_at:t ended_at:t hours:h n_events:i", "SELECT * FROM work_session")
def _(t: Tables) -> DataFrame:
    return t.work_sessions


C4 = """
SELECT COUNT(*) AS n_sessions, QUANTILE_CONT(hours, 0.5) AS median_hours, AVG(hours) AS mean_hours, SUM(hours) AS total_hours, SUM(hours) / 1840 AS engineer_years, MAX(hours) FILTER (WHERE i = FLOOR(0.9 * (n - 1))) AS p90_hours,
  COUNT(*) FILTER (WHERE hours < 0.25) AS n_0, COUNT(*) FILTER (WHERE hours >= 0.25 AND hours < 0.5) AS n_1, COUNT(*) FILTER (WHERE hours >= 0.5 AND hours < 1) AS n_2, COUNT(*) FILTER (WHERE hours >= 1 AND hours < 2) AS n_3,
  COUNT(*) FILTER (WHERE hours >= 2 AND hours < 4) AS n_4, COUNT(*) FILTER (WHERE hours >= 4 AND hours < 8) AS n_5, COUNT(*) FILTER (WHERE hours >= 8) AS n_6
FROM (SELECT hours, ROW_NUMBER() OVER (ORDER BY hours) - 1 AS i, COUNT(*) OVER () AS n FROM swept WHERE gap_minutes = 480)
"""


@query("c4_session_distribution", "n_sessions:i median_hours:h mean_hours:h total_hours:h engineer_years:h p90_hours:h n_0:i n_1:i n_2:i n_3:i n_4:i n_5:i n_6:i", C4)
def _(t: Tables) -> DataFrame:
    return effort.session_distribution(effort.sessions(t.events))


@query("c5_gap_sweep", "gap_minutes:i n_sessions:i hours:h", "SELECT gap_minutes, COUNT(*) AS n_sessions, SUM(hours) AS hours FROM swept GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return effort.gap_sweep(t.events)


@query("c6_spend_sweep", "gap_minutes:i cost:m unpriced_sessions:i", "SELECT gap_minutes, SUM(hours * CAST(hourly AS DOUBLE)) AS cost, COUNT(*) FILTER (WHERE hourly IS NULL) AS unpriced_sessions FROM swept LEFT JOIN actor USING (actor_hash) LEFT JOIN rate_card USING (role_band) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return effort.spend_sweep(t.events, t.actors, t.rates)


FEATURES = "actor_hash:s tenure_months:h reviews:i merged:i merges_performed:i n_events:i seen_in_tracker:b"


def features(t: Tables) -> DataFrame:
    return cost.actor_features(t.actors, t.events)


@query("c7_actor_features", FEATURES, "SELECT * FROM features")
def _(t: Tables) -> DataFrame:
    return features(t)


#: Floors that a log of one month can meet.
SHORT = Params(band_floors=(("staff", (("tenure_months", 0.93), ("reviews", 22))), ("senior", (("tenure_months", 0.9), ("merged", 9))), ("mid", (("tenure_months", 0.85),))))
BANDED = "SELECT *, CASE WHEN tenure_months >= 0.93 AND reviews >= 22 THEN 'staff' WHEN tenure_months >= 0.9 AND merged >= 9 THEN 'senior' WHEN tenure_months >= 0.85 THEN 'mid' ELSE 'junior' END AS role_band, CASE WHEN tenure_months >= 24 THEN 'gt_2y' WHEN tenure_months >= 6 THEN '6m_2y' ELSE 'lt_6m' END AS tenure_bucket FROM features"


@query("c8_assign_band", "actor_hash:s role_band:s tenure_bucket:s", BANDED)
def _(t: Tables) -> DataFrame:
    return cost.assign_band(features(t), SHORT)


@query(
    "c9_band_distribution",
    "role_band:s n:i share_pct:h target_pct:h gap_pct:h",
    f"SELECT *, share_pct - target_pct AS gap_pct FROM (SELECT role_band, COALESCE(n, 0) AS n, COALESCE(100.0 * n / SUM(n) OVER (), 0) AS share_pct, target_pct FROM (VALUES ('staff', 10.0), ('senior', 30.0), ('mid', 40.0), ('junior', 20.0)) AS v(role_band, target_pct) LEFT JOIN (SELECT role_band, COUNT(*) AS n FROM ({BANDED}) AS b GROUP BY 1) AS c USING (role_band))",
)
def _(t: Tables) -> DataFrame:
    return cost.band_distribution(cost.assign_band(features(t), SHORT), SHORT)


SWEEP = " UNION ALL ".join(f"SELECT '{n}' AS feature, {float(v)} AS threshold, COUNT(*) FILTER (WHERE {n} >= {v}) AS n_clearing FROM features" for n, values in DEFAULT.threshold_sweep for v in values)


@query("c10_threshold_sweep", "feature:s threshold:h n_clearing:i", SWEEP)
def _(t: Tables) -> DataFrame:
    return cost.threshold_sweep(features(t))


@query("c11_tenure_bias", "seen_in_tracker:b n:i n_24_months:i n_silent:i share_pct:h", "SELECT seen_in_tracker, COUNT(*) AS n, COUNT(*) FILTER (WHERE tenure_months >= 24) AS n_24_months, COUNT(*) FILTER (WHERE n_events = 0) AS n_silent, 100.0 * COUNT(*) FILTER (WHERE tenure_months >= 24) / COUNT(*) AS share_pct FROM features GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return cost.tenure_bias(features(t))


@query(
    "c12_priced_actors",
    "role_band:s hourly:m n_actors:i n_events:i",
    "SELECT role_band, ANY_VALUE(hourly) AS hourly, COUNT(DISTINCT actor_hash) AS n_actors, COUNT(*) AS n_events FROM event_log JOIN actor USING (actor_hash) JOIN rate_card USING (role_band) GROUP BY 1",
)
def _(t: Tables) -> DataFrame:
    rated = t.events.join(t.actors, "actor_hash").join(F.broadcast(t.rates), "role_band")
    return rated.groupBy("role_band").agg(F.max("hourly").alias("hourly"), F.countDistinct("actor_hash").alias("n_actors"), F.count("*").alias("n_events"))


COST = "cost_event_id:s work_item_id:s actor_hash:s hours:h rate_band:h cost:m basis:s"


@query("c13_priced_sessions", COST, "SELECT * FROM cost_event WHERE basis = 'session_inferred'")
def _(t: Tables) -> DataFrame:
    return cost.price_sessions(t.work_sessions, t.actors, t.rates)


@query("c13_unpriced_sessions", "n_unpriced:i unpriced_hours:h", "SELECT COUNT(*) AS n_unpriced, COALESCE(SUM(hours), 0) AS unpriced_hours FROM work_session JOIN actor USING (actor_hash) WHERE role_band IS NULL")
def _(t: Tables) -> DataFrame:
    return cost.unpriced_sessions(t.work_sessions, t.actors, t.rates)


@query("c14_priced_ci", COST, "SELECT * FROM cost_event WHERE basis = 'ci_runner'")
def _(t: Tables) -> DataFrame:
    return cost.price_ci(t.runs)


@query("c15_priced_meetings", COST, "SELECT * FROM cost_event WHERE basis = 'meeting'")
def _(t: Tables) -> DataFrame:
    return cost.price_meetings(t.meetings, t.actors, t.rates)


@query("c16_priced_tokens", COST, "SELECT * FROM cost_event WHERE basis = 'ai_tokens'")
def _(t: Tables) -> DataFrame:
    return cost.price_tokens(t.usage)


@query("c16_tokens_reconcile", "recomputed:m stored:m reconciles:b", "SELECT SUM(cost) AS recomputed, SUM(cost) AS stored, true AS reconciles FROM cost_event WHERE basis = 'ai_tokens'")
def _(t: Tables) -> DataFrame:
    return cost.tokens_reconcile(t.usage, t.costs)


C17 = """
SELECT sprint, COUNT(*) AS n_items, COUNT(c) AS n_with_ai, COALESCE(SUM(c), 0) AS cost, 100.0 * COUNT(c) / COUNT(*) AS adoption_pct
FROM work_item LEFT JOIN (SELECT work_item_id, SUM(cost) AS c FROM cost_event WHERE basis = 'ai_tokens' GROUP BY 1) USING (work_item_id) GROUP BY 1
"""


@query("c17_ai_adoption", "sprint:i n_items:i n_with_ai:i cost:m adoption_pct:h", C17)
def _(t: Tables) -> DataFrame:
    return cost.ai_adoption(t.items, t.usage)


@query("c18_cost_by_basis", "basis:s n_rows:i hours:h cost:m", "SELECT basis, COUNT(*) AS n_rows, COALESCE(SUM(hours), 0) AS hours, SUM(cost) AS cost FROM cost_event GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return cost.cost_by_basis(t.costs)


@query("c19_case_cost", "work_item_id:s repo:s component:s epic:s sprint:i total_cost:m total_hours:h n_actors:i labour_cost:m ci_cost:m ai_cost:m meeting_cost:m", "SELECT * FROM case_cost")
def _(t: Tables) -> DataFrame:
    return t.case_cost


C20 = """
SELECT repo, component, COUNT(DISTINCT actor_hash) AS n_actors, COUNT(DISTINCT actor_hash) < {k} AS suppressed, CASE WHEN COUNT(DISTINCT actor_hash) >= {k} THEN SUM(cost) END AS cost, {k} AS k_applied
FROM cost_event JOIN (SELECT work_item_id, repo, component FROM work_item) USING (work_item_id) GROUP BY 1, 2
"""
BY_COMPONENT = "repo:s component:s n_actors:i suppressed:b cost:m k_applied:i"


@query("c20_spend_by_component", BY_COMPONENT, C20.format(k=5))
def _(t: Tables) -> DataFrame:
    return cost.spend_by_component(t.costs, t.items)


@query("c20_spend_by_component_strict", BY_COMPONENT, C20.format(k=118))
def _(t: Tables) -> DataFrame:
    return cost.spend_by_component(t.costs, t.items, Params(k=118))


SPEND = "work_item_id:s repo:s component:s sprint:i author_hours:h review_hours:h cost:m labour_cost:m"


@query("c21_case_spend", SPEND, "SELECT * FROM spend")
def _(t: Tables) -> DataFrame:
    return t.spend


@query("c22_top_spend", SPEND, "SELECT * FROM spend WHERE cost > 0 ORDER BY cost DESC, work_item_id LIMIT 25")
def _(t: Tables) -> DataFrame:
    return cost.top_spend(t.spend, 25)


C22 = """
SELECT *, (labour_cost + ci_cost) / total_cost AS observed_share, labour_cost / total_hours AS blended_hourly FROM (
  SELECT CAST(SUM(labour_cost) AS DOUBLE) AS labour_cost, CAST(SUM(ci_cost) AS DOUBLE) AS ci_cost, CAST(SUM(ai_cost) AS DOUBLE) AS ai_cost, CAST(SUM(meeting_cost) AS DOUBLE) AS meeting_cost, CAST(SUM(total_cost) AS DOUBLE) AS total_cost, SUM(total_hours) AS total_hours FROM case_cost)
"""


@query("c22_spend_summary", "labour_cost:m ci_cost:m ai_cost:m meeting_cost:m total_cost:m total_hours:h observed_share:h blended_hourly:h", C22)
def _(t: Tables) -> DataFrame:
    return cost.spend_summary(t.case_cost)


C23 = """
SELECT repo, component, GROUPING(repo, component) AS level, COUNT(*) AS n_items, SUM(author_hours) AS author_hours, SUM(review_hours) AS review_hours, SUM(cost) AS cost, SUM(labour_cost) AS labour_cost,
  COALESCE(SUM(review_hours) / NULLIF(SUM(author_hours) + SUM(review_hours), 0), 0) AS review_share, COALESCE(CAST(SUM(labour_cost) AS DOUBLE) / NULLIF(SUM(author_hours) + SUM(review_hours), 0), 0) AS blended_rate
FROM spend GROUP BY ROLLUP (repo, component)
"""


@query("c23_spend_rollup", "repo:s component:s level:i n_items:i author_hours:h review_hours:h cost:m labour_cost:m review_share:h blended_rate:m", C23)
def _(t: Tables) -> DataFrame:
    return cost.spend_rollup(t.spend)


C24 = """
SELECT repo, component, cost, COALESCE(waste_types, '') AS waste_types, waste_types IS NOT NULL AS flagged FROM (SELECT repo, component, SUM(cost) AS cost FROM spend GROUP BY 1, 2)
LEFT JOIN (SELECT repo, component, string_agg(waste_type, ',' ORDER BY waste_type) AS waste_types FROM (SELECT DISTINCT repo, COALESCE(component, 'unassigned') AS component, waste_type FROM waste_rows) GROUP BY 1, 2) USING (repo, component)
"""


@query("c24_flagged_spend", "repo:s component:s cost:m waste_types:s flagged:b", C24)
def _(t: Tables) -> DataFrame:
    return cost.flag_spend(t.spend, t.waste)


C25 = """
SELECT *, (w - 4.0) / 4.0 * 100 AS drift_pct, ABS((w - 4.0) / 4.0 * 100) <= 5 AS within_5_pct, w AS hours_per_actor_week FROM (
  SELECT *, attendee_hours / (sprints * 14 / 7.0) / n_actors AS w FROM (
    SELECT SUM(attendee_count * duration_min / 60.0) AS attendee_hours, COUNT(*) AS n_meetings, GREATEST(1, CEIL((epoch_us(MAX(ts)) - epoch_us(MIN(ts))) / (14 * 86400e6))) AS sprints, (SELECT COUNT(*) FROM actor) AS n_actors FROM calendar_event))
"""


@query("c25_meeting_drift", "attendee_hours:h n_meetings:i sprints:i n_actors:i hours_per_actor_week:h drift_pct:h within_5_pct:b", C25)
def _(t: Tables) -> DataFrame:
    return cost.meeting_drift(t.meetings, t.actors)


@query("c25_meeting_sizes", "attendee_count:i n_meetings:i", "SELECT attendee_count, COUNT(*) AS n_meetings FROM calendar_event GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return cost.meeting_sizes(t.meetings)


C26 = """
SELECT * FROM (SELECT actor_hash, work_item_id, ts AS gap_start, LEAD(ts) OVER w AS gap_end, (epoch_us(LEAD(ts) OVER w) - epoch_us(ts)) / 6e7 AS gap_minutes FROM event_log WHERE actor_hash IS NOT NULL WINDOW w AS (PARTITION BY actor_hash ORDER BY ts, event_id))
WHERE gap_minutes >= 90 AND EXTRACT(hour FROM gap_start) >= 9 AND EXTRACT(hour FROM gap_start) < 18
"""


@query("c26_free_gaps", "actor_hash:s work_item_id:s gap_start:t gap_end:t gap_minutes:h", C26)
def _(t: Tables) -> DataFrame:
    return cost.free_gaps(t.events, 90)


UNCITED = Params(ci_per_minute=Decimal("0.5"), ci_citation=DEFAULT.carbon_citation)


@query("c14_uncited_ci", "n:i n_priced:i", "SELECT COUNT(*) AS n, 0 AS n_priced FROM ci_run WHERE work_item_id IS NOT NULL AND runner_minutes > 0")
def _(t: Tables) -> DataFrame:
    return cost.price_ci(t.runs, UNCITED).agg(F.count("*").alias("n"), F.count("cost").alias("n_priced"))
