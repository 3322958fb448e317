"""Queries of waste, forecasts and capacity."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import capacity, process, waste
from ..params import Citation, Params
from .base import Tables, query

W1 = """
SELECT COUNT(*) AS n_pairs, COALESCE(SUM(gap_hours), 0) AS total_hours, SUM(gap_hours * CAST(hourly AS DOUBLE)) AS total_cost, COUNT(*) FILTER (WHERE hourly IS NULL) AS n_unpriced,
  CASE WHEN COUNT(*) > 0 AND COUNT(hourly) = 0 THEN 'no rate for any pair' WHEN COUNT(*) FILTER (WHERE hourly IS NULL) > 0 THEN 'some pairs have no rate' END AS reason
FROM rework LEFT JOIN actor a ON a.actor_hash = redone_by LEFT JOIN rate_card USING (role_band) WHERE gap_hours >= 0
"""


@query("w1_rework_cost", "n_pairs:i total_hours:h total_cost:m n_unpriced:i reason:s", W1)
def _(t: Tables) -> DataFrame:
    return waste.rework_cost(t.pairs, t.actors, t.rates)


@query("w2_latency_findings", "definition:s n:i median_hours:h mean_hours:h total_hours:h", "SELECT definition, COUNT(*) AS n, QUANTILE_CONT(latency_hours, 0.5) AS median_hours, AVG(latency_hours) AS mean_hours, SUM(latency_hours) AS total_hours FROM latency_both WHERE latency_hours >= 0 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return waste.latency_findings(t.latency_both)


W3 = """
SELECT segment, value, COUNT(*) AS n, SUM(backlog_hours) AS total_hours, QUANTILE_CONT(backlog_hours, 0.5) AS median_hours, MAX(backlog_hours) FILTER (WHERE i = round_even(0.9 * (n - 1), 0)) AS p90_hours FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY segment, value ORDER BY backlog_hours) - 1 AS i, COUNT(*) OVER (PARTITION BY segment, value) AS n FROM (
    SELECT 'all' AS segment, 'all' AS value, backlog_hours FROM backlog UNION ALL SELECT 'priority', priority, backlog_hours FROM backlog WHERE priority IS NOT NULL UNION ALL SELECT 'issue_type', issue_type, backlog_hours FROM backlog))
GROUP BY 1, 2
"""


@query("w3_backlog_segments", "segment:s value:s n:i total_hours:h median_hours:h p90_hours:h", W3)
def _(t: Tables) -> DataFrame:
    return waste.backlog_segments(t.backlog)


@query("w4_ci_waste", "run_id:s work_item_id:s repo:s attempt:i conclusion:s runner_minutes:h is_rerun:b is_failure:b", "SELECT * FROM ci_wasted")
def _(t: Tables) -> DataFrame:
    return t.ci_waste


MINUTES = "SELECT SUM(runner_minutes) FILTER (WHERE is_rerun) AS rerun_minutes, SUM(runner_minutes) FILTER (WHERE is_failure) AS failure_minutes, SUM(runner_minutes) AS total_minutes FROM ci_wasted"
PRICED = "rerun_minutes:h failure_minutes:h total_minutes:h hours:h cost:m cost_reason:s carbon_kg:h carbon_reason:s"


@query("w5_ci_waste_priced", PRICED, f"SELECT *, total_minutes / 60 AS hours, ROUND(CAST(total_minutes AS DECIMAL(15,3)) * 0.57126::DECIMAL(10,6), 2) AS cost, NULL AS cost_reason, NULL AS carbon_kg, 'carbon: citation is incomplete' AS carbon_reason FROM ({MINUTES}) AS m")
def _(t: Tables) -> DataFrame:
    return waste.ci_waste_priced(waste.ci_waste_minutes(t.ci_waste))


CITED = Params(grid_kg_per_kwh=Decimal("0.71"), runner_watts=Decimal(150), carbon_citation=Citation("Central Electricity Authority, CO2 baseline database", "https://cea.nic.in/cdm-co2-baseline-database/", "2026-01-31"), ci_citation=Citation())


@query("w5_ci_waste_carbon", PRICED, f"SELECT *, total_minutes / 60 AS hours, NULL AS cost, 'ci rate: citation is incomplete' AS cost_reason, ROUND(total_minutes / 60 * 150 / 1000 * 0.71, 3) AS carbon_kg, NULL AS carbon_reason FROM ({MINUTES}) AS m")
def _(t: Tables) -> DataFrame:
    return waste.ci_waste_priced(waste.ci_waste_minutes(t.ci_waste), CITED)


W6 = """
SELECT component, COUNT(*) AS n_actors, SUM(n) AS activity, COUNT(*) < 5 AS suppressed, CASE WHEN COUNT(*) >= 5 THEN MAX(n) / SUM(n) END AS top_share
FROM (SELECT component, actor_hash, COUNT(*) AS n FROM event_log JOIN work_item USING (work_item_id) WHERE actor_hash IS NOT NULL AND component IS NOT NULL AND activity IN ('merged', 'review', 'approved', 'changes_requested') GROUP BY 1, 2) GROUP BY 1
"""


@query("w6_key_person", "component:s n_actors:i activity:i suppressed:b top_share:h", W6)
def _(t: Tables) -> DataFrame:
    return waste.key_person(t.events, t.items)


@query("w7_waste_by_project", "waste_type:s repo:s component:s n_items:i hours:h cost:m", "SELECT * FROM waste_rows")
def _(t: Tables) -> DataFrame:
    return t.waste


W8 = f"""
SELECT *, ROW_NUMBER() OVER (ORDER BY cost DESC NULLS LAST, detector) AS position FROM (
  SELECT 'rework' AS detector, total_hours AS hours, total_cost AS cost FROM ({W1}) AS r UNION ALL SELECT 'ci_waste', total_minutes / 60, CAST(ROUND(CAST(total_minutes AS DECIMAL(15,3)) * 0.57126::DECIMAL(10,6), 2) AS DOUBLE) FROM ({MINUTES}) AS m
  UNION ALL SELECT 'backlog_time', COALESCE(SUM(backlog_hours), 0), NULL FROM backlog)
"""


@query("w8_waste_summary", "detector:s hours:h cost:m position:i", W8)
def _(t: Tables) -> DataFrame:
    return waste.waste_summary(waste.rework_cost(t.pairs, t.actors, t.rates), waste.ci_waste_priced(waste.ci_waste_minutes(t.ci_waste)), t.backlog)


W9 = """
SELECT waste_type, n_rows, amount, CASE WHEN priced AND SUM(amount) OVER () > 0 THEN amount / SUM(amount) OVER () ELSE 0 END AS share, true AS recoverable, priced, CASE WHEN priced THEN sum_hours ELSE mid_hours END AS hours FROM (
  SELECT waste_type, COUNT(*) AS n_rows, CAST(COALESCE(SUM(cost), 0) AS DOUBLE) AS amount, COUNT(cost) = COUNT(*) AS priced, SUM(COALESCE(hours, 0)) AS sum_hours, QUANTILE_CONT(COALESCE(hours, 0), 0.5) AS mid_hours FROM waste_rows GROUP BY 1)
"""


@query("w9_waste_categories", "waste_type:s n_rows:i amount:m share:h recoverable:b priced:b hours:h", W9)
def _(t: Tables) -> DataFrame:
    return waste.waste_categories(t.waste)


W10 = """
SELECT repo, COALESCE(SUM(amount) FILTER (WHERE waste_type <> 'latency'), 0) AS recoverable, COALESCE(SUM(amount) FILTER (WHERE waste_type = 'latency'), 0) AS exposure, ARG_MAX(line, (amount, line)) AS largest_line,
  ARG_MAX(line, (ROUND(hours, 6), line)) FILTER (WHERE n_items >= 5) AS slowest_line
FROM (SELECT *, CAST(COALESCE(cost, 0) AS DOUBLE) AS amount, waste_type || '/' || COALESCE(component, '-') AS line FROM waste_rows) GROUP BY 1
"""


@query("w10_waste_rollup", "repo:s recoverable:m exposure:m largest_line:s slowest_line:s", W10)
def _(t: Tables) -> DataFrame:
    return waste.waste_rollup(t.waste, exposure=("latency",))


F1 = """
SELECT o.repo, o.component, basis, CASE basis WHEN 'component' THEN o.a WHEN 'repo' THEN r.a ELSE g.a END AS p10_hours, CASE basis WHEN 'component' THEN o.b WHEN 'repo' THEN r.b ELSE g.b END AS p50_hours,
  CASE basis WHEN 'component' THEN o.c WHEN 'repo' THEN r.c ELSE g.c END AS p90_hours, CASE basis WHEN 'component' THEN o.n WHEN 'repo' THEN r.n ELSE g.n END AS n_samples, CASE basis WHEN 'component' THEN o.x WHEN 'repo' THEN r.x ELSE g.x END AS n_excluded
FROM (SELECT *, CASE WHEN n >= {least} AND component IS NOT NULL THEN 'component' WHEN rn >= {least} THEN 'repo' ELSE 'global' END AS basis FROM (SELECT repo, component, {facts} FROM cycle GROUP BY 1, 2) JOIN (SELECT repo, COUNT(*) FILTER (WHERE cycle_hours <= {top}) AS rn FROM cycle GROUP BY 1) USING (repo)) o
JOIN (SELECT repo, {facts} FROM cycle GROUP BY 1) r USING (repo), (SELECT {facts} FROM cycle) g
"""


def f1(least: int, top: float) -> str:
    keep = f"FILTER (WHERE cycle_hours <= {top})"
    facts = ", ".join(f"QUANTILE_CONT(cycle_hours, {q}) {keep} AS {n}" for q, n in ((0.1, "a"), (0.5, "b"), (0.9, "c"))) + f", COUNT(*) {keep} AS n, COUNT(*) FILTER (WHERE cycle_hours > {top}) AS x"
    return F1.format(least=least, top=top, facts=facts)


FORECAST = "repo:s component:s basis:s p10_hours:h p50_hours:h p90_hours:h n_samples:i n_excluded:i"


@query("f1_forecast_cycle_time", FORECAST, f1(20, 2160.0))
def _(t: Tables) -> DataFrame:
    return capacity.forecast_cycle_time(process.cycle_time(t.events, t.items))


@query("f1_forecast_short_tail", FORECAST, f1(30, 8.0))
def _(t: Tables) -> DataFrame:
    return capacity.forecast_cycle_time(process.cycle_time(t.events, t.items), Params(min_group_samples=30, max_cycle_hours=8.0))


CAPACITY = "repo:s component:s n_engineers:i total_items:i closed_items:i open_items:i span_weeks:h items_per_week:h throughput_cv:h suppressed:b cost:m hours:h"


@query("f2_component_capacity", CAPACITY, "SELECT * FROM capacity")
def _(t: Tables) -> DataFrame:
    return capacity.component_capacity(t.items, t.events, t.costs)


@query(
    "f3_rankable_components",
    "position:i repo:s component:s n_engineers:i open_items:i items_per_week:h throughput_cv:h cost:m span_weeks:h",
    "SELECT *, ROW_NUMBER() OVER (ORDER BY cost DESC NULLS LAST, n_engineers DESC, repo, component) AS position FROM capacity WHERE n_engineers > 0 AND closed_items > 0",
)
def _(t: Tables) -> DataFrame:
    return capacity.rankable_components(capacity.component_capacity(t.items, t.events, t.costs))


F4 = """
SELECT component, COUNT(*) AS n_actors, CASE WHEN COUNT(*) >= 5 THEN MIN(s) END AS least, CASE WHEN COUNT(*) >= 5 THEN AVG(s) END AS mean, CASE WHEN COUNT(*) >= 5 THEN MAX(s) END AS most FROM (
  SELECT component, CASE WHEN m = 0 AND r = 0 THEN 1.0 ELSE GREATEST(0.5, LEAST(1.5, (0.6 * COALESCE(m / NULLIF(SUM(m) OVER w, 0), 1 / COUNT(*) OVER w) + 0.4 * COALESCE(r / NULLIF(SUM(r) OVER w, 0), 1 / COUNT(*) OVER w)) * COUNT(*) OVER w)) END AS s FROM (
    SELECT component, actor_hash, COUNT(*) FILTER (WHERE activity = 'merged') AS m, COUNT(*) FILTER (WHERE activity IN ('review', 'approved', 'changes_requested')) AS r FROM event_log JOIN work_item USING (work_item_id) WHERE actor_hash IS NOT NULL AND component IS NOT NULL GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY component)) GROUP BY 1
"""


@query("f4_capability", "component:s n_actors:i least:h mean:h most:h", F4)
def _(t: Tables) -> DataFrame:
    return capacity.capability_spread(capacity.capability(capacity.actor_component_activity(t.events, t.items)))


F5 = """
SELECT source_repo, source_component, dest_repo, dest_component, n, refusal, CASE WHEN refusal IS NULL THEN ROUND(sa - sb, 2) END AS source_delta_weeks, CASE WHEN refusal IS NULL THEN ROUND(da - db, 2) END AS dest_delta_weeks,
  CASE WHEN refusal IS NULL AND priced0 THEN ROUND((sa - sb) * sburn + (da - db) * dburn, 2) END AS net_cost, CASE WHEN refusal IS NULL THEN ROUND(50 - spread / 2, 1) END AS confidence_low, CASE WHEN refusal IS NULL THEN ROUND(50 + spread / 2, 1) END AS confidence_high,
  refusal IS NULL AND priced0 AS priced FROM (
  SELECT *, d_open / (d_rate * (d_n + n * blend) / d_n) AS da FROM (
    SELECT s.repo AS source_repo, s.component AS source_component, d.repo AS dest_repo, d.component AS dest_component, n, d.open_items AS d_open, d.items_per_week AS d_rate, d.n_engineers AS d_n,
      CASE WHEN s.repo = d.repo AND s.component = d.component THEN 'same component' WHEN n >= s.n_engineers THEN 'would empty the source' WHEN s.items_per_week <= 1e-9 OR d.items_per_week <= 1e-9 THEN 'no observed delivery rate' END AS refusal,
      s.open_items / s.items_per_week AS sb, s.open_items / (s.items_per_week * (s.n_engineers - n) / s.n_engineers) AS sa, d.open_items / d.items_per_week AS db,
      CASE WHEN GREATEST(d.open_items / d.items_per_week, 1.0) <= 6 THEN 0.5 ELSE (0.5 * 6 + (GREATEST(d.open_items / d.items_per_week, 1.0) - 6)) / GREATEST(d.open_items / d.items_per_week, 1.0) END AS blend,
      GREATEST(12.0, LEAST(55.0, SQRT(POW(s.throughput_cv, 2) + POW(d.throughput_cv, 2)) * 35.0)) AS spread, CAST(s.cost AS DOUBLE) / GREATEST(s.span_weeks, 1.0) AS sburn, CAST(d.cost AS DOUBLE) / GREATEST(d.span_weeks, 1.0) AS dburn,
      s.cost IS NOT NULL AND d.cost IS NOT NULL AS priced0
    FROM capacity s, capacity d, (SELECT unnest([1, 2, 3]) AS n) WHERE s.n_engineers > 0 AND s.closed_items > 0 AND d.n_engineers > 0 AND d.closed_items > 0))
"""
GRID = "source_repo:s source_component:s dest_repo:s dest_component:s n:i refusal:s source_delta_weeks:m dest_delta_weeks:m net_cost:m confidence_low:m confidence_high:m priced:b"


def grid(t: Tables) -> DataFrame:
    return capacity.reallocation_grid(capacity.component_capacity(t.items, t.events, t.costs))


@query("f5_reallocation_grid", GRID, F5)
def _(t: Tables) -> DataFrame:
    return grid(t)


@query("f6_weekly_delivery", "repo:s component:s week:s delivered:i", "SELECT repo, component, CAST(week AS VARCHAR) AS week, delivered FROM weekly")
def _(t: Tables) -> DataFrame:
    return capacity.weekly_delivery(t.log).withColumn("week", F.col("week").cast("string"))


F7 = """
WITH_WEEKS weeks AS (SELECT week, ROW_NUMBER() OVER (ORDER BY week) - 1 AS i, COUNT(*) OVER () - 1 AS n_weeks FROM (SELECT DISTINCT week FROM weekly)),
spine AS (SELECT *, n_weeks - (fold + 1) * 1 AS start FROM weeks, (SELECT unnest([0, 1, 2]) AS fold) WHERE i < n_weeks),
filled AS (SELECT p.repo, p.component, s.fold, s.start, s.i, COALESCE(w.delivered, 0) AS d FROM (SELECT DISTINCT repo, component FROM weekly) p, spine s LEFT JOIN weekly w ON w.repo = p.repo AND w.component = p.component AND w.week = s.week WHERE s.start > 1 AND s.i < s.start + 1),
scored AS (SELECT fold, repo, component, start AS train_weeks, SUM(d) FILTER (WHERE i < start) / start AS rate_per_week, SUM(d) FILTER (WHERE i < start) / start * 1 AS predicted, COALESCE(SUM(d) FILTER (WHERE i >= start), 0) AS actual,
  GREATEST(12.0, LEAST(55.0, COALESCE(STDDEV_POP(d) FILTER (WHERE i < start) / NULLIF(SUM(d) FILTER (WHERE i < start) / start, 0), 0) * 35.0)) / 100 AS s FROM filled GROUP BY fold, repo, component, start HAVING SUM(d) FILTER (WHERE i < start) >= 10),
observed AS (SELECT *, predicted * (1 - s) AS p10, predicted * (1 + s) AS p90 FROM scored)
"""


def with_weeks(tail: str) -> str:
    """The prelude's list of tables can only be extended in the query itself, so the tables above become nested ones."""
    return "WITH" + F7.replace("WITH_WEEKS", "") + tail


@query("f7_backtest", "fold:i repo:s component:s train_weeks:i rate_per_week:h predicted:h actual:i p10:h p90:h", with_weeks("SELECT * FROM observed"))
def _(t: Tables) -> DataFrame:
    return capacity.backtest(capacity.weekly_delivery(t.log), horizon=1, folds=3)


F8 = """
SELECT COUNT(*) AS n, AVG(ABS(predicted - actual)) AS mae, AVG(ABS(mp - actual)) AS baseline_mae, AVG(ABS(predicted - actual) / actual * 100) FILTER (WHERE actual >= 3) AS mape, COUNT(*) FILTER (WHERE actual >= 3) AS n_scored_pct,
  AVG(predicted - actual) AS bias, COUNT(*) FILTER (WHERE predicted < actual) AS under_predicted, AVG(CASE WHEN p10 <= actual AND actual <= p90 THEN 1.0 ELSE 0.0 END) AS band_coverage FROM observed, (SELECT AVG(predicted) AS mp FROM observed)
"""


@query("f8_backtest_report", "n:i mae:h baseline_mae:h mape:h n_scored_pct:i bias:h under_predicted:i band_coverage:h", with_weeks(F8))
def _(t: Tables) -> DataFrame:
    return capacity.backtest_report(capacity.backtest(capacity.weekly_delivery(t.log), horizon=1, folds=3))


F9 = f"""
SELECT *, CASE WHEN certainty > 0.55 THEN 'narrow' WHEN certainty > 0.35 THEN 'moderate' WHEN certainty IS NOT NULL THEN 'wide' END AS verdict FROM (
  SELECT *, CASE WHEN confidence_high IS NOT NULL THEN GREATEST(0.0, LEAST(1.0, 1 - (confidence_high - confidence_low) / 60)) ELSE 0 END AS certainty FROM ({F5}) AS g) WHERE refusal IS NULL
"""


@query("f9_band_verdict", "source_repo:s source_component:s dest_repo:s dest_component:s n:i certainty:h verdict:s", F9)
def _(t: Tables) -> DataFrame:
    return capacity.band_verdict(grid(t)).where("refusal is null")
