"""Queries of staffing. The SQL builds the same people and openings from `customer` and `nation`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import capacity, staffing
from ..sources import sample_people as sample
from .base import Tables, query
from .waste_queries import F5


def lst(values: tuple[str, ...], i: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][CAST(({i}) % {len(values)} AS INTEGER) + 1]"


def norm(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"


PEOPLE = f"""
profile AS (SELECT c_custkey AS i, 'emp-' || c_custkey AS employee_id, c_name AS name, [{lst(sample.SKILLS, 'c_custkey')}, {lst(sample.SKILLS, 'c_custkey * 3 + 1')}] AS skills, 'Rebuilt ' || {lst(sample.SKILLS, 'c_custkey * 5')} || ' years of ' || {lst(sample.SKILLS, 'c_custkey + 2')} AS corpus,
  c_custkey % 13 AS years, {lst(sample.NAMES, 'c_custkey')} AS familiar, 'L' || (c_custkey % 4) AS home, 'L' || ((c_custkey + 1) % 4) AS wish, c_custkey % 3 <> 0 AS moves, 'org/r' || (c_custkey % 2) || '/' || {lst(sample.NAMES, 'c_custkey')} AS asked FROM customer),
preference AS (SELECT c_custkey AS i, {lst(sample.SHIFTS, 'c_custkey')} AS shift, {lst(sample.AREAS, 'c_custkey')} AS area, list_filter([CASE WHEN c_custkey % 4 <> 0 THEN 'mon' END, CASE WHEN (c_custkey + 1) % 4 <> 0 THEN 'tue' END, CASE WHEN (c_custkey + 2) % 4 <> 0 THEN 'wed' END, CASE WHEN (c_custkey + 3) % 4 <> 0 THEN 'thu' END, CASE WHEN (c_custkey + 4) % 4 <> 0 THEN 'fri' END], lambda x: x IS NOT NULL) AS days, c_custkey % 5 <> 0 AS other_teams, c_custkey % 11 AS submitted_at FROM customer WHERE c_custkey % 7 <> 0),
opening AS (SELECT 'open-' || n_nationkey AS opening_id, 'org/r' || (n_nationkey % 2) AS repo, {lst(sample.NAMES, 'n_nationkey')} AS component, 'L' || (n_nationkey % 4) AS place, n_nationkey % 6 = 5 AS stated, {lst((*sample.SHIFTS, 'night'), 'n_nationkey')} AS s, n_nationkey % 3 = 0 AS part FROM nation),
required AS (SELECT opening_id, repo, component, place,
  CASE WHEN stated THEN ['SQL', 'java'] ELSE list_concat(CASE component WHEN 'streams-core' THEN ['Scala', 'Consensus'] WHEN 'stream-lib' THEN ['Java', 'Distributed Systems'] WHEN 'table-api' THEN ['sql'] WHEN 'tools' THEN ['CI/CD'] WHEN 'docs' THEN ['Python'] ELSE [] END,
    list_filter(CASE repo WHEN 'org/r0' THEN ['Java', 'Scala'] ELSE ['Python'] END, lambda x: NOT list_contains(CASE component WHEN 'streams-core' THEN ['Scala', 'Consensus'] WHEN 'stream-lib' THEN ['Java', 'Distributed Systems'] WHEN 'docs' THEN ['Python'] ELSE [] END, x))) END AS skills,
  CASE component WHEN 'streams-core' THEN ['backend', 'data'] WHEN 'stream-lib' THEN ['backend'] WHEN 'table-api' THEN ['data'] WHEN 'tools' THEN ['devops'] ELSE [] END AS areas,
  CASE WHEN s = 'night' THEN 'flexible' ELSE s END AS shift, CASE WHEN part THEN ['mon', 'thu'] ELSE ['mon', 'tue', 'wed', 'thu', 'fri'] END AS days, NOT stated AND component IN ('unassigned', 'web') AS thin FROM opening),
pairs AS (SELECT p.*, r.opening_id, r.component AS target, r.skills AS need, r.areas, r.shift AS wanted, r.days AS need_days, q.shift AS has_shift, q.area, q.days AS has_days, q.other_teams, r.place, r.repo || '/' || r.component AS key,
  len(list_filter(r.skills, lambda s: list_contains(list_transform(p.skills, lambda x: {norm('x')}), {norm('s')}))) AS matched, len(list_filter(r.skills, lambda s: contains({norm('p.corpus')}, {norm('s')}))) AS topical,
  len(list_filter(p.skills, lambda s: list_contains(list_transform(r.skills, lambda x: {norm('x')}), {norm('s')}))) AS offered, len(list_filter(r.days, lambda d: list_contains(q.days, d))) AS shared_days FROM profile p JOIN preference q USING (i), required r),
subs AS (SELECT *, CASE WHEN has_shift = wanted THEN 1.0 WHEN has_shift = 'flexible' OR wanted = 'flexible' THEN 0.85 ELSE 0.0 END AS fits FROM pairs),
parts AS (SELECT *, CASE WHEN len(need) > 0 THEN matched / len(need) ELSE 0 END AS a, 0.5 * LEAST(1.0, years / 6.0) + 0.5 * CASE WHEN len(need) > 0 THEN topical / len(need) ELSE 0 END AS b, CASE WHEN len(areas) > 0 THEN 0.6 * CASE WHEN list_contains(areas, area) THEN 1.0 ELSE 0.0 END + 0.4 * fits ELSE fits END AS c,
  shared_days / len(need_days) AS d, CASE WHEN {norm('familiar')} = {norm('target')} THEN 1.0 WHEN contains({norm('target')}, {norm('familiar')}) OR contains({norm('familiar')}, {norm('target')}) THEN 0.5 ELSE 0.0 END AS e,
  CASE WHEN NOT other_teams THEN 'not open to other teams' WHEN shared_days = 0 THEN 'available on none of the days' WHEN len(need) > 0 AND matched = 0 THEN 'none of the skills' END AS reason FROM subs),
scored AS (SELECT *, ROUND(pa + pb + pc + pd + pe, 4) AS score FROM (SELECT *, ROUND(0.35 * a, 4) AS pa, ROUND(0.25 * b, 4) AS pb, ROUND(0.20 * c, 4) AS pc, ROUND(0.10 * d, 4) AS pd, ROUND(0.10 * e, 4) AS pe FROM parts))
"""


def sql(tail: str) -> str:
    return "WITH " + PEOPLE + tail


def people(t: Tables) -> DataFrame:
    return staffing.candidates(sample.profiles(t.spark, t.sf_dir), sample.preferences(t.spark, t.sf_dir))


def required(t: Tables) -> DataFrame:
    return staffing.requirements(sample.openings(t.spark, t.sf_dir), sample.taxonomy(t.spark), sample.languages(t.spark))


def scores(t: Tables) -> DataFrame:
    return staffing.fit_scores(people(t), required(t))


@query("g1_nameable", "employee_id:s name:s preferred_shift:s", sql("SELECT employee_id, name, shift AS preferred_shift FROM profile JOIN preference USING (i)"), prelude=False)
def _(t: Tables) -> DataFrame:
    return staffing.nameable(sample.profiles(t.spark, t.sf_dir), sample.preferences(t.spark, t.sf_dir))


@query("g1_anonymous", "n_anonymous:i", "SELECT COUNT(*) AS n_anonymous FROM customer WHERE c_custkey % 7 = 0", prelude=False)
def _(t: Tables) -> DataFrame:
    return staffing.anonymous_count(sample.profiles(t.spark, t.sf_dir), sample.preferences(t.spark, t.sf_dir))


@query("g2_requirements", "opening_id:s skills:s areas:s shift:s days:s thin:b", sql("SELECT opening_id, array_to_string(skills, ',') AS skills, array_to_string(areas, ',') AS areas, shift, array_to_string(days, ',') AS days, thin FROM required"), prelude=False)
def _(t: Tables) -> DataFrame:
    return required(t).select("opening_id", F.array_join("required_skills", ",").alias("skills"), F.array_join("work_areas", ",").alias("areas"), "shift", F.array_join("availability", ",").alias("days"), "thin")


@query("g3_fit_scores", "opening_id:s employee_id:s part_skill:h part_experience:h part_preference:h part_availability:h part_familiarity:h score:h", sql("SELECT opening_id, employee_id, pa AS part_skill, pb AS part_experience, pc AS part_preference, pd AS part_availability, pe AS part_familiarity, score FROM scored"), prelude=False)
def _(t: Tables) -> DataFrame:
    return scores(t)


@query("g4_excluded", "opening_id:s employee_id:s excluded_reason:s", sql("SELECT opening_id, employee_id, reason AS excluded_reason FROM scored WHERE reason IS NOT NULL"), prelude=False)
def _(t: Tables) -> DataFrame:
    return staffing.excluded(scores(t))


@query("g5_ranking", "opening_id:s position:i employee_id:s score:h role:s", sql("SELECT opening_id, position, employee_id, score, CASE WHEN position <= 3 THEN 'chosen' ELSE 'alternate' END AS role FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY opening_id ORDER BY score DESC, employee_id) AS position FROM scored WHERE reason IS NULL) WHERE position <= 6"), prelude=False)
def _(t: Tables) -> DataFrame:
    return staffing.best_candidates(people(t), required(t), 3)


G6 = """, terms AS (SELECT opening_id, employee_id, CAST(ROUND(score * 100, 0) AS INTEGER) AS headline, unnest([0, 1, 2, 3, 4]) AS i, unnest(['skill', 'experience', 'preference', 'availability', 'familiarity']) AS term, ROUND(unnest([pa, pb, pc, pd, pe]) * 100, 6) AS exact FROM scored WHERE reason IS NULL)
SELECT opening_id, employee_id, term, FLOOR(exact) + CASE WHEN ROW_NUMBER() OVER (PARTITION BY opening_id, employee_id ORDER BY exact - FLOOR(exact) DESC, i) <= headline - SUM(FLOOR(exact)) OVER (PARTITION BY opening_id, employee_id) THEN 1 ELSE 0 END AS points, headline FROM terms"""


@query("g6_fit_points", "opening_id:s employee_id:s term:s points:i headline:i", sql(G6), prelude=False)
def _(t: Tables) -> DataFrame:
    return staffing.fit_points(staffing.eligible(scores(t)))


G7 = """
SELECT employee_id, opening_id, fit, relocation_required, fit >= 50 AS shown FROM (
  SELECT employee_id, opening_id, LEAST(100, LEAST(45, offered * 18) + CASE WHEN asked = key THEN 15 ELSE 0 END + CASE WHEN home = place THEN 15 WHEN moves AND wish = place THEN 12 WHEN moves THEN 4 ELSE 0 END + CASE WHEN fits > 0 THEN 13 ELSE 0 END + CASE WHEN shared_days = len(need_days) THEN 12 WHEN shared_days > 0 THEN 6 ELSE 0 END) AS fit, home <> place AS relocation_required FROM subs)
"""


@query("g7_opportunities", "employee_id:s opening_id:s fit:i relocation_required:b shown:b", sql(G7), prelude=False)
def _(t: Tables) -> DataFrame:
    return staffing.opportunities(people(t), required(t))


@query("g8_saved_preferences", "employee_id:s preferred_shift:s submitted_at:i", sql("SELECT 'emp-' || i AS employee_id, CASE WHEN i % 2 = 0 AND submitted_at <= 5 THEN 'new' ELSE shift END AS preferred_shift, CASE WHEN i % 2 = 0 THEN GREATEST(submitted_at, 5) ELSE submitted_at END AS submitted_at FROM preference"), prelude=False)
def _(t: Tables) -> DataFrame:
    stated = sample.preferences(t.spark, t.sf_dir)
    number = F.split_part("employee_id", F.lit("-"), F.lit(2)).cast("bigint")
    new = stated.where(number % 2 == 0).withColumns({"preferred_shift": F.lit("new"), "submitted_at": F.lit(5).cast("bigint")})
    strangers = new.limit(3).withColumn("employee_id", F.concat(F.lit("x"), "employee_id"))
    return staffing.save_preferences(stated, new.unionByName(strangers), sample.profiles(t.spark, t.sf_dir))


F10 = f"""
SELECT employee_id, opening_id, feasibility, total_cost, -total_cost AS net_benefit, CASE WHEN feasibility = 'not-opted-in' OR -total_cost <= 0 THEN 'do-not-proceed' ELSE 'proceed' END AS verdict, CASE WHEN dest_delta_weeks < 0 THEN 'improved' ELSE 'delayed' END AS dest_outcome, CASE WHEN source_delta_weeks > 0 THEN 'delayed' ELSE 'improved' END AS source_outcome, priced FROM (
  SELECT *, ROUND(COALESCE(net_cost, 0) + CASE WHEN feasibility <> 'not-required' THEN 35000.0 ELSE 0 END + 100000, 2) AS total_cost FROM (
    SELECT p.employee_id, o.opening_id, g.*, CASE WHEN home = place THEN 'not-required' WHEN NOT moves THEN 'not-opted-in' WHEN wish = place THEN 'preferred' ELSE 'acceptable' END AS feasibility
    FROM (SELECT 'emp-' || c_custkey AS employee_id, 'org/r' || (c_custkey % 2) AS repo, 'c' || (c_custkey % 10) AS component, 'L' || (c_custkey % 4) AS home, 'L' || ((c_custkey + 1) % 4) AS wish, c_custkey % 3 <> 0 AS moves FROM customer) p
    JOIN ({F5}) AS g ON g.source_repo = p.repo AND g.source_component = p.component AND g.n = 1 AND g.refusal IS NULL
    JOIN (SELECT 'open-' || n_nationkey AS opening_id, 'org/r' || (n_nationkey % 2) AS repo, 'c' || (n_nationkey % 10) AS component, 'L' || (n_nationkey % 4) AS place FROM nation) o ON o.repo = g.dest_repo AND o.component = g.dest_component))
"""


@query("f10_net_impact", "employee_id:s opening_id:s feasibility:s total_cost:m net_benefit:m verdict:s dest_outcome:s source_outcome:s priced:b", F10)
def _(t: Tables) -> DataFrame:
    grid = capacity.reallocation_grid(capacity.component_capacity(t.items, t.events, t.costs))
    number = F.split_part("opening_id", F.lit("-"), F.lit(2)).cast("int")
    openings = sample.openings(t.spark, t.sf_dir).withColumn("component", F.concat(F.lit("c"), number % 10))
    return capacity.net_impact(sample.profiles(t.spark, t.sf_dir), openings, grid, package=20_000.0, housing=10_000.0, travel=5_000.0, extra_weeks=1.0, hourly=2_500.0)
