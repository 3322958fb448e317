"""From hours to money: actor bands, cited rates, pricing of sessions, CI, meetings and tokens, and roll-ups.

Money is decimal inside the operators. What has no cited or known price is null with a reason, never 0.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import count_if, floored, is_in, micros, minutes_between, sum_if, suppressed
from ..params import BANDS, DEFAULT, REVIEWS, Citation, Params

MONEY = "decimal(18,2)"


def cited(value: Decimal | None, citation: Citation, name: str) -> tuple[Column, Column]:
    """The figure and a null reason, or null and why it cannot be used."""
    if not citation.complete:
        return F.lit(None).cast("decimal(18,6)"), F.lit(f"{name}: citation is incomplete")
    if value is None:
        return F.lit(None).cast("decimal(18,6)"), F.lit(f"{name}: not set")
    return F.lit(value).cast("decimal(18,6)"), F.lit(None).cast("string")


def rate_card(spark: SparkSession, p: Params = DEFAULT) -> DataFrame:
    """role_band, hourly, currency, loading, reason. Without a citation hourly is null; figures must rise with the band."""
    if list(p.annual) != sorted(p.annual) or p.annual[0] <= 0 or p.loading <= 0 or p.working_days <= 0 or p.hours_per_day <= 0:
        raise ValueError("annual figures must be positive and ascending, loading, days and hours positive")
    bands = spark.createDataFrame([(b, a) for b, a in zip(BANDS, p.annual)], "role_band string, annual decimal(18,2)")
    hourly = F.round(F.col("annual") * F.lit(p.loading).cast("decimal(6,2)") / F.lit(p.working_days * p.hours_per_day), 2).cast(MONEY)
    ok = p.rate_citation.complete
    return bands.select("role_band", (hourly if ok else F.lit(None).cast(MONEY)).alias("hourly"), F.lit(p.currency).alias("currency"), F.lit(p.loading).cast("decimal(6,2)").alias("loading"), F.lit(None if ok else "rate card: citation is incomplete").cast("string").alias("reason"))


def actor_features(actors: DataFrame, events: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Tenure, reviews, authored and performed merges, events and tracker presence of every actor, zero where there are none."""
    own = events.where("actor_hash is not null").groupBy("actor_hash").agg(
        ((micros(F.max("ts")) - micros(F.min("ts"))) / 1e6 / p.seconds_per_month).alias("tenure_months"),
        count_if(is_in("activity", REVIEWS)).alias("reviews"),
        count_if(F.col("activity") == "merged").alias("merges_performed"),
        F.count("*").alias("n_events"),
        F.bool_or(F.coalesce(F.col("attrs.ingest_source"), F.lit("git_local")) == "asf_jira").alias("seen_in_tracker"),
    )
    authored = events.where("activity = 'merged' and attrs.authored_by is not null").groupBy(F.col("attrs.authored_by").alias("actor_hash")).agg(F.countDistinct("work_item_id").alias("merged"))
    out = actors.select("actor_hash").join(own, "actor_hash", "left").join(authored, "actor_hash", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("reviews", "merged", "merges_performed", "n_events")}
    return out.withColumns(zero | {"tenure_months": F.coalesce("tenure_months", F.lit(0.0)), "seen_in_tracker": F.coalesce("seen_in_tracker", F.lit(False))})


def assign_band(features: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The most senior band all of whose floors are met, else junior; and the bucket of tenure."""
    chain = None
    for band, floors in p.band_floors:
        met = F.lit(True)
        for name, floor in floors:
            met = met & (F.col(name) >= floor)
        chain = F.when(met, band) if chain is None else chain.when(met, band)
    months = F.col("tenure_months")
    bucket = F.when(months >= 24, "gt_2y").when(months >= 6, "6m_2y").otherwise("lt_6m")
    return features.withColumns({"role_band": chain.otherwise("junior") if chain is not None else F.lit("junior"), "tenure_bucket": bucket, "band_basis": F.lit("inferred")})


def band_distribution(banded: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Actors and share by band against the target; a band without actors is shown with 0."""
    target = banded.sparkSession.createDataFrame([(b, float(t)) for b, t in p.band_targets], "role_band string, target_pct double")
    counts = banded.groupBy("role_band").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(F.lit(0))
    joined = F.broadcast(target).join(counts, "role_band", "full_outer").withColumns({"n": F.coalesce("n", F.lit(0)), "target_pct": F.coalesce("target_pct", F.lit(0.0))})
    share = 100.0 * F.col("n") / F.nullif(F.sum("n").over(whole), F.lit(0))
    return joined.select("role_band", "n", F.coalesce(share, F.lit(0.0)).alias("share_pct"), "target_pct").withColumn("gap_pct", F.col("share_pct") - F.col("target_pct"))


def threshold_sweep(features: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """How many actors would clear each candidate value; one pass over the features."""
    cells = [(name, float(v)) for name, values in p.threshold_sweep for v in values]
    row = features.agg(*[count_if(F.col(name) >= v).alias(f"_{i}") for i, (name, v) in enumerate(cells)])
    table = F.array(*[F.struct(F.lit(name).alias("feature"), F.lit(v).alias("threshold"), F.col(f"_{i}").alias("n_clearing")) for i, (name, v) in enumerate(cells)])
    return row.select(F.explode(table).alias("x")).select("x.*")


def tenure_bias(features: DataFrame) -> DataFrame:
    """C11: whether actors seen in the tracker show more tenure than others, and how many have no events at all."""
    grouped = features.groupBy("seen_in_tracker").agg(F.count("*").alias("n"), count_if(F.col("tenure_months") >= 24).alias("n_24_months"), count_if(F.col("n_events") == 0).alias("n_silent"))
    return grouped.withColumn("share_pct", 100.0 * F.col("n_24_months") / F.greatest("n", F.lit(1)))


def _rated(people: DataFrame, actors: DataFrame, rates: DataFrame, how: str = "inner") -> DataFrame:
    known = actors.select("actor_hash", "role_band").join(F.broadcast(rates.select("role_band", "hourly")), "role_band", "left")
    return people.join(known, "actor_hash", how)


def cost_row(prefix: str, key: str, basis: str, **columns: Column) -> list[Column]:
    """The columns of a cost event, null where not given."""
    kinds = {"actor_hash": "string", "hours": "double", "rate_band": "decimal(18,6)", "cost": MONEY}
    rest = [columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]
    return [F.concat(F.lit(prefix), F.col(key)).alias("cost_event_id"), F.col("work_item_id"), *rest, F.lit(basis).alias("basis")]


def price_sessions(sessions: DataFrame, actors: DataFrame, rates: DataFrame) -> DataFrame:
    """Hours times the actor's hourly rate; sessions without a rate are not priced."""
    priced = _rated(sessions, actors, rates).where("hourly is not null")
    cost = F.round(F.col("hours").cast("decimal(18,4)") * F.col("hourly"), 2)
    return priced.select(*cost_row("sess:", "session_id", "session_inferred", actor_hash=F.col("actor_hash"), hours=F.col("hours"), rate_band=F.col("hourly"), cost=cost))


def unpriced_sessions(sessions: DataFrame, actors: DataFrame, rates: DataFrame) -> DataFrame:
    """Sessions of known actors left without a price, and their hours."""
    return _rated(sessions, actors, rates).where("hourly is null").agg(F.count("*").alias("n_unpriced"), F.coalesce(F.sum("hours"), F.lit(0.0)).alias("unpriced_hours"))


def price_ci(runs: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """C14: runner minutes of attributed runs times the cited rate; machine time has neither hours nor an actor."""
    rate, _ = cited(p.ci_per_minute, p.ci_citation, "ci rate")
    paid = runs.where("work_item_id is not null and runner_minutes > 0")
    return paid.select(*cost_row("ci:", "run_id", "ci_runner", cost=F.round(F.col("runner_minutes").cast("decimal(18,3)") * rate, 2)))


def blended_rate(actors: DataFrame, rates: DataFrame) -> DataFrame:
    """The mean hourly rate over all actors with one, as one row; 0 if there are none."""
    known = actors.join(F.broadcast(rates), "role_band").where("hourly is not null")
    return known.agg(F.coalesce(F.sum("hourly") / F.nullif(F.count("*"), F.lit(0)), F.lit(0)).cast("decimal(18,6)").alias("blended"))


def price_meetings(meetings: DataFrame, actors: DataFrame, rates: DataFrame) -> DataFrame:
    """Attendee hours of meetings on a case times the blended rate."""
    held = meetings.where("work_item_id is not null").crossJoin(F.broadcast(blended_rate(actors, rates)))
    hours = F.col("attendee_count") * F.col("duration_min") / 60.0
    return held.select(*cost_row("meet:", "meeting_id", "meeting", hours=hours, rate_band=F.col("blended"), cost=F.round(hours.cast("decimal(18,4)") * F.col("blended"), 2)))


def token_cost(p: Params = DEFAULT) -> Column:
    """Tokens at prices per million, converted, rounded half up to two digits."""
    exact = F.col("tokens_in").cast("decimal(18,0)") * F.lit(p.token_in_per_million).cast("decimal(10,2)") + F.col("tokens_out").cast("decimal(18,0)") * F.lit(p.token_out_per_million).cast("decimal(10,2)")
    return F.round((exact * F.lit(p.token_fx).cast("decimal(8,2)")).cast("decimal(38,4)") / F.lit(1_000_000), 2).cast(MONEY)


def price_tokens(usage: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Cost events of token usage; nobody's hours."""
    return usage.withColumn("_cost", token_cost(p)).select(*cost_row("ai:", "usage_id", "ai_tokens", cost=F.col("_cost")))


def tokens_reconcile(usage: DataFrame, stored: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The sum of recomputed costs against what is stored."""
    both = usage.agg(F.sum(token_cost(p)).alias("recomputed")).crossJoin(stored.where("basis = 'ai_tokens'").agg(F.sum("cost").alias("stored")))
    return both.withColumn("reconciles", F.col("recomputed").eqNullSafe(F.col("stored")))


def ai_adoption(items: DataFrame, usage: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """C17: items, items with AI usage, their share and the cost by sprint."""
    spent = usage.withColumn("_cost", token_cost(p)).groupBy("work_item_id").agg(F.sum("_cost").alias("_cost"))
    joined = items.select("work_item_id", "sprint").join(spent, "work_item_id", "left")
    grouped = joined.groupBy("sprint").agg(F.count("*").alias("n_items"), F.count("_cost").alias("n_with_ai"), F.coalesce(F.sum("_cost"), F.lit(0)).cast(MONEY).alias("cost"))
    return grouped.withColumn("adoption_pct", 100.0 * F.col("n_with_ai") / F.col("n_items"))


def cost_events(*parts: DataFrame) -> DataFrame:
    """All bases in one table."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cost_by_basis(costs: DataFrame) -> DataFrame:
    """Rows, hours and cost by basis."""
    return costs.groupBy("basis").agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("hours"), F.lit(0.0)).alias("hours"), F.coalesce(F.sum("cost"), F.lit(0)).cast(MONEY).alias("cost"))


def case_cost(items: DataFrame, costs: DataFrame) -> DataFrame:
    """Every case with its total and its four kinds of cost, null where it has none."""
    kinds = (("session_inferred", "labour_cost"), ("ci_runner", "ci_cost"), ("ai_tokens", "ai_cost"), ("meeting", "meeting_cost"))
    sums = costs.groupBy("work_item_id").agg(F.sum("cost").alias("total_cost"), F.sum("hours").alias("total_hours"), F.countDistinct("actor_hash").alias("n_actors"), *[sum_if(F.col("basis") == b, "cost").alias(n) for b, n in kinds])
    return items.select("work_item_id", "repo", "component", "epic", "sprint").join(sums, "work_item_id", "left").withColumn("n_actors", F.coalesce("n_actors", F.lit(0)))


def spend_by_component(costs: DataFrame, items: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """C20: cost by component behind the k-anonymity floor; what is withheld stays as a row. A null component is a group."""
    grouped = costs.join(items.select("work_item_id", "repo", "component"), "work_item_id").groupBy("repo", "component").agg(F.countDistinct("actor_hash").alias("n_actors"), F.sum("cost").alias("all_cost"))
    return grouped.select("repo", "component", "n_actors", suppressed("n_actors", p.k).alias("suppressed"), floored("n_actors", "all_cost", p.k).alias("cost"), F.lit(p.k).alias("k_applied"))


def case_spend(items: DataFrame, costs: DataFrame, events: DataFrame) -> DataFrame:
    """A case's labour hours split into writing and reviewing by each actor's mix of events on it."""
    human = events.where("actor_hash is not null and activity != 'ci_run'")
    mix = human.groupBy("work_item_id", "actor_hash").agg((count_if(is_in("activity", REVIEWS)) / F.count("*")).alias("reviewing"))
    labour = costs.where("basis = 'session_inferred'").groupBy("work_item_id", "actor_hash").agg(F.sum("hours").alias("hours"))
    part = F.coalesce("reviewing", F.lit(0.0))
    split = labour.join(mix, ["work_item_id", "actor_hash"], "left").groupBy("work_item_id").agg(F.sum(F.col("hours") * (1 - part)).alias("author_hours"), F.sum(F.col("hours") * part).alias("review_hours"))
    priced = costs.groupBy("work_item_id").agg(F.sum("cost").alias("cost"), sum_if(F.col("basis") == "session_inferred", "cost").alias("labour_cost"))
    out = items.select("work_item_id", "repo", F.coalesce("component", F.lit("unassigned")).alias("component"), "sprint").join(split, "work_item_id", "left").join(priced, "work_item_id", "left")
    hours = {c: F.coalesce(c, F.lit(0.0)) for c in ("author_hours", "review_hours")}
    return out.withColumns(hours | {c: F.coalesce(c, F.lit(0)).cast(MONEY) for c in ("cost", "labour_cost")})


def top_spend(spend: DataFrame, n: int) -> DataFrame:
    """The n costliest cases."""
    return spend.where("cost > 0").orderBy(F.col("cost").desc(), "work_item_id").limit(n)


def spend_summary(case_cost: DataFrame) -> DataFrame:
    """Totals by basis, the observed share (labour and CI), and labour cost per hour."""
    names = ("labour_cost", "ci_cost", "ai_cost", "meeting_cost", "total_cost")
    sums = case_cost.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in names], F.coalesce(F.sum("total_hours"), F.lit(0.0)).alias("total_hours"))
    observed = F.coalesce(F.try_divide(F.col("labour_cost") + F.col("ci_cost"), "total_cost"), F.lit(0.0))
    return sums.withColumns({"observed_share": observed, "blended_hourly": F.coalesce(F.try_divide("labour_cost", "total_hours"), F.lit(0.0))})


def spend_rollup(spend: DataFrame) -> DataFrame:
    """Totals, by repository and by component in one roll-up, with the share of review and the labour rate. level: 0 component, 1 repository, 3 all."""
    rolled = spend.rollup("repo", "component").agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("n_items"), F.sum("author_hours").alias("author_hours"), F.sum("review_hours").alias("review_hours"),
        F.sum("cost").alias("cost"), F.sum("labour_cost").alias("labour_cost"),
    )
    hours = F.col("author_hours") + F.col("review_hours")
    return rolled.withColumns({"review_share": F.coalesce(F.try_divide("review_hours", hours), F.lit(0.0)), "blended_rate": F.coalesce(F.try_divide(F.col("labour_cost").cast("double"), hours), F.lit(0.0))})


def flag_spend(spend: DataFrame, waste: DataFrame) -> DataFrame:
    """Components with their cost and the kinds of waste found there."""
    by = spend.groupBy("repo", "component").agg(F.sum("cost").alias("cost"))
    found = waste.select("repo", F.coalesce("component", F.lit("unassigned")).alias("component"), "waste_type").groupBy("repo", "component").agg(F.array_join(F.array_sort(F.collect_set("waste_type")), ",").alias("waste_types"))
    return by.join(found, ["repo", "component"], "left").select("repo", "component", "cost", F.coalesce("waste_types", F.lit("")).alias("waste_types"), F.col("waste_types").isNotNull().alias("flagged"))


def meeting_drift(meetings: DataFrame, n_actors: int | DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Attendee hours per actor and week against the assumption; within_5_pct tells whether they agree.

    Meetings have no list of attendees here, so their hours are spread over all actors (a number, or a table of them).
    """
    span = meetings.agg(F.sum(F.col("attendee_count") * F.col("duration_min") / 60.0).alias("attendee_hours"), F.count("*").alias("n_meetings"), F.greatest(F.lit(1.0), F.ceil((micros(F.max("ts")) - micros(F.min("ts"))) / (p.sprint_days * 86_400e6))).alias("sprints"))
    people = span.crossJoin(F.broadcast(n_actors.agg(F.count("*").alias("n_actors")))) if isinstance(n_actors, DataFrame) else span.withColumn("n_actors", F.lit(n_actors))
    weekly = F.col("attendee_hours") / (F.col("sprints") * p.sprint_days / 7.0) / F.nullif(F.col("n_actors"), F.lit(0))
    drift = (F.coalesce(weekly, F.lit(0.0)) - p.meeting_hours_per_week) / p.meeting_hours_per_week * 100
    return people.withColumns({"hours_per_actor_week": F.coalesce(weekly, F.lit(0.0)), "drift_pct": drift, "within_5_pct": F.abs(drift) <= 5})


def meeting_sizes(meetings: DataFrame) -> DataFrame:
    """Meetings by number of attendees."""
    return meetings.groupBy("attendee_count").agg(F.count("*").alias("n_meetings"))


def free_gaps(events: DataFrame, minutes: float, start_hour: int = 9, end_hour: int = 18) -> DataFrame:
    """Gaps between an actor's consecutive events that hold a slot of so many minutes and begin in working hours.

    Two neighbours further apart than a slot never share a cell of half a slot's width, so a gap leads from the last event of a
    cell to the first one of the actor's next cell: events are combined by cell before the shuffle, and cells are put in order
    instead of events. A slot of no length has no such cells; then every neighbour is a gap and all events are ordered.
    """
    known = events.where("actor_hash is not null")
    first, last = F.struct("ts", "event_id"), F.struct("ts", "event_id", "work_item_id")
    if minutes > 0:
        width = max(1, int(minutes * 30_000_000))
        cells = known.groupBy("actor_hash", F.floor(micros("ts") / width).alias("cell")).agg(F.min(first).alias("first"), F.max_by(last, first).alias("last"))
    else:
        cells = known.select("actor_hash", first.alias("first"), last.alias("last"))
    nexts = cells.withColumn("gap_end", F.lead("first.ts").over(Window.partitionBy("actor_hash").orderBy("first")))
    gaps = nexts.where(F.col("gap_end").isNotNull()).select("actor_hash", F.col("last.work_item_id").alias("work_item_id"), F.col("last.ts").alias("gap_start"), "gap_end", minutes_between("last.ts", "gap_end").alias("gap_minutes"))
    return gaps.where((F.col("gap_minutes") >= minutes) & (F.hour("gap_start") >= start_hour) & (F.hour("gap_start") < end_hour))
