"""Waste: rework, review latency, backlog time, failed and repeated CI runs, and concentration on one person.

Idle time is never priced; what cannot be priced is null with a reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import count_if, floored, is_in, sum_if, suppressed
from ..functions.ranks import with_ranks
from ..params import DEFAULT, REVIEWS, Params
from .cost import cited


def _priced_pairs(pairs: DataFrame, actors: DataFrame, rates: DataFrame) -> DataFrame:
    redone = pairs.where("gap_hours >= 0").join(actors.select(F.col("actor_hash").alias("redone_by"), "role_band"), "redone_by", "left")
    rated = redone.join(F.broadcast(rates.select("role_band", "hourly")), "role_band", "left")
    return rated.withColumn("pair_cost", F.col("gap_hours") * F.col("hourly").cast("double"))


def rework_cost(pairs: DataFrame, actors: DataFrame, rates: DataFrame) -> DataFrame:
    """Pairs, hours, cost (null if none has a rate), pairs without a rate, and the reason."""
    row = _priced_pairs(pairs, actors, rates).agg(F.count("*").alias("n_pairs"), F.coalesce(F.sum("gap_hours"), F.lit(0.0)).alias("total_hours"), F.sum("pair_cost").alias("total_cost"), count_if(F.col("hourly").isNull()).alias("n_unpriced"))
    reason = F.when((F.col("n_pairs") > 0) & F.col("total_cost").isNull(), "no rate for any pair").when(F.col("n_unpriced") > 0, "some pairs have no rate")
    return row.withColumn("reason", reason).withColumn("total_cost", F.when(F.col("n_pairs") == 0, 0.0).otherwise(F.col("total_cost")))


def latency_findings(both: DataFrame) -> DataFrame:
    """Per definition: number, median, mean and sum of non-negative latencies."""
    facts = [F.count("*").alias("n"), F.avg("latency_hours").alias("mean_hours"), F.sum("latency_hours").alias("total_hours")]
    return with_ranks(both.where("latency_hours >= 0"), ["definition"], "latency_hours", facts, {"median_hours": (0.5, "between")})


def backlog_segments(backlog: DataFrame) -> DataFrame:
    """Number, median and nearest-rank 90th percentile of backlog hours: for all, by priority and by issue type."""
    waited = backlog.where("backlog_hours >= 0")
    segments = F.array(*[F.struct(F.lit(s).alias("segment"), v.alias("value")) for s, v in (("all", F.lit("all")), ("priority", F.col("priority")), ("issue_type", F.col("issue_type")))])
    long = waited.select("backlog_hours", F.explode(segments).alias("s")).select("backlog_hours", "s.*").where("value is not null and value != ''")
    ranks = {"median_hours": (0.5, "between"), "p90_hours": (0.9, "nearest")}
    return with_ranks(long, ["segment", "value"], "backlog_hours", [F.count("*").alias("n"), F.sum("backlog_hours").alias("total_hours")], ranks)


def ci_waste(runs: DataFrame) -> DataFrame:
    """Runs that are repetitions or failures."""
    wasted = runs.where("attempt > 1 or conclusion = 'failure'")
    return wasted.select("run_id", "work_item_id", "repo", "attempt", "conclusion", "runner_minutes", (F.col("attempt") > 1).alias("is_rerun"), F.coalesce(F.col("conclusion") == "failure", F.lit(False)).alias("is_failure"))


def ci_waste_minutes(wasted: DataFrame) -> DataFrame:
    """Minutes of repetitions, of failures and of both, as one row."""
    zero = F.lit(0.0)
    return wasted.agg(F.coalesce(sum_if(F.col("is_rerun"), "runner_minutes"), zero).alias("rerun_minutes"), F.coalesce(sum_if(F.col("is_failure"), "runner_minutes"), zero).alias("failure_minutes"), F.coalesce(F.sum("runner_minutes"), zero).alias("total_minutes"))


def ci_waste_priced(minutes: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Cost and carbon of wasted minutes; each is null with a reason if its figure is uncited or not set."""
    rate, why = cited(p.ci_per_minute, p.ci_citation, "ci rate")
    grid, no_carbon = cited(p.grid_kg_per_kwh, p.carbon_citation, "carbon")
    watts = F.lit(p.runner_watts).cast("decimal(10,2)")
    exact = F.col("total_minutes").cast("decimal(18,3)")
    kwh = F.col("total_minutes") / 60.0 * watts.cast("double") / 1000.0
    missing = F.coalesce(no_carbon, F.when(watts.isNull(), F.lit("carbon: not set")))
    return minutes.withColumns({"hours": F.col("total_minutes") / 60.0, "cost": F.round(exact * rate, 2).cast("decimal(18,2)"), "cost_reason": why, "carbon_kg": F.round(kwh * grid.cast("double"), 3), "carbon_reason": missing})


def key_person(events: DataFrame, items: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The largest share of a component's merges and reviews that one person holds, behind the k-anonymity floor. Who that is stays inside."""
    done = events.where("actor_hash is not null").where(is_in("activity", ("merged", *REVIEWS))).join(items.where("component is not null").select("work_item_id", "component"), "work_item_id")
    own = done.groupBy("component", "actor_hash").agg(F.count("*").alias("n"))
    by = own.groupBy("component").agg(F.count("*").alias("n_actors"), F.sum("n").alias("activity"), (F.max("n") / F.sum("n")).alias("share"))
    return by.select("component", "n_actors", "activity", suppressed("n_actors", p.k).alias("suppressed"), floored("n_actors", "share", p.k).alias("top_share"))


def waste_by_project(pairs: DataFrame, actors: DataFrame, rates: DataFrame, items: DataFrame, case_cost: DataFrame, both: DataFrame, wasted: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Rework, meetings, latency (median hours, unpriced) by component, and CI by repository."""
    places = items.select("work_item_id", "repo", "component")
    money = "decimal(18,2)"
    rework = _priced_pairs(pairs, actors, rates).join(places, "work_item_id").groupBy("repo", "component").agg(F.count("*").alias("n_items"), F.sum("gap_hours").alias("hours"), F.round(F.sum("pair_cost"), 2).cast(money).alias("cost"))
    meeting = case_cost.where("meeting_cost > 0").groupBy("repo", "component").agg(F.count("*").alias("n_items"), F.lit(0.0).alias("hours"), F.sum("meeting_cost").cast(money).alias("cost"))
    reviewed = both.where("definition = 'pr_opened_to_first_review'").join(places, "work_item_id").withColumn("place", F.array("repo", "component"))
    latency = with_ranks(reviewed, ["place"], "latency_hours", [F.count("*").alias("n_items")], {"hours": (0.5, "between")})
    latency = latency.select(F.col("place")[0].alias("repo"), F.col("place")[1].alias("component"), "n_items", "hours", F.lit(None).cast(money).alias("cost"))
    rate, _ = cited(p.ci_per_minute, p.ci_citation, "ci rate")
    ci = wasted.groupBy("repo").agg(F.count("*").alias("n_items"), (F.sum("runner_minutes") / 60.0).alias("hours"), F.sum("runner_minutes").alias("m"))
    ci = ci.select("repo", F.lit(None).cast("string").alias("component"), "n_items", "hours", F.round(F.col("m").cast("decimal(18,3)") * rate, 2).cast(money).alias("cost"))
    parts = [d.withColumn("waste_type", F.lit(t)) for t, d in (("rework", rework), ("meeting", meeting), ("latency", latency), ("ci", ci))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("waste_type", "repo", "component", "n_items", "hours", "cost")


def waste_summary(rework: DataFrame, ci: DataFrame, backlog: DataFrame) -> DataFrame:
    """One row per detector, ranked by cost with the unpriced ones last."""
    rows = rework.select(F.lit("rework").alias("detector"), F.col("total_hours").alias("hours"), F.col("total_cost").cast("double").alias("cost"))
    rows = rows.unionByName(ci.select(F.lit("ci_waste").alias("detector"), "hours", F.col("cost").cast("double").alias("cost")))
    rows = rows.unionByName(backlog.agg(F.lit("backlog_time").alias("detector"), F.coalesce(F.sum("backlog_hours"), F.lit(0.0)).alias("hours"), F.lit(None).cast("double").alias("cost")))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("cost").desc_nulls_last(), "detector")  # three rows
    return rows.withColumn("position", F.row_number().over(order))


def waste_categories(waste: DataFrame, exposure: tuple[str, ...] = ("key_person",)) -> DataFrame:
    """Amount by kind, its share of what is recoverable, and hours: summed if all is priced, else their median."""
    facts = [
        F.count("*").alias("n_rows"),
        F.coalesce(F.sum("cost"), F.lit(0)).cast("double").alias("amount"),
        (F.count("cost") == F.count("*")).alias("priced"),
        F.sum("hours").alias("sum_hours"),
    ]
    by = with_ranks(waste.withColumn("hours", F.coalesce("hours", F.lit(0.0))), ["waste_type"], "hours", facts, {"mid_hours": (0.5, "between")})
    recoverable = ~is_in("waste_type", exposure)
    total = F.sum(F.when(recoverable, F.col("amount")).otherwise(0.0)).over(Window.partitionBy(F.lit(0)))
    share = F.when(recoverable & F.col("priced") & (total > 0), F.col("amount") / total).otherwise(0.0)
    return by.select("waste_type", "n_rows", "amount", share.alias("share"), recoverable.alias("recoverable"), "priced", F.when(F.col("priced"), F.col("sum_hours")).otherwise(F.col("mid_hours")).alias("hours"))


def waste_rollup(waste: DataFrame, exposure: tuple[str, ...] = ("key_person",), least_items: int = 5) -> DataFrame:
    """Per repository: recoverable and exposed amounts, its largest line, and its slowest line of at least so many items."""
    at_risk = is_in("waste_type", exposure)
    amount = F.coalesce(F.col("cost").cast("double"), F.lit(0.0))
    line = F.concat_ws("/", "waste_type", F.coalesce("component", F.lit("-")))
    known = waste.withColumns({"amount": amount, "line": line})
    slow = F.when(F.col("n_items") >= least_items, F.struct(F.round("hours", 6), F.col("line")))
    return known.groupBy("repo").agg(
        F.coalesce(sum_if(~at_risk, "amount"), F.lit(0.0)).alias("recoverable"),
        F.coalesce(sum_if(at_risk, "amount"), F.lit(0.0)).alias("exposure"),
        F.max_by("line", F.struct("amount", "line")).alias("largest_line"),
        F.max_by("line", slow).alias("slowest_line"),
    )
