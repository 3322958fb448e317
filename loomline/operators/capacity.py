"""Delivery rates: cycle-time forecasts, component capacity, capability, reallocation pricing and a blind backtest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import count_if, floored, is_in, micros, suppressed
from ..functions.ranks import with_ranks
from ..params import DEFAULT, REVIEWS, Params


def forecast_cycle_time(cycles: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """10th, 50th and 90th percentile of cycle time for every repository and component at once.

    Outliers are left out and counted. A group of too few samples takes its repository's figures, or else all of them.
    """
    kept = F.col("cycle_hours") <= p.max_cycle_hours
    places = F.array(F.array("repo", "component"), F.array("repo"), F.array().cast("array<string>"))
    long = cycles.where("cycle_hours > 0").select(F.when(kept, F.col("cycle_hours")).alias("hours"), kept.alias("kept"), F.explode(places).alias("place"))
    facts = [count_if(F.col("kept")).alias("n"), count_if(~F.col("kept")).alias("out")]
    found = with_ranks(long, ["place"], "hours", facts, {"p10": (0.1, "between"), "p50": (0.5, "between"), "p90": (0.9, "between")})
    known = found.select("place", F.get("place", F.lit(0)).alias("repo"), F.get("place", F.lit(1)).alias("component"), F.array("p10", "p50", "p90").alias("q"), "n", "out")
    figures = F.struct("q", "n", "out")
    # there are few groups, so the windows that give each its repository's and the overall figures are cheap
    joined = known.withColumns({"in_repo": F.max(F.when(F.size("place") == 1, figures)).over(Window.partitionBy("repo")), "in_all": F.max(F.when(F.size("place") == 0, figures)).over(Window.partitionBy(F.lit(0)))})
    joined = joined.where("size(place) = 2 and repo is not null").select("repo", "component", "q", "n", "out", *[F.col(f"in_{w}")[c].alias(f"{w}_{c}") for w in ("repo", "all") for c in ("q", "n", "out")])
    basis = F.when((F.col("n") >= p.min_group_samples) & F.col("component").isNotNull(), "component").when(F.col("repo_n") >= p.min_group_samples, "repo").otherwise("global")

    def pick(c: str) -> Column:
        return F.when(F.col("basis") == "component", F.col(c)).when(F.col("basis") == "repo", F.col(f"repo_{c}")).otherwise(F.col(f"all_{c}"))

    return joined.withColumn("basis", basis).select("repo", "component", "basis", *[pick("q")[i].alias(f"{n}_hours") for i, n in enumerate(("p10", "p50", "p90"))], pick("n").alias("n_samples"), pick("out").alias("n_excluded"))


def component_capacity(items: DataFrame, events: DataFrame, costs: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """people, flow, rate, weekly variation (sample deviation over weeks with deliveries) and floored cost per component."""
    key = ["repo", "component"]
    scoped = items.select("work_item_id", "repo", F.coalesce("component", F.lit("unassigned")).alias("component"), "closed_at")
    people = events.where("actor_hash is not null").select("work_item_id", "actor_hash").distinct().join(scoped, "work_item_id").groupBy(*key).agg(F.countDistinct("actor_hash").alias("n_engineers"))
    weeks = (micros(F.max("closed_at")) - micros(F.min("closed_at"))) / 6.048e11
    flow = scoped.groupBy(*key).agg(F.count("*").alias("total_items"), F.count("closed_at").alias("closed_items"), count_if(F.col("closed_at").isNull()).alias("open_items"), F.greatest(weeks, F.lit(1.0)).alias("span_weeks"))
    weekly = scoped.where("closed_at is not null").groupBy(*key, F.date_trunc("week", "closed_at").alias("week")).agg(F.count("*").alias("n"))
    varied = weekly.groupBy(*key).agg(F.coalesce(F.stddev_samp("n") / F.nullif(F.avg("n"), F.lit(0.0)), F.lit(0.0)).alias("throughput_cv"))
    spent = costs.groupBy("work_item_id").agg(F.sum("cost").alias("cost"), F.sum("hours").alias("hours")).join(scoped, "work_item_id").groupBy(*key).agg(F.sum("cost").alias("all_cost"), F.sum("hours").alias("hours"))
    joined = flow.join(people, key, "left").join(varied, key, "left").join(spent, key, "left")
    return joined.select(
        *key, F.coalesce("n_engineers", F.lit(0)).alias("n_engineers"), "total_items", "closed_items", "open_items", "span_weeks",
        (F.col("closed_items") / F.col("span_weeks")).alias("items_per_week"), F.coalesce("throughput_cv", F.lit(0.0)).alias("throughput_cv"),
        suppressed("n_engineers", p.k).alias("suppressed"), floored("n_engineers", "all_cost", p.k).alias("cost"), F.coalesce("hours", F.lit(0.0)).alias("hours"), F.lit(p.k).alias("k_applied"),
    )


def rankable_components(capacity: DataFrame) -> DataFrame:
    """components with people and closed work, numbered by cost (withheld last), then people."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("cost").desc_nulls_last(), F.col("n_engineers").desc(), "repo", "component")  # components, not events
    return capacity.where("n_engineers > 0 and closed_items > 0").withColumn("position", F.row_number().over(order)).select("position", "repo", "component", "n_engineers", "open_items", "items_per_week", "throughput_cv", "cost", "span_weeks")


def actor_component_activity(events: DataFrame, items: DataFrame) -> DataFrame:
    """Merges and reviews of each actor in each component. Per person: an input of other operators, never an output."""
    done = events.where("actor_hash is not null").join(items.where("component is not null").select("work_item_id", "component"), "work_item_id")
    return done.groupBy("component", "actor_hash").agg(count_if(F.col("activity") == "merged").alias("n_merged"), count_if(is_in("activity", REVIEWS)).alias("n_reviews"))


def capability(activity: DataFrame) -> DataFrame:
    """an actor's share of merges (0.6) and reviews (0.4) against an equal split, held between 0.5 and 1.5; neutral without activity."""
    w = Window.partitionBy("component")
    equal = 1.0 / F.count("*").over(w)

    def share(c: str) -> Column:
        total = F.sum(c).over(w)
        return F.when(total > 0, F.col(c) / total).otherwise(equal)

    raw = (0.6 * share("n_merged") + 0.4 * share("n_reviews")) / equal
    idle = (F.col("n_merged") == 0) & (F.col("n_reviews") == 0)
    score = F.when(idle, 1.0).otherwise(F.greatest(F.lit(0.5), F.least(F.lit(1.5), raw)))
    return activity.select("component", "actor_hash", score.alias("effectiveness"), F.when(idle, "neutral_fallback").otherwise("historical_component_throughput").alias("basis"))


def capability_spread(scored: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """F4 as it may be published: the range of capability per component, behind the floor."""
    by = scored.groupBy("component").agg(F.count("*").alias("n_actors"), F.min("effectiveness").alias("lo"), F.max("effectiveness").alias("hi"), F.avg("effectiveness").alias("mid"))
    return by.select("component", "n_actors", *[floored("n_actors", c, p.k).alias(n) for c, n in (("lo", "least"), ("mid", "mean"), ("hi", "most"))])


def _weeks(open_items: Column, rate: Column) -> Column:
    return open_items / rate


def reallocation_grid(capacity: DataFrame, counts: tuple[int, ...] = (1, 2, 3), p: Params = DEFAULT, blocks: int = 6) -> DataFrame:
    """what moving n engineers from one component to another does, for every pair and count.

    Refused moves stay as rows with a reason and without figures. The grid has components squared times counts rows.
    Components are dealt into `blocks` blocks by a hash; a pair of blocks is the key of the exchange, and each pair of
    components meets in the task of its pair of blocks, so that a component is sent to as many tasks as there are blocks.
    """
    cols = ("repo", "component", "n_engineers", "open_items", "items_per_week", "throughput_cv", "cost", "span_weeks")
    side = capacity.where("n_engineers > 0 and closed_items > 0").select(*cols)
    # the aggregate is computed once: each of its rows goes to its blocks as a source and as a destination, told apart by a flag
    own = F.pmod(F.xxhash64("repo", "component"), F.lit(blocks)).cast("int")
    ways = F.flatten(F.array(*[F.array(F.struct(own.alias("row"), F.lit(i).alias("column"), F.lit(True).alias("gives")), F.struct(F.lit(i).alias("row"), own.alias("column"), F.lit(False).alias("gives"))) for i in range(blocks)]))
    sent = side.withColumn("to", F.explode(ways)).select("*", "to.row", "to.column").repartition(blocks * blocks, "row", "column").groupBy("row", "column").agg(*[F.collect_list(F.when(F.col("to.gives") == gives, F.struct(*[F.col(c).alias(f"{name}_{c}") for c in cols]))).alias(name) for name, gives in (("source", True), ("dest", False))])
    grid = sent.select(F.inline("source"), "dest").select("*", F.inline("dest")).drop("dest").withColumn("n", F.explode(F.array(*[F.lit(n) for n in counts])))
    s, d, n = (lambda c: F.col(f"source_{c}")), (lambda c: F.col(f"dest_{c}")), F.col("n")
    same = (s("repo") == d("repo")) & (s("component") == d("component"))
    refusal = F.when(n <= 0, "count must be at least 1").when(same, "same component").when(n >= s("n_engineers"), "would empty the source").when((s("items_per_week") <= 1e-9) | (d("items_per_week") <= 1e-9), "no observed delivery rate")
    before_s = _weeks(s("open_items"), s("items_per_week"))
    after_s = _weeks(s("open_items"), s("items_per_week") * (s("n_engineers") - n) / s("n_engineers"))
    before_d = _weeks(d("open_items"), d("items_per_week"))
    horizon = F.greatest(before_d, F.lit(1.0))
    blend = F.when(horizon <= p.ramp_weeks, F.lit(p.ramp_efficiency)).otherwise((p.ramp_efficiency * p.ramp_weeks + (horizon - p.ramp_weeks)) / horizon)
    after_d = _weeks(d("open_items"), d("items_per_week") * (d("n_engineers") + n * blend) / d("n_engineers"))
    burn_s, burn_d = (c("cost").cast("double") / F.greatest(c("span_weeks"), F.lit(1.0)) for c in (s, d))
    spread = F.greatest(F.lit(p.min_spread), F.least(F.lit(p.max_spread), F.sqrt(s("throughput_cv") ** 2 + d("throughput_cv") ** 2) * p.cv_to_spread))
    priced = s("cost").isNotNull() & d("cost").isNotNull()
    net = (after_s - before_s) * burn_s + (after_d - before_d) * burn_d

    def unless(c: Column, digits: int) -> Column:
        return F.when(F.col("refusal").isNull(), F.round(c, digits))

    return grid.withColumn("refusal", refusal).select(
        "source_repo", "source_component", "dest_repo", "dest_component", "n", "refusal",
        unless(after_s - before_s, 2).alias("source_delta_weeks"), unless(after_d - before_d, 2).alias("dest_delta_weeks"),
        unless(F.when(priced, net), 2).alias("net_cost"), unless(50 - spread / 2, 1).alias("confidence_low"), unless(50 + spread / 2, 1).alias("confidence_high"),
        (F.col("refusal").isNull() & priced).alias("priced"),
    )


def weekly_delivery(log: DataFrame) -> DataFrame:
    """distinct merged cases in the window by component and week."""
    merged = log.where("activity = 'merged' and in_window")
    return merged.groupBy("repo", F.coalesce("component", F.lit("unassigned")).alias("component"), F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(F.countDistinct("case_id").alias("delivered"))


def backtest(weekly: DataFrame, horizon: int = 4, folds: int = 6, min_items: int = 10, p: Params = DEFAULT) -> DataFrame:
    """rolling-origin backtest: the rate over the weeks before a fold against what the fold's weeks delivered.

    The weeks are those with any delivery, without the last, which is partial. Variation is the population deviation
    over all training weeks, empty ones included. The table of weeks and folds is small and broadcast.
    """
    weeks = weekly.select("week").distinct()
    numbered = weeks.withColumns({"i": F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("week")) - 1, "n_weeks": F.count("*").over(Window.partitionBy(F.lit(0))) - 1}).where("i < n_weeks")
    spine = numbered.withColumn("fold", F.explode(F.array(*[F.lit(f) for f in range(folds)])))
    spine = spine.withColumn("start", F.col("n_weeks") - (F.col("fold") + 1) * horizon).where((F.col("start") > horizon) & (F.col("i") < F.col("start") + horizon))
    places = weekly.select("repo", "component").distinct()
    filled = places.crossJoin(F.broadcast(spine)).join(weekly, ["repo", "component", "week"], "left").withColumn("delivered", F.coalesce("delivered", F.lit(0)))
    train = F.when(F.col("i") < F.col("start"), F.col("delivered"))
    by = filled.groupBy("repo", "component", "fold", "start").agg(F.sum(train).alias("trained"), F.stddev_pop(train).alias("deviation"), F.sum(F.when(F.col("i") >= F.col("start"), F.col("delivered"))).alias("actual"))
    rate = F.col("trained") / F.col("start")
    cv = F.when(F.col("start") < 2, 0.0).otherwise(F.col("deviation") / rate)
    spread = F.greatest(F.lit(p.min_spread), F.least(F.lit(p.max_spread), cv * p.cv_to_spread)) / 100.0
    scored = by.where((F.col("trained") >= min_items) & (F.col("trained") > 0)).select("fold", "repo", "component", F.col("start").cast("long").alias("train_weeks"), rate.alias("rate_per_week"), (rate * horizon).alias("predicted"), "actual", spread.alias("s"))
    return scored.withColumns({"p10": F.col("predicted") * (1 - F.col("s")), "p90": F.col("predicted") * (1 + F.col("s"))}).drop("s")


def backtest_report(observed: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """F8: errors of the backtest as one row. Percentages count only where enough was delivered; the baseline predicts the mean of all predictions."""
    known = observed.crossJoin(F.broadcast(observed.agg(F.avg("predicted").alias("mean_predicted"))))
    error = F.abs(F.col("predicted") - F.col("actual"))
    enough = F.col("actual") >= p.min_actual_for_pct
    return known.agg(
        F.count("*").alias("n"), F.avg(error).alias("mae"), F.avg(F.abs(F.col("mean_predicted") - F.col("actual"))).alias("baseline_mae"), F.avg(F.when(enough, error / F.col("actual") * 100)).alias("mape"), count_if(enough).alias("n_scored_pct"),
        F.avg(F.col("predicted") - F.col("actual")).alias("bias"), count_if(F.col("predicted") < F.col("actual")).alias("under_predicted"),
        F.avg(F.when((F.col("p10") <= F.col("actual")) & (F.col("actual") <= F.col("p90")), 1.0).otherwise(0.0)).alias("band_coverage"),
    )


def band_verdict(grid: DataFrame, widest: float = 60.0) -> DataFrame:
    """how certain a scenario is, and whether its band is narrow, moderate or wide."""
    spread = F.greatest(F.lit(0.0), F.col("confidence_high") - F.col("confidence_low"))
    certainty = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - spread / widest))
    return grid.withColumns({"spread": spread, "certainty": certainty, "verdict": F.when(certainty > 0.55, "narrow").when(certainty > 0.35, "moderate").when(certainty.isNotNull(), "wide")})


def net_impact(candidates: DataFrame, openings: DataFrame, grid: DataFrame, package: float = 0.0, housing: float = 0.0, travel: float = 0.0, extra_weeks: float = 0.0, hourly: float | None = None, hours_per_week: float = 40.0) -> DataFrame:
    """delivery impact and relocation cost of moving a candidate to an opening, with the feasibility gate and the verdict.

    candidates: employee_id, repo, component, location, open_to_relocation, preferred_locations; openings: opening_id,
    repo, component, location. The grid's moves of one engineer price the delivery side.
    """
    one = grid.where("n = 1 and refusal is null")
    c = candidates.select("employee_id", F.col("repo").alias("source_repo"), F.col("component").alias("source_component"), F.col("location").alias("home"), "open_to_relocation", "preferred_locations")
    o = openings.select("opening_id", F.col("repo").alias("dest_repo"), F.col("component").alias("dest_component"), F.col("location").alias("place"))
    # priced moves with the openings at their other end first: candidates meet only moves that lead to an opening
    pairs = c.join(one.join(o, ["dest_repo", "dest_component"]), ["source_repo", "source_component"])
    feasible = F.when(F.col("home") == F.col("place"), "not-required").when(~F.col("open_to_relocation"), "not-opted-in").when(F.array_contains("preferred_locations", F.col("place")), "preferred").otherwise("acceptable")
    ramp = 0.0 if hourly is None else float(round(extra_weeks * hours_per_week * hourly))
    moved = F.when(F.col("feasibility") != "not-required", F.lit(package + housing + travel)).otherwise(0.0)
    total = F.coalesce("net_cost", F.lit(0.0)) + moved + ramp
    verdict = F.when(F.col("feasibility") == "not-opted-in", "do-not-proceed").when(-F.col("total_cost") > 0, "proceed").otherwise("do-not-proceed")
    return pairs.withColumn("feasibility", feasible).withColumn("total_cost", total).select(
        "employee_id", "opening_id", "feasibility", F.round("total_cost", 2).alias("total_cost"), F.round(-F.col("total_cost"), 2).alias("net_benefit"), verdict.alias("verdict"),
        F.when(F.col("dest_delta_weeks") < 0, "improved").otherwise("delayed").alias("dest_outcome"), F.when(F.col("source_delta_weeks") > 0, "delayed").otherwise("improved").alias("source_outcome"), "priced",
    )
