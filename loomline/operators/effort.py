"""Hours from timestamps: working sessions, their daily cap, their split over work items, and how settings change them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import evidence_id, hours_between, iso_utc, micros
from ..functions.ranks import with_ranks
from ..params import DEFAULT, Params


def _cells(events: DataFrame, keys: list[str], gap_minutes: int) -> DataFrame:
    """Events that count as work, counted by actor and by cells of time as wide as the gap, with the first and last time of each.

    Two events of one cell are less than the gap apart, so no session ends within a cell. The events themselves are
    therefore never ordered, only combined on the map side; an actor has as many cells as its span has gaps, however
    many events.
    """
    width = max(gap_minutes * 60_000_000, 1)
    work = events.where("actor_hash is not null and activity != 'ci_run'").withColumn("_cell", micros("ts") - F.pmod(micros("ts"), F.lit(width)))
    return work.groupBy("actor_hash", "_cell", *keys).agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"), F.count("*").alias("n_events"))


def _number(gap_minutes: int) -> Column:
    """Running number of a cell's session: a new one after a gap longer than allowed (an equal one still joins)."""
    w = Window.partitionBy("actor_hash").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(F.when(F.col("_gap") > gap_minutes * 60_000_000, 1).otherwise(0)).over(w)


def _gapped(cells: DataFrame) -> DataFrame:
    return cells.withColumn("_gap", micros("_first") - micros(F.lag("_last").over(Window.partitionBy("actor_hash").orderBy("_cell"))))


def _capped(sessions: DataFrame, keys: list[str], p: Params) -> DataFrame:
    """An actor's sessions of one UTC day (of the start after the lead-in) are scaled down together to the cap."""
    day = F.sum("raw_hours").over(Window.partitionBy(*keys, F.to_date("started_at")))
    return sessions.withColumn("hours", F.col("raw_hours") * F.when(day > p.cap_hours, F.lit(p.cap_hours) / day).otherwise(1.0))


def _sessions(cells: DataFrame, keys: list[str], p: Params) -> DataFrame:
    lead = F.expr(f"INTERVAL {p.lead_in_minutes} MINUTES")
    grouped = cells.groupBy(*keys, "_session").agg((F.min("_first") - lead).alias("started_at"), F.max("_last").alias("ended_at"), F.sum("n_events").alias("n_events"))
    return _capped(grouped.withColumn("raw_hours", hours_between("started_at", "ended_at")), keys, p)


def sessions(events: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One row per actor and session: started_at, ended_at, n_events, raw_hours, hours (capped)."""
    return _sessions(_gapped(_cells(events, [], p.gap_minutes)).withColumn("_session", _number(p.gap_minutes)), ["actor_hash"], p)


def work_sessions(events: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Sessions split over work items by their share of events, with ids that a rerun repeats."""
    by_item = _cells(events, ["work_item_id"], p.gap_minutes)
    cells = by_item.groupBy("actor_hash", "_cell").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.sum("n_events").alias("n_events"))
    numbered = _gapped(cells).withColumn("_session", _number(p.gap_minutes))
    same = (F.col("i.actor_hash") == F.col("c.actor_hash")) & F.col("i._cell").eqNullSafe(F.col("c._cell"))
    placed = by_item.alias("i").join(numbered.alias("c"), same).select("i.actor_hash", "_session", "work_item_id", "i.n_events")
    per_item = placed.groupBy("actor_hash", "_session", "work_item_id").agg(F.sum("n_events").alias("n_events"))
    whole = _sessions(numbered, ["actor_hash"], p).withColumnRenamed("n_events", "n_all")
    split = per_item.join(whole, ["actor_hash", "_session"])
    return split.select(
        evidence_id("actor_hash", iso_utc("started_at"), "work_item_id").alias("session_id"),
        "actor_hash",
        "work_item_id",
        "started_at",
        "ended_at",
        F.round(F.col("hours") * F.col("n_events") / F.col("n_all"), 4).alias("hours"),
        "n_events",
    )


BUCKETS = ((0.25, "<15m"), (0.5, "15-30m"), (1.0, "30m-1h"), (2.0, "1-2h"), (4.0, "2-4h"), (8.0, "4-8h"))


def session_distribution(sessions: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """C4: one row: n, median, mean, floor-rank 90th percentile, total hours, engineer years, and a count for each bucket."""
    chain = None
    for top, label in BUCKETS:
        chain = F.when(F.col("hours") < top, label) if chain is None else chain.when(F.col("hours") < top, label)
    labels = [label for _, label in BUCKETS] + ["8h+"]
    counts = [F.count(F.when(F.col("bucket") == label, 1)).alias(f"n_{i}") for i, label in enumerate(labels)]
    facts = [F.count("*").alias("n_sessions"), F.avg("hours").alias("mean_hours"), F.sum("hours").alias("total_hours"), (F.sum("hours") / p.hours_per_engineer_year).alias("engineer_years"), *counts]
    return with_ranks(sessions.withColumn("bucket", chain.otherwise("8h+")), [], "hours", facts, {"median_hours": (0.5, "between"), "p90_hours": (0.9, "floor")})


def gap_sweep(events: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Sessions and hours at each gap setting, all settings in one job."""
    return _swept(events, p).groupBy("gap_minutes").agg(F.count("*").alias("n_sessions"), F.sum("hours").alias("hours"))


def _swept(events: DataFrame, p: Params) -> DataFrame:
    """Sessions at every gap setting: cells of the shortest gap serve all settings, with a running number for each."""
    gapped = _gapped(_cells(events, [], min(p.gap_sweep)))
    numbers = F.array(*[F.struct(F.lit(g).alias("gap_minutes"), _number(g).alias("_session")) for g in p.gap_sweep])
    numbered = gapped.withColumn("s", numbers).select("actor_hash", "_first", "_last", "n_events", F.inline("s"))
    return _sessions(numbered, ["gap_minutes", "actor_hash"], p)


def spend_sweep(events: DataFrame, actors: DataFrame, rates: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """What the sessions of each gap setting cost, and how many have no rate."""
    priced = _swept(events, p).join(actors.select("actor_hash", "role_band"), "actor_hash", "left").join(F.broadcast(rates.select("role_band", "hourly")), "role_band", "left")
    return priced.groupBy("gap_minutes").agg(F.sum(F.col("hours") * F.col("hourly").cast("double")).alias("cost"), F.count(F.when(F.col("hourly").isNull(), 1)).alias("unpriced_sessions"))


