"""Process discovery: from the event log to sequences, transitions, variants and the priced process map.

Input columns: events(event_id, work_item_id, actor_hash, activity, ts, duration_s, source, attrs), items(work_item_id,
repo, component, sprint, case_source, jira_key, opened_at, jira_created_at, ...), case_cost(work_item_id, total_cost).
Everything that orders a case does so by (ts, event_id), so that ties have one order. Cases of more than `rows` events are
ordered in cells (functions/cells.py), so none is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells
from ..functions.cells import in_cells
from ..functions.exprs import count_if, hours_between, is_in, sorted_list
from ..functions.joins import measured
from ..functions.ranks import with_ranks
from ..params import DEFAULT, REVIEWS, Params


CASE, ORDER = "work_item_id", ["ts", "event_id"]


def first_time(activity: str):
    return F.min(F.when(F.col("activity") == activity, F.col("ts")))


def canonical_log(events: DataFrame, items: DataFrame, cutoff: str | None = None, rows: int = cells.ROWS) -> DataFrame:
    """Events with their case's attributes, the connector they came from, whether they fall in the window, and their step."""
    source = F.coalesce(F.col("attrs.ingest_source"), F.when(F.col("activity") == "commit", "git_local"), F.col("source"))
    known = items.select("work_item_id", "repo", "component", "sprint", "case_source", "jira_key")
    numbered = cells.numbered(cells.with_facts(in_cells(events, CASE, ORDER, rows), known, CASE), [CASE], [*ORDER], "step")
    return numbered.select(
        "event_id",
        F.col("work_item_id").alias("case_id"),
        "activity",
        "ts",
        F.col("actor_hash").alias("resource"),
        "duration_s",
        "source",
        source.alias("ingest_source"),
        "repo",
        "component",
        "sprint",
        "case_source",
        "jira_key",
        (F.lit(True) if cutoff is None else F.col("ts") >= F.lit(cutoff).cast("timestamp_ntz")).alias("in_window"),
        "step",
    )


def case_evidence(log: DataFrame, items: DataFrame) -> DataFrame:
    """Which sources proved something about each case, and its first commit, merge and ticket."""

    def first(activity: str, name: str):
        return first_time(activity).alias(name)

    def has(source: str, name: str):
        return F.bool_or(F.col("ingest_source") == source).alias(name)

    facts = log.groupBy("case_id").agg(
        F.count("*").alias("n_events"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"),
        has("git_local", "has_git"), has("github_graphql", "has_pr"), has("github_actions", "has_ci"), has("asf_jira", "has_jira"),
        count_if(~F.col("in_window")).alias("n_pre_window"), first("commit", "first_commit_at"), first("merged", "merged_at"), first("ticket_created", "ticket_created_at"),
    )
    cases = items.select(F.col("work_item_id").alias("case_id"), "repo", "component", "sprint", "case_source")
    out = cases.join(facts, "case_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_events", "n_pre_window")})


def event_sequence(events: DataFrame, rows: int = cells.ROWS) -> DataFrame:
    """Each event with the activity, time and actor of the next one on its case."""
    new = {f"next_{c}": c for c in ("activity", "ts", "actor_hash", "event_id")}
    return cells.following(in_cells(events, CASE, ORDER, rows), [CASE], ORDER, new).select("event_id", CASE, "actor_hash", "activity", "ts", *new)


def transitions(events: DataFrame, rows: int = cells.ROWS) -> DataFrame:
    """Raw directly-follows pairs with the gap between them."""
    pairs = event_sequence(events, rows).where("next_activity is not null")
    return pairs.select("work_item_id", F.col("activity").alias("source_activity"), F.col("next_activity").alias("target_activity"), F.col("ts").alias("source_ts"), F.col("next_ts").alias("target_ts"), hours_between("ts", "next_ts").alias("gap_hours"))


def path_digest(step: str, label: str):
    """A digest of labels in order, 128 bits. As a sum over (step, label) it needs no order and is combined before the shuffle."""
    return F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64(F.col(step).cast("long"), label)).alias("a"), F.bit_xor(F.xxhash64(label, F.lit("path"), F.col(step).cast("long"))).alias("b")).alias("path")


def spelled(steps: DataFrame, cases: DataFrame, step: str, label: str) -> DataFrame:
    """The labels in order, as an array, of the given cases only: those that stand for all cases of one path."""
    own = steps.join(cases.select(CASE), CASE, "left_semi")
    return own.groupBy(CASE).agg(sorted_list([step], label).alias("activity_sequence"))


def by_path(paths: DataFrame, steps: DataFrame, step: str, label: str) -> DataFrame:
    """The array of each path (column path of `paths`), spelled once, from the case that comes first."""
    first = paths.groupBy("path").agg(F.min(CASE).alias(CASE))
    return first.join(spelled(steps, first, step, label), CASE).select("path", "activity_sequence")


def case_sequence(events: DataFrame, items: DataFrame, rows: int = cells.ROWS) -> DataFrame:
    """P5: a case's ordered activities, their digest, and its extent. Cases of one path share the array, which only one of them gathers."""
    steps = cells.numbered(in_cells(events, CASE, ORDER, rows), [CASE], [*ORDER], "_step")
    paths = steps.groupBy(CASE).agg(path_digest("_step", "activity"), F.count("*").alias("n_events"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"))
    arrays = by_path(paths, steps, "_step", "activity").withColumn("variant_id", F.md5(F.array_join("activity_sequence", ">")))
    return paths.join(arrays, "path").drop("path").join(items.select(CASE, "repo", "component", "sprint"), CASE)


def cycle_time(events: DataFrame, items: DataFrame) -> DataFrame:
    """From first commit to first merge, where that is positive."""
    times = events.groupBy("work_item_id").agg(first_time("commit").alias("first_commit_at"), first_time("merged").alias("merged_at"))
    done = times.where("merged_at > first_commit_at").join(items.select("work_item_id", "repo", "component", "sprint"), "work_item_id")
    return done.withColumn("cycle_hours", hours_between("first_commit_at", "merged_at"))


def rework_pairs(events: DataFrame) -> DataFrame:
    """A request for changes directly followed by a commit. The redoer is found by time: commits at one instant give a row each."""
    pairs = transitions(events).where("source_activity = 'changes_requested' and target_activity = 'commit'")
    commits = events.where("activity = 'commit'").select("work_item_id", F.col("ts").alias("target_ts"), F.col("actor_hash").alias("redone_by"))
    return pairs.join(commits, ["work_item_id", "target_ts"]).select("work_item_id", F.col("source_ts").alias("changes_requested_at"), F.col("target_ts").alias("redo_commit_at"), "gap_hours", "redone_by")


def review_latency(events: DataFrame, rows: int = cells.ROWS) -> DataFrame:
    """From a request for review to the first response strictly after it.

    A running minimum from the case's end backwards takes the place of a self-join, in time linear in its events;
    requests at one instant are one request. In a case of cells the minimum runs within each one, over instants, and
    behind it the least response of all later cells is the next one.
    """
    timed = in_cells(events.where(is_in("activity", ("review_requested", *REVIEWS))), CASE, ["ts"], rows)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    response = F.when(is_in("activity", REVIEWS), F.col("ts"))
    if not cells.cell(timed):
        later = Window.partitionBy(CASE).orderBy(F.col("at").desc()).rangeBetween(Window.unboundedPreceding, -1)
        answered = timed.withColumn("at", at).withColumn("responded_at", F.min(response).over(later)).where("activity = 'review_requested' and responded_at is not null")
        once = answered.groupBy(CASE, F.col("ts").alias("requested_at")).agg(F.min("responded_at").alias("responded_at"))
        return once.withColumn("latency_hours", hours_between("requested_at", "responded_at"))
    instants = timed.groupBy(CASE, "ts").agg(F.min(cells.CELL).alias(cells.CELL), F.bool_or(F.col("activity") == "review_requested").alias("asked"), F.min(response).alias("response"))
    later = Window.partitionBy(CASE, cells.CELL).orderBy("ts").rowsBetween(1, Window.unboundedFollowing)
    own = instants.withColumn("responded_at", F.min("response").over(later)).where("asked")
    behind = F.min("_least").over(Window.partitionBy(CASE).orderBy(cells.CELL).rowsBetween(1, Window.unboundedFollowing))
    carried = instants.where(F.col(cells.CELL) > 0).groupBy(CASE, cells.CELL).agg(F.min("response").alias("_least")).withColumn("_behind", behind)
    answered = own.join(measured(cells.cut(carried.drop("_least"))), [CASE, cells.CELL], "left")
    answered = answered.select(CASE, F.col("ts").alias("requested_at"), F.coalesce("responded_at", "_behind").alias("responded_at")).where("responded_at is not null")
    return answered.withColumn("latency_hours", hours_between("requested_at", "responded_at"))


def review_latency_both(events: DataFrame, items: DataFrame, rows: int = cells.ROWS) -> DataFrame:
    """Both definitions of review latency, told apart by a column."""
    asked = review_latency(events, rows).select(F.lit("requested_to_first_response").alias("definition"), "work_item_id", "latency_hours")
    first = events.where("activity = 'review'").groupBy("work_item_id").agg(F.min("ts").alias("first_review"))
    opened = items.select("work_item_id", "opened_at").join(first, "work_item_id").where("first_review > opened_at")
    return asked.unionByName(opened.select(F.lit("pr_opened_to_first_review").alias("definition"), "work_item_id", hours_between("opened_at", "first_review").alias("latency_hours")))


def backlog_time(events: DataFrame, items: DataFrame) -> DataFrame:
    """P10: from a ticket's creation to the case's first commit, with priority and type."""
    first = events.where("activity = 'commit'").groupBy("work_item_id").agg(F.min("ts").alias("first_commit_at"))
    waited = items.join(first, "work_item_id").where("first_commit_at > jira_created_at")
    return waited.select("work_item_id", "repo", "component", hours_between("jira_created_at", "first_commit_at").alias("backlog_hours"), "priority", "issue_type")


def collapsed_sequence(events: DataFrame, rows: int = cells.ROWS) -> DataFrame:
    """Runs of one activity become a node with a repeat count; CI runs are left out. Nodes are ordered by their first event.

    Events of one run have the same difference between their number in the case and their number among those of their
    activity, also where the run goes on in the next cell. The nodes of a case in cells keep the cell of their first event.
    """
    human = in_cells(events.where("activity != 'ci_run'"), CASE, ORDER, rows)
    placed = cells.numbered(cells.numbered(human, [CASE], [*ORDER], "_at"), [CASE, "activity"], [*ORDER], "_same")
    first = [F.min(c).alias(c) for c in cells.cell(placed)]
    nodes = placed.groupBy(CASE, "activity", (F.col("_at") - F.col("_same")).alias("run_id")).agg(F.min(F.struct(*ORDER)).alias("begin"), F.max("ts").alias("ended_at"), F.count("*").alias("repeat_count"), *first)
    return cells.numbered(nodes, [CASE], ["begin"], "node_step").select(CASE, "activity", "run_id", F.col("begin.ts").alias("started_at"), "ended_at", "repeat_count", "node_step", *cells.cell(nodes))


def human_transitions(nodes: DataFrame) -> DataFrame:
    """From each collapsed node to the next (null after the last); the gap runs from the end of one to the start of the other."""
    nexts = cells.following(nodes, [CASE], ["node_step"], {"target_activity": "activity", "target_started_at": "started_at"})
    return nexts.select(CASE, F.col("activity").alias("source_activity"), "target_activity", F.col("started_at").alias("source_started_at"), "target_started_at", hours_between("ended_at", "target_started_at").alias("gap_hours"), *cells.cell(nodes))


def edges(moves: DataFrame, items: DataFrame, case_cost: DataFrame) -> DataFrame:
    """Directly-follows edges by repository with their median gap and the cost of all cases that took them, each case once."""
    key = ["repo", "source_activity", "target_activity"]
    labelled = cells.with_facts(moves.where("target_activity is not null"), items.select("work_item_id", "repo"), CASE)
    by_case = labelled.dropna(subset=key).groupBy(*key, "work_item_id").agg(F.count("*").alias("n"))
    exposed = by_case.join(case_cost.select("work_item_id", "total_cost"), "work_item_id", "left").groupBy(*key)
    exposed = exposed.agg(F.sum("n").alias("n_transitions"), F.count("*").alias("n_cases"), F.sum(F.coalesce("total_cost", F.lit(0).cast("decimal(18,2)"))).alias("case_cost_exposure"))
    gaps = with_ranks(labelled, key, "gap_hours", [], {"median_gap_hours": (0.5, "between")})
    return exposed.join(gaps, key, "left")


def significant_edges(edges: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Edges that make up the first `significance_pct` of the weight: cost, or frequency where nothing is priced.

    The edge that crosses the line is left out. There are few edges, so one ordered window over them all is enough.
    """
    whole = Window.partitionBy(F.lit(0))
    weight = F.when(F.sum("case_cost_exposure").over(whole) > 0, F.col("case_cost_exposure").cast("double")).otherwise(F.col("n_transitions").cast("double"))
    weighed = edges.withColumn("weight", weight)
    running = Window.partitionBy(F.lit(0)).orderBy(F.col("weight").desc(), "repo", "source_activity", "target_activity")
    shared = weighed.withColumn("running_pct", 100.0 * F.sum("weight").over(running) / F.nullif(F.sum("weight").over(whole), F.lit(0.0)))
    return shared.where(F.col("running_pct") <= p.significance_pct)


def labelled(nodes: DataFrame) -> DataFrame:
    repeats = F.when(F.col("repeat_count") > 1, F.concat(F.lit("x"), F.col("repeat_count"))).otherwise("")
    return nodes.withColumn("label", F.concat("activity", repeats))


def case_paths(nodes: DataFrame, items: DataFrame, case_cost: DataFrame) -> DataFrame:
    """A case's collapsed path as a digest, with its cost; the path itself is not gathered."""
    paths = labelled(nodes).groupBy(CASE).agg(path_digest("node_step", "label"))
    priced = paths.join(items.select(CASE, "repo"), CASE).join(case_cost.select(CASE, "total_cost"), CASE, "left")
    return priced.select(CASE, "repo", "path", F.coalesce("total_cost", F.lit(0).cast("decimal(18,2)")).alias("case_cost"))


def case_variant(nodes: DataFrame, items: DataFrame, case_cost: DataFrame) -> DataFrame:
    """A case's collapsed path as an array and a key, with its cost. Cases of one path share the array, which only one of them gathers."""
    paths = case_paths(nodes, items, case_cost)
    arrays = by_path(paths, labelled(nodes), "node_step", "label")
    return paths.join(arrays, "path").select(CASE, "repo", F.array_join("activity_sequence", ">").alias("variant_key"), "activity_sequence", "case_cost")


def variants(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Variants by repository, with their share of its cost; the most frequent ones are modal (several on ties).

    paths: of `case_paths`. Cases are grouped by the digests of their paths; one case of each variant spells it out.
    """
    grouped = paths.groupBy("repo", "path").agg(F.min(CASE).alias(CASE), F.count("*").alias("n_cases"), F.sum("case_cost").alias("total_cost"))
    whole = grouped.groupBy(F.col("repo").alias("_repo")).agg(F.max("n_cases").alias("_most"), F.sum("total_cost").cast("double").alias("_all"))
    share = 100.0 * F.col("total_cost").cast("double") / F.nullif(F.col("_all"), F.lit(0.0))
    named = grouped.join(whole, F.col("repo").eqNullSafe(F.col("_repo"))).join(spelled(labelled(nodes), grouped, "node_step", "label"), CASE).withColumn("variant_key", F.array_join("activity_sequence", ">"))
    return named.select(F.md5(F.concat_ws("|", "repo", "variant_key")).alias("variant_id"), "repo", "variant_key", "activity_sequence", "n_cases", "total_cost", F.round(share, 2).alias("cost_share_pct"), (F.col("n_cases") == F.col("_most")).alias("is_modal"))


def rare_but_costly(variants: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The variants of few cases with the largest shares of cost."""
    return variants.where((F.col("n_cases") <= p.rare_cases) & (F.col("cost_share_pct") > 0)).orderBy(F.col("cost_share_pct").desc(), "variant_id").limit(p.rare_limit)


def variant_class(events: DataFrame) -> DataFrame:
    """rework_loop before triple_review before happy_path, from the raw events."""
    counts = events.groupBy("work_item_id").agg(count_if(F.col("activity") == "changes_requested").alias("changes"), count_if(F.col("activity") == "review").alias("reviews"))
    return counts.select("work_item_id", F.when(F.col("changes") > 0, "rework_loop").when(F.col("reviews") >= 3, "triple_review").otherwise("happy_path").alias("variant_class"))


def edges_by_class(moves: DataFrame, classes: DataFrame, items: DataFrame, case_cost: DataFrame) -> DataFrame:
    """Edges by repository and class, a case's cost split evenly over its transitions."""
    # counted by case and edge first: a case has no more rows here than there are pairs of activities
    taken = moves.where("target_activity is not null").groupBy(CASE, "source_activity", "target_activity").agg(F.count("*").alias("n"))
    owned = taken.withColumn("n_own", F.sum("n").over(Window.partitionBy(CASE)))
    known = owned.join(items.select("work_item_id", "repo"), "work_item_id").join(classes, "work_item_id").join(case_cost.select("work_item_id", "total_cost"), "work_item_id", "left")
    cost = F.coalesce(F.col("total_cost").cast("double"), F.lit(0.0)) / F.col("n_own") * F.col("n")
    return known.groupBy("repo", "variant_class", "source_activity", "target_activity").agg(F.sum("n").alias("n_transitions"), F.count("*").alias("n_cases"), F.sum(cost).alias("cost_rupees"))


def class_summary(classes: DataFrame, items: DataFrame, case_cost: DataFrame) -> DataFrame:
    """P20: cases and cost by class, and their shares of all."""
    scoped = classes.join(items.select("work_item_id"), "work_item_id").join(case_cost.select("work_item_id", "total_cost"), "work_item_id", "left")
    grouped = scoped.groupBy("variant_class").agg(F.count("*").alias("n_cases"), F.sum(F.coalesce("total_cost", F.lit(0).cast("decimal(18,2)"))).alias("total_cost"))
    whole = Window.partitionBy(F.lit(0))  # three rows at most
    cost = F.col("total_cost").cast("double")
    return grouped.select("variant_class", "n_cases", "total_cost", (F.col("n_cases") / F.sum("n_cases").over(whole)).alias("share_of_work_items"), F.coalesce(cost / F.nullif(F.sum(cost).over(whole), F.lit(0.0)), F.lit(0.0)).alias("share_of_cost"))


def process_map(by_class: DataFrame, k: int, p: Params = DEFAULT, repo: str | None = None) -> DataFrame:
    """The k costliest transitions with their classes, and the share of all cost that they cover. Excluded activities go after the split."""
    kept = by_class.where(~is_in("source_activity", p.excluded_from_map) & ~is_in("target_activity", p.excluded_from_map)) if p.excluded_from_map else by_class
    kept = kept if repo is None else kept.where(F.col("repo") == repo)
    grouped = kept.groupBy("source_activity", "target_activity", "variant_class").agg(F.sum("n_transitions").alias("frequency"), F.sum("cost_rupees").alias("cost_rupees"))
    # one pass: windows over the aggregated transitions, of which there are as many as pairs of activities and classes
    edge, whole = Window.partitionBy("source_activity", "target_activity"), Window.partitionBy(F.lit(0))
    ranked = grouped.withColumn("edge_cost", F.round(F.sum("cost_rupees").over(edge), 4)).withColumn("place", F.dense_rank().over(whole.orderBy(F.col("edge_cost").desc(), "source_activity", "target_activity")))
    shown = F.sum(F.when(F.col("place") <= k, F.col("cost_rupees"))).over(whole)
    covered = F.coalesce(shown / F.nullif(F.sum("cost_rupees").over(whole), F.lit(0.0)), F.lit(0.0))
    return ranked.withColumn("coverage", covered).where(F.col("place") <= k).drop("edge_cost", "place")


def rework_returns(log: DataFrame) -> DataFrame:
    """How often work was sent back, and on how many cases."""
    return log.where("activity = 'changes_requested'").agg(F.count("*").alias("events"), F.countDistinct("case_id").alias("cases"))


def graph_nodes(edges: DataFrame) -> DataFrame:
    """The activities that an edge touches."""
    return edges.select(F.col("source_activity").alias("activity")).union(edges.select("target_activity")).distinct()


def class_statistics(summary: DataFrame) -> DataFrame:
    """How much costlier than its share of items a class is, the share off the happy path, and all items."""
    whole = Window.partitionBy(F.lit(0))
    off = F.sum(F.when(F.col("variant_class") != "happy_path", F.col("share_of_work_items")).otherwise(0.0)).over(whole)
    return summary.select("variant_class", "n_cases", "share_of_work_items", "share_of_cost", F.coalesce(F.try_divide("share_of_cost", "share_of_work_items"), F.lit(0.0)).alias("cost_multiple"), off.alias("off_happy_path"), F.sum("n_cases").over(whole).alias("total_items"))


def merged_edges(by_class: DataFrame) -> DataFrame:
    """P25: one row per transition: cost, frequency, each class's share of its cost, and the dominant class."""
    key = ["source_activity", "target_activity"]
    grouped = by_class.groupBy(*key, "variant_class").agg(F.sum("n_transitions").alias("frequency"), F.sum("cost_rupees").alias("cost"))
    cost = F.sum("cost")
    shares = [F.coalesce(F.try_divide(F.sum(F.when(F.col("variant_class") == c, F.col("cost")).otherwise(0.0)), cost), F.lit(0.0)).alias(f"share_{c}") for c in ("happy_path", "rework_loop", "triple_review")]
    return grouped.groupBy(*key).agg(F.sum("frequency").alias("frequency"), cost.alias("cost_rupees"), *shares, F.max_by("variant_class", F.struct(F.round("cost", 4), F.col("frequency"), F.col("variant_class"))).alias("dominant_class"))
