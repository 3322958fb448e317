"""Small cases with known answers, and properties that must hold whatever the input."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta

import hashlib
import random

import pytest
from loomline.operators import capacity, cost, effort, normalise, privacy, process, quality, staffing, waste
from loomline.functions import cells
from loomline.functions.joins import measured
from loomline.functions.ranks import ordered_bits, with_ranks
from loomline.params import Citation, Params
from loomline.sources import keyed_log, landing, sample_log
from loomline.streaming import streams
from pyspark.sql import functions as F

START = datetime(2024, 1, 1, 12)
EVENTS = "event_id string, work_item_id string, actor_hash string, activity string, ts timestamp_ntz"


def at(minutes: float) -> datetime:
    return START + timedelta(minutes=minutes)


def events(spark, rows):
    return spark.createDataFrame([(f"e{i:04}", c, a, k, at(m)) for i, (c, a, k, m) in enumerate(rows)], EVENTS)


def commits(spark, minutes, actor="a"):
    return events(spark, [("x", actor, "commit", m) for m in minutes])


@pytest.mark.parametrize(("minutes", "n"), [([0, 90], 1), ([0, 91], 2), ([0, 200], 2), ([0, 90, 180], 1)])
def test_gap_is_exclusive(spark, minutes, n):
    assert effort.sessions(commits(spark, minutes), Params(gap_minutes=90)).count() == n


@pytest.mark.parametrize("gap", [0, 7, 90])
def test_sessions_against_a_walk_over_the_events(spark, gap):
    rng = random.Random(gap)
    long_ago = -40_000_000  # minutes: cells before 1970 as well
    rows = [(rng.choice("xyz"), rng.choice("aab"), "commit", rng.choice((0, long_ago)) + rng.randrange(3_000)) for _ in range(600)]
    rows += [("x", "a", "ci_run", 5), ("x", None, "commit", 6)]
    p = Params(gap_minutes=gap, lead_in_minutes=0)
    want, items = [], []
    for actor in "ab":
        groups: list[list] = []
        for case, _, _, m in sorted((r for r in rows if r[1] == actor and r[2] != "ci_run"), key=lambda r: r[3]):
            if groups and m - groups[-1][-1][1] <= gap:
                groups[-1].append((case, m))
            else:
                groups.append([(case, m)])
        want += [(actor, at(g[0][1]), at(g[-1][1]), len(g)) for g in groups]
        items += [(actor, at(g[0][1]), c, sum(x == c for x, _ in g)) for g in groups for c in {x for x, _ in g}]
    df = events(spark, rows)
    assert sorted(map(tuple, effort.sessions(df, p).select("actor_hash", "started_at", "ended_at", "n_events").collect())) == sorted(want)
    assert sorted(map(tuple, effort.work_sessions(df, p).select("actor_hash", "started_at", "work_item_id", "n_events").collect())) == sorted(items)
    swept = {r.gap_minutes: r.n_sessions for r in effort.gap_sweep(df, Params(gap_sweep=(gap, 500), lead_in_minutes=0)).collect()}
    assert swept[gap] == len(want) and swept[500] == effort.sessions(df, Params(gap_minutes=500)).count()


def test_forecast_of_unnamed_components_and_repositories(spark):
    rows = [("r", None, float(h)) for h in range(1, 6)] + [("r", "c", 10.0), ("r", "c", 9000.0), (None, "c", 500.0), ("s", "d", -1.0)]
    df = spark.createDataFrame(rows, "repo string, component string, cycle_hours double")
    got = {(r.repo, r.component): r for r in capacity.forecast_cycle_time(df, Params(min_group_samples=6)).collect()}
    assert set(got) == {("r", None), ("r", "c")}
    assert all(r.basis == "repo" and r.n_samples == 6 and r.n_excluded == 1 and r.p50_hours == pytest.approx(3.5) for r in got.values())
    whole = capacity.forecast_cycle_time(df, Params(min_group_samples=7)).first()
    assert (whole.basis, whole.n_samples, whole.p50_hours) == ("global", 7, pytest.approx(4.0))
    assert capacity.forecast_cycle_time(df.limit(0)).collect() == []


def test_only_small_sides_are_broadcast(spark):
    df = spark.range(10).selectExpr("id", "repeat('x', 100) AS t")
    hinted = [measured(df, *bounds)._jdf.queryExecution().analyzed().toString().count("strategy=broadcast") for bounds in ((10, 2000), (9, 2000), (10, 1000))]
    assert hinted == [1, 0, 0] and measured(df.limit(0)).count() == 0


def test_lead_in(spark):
    assert effort.sessions(commits(spark, [0, 60]), Params(lead_in_minutes=30)).first().hours == pytest.approx(1.5)


def test_daily_cap_is_shared(spark):
    p = Params(gap_minutes=60, lead_in_minutes=0, cap_hours=6.0)
    spread = [m for s in (0, 310) for m in range(s, s + 241, 60)]
    assert [r.hours for r in effort.sessions(commits(spark, spread), p).collect()] == pytest.approx([3.0, 3.0])
    both = commits(spark, spread[:5]).unionByName(commits(spark, spread[5:], "b"))
    assert [r.hours for r in effort.sessions(both, p).collect()] == pytest.approx([4.0, 4.0])


def test_split_sums_back(spark, sf_dir):
    log = sample_log.event_log(spark, sf_dir)
    whole = effort.sessions(log).agg(F.sum("hours")).first()[0]
    parts = effort.work_sessions(log).agg(F.sum("hours"), F.count("*"), F.countDistinct("session_id")).first()
    assert parts[0] == pytest.approx(whole, abs=parts[1] * 5e-5) and parts[1] == parts[2]


def test_order_of_rows_does_not_matter(spark, sf_dir):
    log, items = sample_log.event_log(spark, sf_dir), sample_log.work_items(spark, sf_dir)
    shuffled = log.repartition(7).orderBy(F.rand(3))
    for f in (process.collapsed_sequence, effort.work_sessions, process.review_latency, lambda e: process.case_sequence(e, items)):
        assert sorted(map(str, f(log).collect())) == sorted(map(str, f(shuffled).collect()))


@pytest.mark.parametrize(("months", "reviews", "merged", "band"), [(30, 120, 0, "staff"), (30, 99, 0, "mid"), (12, 0, 30, "senior"), (5.9, 500, 500, "junior"), (6, 0, 0, "mid")])
def test_bands(spark, months, reviews, merged, band):
    row = spark.createDataFrame([("a", float(months), reviews, merged)], "actor_hash string, tenure_months double, reviews int, merged int")
    assert cost.assign_band(row).first().role_band == band


def test_rates(spark):
    assert {r.role_band: str(r.hourly) for r in cost.rate_card(spark).collect()} == {"junior": "1172.83", "mid": "2087.04", "senior": "3412.50", "staff": "4910.33"}
    uncited = cost.rate_card(spark, Params(rate_citation=Citation("p", "", "2026-01-01"))).collect()
    assert all(r.hourly is None and r.reason for r in uncited)
    with pytest.raises(ValueError):
        cost.rate_card(spark, Params(annual=(*Params().annual[::-1],)))
    real = ("A statistics office", "https://stats.gov.in/wages", "2026-01-01")
    assert Citation(*real).complete and Params().rate_citation.complete and Params().ci_citation.complete
    for i, texts in ((0, ("TODO", "todo: find one", "Fill me", "tbd", "none", " ")), (1, ("TODO", "change-me", "https://example.org/x", "http://www.example.com", "https://localhost/x", "https://a.test/x", "stats.gov.in", ""))):
        for text in texts:
            assert not Citation(*(text if j == i else part for j, part in enumerate(real))).complete, text
    assert not Citation("p", "u", "soon").complete and not Citation("p", "u", "2026-13-01").complete


def weekly(spark, counts, component="c"):
    return spark.createDataFrame([("r", component, (datetime(2023, 1, 2) + timedelta(weeks=i)).date(), n) for i, n in enumerate(counts) if n], "repo string, component string, week date, delivered long")


def test_backtest_of_a_steady_rate(spark):
    rows = capacity.backtest(weekly(spark, [5] * 30)).collect()
    assert rows and all(r.predicted == 20 and r.actual == 20 for r in rows)
    report = capacity.backtest_report(capacity.backtest(weekly(spark, [5] * 30))).first()
    assert report.mae == 0 and report.bias == 0 and report.band_coverage == 1


def test_backtest_does_not_see_the_future(spark):
    first, changed = ({r.fold: r.predicted for r in capacity.backtest(weekly(spark, [5] * 26 + tail)).collect()} for tail in ([5, 5, 5, 5], [50, 1, 70, 9]))
    assert first[1] == changed[1] and first[0] == changed[0]


def test_report_percentages(spark):
    rows = [(0, "r", "c", 8, 1.0, 3.0, 1, 0.0, 9.0), (0, "r", "d", 8, 1.0, 11.0, 10, 0.0, 9.0)]
    r = capacity.backtest_report(spark.createDataFrame(rows, "fold int, repo string, component string, train_weeks long, rate_per_week double, predicted double, actual long, p10 double, p90 double")).first()
    assert r.mape == pytest.approx(10) and r.n_scored_pct == 1 and r.mae == pytest.approx(1.5) and r.band_coverage == 0.5


def test_rare_but_costly(spark):
    rows = [("a", 1, 5.0), ("b", 50, 80.0), ("c", 1, 0.0)]
    assert [r.variant_id for r in process.rare_but_costly(spark.createDataFrame(rows, "variant_id string, n_cases long, cost_share_pct double")).collect()] == ["a"]


def test_dominant_edge_leaves_nothing_significant(spark):
    rows = [("r", "a", "b", 10, 1, 99.0), ("r", "b", "c", 10, 1, 1.0)]
    schema = "repo string, source_activity string, target_activity string, n_transitions long, n_cases long, case_cost_exposure double"
    assert process.significant_edges(spark.createDataFrame(rows, schema)).count() == 0
    free = spark.createDataFrame([r[:5] + (0.0,) for r in rows], schema)
    assert process.significant_edges(free).count() == 1  # by frequency, where nothing is priced


def test_runs_collapse_and_ci_is_left_out(spark):
    log = events(spark, [("x", "a", k, i) for i, k in enumerate(["commit", "commit", "ci_run", "commit", "review", "commit"])])
    nodes = process.collapsed_sequence(log).orderBy("node_step").collect()
    assert [(n.activity, n.repeat_count) for n in nodes] == [("commit", 3), ("review", 1), ("commit", 1)]


def test_latency_is_strictly_later(spark):
    log = events(spark, [("x", "a", "review_requested", 0), ("x", "b", "review_requested", 0), ("x", "c", "review", 0), ("x", "c", "approved", 30)])
    assert [(r.latency_hours) for r in process.review_latency(log).collect()] == [0.5]


def test_rework_needs_a_direct_successor(spark):
    direct = events(spark, [("x", "a", "changes_requested", 0), ("x", "b", "commit", 60)])
    apart = events(spark, [("x", "a", "changes_requested", 0), ("x", None, "ci_run", 5), ("x", "b", "commit", 60)])
    assert process.rework_pairs(direct).first().redone_by == "b" and process.rework_pairs(apart).count() == 0


def test_waste_without_rows(spark):
    empty = spark.createDataFrame([], "work_item_id string, repo string, component string, backlog_hours double, priority string, issue_type string")
    assert waste.backlog_segments(empty).count() == 0
    pairs = spark.createDataFrame([], "work_item_id string, gap_hours double, redone_by string")
    row = waste.rework_cost(pairs, spark.createDataFrame([], "actor_hash string, role_band string"), cost.rate_card(spark)).first()
    assert (row.n_pairs, row.total_hours, row.total_cost, row.reason) == (0, 0.0, 0.0, None)


def test_ci_waste_price(spark):
    from decimal import Decimal

    minutes = spark.createDataFrame([(60.0, 40.0, 100.0)], "rerun_minutes double, failure_minutes double, total_minutes double")
    good = waste.ci_waste_priced(minutes, Params(ci_per_minute=Decimal("0.5"))).first()
    assert float(good.cost) == 50.0 and good.cost_reason is None and good.carbon_kg is None and good.carbon_reason
    bad = waste.ci_waste_priced(minutes, Params(ci_citation=Citation())).first()
    assert bad.cost is None and bad.cost_reason


def test_grid_refuses_and_grows(spark):
    rows = [("r", "a", 6, 20, 2.0, 0.3, 900.0, 10.0, 5), ("r", "b", 5, 30, 1.0, 0.5, 800.0, 10.0, 5), ("r", "c", 1, 3, 0.0, 0.5, None, 10.0, 5)]
    df = spark.createDataFrame(rows, "repo string, component string, n_engineers long, open_items long, items_per_week double, throughput_cv double, cost double, span_weeks double, closed_items long")
    grid = capacity.reallocation_grid(df, (0, 1, 2, 6)).collect()
    get = {(r.source_component, r.dest_component, r.n): r for r in grid}
    assert len(grid) == 36 and get["a", "a", 1].refusal == "same component" and get["a", "b", 0].refusal and get["a", "b", 6].refusal == "would empty the source" and get["a", "c", 1].refusal == "no observed delivery rate"
    assert get["a", "b", 1].source_delta_weeks < get["a", "b", 2].source_delta_weeks and get["a", "b", 1].dest_delta_weeks > get["a", "b", 2].dest_delta_weeks and get["a", "b", 1].priced


def test_pseudonyms(spark):
    import hashlib

    df = spark.createDataFrame([(" Ada ",), ("ada",), ("",), (None,)], "login string")
    want = hashlib.sha256(b"adasalt").hexdigest()[:16]
    assert [r.actor_hash for r in privacy.pseudonymise(df, "login", "salt").collect()] == [want, want]


def test_redaction(spark):
    rows = [("mail ada@x.org and ask Ada or adam, @bob-2 and x@y", ["ada", "ad"]), (None, ["a"]), ("$1 a.b \\ @", ["a.b"]), ("plain", None)]
    out = [r.t for r in privacy.redact(spark.createDataFrame(rows, "t string, l array<string>"), "t", "l", "s").collect()]
    h = lambda x: spark.range(1).select(F.substring(privacy.pseudonym(F.lit(x), "s"), 1, 8)).first()[0]
    assert out == [f"mail <email-redacted> and ask {h('ada')} or adam, @{h('bob-2')} and x@y", None, f"$1 {h('a.b')} \\ @", "plain"]


def test_gates(spark):
    clean = spark.createDataFrame([("0" * 15, 1)], "note string, n int")
    assert privacy.assert_published(clean) is clean and privacy.assert_no_identity(clean, strict=True) is clean
    for bad in (spark.createDataFrame([("f" * 16,)], "note string"), spark.createDataFrame([("x",)], "actor_hash string")):
        with pytest.raises(privacy.IdentityLeak):
            privacy.assert_published(bad)
    with pytest.raises(privacy.IdentityLeak):
        privacy.assert_no_identity(spark.createDataFrame([((("x",),),)], "a struct<b:struct<user_name:string>>"))
    with pytest.raises(privacy.IdentityLeak):
        privacy.assert_no_identity(spark.createDataFrame([("me@x.org",)], "note string"), strict=True)
    people = privacy.identity_map(spark.createDataFrame([("Ada", "git", START)], "login string, source string, first_seen timestamp"), "s1")
    privacy.assert_same_salt(people, "s1")
    with pytest.raises(ValueError):
        privacy.assert_same_salt(people, "s2")


def test_guard(spark):
    some, none = spark.createDataFrame([("a",)], "event_id string"), spark.createDataFrame([], "event_id string")
    assert quality.guard(some, none) == 1
    for candidates, referenced in ((none, none), (some, some)):
        with pytest.raises(ValueError):
            quality.guard(candidates, referenced)


def test_vocabulary_splits_rows(spark):
    df = spark.createDataFrame([("commit",), ("guess",), (None,)], "activity string")
    good, bad = quality.split_valid(df, "activity", ("commit", "merged"))
    assert [r.activity for r in good.collect()] == ["commit"] and {r.activity for r in bad.collect()} == {"guess", None}


def test_umbrella_without_a_scale(spark):
    rows = [("a", "pr", START, START), ("b", "pr", START, at(600)), ("c", "pr", START, START), ("d", "pr", START, None)]
    items = spark.createDataFrame(rows, "work_item_id string, case_source string, opened_at timestamp_ntz, closed_at timestamp_ntz")
    prs = spark.createDataFrame([("d", 8), ("a", 7)], "work_item_id string, n_prs long")
    assert [r.work_item_id for r in quality.umbrellas(items, prs).collect()] == ["d"]


def test_components(spark):
    rows = [(["b/x", "a/y"],), (["b/x", "b/z", "a/y"],), (["x", "y", "a/y"],), ([],), (None,)]
    out = spark.createDataFrame(rows, "f array<string>").select(normalise.component("f").alias("c")).collect()
    assert [r.c for r in out] == ["a", "b", "(root)", None, None]


def test_identity_keys(spark):
    rows = [("123+Ada@users.noreply.github.com", "x"), ("bob@users.noreply.github.com", "x"), ("Eve@apache.org", "x"), ("Me@Home.org", "x"), ("", " Some Name "), (None, None)]
    out = spark.createDataFrame(rows, "email string, name string").select(normalise.identity_key().alias("k")).collect()
    assert [r.k for r in out] == ["ada", "bob", "eve", "me@home.org", "some name", ""]


def test_both_offset_styles(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05.000+0000",), ("soon",), (None,)], "s string").select(normalise.stamp("s").alias("t"))
    got = [r.t for r in df.collect()]
    assert got[0] == got[1] and got[0] is not None and got[2] is None and got[3] is None


ENVELOPE = "source string, entity_type string, entity_id string, fetched_at timestamp, body string"


def landed_rows(spark, path):
    return sorted((r.source, r.entity_id, r.body) for r in landing.raw_log(spark, path).read().collect())


def test_landing_is_idempotent_and_pruned(spark, tmp_path):
    rows = [("git", "commit", "1", at(0), "old"), ("git", "commit", "2", at(0), "old"), ("jira", "issue", "1", at(0), "old")]
    path = str(tmp_path / "raw")
    landing.write_raw(spark.createDataFrame(rows, ENVELOPE), path)
    newer = spark.createDataFrame([("git", "commit", "1", at(5), "new"), ("git", "commit", "2", at(-5), "older")], ENVELOPE)
    merge = streams.land(path, "fetch")
    for _ in range(2):
        merge(newer, 0)
        assert landed_rows(spark, path) == [("git", "1", "new"), ("git", "2", "old"), ("jira", "1", "old")]
    assert landing.raw_log(spark, path).versions() == [1, 2]
    only = landing.raw(spark, path, "git", "commit")
    assert only.count() == 2 and only.inputFiles() and all("_cell=git" in f for f in only.inputFiles())
    assert landing.raw(spark, path, "git", "none").count() == 0 and landing.raw(spark, str(tmp_path / "none"), "git", "commit").count() == 0


def test_empty_batches_change_nothing(spark, tmp_path):
    path, merge = str(tmp_path / "raw"), streams.land(str(tmp_path / "raw"))
    empty, one = spark.createDataFrame([], ENVELOPE), spark.createDataFrame([("git", "commit", "1", at(0), "v")], ENVELOPE)
    merge(empty, 0)
    assert landing.raw_log(spark, path).versions() == []
    for batch in (one, empty, one, empty):
        merge(batch, 1)
        assert landed_rows(spark, path) == [("git", "1", "v")]


def test_a_batch_writes_its_own_rows_only(spark, tmp_path):
    """Files and bytes of a batch of one row, beside a log of 2,000: one cell is written, none is read or rewritten."""
    log = landing.raw_log(spark, str(tmp_path / "raw"))
    log.upsert(spark.createDataFrame([("git", "commit", str(i), at(0), "x" * 100) for i in range(2000)], ENVELOPE))
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "raw" / "data").rglob("*.parquet")}
    log.upsert(spark.createDataFrame([("git", "commit", "7", at(1), "changed")], ENVELOPE))
    now = {f: f.stat().st_mtime_ns for f in (tmp_path / "raw" / "data").rglob("*.parquet")}
    assert files.items() <= now.items() and len(now) == len(files) + 1
    assert sum(f.stat().st_size for f in now.keys() - files.keys()) < sum(f.stat().st_size for f in files) / 10
    assert {b: len(c) for b, c in log.manifest()["cells"].items() if len(c) > 1} and sum(len(c) for c in log.manifest()["cells"].values()) == 17
    assert {r.entity_id: r.body for r in log.read().where("body = 'changed'").collect()} == {"7": "changed"} and log.read().count() == 2000


def test_a_crash_before_the_switch_leaves_the_old_version(spark, tmp_path, monkeypatch):
    log = landing.raw_log(spark, str(tmp_path / "raw"))
    log.upsert(spark.createDataFrame([("git", "commit", "1", at(0), "old")], ENVELOPE), ("w", 0))
    new = spark.createDataFrame([("git", "commit", "1", at(1), "new"), ("git", "issue", "2", at(1), "new")], ENVELOPE)
    with monkeypatch.context() as m:
        m.setattr(type(log), "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("crash")))
        for change in (lambda: log.upsert(new, ("w", 1)), lambda: log.replace(new)):
            with pytest.raises(RuntimeError, match="crash"):
                change()
    assert log.versions() == [1] and landed_rows(spark, log.path) == [("git", "1", "old")]
    assert log.upsert(new, ("w", 1)) and landed_rows(spark, log.path) == [("git", "1", "new"), ("git", "2", "new")]
    assert not log.upsert(spark.createDataFrame([("git", "commit", "1", at(9), "replayed")], ENVELOPE), ("w", 1)) and log.read(version=1).first().body == "old"


def test_two_writers_and_merged_cells(spark, tmp_path):
    """A version is committed once; many pieces are merged in full cells only; unused folders go."""
    log = replace(landing.raw_log(spark, str(tmp_path / "raw")), buckets=4, most_pieces=3)
    first = spark.createDataFrame([("git", "commit", str(i), at(0), "0") for i in range(40)], ENVELOPE)
    log.upsert(first)
    with pytest.raises(keyed_log.Conflict):
        log._commit(log.manifest())
    for n in range(1, 6):
        log.upsert(spark.createDataFrame([("git", "commit", "3", at(n), str(n))], ENVELOPE))
    pieces = sorted(len(c) for c in log.manifest()["cells"].values())
    assert pieces[:3] == [1, 1, 1] and pieces[3] <= 3
    rows = {r.entity_id: r.body for r in log.read().collect()}
    assert len(rows) == 40 and rows["3"] == "5"
    assert log.vacuum(keep=1) > 0 and len(log.versions()) == 1 and {r.entity_id: r.body for r in log.read().collect()} == rows
    log.replace(spark.createDataFrame([("git", "commit", "9", None, "only"), ("git", "commit", "9", at(0), "dated")], ENVELOPE))
    assert landed_rows(spark, log.path) == [("git", "9", "dated")]


def test_exact_ranks(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([0.0, 1.5, 2.25, 2.2500001, rng.uniform(-3, 400)])) for g in "abc" for _ in range(rng.choice([1, 2, 9, 60]))]
    df = spark.createDataFrame([*rows, ("a", None)], "g string, v double")
    got = {r.g: r for r in with_ranks(df, ["g"], "v", [F.count("*").alias("n")], {"m": (0.5, "between"), "q": (0.9, "nearest"), "f": (0.9, "floor")}).collect()}
    for g in "abc":
        v = sorted(x for k, x in rows if k == g)
        n = len(v) - 1
        low, high = v[n // 2], v[-(-n // 2)]
        assert got[g].n == len(v) + (g == "a") and abs(got[g].m - (low + high) / 2) < 1e-9
        assert got[g].q == v[round(0.9 * n)] and got[g].f == v[int(0.9 * n)]
    alone = with_ranks(df.limit(0), [], "v", [F.count("*").alias("n")], {"m": (0.5, "between")}).collect()
    assert not alone or alone[0].m is None


def test_streamed_landing(spark, tmp_path):
    schema = ENVELOPE
    for i in range(2):
        spark.createDataFrame([("git", "commit", "1", at(i), f"v{i}")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    run = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).writeStream.foreachBatch(streams.land(str(tmp_path / "raw"))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert [r.body for r in landing.raw(spark, str(tmp_path / "raw"), "git", "commit").collect()] == ["v1"]
    assert len(landing.raw_log(spark, str(tmp_path / "raw")).manifest()["batches"]) == 1


def test_tables_are_rewritten_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    for values in ([(1, "a"), (2, "b")], [(3, "b")]):
        landing.write_table(spark.createDataFrame(values, "n int, p string"), path, ("n",), "p")
    log = landing.derived_log(spark, path, ("n",), "p")
    assert sorted((r.n, r.p) for r in log.read().collect()) == [(1, "a"), (3, "b")]
    landing.upsert_table(spark.createDataFrame([(1, "a"), (4, "a")], "n int, p string"), path, ("n",), "p")
    assert sorted((r.n, r.p) for r in log.read().collect()) == [(1, "a"), (3, "b"), (4, "a")]
    whole = str(tmp_path / "w")
    for values in ([(1, "a")], [(2, "b")], []):
        landing.write_table(spark.createDataFrame(values, "n int, p string"), whole, ("n",))
        assert [tuple(r) for r in landing.derived_log(spark, whole, ("n",)).read().collect()] == values


def test_commit_log_from_a_file(spark, tmp_path):
    text = "@@@s1|2024-01-01T10:00:00+02:00|2024-01-01T10:00:00+02:00|a@x.org|A|p|sub|ject\n3\t1\ta/{b => c}/d.py\n-\t-\tx => y\n\n@@@s2|2024-01-02T10:00:00+00:00|2024-01-02T10:00:00+00:00|b@x.org|B||plain\n"
    (tmp_path / "log.txt").write_text(text)
    rows = {r.sha: r for r in landing.parse_commits(landing.read_commit_log(spark, str(tmp_path))).collect()}
    assert rows["s1"].files == ["a/c/d.py", "y"] and (rows["s1"].additions, rows["s1"].deletions, rows["s1"].subject) == (3, 1, "sub|ject")
    assert rows["s2"].files == [] and rows["s2"].parents == [] and rows["s1"].authored_at == datetime(2024, 1, 1, 8)


def test_commits_from_two_sources_converge(spark):
    a = spark.createDataFrame([("s1", START, "c", "a", "r")], "sha string, authored_at timestamp, work_item_id string, actor_hash string, repo string")
    b = spark.createDataFrame([("r", 1, "c", [(("s1", "2024-01-01T12:00:00Z", (("User", False, "a"),)),)])], "repo string, number int, work_item_id string, c array<struct<commit:struct<oid:string,authoredDate:string,author:struct<user:struct<__typename:string,is_bot:boolean,actor_hash:string>>>>>")
    both = normalise.commit_events(a).unionByName(normalise.pr_commit_events(b.select("repo", "number", "work_item_id", F.struct(F.col("c").alias("nodes")).alias("commits"))))
    assert normalise.dedup_events(both).count() == 1


def test_plans_stay_native(spark, sf_dir):
    """No Python on the executors; text scans read only the columns they need; a case's windows share one exchange."""
    log = sample_log.event_log(spark, sf_dir)
    plan = process.collapsed_sequence(log)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
    scan = process.variant_class(log)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in scan and "value" not in scan.split("ReadSchema")[1].split("\n")[0]
    assert process.event_sequence(log)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_redaction_beside_letters_beyond_ascii(spark):
    rows = [("éana@x.org", []), ("ana@x.orgé", []), ("mél@x.org", []), ("écrire à jo@x.org.", [])]
    out = [r.t for r in privacy.redact(spark.createDataFrame(rows, "t string, l array<string>"), "t", "l", "s").collect()]
    assert out == ["é<email-redacted>", "<email-redacted>é", "mé<email-redacted>", "écrire à <email-redacted>."]


def test_redaction_of_all_documents(spark, sf_dir):
    from loomline.plans import QUERIES

    rows = QUERIES["v3_redacted_documents"](spark, sf_dir)
    assert rows.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def giant_log(spark, n=3000, share=2, seed=4):
    """A log in which one case has half of all events, many of them at one instant or one after another of one activity."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        case = "giant" if i % share == 0 else f"c{rng.randrange(40)}"
        activity = rng.choice(["commit"] * 6 + ["review", "approved", "changes_requested", "review_requested", "ci_run", "merged"])
        rows.append((case, rng.choice("abc"), activity, rng.choice([float(i), float(i), 1000.0])))
    return events(spark, rows)


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.select(a.columns).collect()))


def test_giant_cases_in_cells_change_nothing(spark):
    """All orders of a case found in cells of some hundred rows equal those found in one window."""
    log = giant_log(spark)
    items = log.groupBy("work_item_id").agg(F.min("ts").alias("opened_at")).withColumns({c: F.lit(c) for c in ("repo", "component", "sprint", "case_source", "jira_key")})
    items = items.withColumn("jira_created_at", F.col("opened_at"))
    log = log.withColumns({"source": F.lit("github"), "duration_s": F.lit(1.0), "attrs": F.struct(F.lit("x").alias("ingest_source"))})
    split = cells.in_cells(log, "work_item_id", ["ts", "event_id"], 400)
    sizes = [r["count"] for r in split.where("_cell > 0").groupBy("_cell").count().collect()]
    assert len(sizes) >= 8 and max(sizes) <= 400 and sum(sizes) == 1500 and cells.in_cells(log, "work_item_id", ["ts", "event_id"]).columns == log.columns
    for f in (process.event_sequence, process.transitions, lambda e, rows: process.canonical_log(e, items, rows=rows), process.review_latency, lambda e, rows: process.case_sequence(e, items, rows), lambda e, rows: process.review_latency_both(e, items, rows)):
        assert same(f(log, rows=10**6), f(log, rows=400))
    whole, parts = process.collapsed_sequence(log), process.collapsed_sequence(log, rows=400)
    assert "_cell" in parts.columns and same(whole, parts) and same(process.human_transitions(whole), process.human_transitions(parts))
    cost_of = items.select("work_item_id", F.lit(1).cast("decimal(18,2)").alias("total_cost"))
    assert same(process.case_variant(whole, items, cost_of), process.case_variant(parts, items, cost_of))
    assert same(process.variants(process.case_paths(whole, items, cost_of), whole), process.variants(process.case_paths(parts, items, cost_of), parts))


def test_a_giant_case_leaves_no_giant_task(spark):
    """Half of a million events on one case: after the split no (case, cell) has more than a few per cent of all rows."""
    log = spark.range(1_000_000).select(F.col("id").cast("string").alias("event_id"), F.when(F.col("id") % 2 == 0, "giant").otherwise(F.concat(F.lit("c"), F.col("id") % 999)).alias("work_item_id"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") % 100_000)).alias("ts"))
    largest = cells.in_cells(log, "work_item_id", ["ts", "event_id"]).groupBy("work_item_id", "_cell").count().agg(F.max("count")).first()[0]
    assert largest <= 30_000


def test_variants_spell_one_case_each(spark):
    """Cases of one path are grouped by its digest; order and repeats count."""
    log = events(spark, [(c, "a", k, i) for c, path in (("x", "rcm"), ("y", "rcm"), ("z", "crm"), ("w", "rccm")) for i, k in enumerate({"r": "review", "c": "commit", "m": "merged"}[p] for p in path)])
    items = log.select("work_item_id").distinct().withColumn("repo", F.lit("r"))
    cost_of = items.select("work_item_id", F.lit(2).cast("decimal(18,2)").alias("total_cost"))
    nodes = process.collapsed_sequence(log)
    found = {r.variant_key: (r.n_cases, r.total_cost, r.cost_share_pct, r.is_modal) for r in process.variants(process.case_paths(nodes, items, cost_of), nodes).collect()}
    assert {k: v[0] for k, v in found.items()} == {"review>commit>merged": 2, "commit>review>merged": 1, "review>commitx2>merged": 1}
    assert found["review>commit>merged"][2:] == (50.0, True) and not found["commit>review>merged"][3]


def test_ranks_of_dense_values(spark):
    """A hundred thousand values within one thousandth: cells of the last bits decide, and no round orders all values."""
    rng = random.Random(8)
    values = [1.0 + rng.random() / 1000 for _ in range(100_000)] + [0.0, -0.0, -1e-310, 5e-324, 1e308, -1e308, float("inf"), -2.5, -2.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = with_ranks(df, [], "v", [F.count("*").alias("n")], {"m": (0.5, "between"), "low": (0.0, "floor"), "p": (0.9, "nearest")}).first()
    values.sort()
    assert got.n == len(values) and got.m == pytest.approx(values[len(values) // 2], rel=1e-12) and got.low == -1e308 and got.p == values[round(0.9 * (len(values) - 1))]


def test_bits_are_ordered_as_the_values(spark):
    rng = random.Random(9)
    values = sorted({0.0, 5e-324, 2.0**-1022, 1.0, 2.0, 3.0, 1e308, float("inf"), *(rng.choice((-1, 1)) * rng.random() * 2.0 ** rng.randint(-1070, 1000) for _ in range(3000)), *(2.0**i for i in range(-1030, 1000, 7)), *(-(2.0**i) * (1 - 2**-53) for i in range(-60, 60))})
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").withColumn("b", ordered_bits("v")).orderBy("i").collect()
    assert all(a.b < b.b for a, b in zip(rows, rows[1:]))


def test_grid_without_a_window_over_all(spark):
    rows = [("r", f"c{i}", 5, 3, 2, 2.0, 0.5, None, 4.0) for i in range(40)]
    df = spark.createDataFrame(rows, "repo string, component string, n_engineers int, closed_items int, open_items int, items_per_week double, throughput_cv double, cost decimal(18,2), span_weeks double")
    grid = capacity.reallocation_grid(df)
    assert grid.count() == 40 * 40 * 3 and "Window" not in grid._jdf.queryExecution().toString()
    assert grid.groupBy(F.spark_partition_id()).count().count() > 1


@pytest.mark.parametrize("minutes", [0, 30, 45.5])
def test_free_gaps_against_a_walk(spark, minutes):
    rng = random.Random(2)
    log = events(spark, [(f"w{i % 3}", rng.choice("ab"), "commit", rng.choice([rng.randrange(3000), 600, 645.5, 630])) for i in range(200)])
    want = []
    for who in "ab":
        own = sorted((r.ts, r.event_id, r.work_item_id) for r in log.where(F.col("actor_hash") == who).collect())
        want += [(who, a[2], a[0], b[0]) for a, b in zip(own, own[1:]) if (b[0] - a[0]).total_seconds() / 60 >= minutes and 9 <= a[0].hour < 18]
    assert sorted((r.actor_hash, r.work_item_id, r.gap_start, r.gap_end) for r in cost.free_gaps(log, minutes).collect()) == sorted(want)


def test_redaction_in_one_pass(spark):
    rows = [("ann and Ann-Lee, not anna; by ann-lee@x.org @ANN", ["ann", "ann-lee", " "]), ("a.b [bot] a.b x\\Ey", ["a.b", "[bot]", "x\\Ey"]), (None, ["ann"]), ("plain text", None), ("@bob! hi", [])]
    out = [r.t for r in privacy.redact(spark.createDataFrame(rows, "t string, l array<string>"), "t", "l", "s").collect()]
    p = lambda x: hashlib.sha256((x + "s").encode()).hexdigest()[:8]
    assert out[1:] == [f"{p('a.b')} {p('[bot]')} {p('a.b')} {p(chr(120) + chr(92) + 'ey')}", None, "plain text", f"@{p('bob')}! hi"]
    assert out[0].startswith(f"{p('ann')} and {p('ann-lee')}, not anna; by <email-redacted> @")


def test_best_candidates_score_few_pairs(spark):
    """Equal to ranking all pairs; of ten thousand people and a thousand openings a small part is scored."""

    def made(n, m):
        pick = lambda c, values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.xxhash64("id", F.lit(c)), F.lit(len(values))) + 1).cast("int"))
        skills = [f"Skill {i}" for i in range(40)]
        people = spark.range(n).select(F.format_string("e%05d", "id").alias("employee_id"), F.lit("x").alias("name"), F.array(pick("a", skills), pick("b", skills)).alias("skills"), F.array(pick("c", skills)).alias("projects"), F.array(F.lit("text")).alias("experience"), F.pmod("id", F.lit(9)).alias("years_experience"),
                                       F.array(pick("d", ["core", "lib", "web"])).alias("familiar_components"), pick("e", ["morning", "flexible", "evening"]).alias("preferred_shift"), F.array(pick("f", ["backend", "data"])).alias("preferred_areas"), F.array(pick("g", staffing.WEEKDAYS), pick("h", staffing.WEEKDAYS)).alias("availability"), (F.col("id") % 5 > 0).alias("open_to_other_teams"))
        openings = spark.range(m).select(F.format_string("o%04d", "id").alias("opening_id"), pick("i", ["core", "lib", "web"]).alias("component"), F.when(F.col("id") % 50 == 7, F.array().cast("array<string>")).otherwise(F.array(pick("j", skills), pick("k", skills), pick("l", skills))).alias("required_skills"),
                                         F.when(F.col("id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("data"))).alias("work_areas"), pick("m", ["morning", "flexible"]).alias("shift"), F.array(pick("n", staffing.WEEKDAYS), pick("o", staffing.WEEKDAYS)).alias("availability"))
        return people, openings

    people, openings = made(400, 60)
    assert same(staffing.rank_candidates(staffing.fit_scores(people, openings), 3), staffing.best_candidates(people, openings, 3))
    people, openings = made(10_000, 1_000)
    assert staffing.shortlist(people, openings, 6).count() < 10_000 * 1_000 / 15


def test_best_candidates_among_many_ties(spark):
    """Equal to ranking all pairs where scores tie and skills repeat or are null; the shortlist orders and distincts no pairs."""
    cols = "employee_id string, name string, skills array<string>, projects array<string>, experience array<string>, years_experience double, familiar_components array<string>, preferred_shift string, preferred_areas array<string>, availability array<string>, open_to_other_teams boolean"
    skills = [["SQL", "sql", "Java"], [None, "java"], ["Go"], []]
    people = spark.createDataFrame([(f"e{i:03}", "x", skills[i % 4], ["java"], ["x"], float(i % 2), ["core"], "flexible", ["data"], ["mon"], i % 5 > 0) for i in range(120)], cols)
    wanted = [("o1", "core", ["java", "Sql"], ["data"], "morning", ["mon"]), ("o2", "lib", [None, "JAVA"], [], "flexible", ["mon", "fri"]), ("o3", "lib", [], [], "flexible", ["mon"]), ("o4", "lib", ["go"], [], "flexible", ["fri"])]
    openings = spark.createDataFrame(wanted, "opening_id string, component string, required_skills array<string>, work_areas array<string>, shift string, availability array<string>")
    assert same(staffing.rank_candidates(staffing.fit_scores(people, openings), 3), staffing.best_candidates(people, openings, 3))
    plan = staffing.shortlist(people, openings, 6)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "Join Inner, (employee_id" not in plan
