import random
import time

import pytest
from loomline.llm.mixing import capped_targets, min_cost_flow, mix, mix_by_source, word_count
from pyspark.sql import functions as F


def test_targets():
    assert capped_targets([100, 10, 50], [5, 2, 1], 240.0, 2) == pytest.approx([240 - 20 - (220 / 6), 20.0, 220 / 6])
    assert capped_targets([0, 4], [5, 2], 6.0, 2) == [0.0, 6.0] and capped_targets([], [], 0.0, 2) == []


def test_flow_against_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        n, m = rng.randint(1, 3), rng.randint(1, 2)
        supplies, quotas = [rng.randint(0, 3) for _ in range(n)], [rng.randint(0, 5) for _ in range(m)]
        members = [sorted(rng.sample(range(m), rng.randint(1, m))) for _ in range(n)]
        taken = min_cost_flow(supplies, members, quotas, 2)

        def fits(amounts):
            """Whether the quotas can take these amounts: Hall's condition over all sets of sources."""
            return all(sum(a for a, ms in zip(amounts, members) if set(ms) <= {j for j in range(m) if s >> j & 1}) <= sum(q for j, q in enumerate(quotas) if s >> j & 1) for s in range(1 << m))

        def amounts(i=0, done=()):
            if i == n:
                yield done
            else:
                for a in range(2 * supplies[i] + 1):
                    yield from amounts(i + 1, (*done, a))

        cost = lambda x: (-sum(x), sum(max(0, a - s) for a, s in zip(x, supplies)))
        assert fits(taken) and cost(taken) == min(cost(a) for a in amounts() if fits(a))


def test_every_source_meets_its_target(docs):
    rows = mix_by_source(docs).collect()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and r.size == len(r.text.split())
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in rows)
    assert abs(sum(v[0].target[0] for v in by.values()) - 1.5 * total) < 1
    for v in by.values():
        assert v[0].source_size == [sum(r.size for r in v)] and abs(sum(r.taken for r in v) - v[0].target[0]) <= 1
        part = sum(1 for r in v if r.taken not in (0, r.size, 2 * r.size))
        assert part <= 1
    again = mix_by_source(docs.repartition(5)).collect()
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in again}


def test_overlapping_sources_share_the_load(spark):
    rows = [(i, ["a"], 10) for i in range(50)] + [(100 + i, ["b", "a"], 10) for i in range(50)] + [(200 + i, ["b"], 10) for i in range(5)]
    out = mix(spark.createDataFrame(rows, "doc_id long, names array<string>, n long"), F.col("names"), F.col("n"), weights=(1, 1), share=1.0).collect()
    taken = {}
    for r in out:
        taken[tuple(r.sources)] = taken.get(tuple(r.sources), 0) + r.taken
    # 525 each: everything is used once, nothing is repeated
    assert taken == {("a",): 500, ("a", "b"): 500, ("b",): 50}


def test_word_count(spark):
    texts = [None, "", " ", "a", " a\tb\n\x0bc\x0c\rd ", "x y\x1fz"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", word_count(F.col("t")).alias("n"))
    assert [r.n for r in df.orderBy("i").collect()] == [0, 0, 0, 1, 4, 1]


def test_flow_of_many_sets_ends_soon():
    rng = random.Random(7)
    sources = 30
    members = [sorted(rng.sample(range(sources), 3)) for _ in range(100_000)]
    supplies = [rng.randint(1, 1000) for _ in members]
    quotas = [round(rng.uniform(0.2, 2.4) * sum(supplies) / sources) for _ in range(sources)]
    began = time.time()
    taken = min_cost_flow(supplies, members, quotas, 2)
    assert time.time() - began < 120 and all(0 <= t <= 2 * s for t, s in zip(taken, supplies))
    assert sum(taken) == min(sum(quotas), 2 * sum(supplies)) or sum(taken) < sum(quotas)


def test_awkward_rows(awkward, empty):
    out = mix_by_source(awkward("target")).collect()
    assert len(out) == 9 and all(r.taken <= 2 * r.size for r in out)
    for extra in ("_bucket", "_set", "_order", "_sources", "_size", "_cut", "_left", "_part", "_mix"):
        rows = mix_by_source(awkward(extra)).collect()
        assert sorted((r.doc_id or 0, r[extra] or 0) for r in rows) == sorted((r.doc_id or 0, r[extra] or 0) for r in awkward(extra).collect())
    assert mix_by_source(empty).count() == 0
