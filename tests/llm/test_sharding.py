from collections import Counter

import numpy as np
from loomline.llm.sharding import communication_matrix, even_sizes, hypergeometric, hypergeometric_shards


def test_draws_follow_the_law():
    rng = np.random.default_rng(0)
    ours = [hypergeometric(rng, 50, 100, 30) for _ in range(4000)]
    assert abs(np.mean(ours) - 10) < 0.15 and abs(np.var(ours) - 30 / 9 * 2 * 120 / 149) < 0.5
    assert hypergeometric(rng, 0, 5, 3) == 0 and hypergeometric(rng, 5, 0, 3) == 3
    big = [hypergeometric(rng, 4 * 10**12, 6 * 10**12, 10**5) for _ in range(400)]
    assert abs(np.mean(big) - 40_000) < 40 and abs(np.std(big) - 155) < 25


def test_matrix_has_its_margins():
    rows, shards = [7, 0, 12, 1], even_sizes(20, 3)
    m = communication_matrix(rows, shards, 1)
    assert m.sum(axis=1).tolist() == rows and m.sum(axis=0).tolist() == shards and m.min() >= 0


def _check(rows, n, shards):
    counts = Counter(r.shard for r in rows)
    assert sum(counts.values()) == n and max(counts.values(), default=0) - min((counts[s] for s in range(shards)), default=0) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


def test_exact_sizes_and_gapless_slots(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "'a' as shard", "id as slot", "1 as _x")
    rows = hypergeometric_shards(df, 24, ["doc_id"], rows_per_block=64).collect()
    _check(rows, 5000, 24)
    again = hypergeometric_shards(df.repartition(7), 24, ["doc_id"], rows_per_block=64).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}
    # neighbours are spread: the correlation of ids with slots is weak
    ids, slots = np.array([(r.doc_id, r.slot) for r in rows if r.shard == 0]).T
    assert abs(np.corrcoef(ids, slots)[0, 1]) < 0.3


def test_every_shard_is_equally_likely(spark):
    hits = Counter()
    for seed in range(12):
        rows = hypergeometric_shards(spark.range(60).withColumnRenamed("id", "doc_id"), 3, ["doc_id"], seed=seed).collect()
        hits += Counter(r.shard for r in rows if r.doc_id < 10)
    assert all(20 <= hits[s] <= 60 for s in range(3))


def test_awkward_rows(awkward, empty):
    for extra in ("slot", "_order", "_rank", "_slot", "_sender", "_part", "_tie", "_block", "_at", "_again", "_begun", "_shards", "_BLOCKS"):
        rows = hypergeometric_shards(awkward(extra), 4, ["doc_id"]).collect()
        _check(rows, 9, 4)
        if extra != "slot":
            assert sorted((r.doc_id or 0, r[extra] or 0) for r in rows) == sorted((r.doc_id or 0, r[extra] or 0) for r in awkward(extra).collect())
    assert hypergeometric_shards(empty, 4, ["doc_id"]).count() == 0
    assert len(hypergeometric_shards(awkward(), 24, ["doc_id"]).collect()) == 9
