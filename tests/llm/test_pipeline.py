import corpus_pipeline
import pytest
from tests.llm.test_decontaminate import brute as leaked
from tests.llm.test_simhash import brute_groups


def test_stages_against_brute_force(spark, sf_dir):
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf_dir).persist()
        rows, old = docs.collect(), before.collect()
        if name == "language ID":
            assert len(rows) >= 0.98 * len(old)
        if name == "SimHash near-dedup":
            groups = brute_groups({r.text or "" for r in old})
            least = {}
            for r in sorted(old, key=lambda r: r.doc_id):
                least.setdefault(groups[r.text or ""], r.doc_id)
            assert {r.doc_id for r in rows} == set(least.values()) and len(rows) == len(least)
        if name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert {r.doc_id for r in rows} == {r.doc_id for r in old} - {d for d, _ in leaked([(r.doc_id, r.text) for r in old], items)}
        if name == "mixing sources to target weights":
            words = sum(len(r.text.split()) for r in old)
            assert abs(sum(len(r.text.split()) for r in rows) - 1.5 * words) < 0.05 * words and {r.doc_id for r in rows} <= {r.doc_id for r in old}
        if name == "sharding":
            assert len(rows) == len(old) and {r.shard for r in rows} == set(range(24))
        else:
            assert docs.columns == before.columns


def test_run_repeats_itself(spark, sf_dir):
    a, b = (sorted((r.doc_id, r.shard, r.slot) for r in corpus_pipeline.run(spark, sf_dir).collect()) for _ in range(2))
    assert a == b


@pytest.mark.parametrize("extra", ["_mix_foo", "_mix_size", "_MIX_members", "_mix_key", "_bucket", "taken", "_copy", "_kept0_size"])
def test_mix_keeps_columns_of_any_name(spark, sf_dir, awkward, extra):
    docs = awkward(extra)
    out = dict(corpus_pipeline.STAGES)["mixing sources to target weights"](spark, docs, sf_dir)
    assert out.columns == docs.columns and {(r.doc_id, r.text, r[extra]) for r in out.collect()} <= {(r.doc_id, r.text, r[extra]) for r in docs.collect()}


#: Names that the stages use for columns of their own.
CLASHES = {"language ID": "score", "SimHash near-dedup": "_best", "benchmark decontamination": "_leaks", "mixing sources to target weights": "size", "sharding": "_order"}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_awkward_rows_and_empty_tables(spark, sf_dir, awkward, empty, name, stage):
    docs = awkward(CLASHES[name])
    old, out = docs.collect(), stage(spark, docs, sf_dir)
    assert out.columns[: len(docs.columns)] == docs.columns
    pairs = {(r.doc_id, r.text, r[CLASHES[name]]) for r in old}
    rows = out.collect()
    assert rows and {(r.doc_id, r.text, r[CLASHES[name]]) for r in rows} <= pairs
    if name == "sharding":
        assert len(rows) == len(old)
    if name == "SimHash near-dedup":
        assert sorted(r.doc_id or 0 for r in rows) == [0, 1, 2, 5, 6, 7]
    if name == "language ID":
        assert not {2, 3, 4} & {r.doc_id for r in rows}
    assert stage(spark, empty, sf_dir).count() == 0
