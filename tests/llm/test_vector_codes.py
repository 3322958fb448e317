"""Codes, errors and codebooks against plain Python, and the awkward cases."""

import hashlib
import math

import numpy as np
import pytest
from loomline.llm import vector_codes
from loomline.llm.queries import QUERIES


def brute(rows, parts=16, entries=64, rounds=2):
    """(key, label, vector) -> {key: (code, error, label_error)} and the codebooks' digest, without tables or numpy."""
    kept = sorted((k, label, [math.floor(256 * x) for x in v]) for k, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    w = len(kept[0][2]) // parts
    cells = {k: [v[p * w : p * w + w] for p in range(parts)] for k, _, v in kept}
    books = [[cells[k][p] for k, _, _ in kept[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for c in cells.values():
                held.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(col) // len(held[i]) for col in zip(*held[i])] if i in held else e for i, e in enumerate(books[p])]
    out = {k: [nearest(c[p], books[p]) for p in range(parts)] for k, c in cells.items()}
    error = {k: sum(d for d, _ in v) for k, v in out.items()}
    by_label = {}
    for k, label, _ in kept:
        by_label[label] = by_label.get(label, 0) + error[k]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return {k: ("".join(f"{i:02x}" for _, i in out[k]), error[k], by_label[label]) for k, label, _ in kept}, digest


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want, digest = brute(rows)
    found = QUERIES["op12_vector_codes"](spark, sf_dir).collect()
    assert {r.vec_id: (r.code, r.error, r.label_error) for r in found} == want and {r.codebooks_sha256 for r in found} == {digest}


def test_dropped_rows_ties_and_labels(spark):
    """Null, NaN and infinite components go; few vectors, equal vectors and null labels stay."""
    rng = np.random.default_rng(0)
    rows = [(i, None if i % 3 == 0 else i % 2, [float(x) for x in rng.integers(-3, 3, 32) / 256]) for i in range(90)]
    rows += [(100 + i, 1, rows[5][2]) for i in range(20)]
    bad = [(200, 1, None), (201, 1, [None, *rows[0][2][1:]]), (202, 1, [math.nan, *rows[0][2][1:]]), (203, None, [math.inf, *rows[0][2][1:]])]
    df = spark.createDataFrame(rows + bad, "vec_id long, label int, embedding array<double>")
    want, digest = brute(rows)
    found, books = vector_codes.compress(df.repartition(3))
    assert {r.vec_id: (r.code, r.error, r.label_error) for r in found.collect()} == want and books.sha256 == digest


def test_spread_totals(spark, monkeypatch):
    """Beyond the broadcast's bound a frequent label's total is joined in copies."""
    df = spark.createDataFrame([(i, None if i % 2 else 7, f"{i:02x}", i) for i in range(100)], "_key int, _label int, code string, error long")
    monkeypatch.setattr(vector_codes, "small", lambda x: x)
    found = {r._key: r.label_error for r in vector_codes.with_label_error(df).collect()}
    assert found == {i: sum(range(i % 2, 100, 2)) for i in range(100)}


def test_blocks_of_many_values_and_bounds(spark):
    """More than 256 distinct integers in a dimension, integers held at the bounds, vectors of other lengths filled up with zeros."""
    rows = [(i, 0, [float(i), 1e30, -1e30, 0.5]) for i in range(600)] + [(600, 0, [1.0]), (601, 0, [])]
    found, books = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), parts=2, entries=4)
    out = {r.vec_id: r for r in found.collect()}
    assert len(out) == 602 and books.width == 2 and out[5].error > 0 and all(len(r.code) == 4 for r in out.values())
    assert books.entries[0][:, 1].max() == vector_codes.MOST and books.entries[1][:, 0].min() == vector_codes.LEAST


def test_decompress(spark):
    df = spark.createDataFrame([(i, 0, [i / 256, 2 * i / 256]) for i in range(4)], "vec_id long, label int, embedding array<double>")
    found, books = vector_codes.compress(df, parts=2, entries=4)
    back = vector_codes.decompress(found, books).collect()
    assert {r.vec_id: r.approximate for r in back} == {i: [i / 256, 2 * i / 256] for i in range(4)} and all(r.error == 0 for r in back)


@pytest.mark.parametrize("extra", ["_key", "code", "error", "label_error", "keys"])
def test_awkward_rows(spark, extra):
    rows = [(None, None, [0.1] * 16, 1), (None, 1, [0.1] * 16, 2), (1, 1, [0.2] * 16, 3), (1, 1, [0.2] * 16, 3)]
    df = spark.createDataFrame(rows, f"vec_id long, label int, embedding array<float>, {extra} int")
    found, _ = vector_codes.compress(df)
    assert sorted((r.vec_id or -1, r.error) for r in found.collect()) == [(-1, 0), (-1, 0), (1, 0), (1, 0)]
    none, books = vector_codes.compress(df.limit(0))
    assert none.columns == found.columns and none.count() == 0 and books.entries == ()
