import re

from loomline.llm.decontaminate import item_shingles, leaks, without_leaks


def shingle_set(text, n=5):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    n = min(n, len(words)) if n is None else n
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(docs, items):
    out = set()
    for item, text in items:
        words = re.findall(r"[^\W_]+", (text or "").lower())
        n = min(5, len(words))
        want = shingle_set(text, n) if n else set()
        for doc, body in docs:
            if want and len(want & shingle_set(body, n)) / len(want) >= 0.8:
                out.add((doc, item))
    return out


def test_whole_tables(spark, docs, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in leaks(docs, items).collect()}
    assert got and got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert {r.doc_id for r in without_leaks(docs, items).select("doc_id").collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in got}


def test_threshold_sizes_and_short_items(spark):
    words = [f"w{i}" for i in range(60)]
    items = [(1, " ".join(words[:14])), (2, "Three short WORDS"), (3, "..."), (4, None), (5, " ".join(words[20:60])), (6, "one")]
    bodies = [
        (1, "x y " + " ".join(words[:14]) + " z"),
        (2, " ".join(words[:12])),  # 8 of 10 shingles
        (3, " ".join(words[:11])),  # 7 of 10
        (4, "three, short; words! more"),
        (5, "a " * 3000 + " ".join(words[20:56]).upper()),  # 32 of 36
        (6, " ".join(words[20:50])),  # 26 of 36
        (7, "one"),
        (8, None),
        (9, ""),
    ]
    docs, bench = spark.createDataFrame(bodies, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_found, r.n_shingles) for r in leaks(docs, bench).collect()}
    assert set(got) == brute(bodies, items) == {(1, 1), (2, 1), (4, 2), (5, 5), (7, 6)}
    assert got[(2, 1)] == (8, 10)


def test_sketches_outnumber_what_may_be_missing(spark):
    items = spark.createDataFrame([(n, " ".join(f"v{n}x{i}" for i in range(n + 4))) for n in (1, 2, 5, 9, 10, 33, 100)], "item_id long, text string")
    rows = item_shingles(items, "item_id", "text", 5, 0.8, 7).collect()
    for n in {r.item for r in rows}:
        assert sum(r.sketched for r in rows if r.item == n) >= min(n, n - -(-8 * n // 10) + 1)


def test_awkward_rows(spark, awkward, empty):
    items = spark.createDataFrame([(1, "hello world this is a short text"), (None, "a row without a name")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks(awkward("item"), items).collect()} == {(1, 1)}
    for extra in ("h", "_leaks", "_text", "w", "_key"):
        kept = without_leaks(awkward(extra), items)
        assert kept.columns == awkward(extra).columns and sorted((r.doc_id or 0, r[extra] or 0) for r in kept.collect()) == [(0, 4), (2, 2), (3, 3), (4, 0), (5, 5), (6, 6), (7, 7)]
    unnamed = spark.createDataFrame([(5, "a row without a name")], "item_id long, text string")
    assert {r.doc_id for r in without_leaks(awkward(), unnamed).collect()} == {1, 2, 3, 4, 5, 6, 7}
    assert leaks(empty, items).count() == 0 and leaks(awkward(), items.limit(0)).count() == 0
