import itertools
import random
import re

import pytest
import xxhash
from loomline.llm import simhash
from loomline.llm.simhash import ball, components, fingerprint, fingerprints, links, near_duplicates, one_of_each, similar_groups, split
from pyspark.sql import functions as F


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius=2):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= radius and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {v: root(v) for v in values}


def brute_groups(texts, radius=7, words=2, shingle=5, least=(4, 5)):
    """The least text of each text's group: fingerprints of distinct shingles near, and word shingles alike in fact."""
    texts = sorted(texts)
    prints, sets, parent = {}, {}, {t: t for t in texts}
    for t in texts:
        w = t.lower().split()
        prints[t] = fingerprint(t, words, distinct=True)
        sets[t] = {tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set())

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for a, b in itertools.combinations(texts, 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius:
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if both * least[1] >= either * least[0] and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {t: root(t) for t in texts}


def test_fingerprints(spark, docs):
    texts = ["", " \n", "One", "one TWO", "a b c", "É é \x1f x\x85y z", *(r.text for r in docs.limit(40).collect())]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = {r.i: r.fingerprint for r in fingerprints(df).collect()}
    assert [got[i] & (2**64 - 1) for i in range(len(texts))] == [brute_fingerprint(t) for t in texts] == [fingerprint(t) for t in texts]
    # the engine's own hash is the same one
    assert df.select(F.xxhash64(F.lit("a b c"))).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c", seed=42)


def brute_links(values, radius):
    return {(max(a, b), min(a, b)) for a, b in itertools.combinations(values, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= radius}


def clustered(rng, groups, most, flips):
    values = set()
    for _ in range(groups):
        v = rng.getrandbits(64) - 2**63
        for _ in range(rng.randint(1, most)):
            for _ in range(rng.randint(0, flips)):
                v ^= 1 << rng.randrange(63)
            values.add(v)
    return values


@pytest.mark.parametrize("radius, segments, most", [(2, 2, 1024), (2, 2, 20), (5, 3, 40), (4, 4, 1024)])
def test_links_are_all_near_pairs(spark, radius, segments, most):
    values = clustered(random.Random(4), 12, 90, 4)
    df = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    got = [(r.a, r.b) for r in links(df, radius, segments, most).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_links(values, radius)


def edited(rng, base, vocabulary, share):
    return " ".join(rng.choice(vocabulary) if rng.random() < share else w for w in base)


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_groups_of_verified_links(spark, rounds):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = {"", " ", "one", "one two", "One two", " ".join(["spam"] * 50), " ".join(["spam"] * 90)}
    for _ in range(6):
        base = rng.choices(vocabulary, k=rng.randint(60, 300))
        texts |= {edited(rng, base, vocabulary, rng.choice([0.002, 0.01, 0.03])) for _ in range(25)}
    names = {i.to_bytes(16, "big"): t for i, t in enumerate(sorted(texts))}
    # a third of all texts share their fingerprint whatever they say, so that equal fingerprints are not enough
    prints = {n: 5 if i % 3 == 0 else fingerprint(t, 2, distinct=True) - 2**63 for i, (n, t) in enumerate(names.items())}
    nodes = spark.createDataFrame([(n, prints[n]) for n in names], "node binary, fingerprint long")
    whole = spark.createDataFrame(list(names.items()), "node binary, text string")
    got = {bytes(r.node): bytes(r.root) for r in similar_groups(nodes, lambda wanted: whole.join(wanted, "node", "left_semi"), 7, 4, 5, 0.8, rounds).collect()}
    want, sets = {}, {}
    for n, t in names.items():
        w = t.lower().split()
        sets[n] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
        want[n] = n
    linked = [(a, b) for a, b in itertools.combinations(sorted(names), 2) if ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count() <= 7 and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in names:
        for a, b in linked:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want and len(set(want.values())) > 10


def test_a_common_passage_does_not_list_all_pairs(spark, monkeypatch):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(20_000)]
    passage = rng.choices(vocabulary, k=150)
    own = [" ".join(passage + rng.choices(vocabulary, k=40)) for _ in range(250)]  # a passage in common: 0.65 alike
    copies = [edited(rng, passage, vocabulary, 0.004) for _ in range(60)]  # copies of it
    names = {i.to_bytes(16, "big"): t for i, t in enumerate(dict.fromkeys(own + copies))}
    nodes = spark.createDataFrame([(n, 5) for n in names], "node binary, fingerprint long")
    whole = spark.createDataFrame(list(names.items()), "node binary, text string")
    listed, verify = [], simhash._alike
    monkeypatch.setattr(simhash, "_alike", lambda pairs, *more: listed.append(pairs.count()) or verify(pairs, *more))
    got = {bytes(r.node): bytes(r.root) for r in similar_groups(nodes, lambda wanted: whole.join(wanted, "node", "left_semi"), 7, 4, 5, 0.8).collect()}
    sets = {n: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for n, t in names.items()}
    want = {n: n for n in names}
    linked = [(a, b) for a, b in itertools.combinations(sorted(names), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    while any(want[a] != want[b] for a, b in linked):
        for a, b in linked:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want and len(set(want.values())) > 200 and sum(listed) < 50 * len(names)


def test_near_copies_are_caught(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(5000)]
    bases = [rng.choices(vocabulary, k=rng.randint(100, 600)) for _ in range(300)]
    pairs = [(" ".join(b), edited(rng, b, vocabulary, rng.random() * 0.03)) for b in bases]
    caught = total = 0
    for a, b in pairs:
        x, y = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
        if len(x & y) >= 0.8 * len(x | y):
            total += 1
            caught += (fingerprint(a, 2, distinct=True) ^ fingerprint(b, 2, distinct=True)).bit_count() <= 7
    assert total > 150 and caught >= 0.9 * total


def test_many_fingerprints_share_a_segment(spark):
    rng = random.Random(5)
    low = rng.getrandbits(32)
    values = {(rng.getrandbits(31) << 32) | low for _ in range(50_000)}
    near = {(v ^ (1 << 40) ^ (1 << 3)) for v in itertools.islice(sorted(values), 200)}
    every = sorted(values | near)
    got = {(r.a, r.b) for r in links(spark.createDataFrame([(v,) for v in every], "fingerprint long")).collect()}
    held, want = set(every), set()
    for v in every:  # the whole ball, looked up
        want |= {(max(v, v ^ m), min(v, v ^ m)) for m in ball([1 << b for b in range(63)], 2) if m and v ^ m in held}
    assert len(want) >= 200 and got == want


def test_segments_cover_what_is_left():
    for mask, m in ((0, 2), (0, 3), ((1 << 22) - 1, 3), ((1 << 62) - 1, 3)):
        bits = [b for part in split(mask, m) for b in part]
        assert sorted(bits) == [1 << i for i in range(64) if not mask >> i & 1]


def test_components_of_chains_and_stars(spark):
    chain = [(i + 1, i) for i in range(0, 40)] + [(200 + i, 200) for i in range(1, 60)] + [(301, 300)]
    found = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {found[i] for i in range(41)} == {0} and {found[200 + i] for i in range(60)} == {200} and found[301] == 300
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_whole_table(docs):
    rows = near_duplicates(docs).collect()
    texts = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    roots, least = brute_components(sorted(set(texts.values()))), {}
    for i in sorted(texts):
        least.setdefault(roots[texts[i]], i)
    assert {r.doc_id: r.component_id for r in rows} == {i: least[roots[v]] for i, v in texts.items()}
    kept = {r.doc_id for r in one_of_each(docs).collect()}
    assert kept == set(least.values())


def test_awkward_rows(awkward, empty):
    rows = near_duplicates(awkward("fingerprint")).collect()
    assert len(rows) == 9 and {r.component_id for r in rows if r.doc_id in (2, 3, 4)} == {2}
    for extra in ("component_id", "_key", "_best", "fingerprint", "_root", "_all", "mask", "cell"):
        kept = one_of_each(awkward(extra))
        assert sorted((r.doc_id or 0, r[extra] or 0) for r in kept.collect()) == [(0, 4), (1, 1), (2, 2), (5, 5), (6, 6), (7, 7)] and kept.columns == awkward(extra).columns
    assert near_duplicates(empty).count() == 0 and one_of_each(empty).count() == 0


def test_repeated_and_null_keys_are_judged_by_their_texts(spark):
    a, b, c = ("alpha beta gamma delta epsilon", "one two three four five", "uno dos tres cuatro cinco")
    rows = [(3, a), (5, a), (5, b), (9, b), (None, c), (None, c), (None, a), (12, c + " seis"), (5, b)]
    kept = one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(3, a), (5, b), (0, c), (12, c + " seis")])


def test_work_grows_with_rows_not_with_tables(spark):
    """One pass enters all tables (a union of one pass each gave as many tasks as tables, anew on each level), and merging rounds add no parts."""
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(40)]
    rows = spark.createDataFrame([(simhash.signed(v), 0, 0) for v in values], "fingerprint long, mask long, cell long").repartition(3)
    first = [sum(bits) for bits in split(0, 4)]
    held, probes = simhash._enter(rows, [0], 4, None), simhash._enter(rows, [0], 4, 7)
    further = simhash._enter(held, first, 4, None), simhash._enter(probes, first, 4, 7)
    assert {x.rdd.getNumPartitions() for x in (held, probes, *further)} == {3}
    tables = {}
    for v in values:
        for bits in first:
            left = [sum(x) for x in split(bits, 4)]
            for flip in ball([1 << b for b in range(64) if bits >> b & 1], 1):
                reach = (7 - flip.bit_count()) // 4
                for more in left:
                    for m in ball([1 << b for b in range(64) if more >> b & 1], reach):
                        entry = tuple(map(simhash.signed, (v, bits | more, (v & bits ^ flip) | (v & more ^ m))))
                        tables[entry] = tables.get(entry, 0) + 1
    got = {(r.fingerprint, r.mask, r.cell): r.n for r in further[1].groupBy("fingerprint", "mask", "cell").agg(F.count("*").alias("n")).collect()}
    assert got == tables
    named = spark.createDataFrame([(i, 0, i) for i in range(9)], "node long, fingerprint long, root long")
    for pairs in ([(1, 0), (3, 2), (5, 4)], [(2, 0), (6, 4)], [(4, 0)]):
        named = simhash._merged(named, spark.createDataFrame(pairs, "x long, y long"))
        assert named.rdd.getNumPartitions() <= 4
    assert {r.node: r.root for r in named.collect()} == {**dict.fromkeys(range(7), 0), 7: 7, 8: 8}
