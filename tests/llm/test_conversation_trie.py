"""Nodes of the trie against one built by dictionaries, and the ranking of lists."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from loomline.llm import conversation_trie, list_ranking
from loomline.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    """(conv_id, turn, role, text) -> {(conv_id, depth, ...)} by walking every rebuilt conversation."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(role, text) for _, _, role, text in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        path = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
        ends[path].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = defaultdict(int), defaultdict(int)
    for path in sorted(members, key=len, reverse=True):
        leaves[path] += 0 if children[path] else 1
        saved[path] += (len(members[path]) - 1) * len(WORD.findall(path[-1][1])) if path else 0
        if path:
            leaves[path[:-1]] += leaves[path]
            saved[path[:-1]] += saved[path]
    digest = {path: hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest() for path in members}
    return {(min(m), len(path), min(members[path[:-1]]) if path else None, len(m), len(children[path]), leaves[path], saved[path], digest[path]) for path, m in members.items()}


def found(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    assert found(QUERIES["op11_prefix_trie"](spark, sf_dir)) == brute(rows)


def test_shared_beginnings_nulls_and_long_conversations(spark):
    """Many equal turns, one conversation over several ranges, null ids, turns, roles and texts, negative ids, parts of a few rows."""
    rng = random.Random(11)
    rows = [(c, t, rng.choice(("user", "user", None)), rng.choice(("a b", "a b", "c", "", None))) for c in range(-30, 170) if c % 7 for t in range(rng.randint(1, 6))]
    rows += [(40, t, "user", f"w{t % 5} x") for t in range(6, 400)] + [(None, 1, "user", "lost"), (41, None, "user", "first"), (41, None, None, "also first"), (999, 0, "user", "a b"), (999, 0, "user", "a b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert found(conversation_trie.prefix_trie(df, rows_per_part=64)) == brute(rows)


@pytest.mark.parametrize("extra", ["conv", "at", "part", "node", "words", "depth"])
def test_awkward(spark, extra):
    df = spark.createDataFrame([(20, 0, "user", "hello there", 1), (20, 1, "assistant", None, 2)], f"conv_id long, turn long, role string, text string, {extra} int")
    assert found(conversation_trie.prefix_trie(df)) == brute([(20, 0, "user", "hello there"), (20, 1, "assistant", None)])
    assert found(conversation_trie.prefix_trie(df.limit(0))) == set()


def test_turnless_conversations_are_members_of_the_root(spark):
    short = [c for c in range(1, 200) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20][:3]
    rows = [(c, 0, "user", "gone") for c in short]
    assert found(conversation_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))) == brute(rows)


@pytest.mark.parametrize("near", [True, False])
def test_ranking(spark, near):
    """A list dealt to many small parts, with places that follow it and with places that say nothing (then lots are drawn)."""
    n, rng = 3000, random.Random(1)
    ids = rng.sample(range(10**6), n)
    rows = [(ids[i], ids[i + 1] if i + 1 < n else None, i if near else rng.randrange(n), rng.randrange(9), 1) for i in range(n)]
    total, want = 0, {}
    for i, r in enumerate(rows):
        want[r[0]] = (total, i)
        total += r[3]
    df = spark.createDataFrame(rows, "id long, next long, place long, w long, one long")
    got = {r.id: (r.w, r.one) for r in list_ranking.rank(df, ["w", "one"], rows_per_part=400).collect()}
    assert got == want
    assert list_ranking.rank(df.limit(0), ["w", "one"]).count() == 0


def test_a_hot_parent_is_broadcast(spark):
    """A first turn with more than a thousandth of all nodes as children."""
    rows = [(c, t, "user", "same" if t < 3 else f"text {c}") for c in range(400) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert found(conversation_trie.prefix_trie(df, rows_per_part=100)) == brute(rows)
