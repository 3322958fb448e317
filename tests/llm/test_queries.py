"""Every registered query of the text operators over the whole small tables, its returned columns against plain Python."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from loomline.llm.pii import seed_secrets
from loomline.llm.queries import ORACLES, QUERIES
from loomline.llm.simhash import fingerprint
from loomline.llm.winnow import edited
from tests.llm.test_decontaminate import brute as leaked
from tests.llm.test_licenses import brute as phrase_hits
from tests.llm.test_pii import brute as base_spans
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tests.llm.test_winnow import brute as plain_winnow

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def run(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir).collect()


def test_op1(spark, sf_dir, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    rows = run(spark, sf_dir, "op1_token_counts")
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id].text or ""
        n = len(library.encode(t, add_special_tokens=False))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 1024)


def test_op2(spark, sf_dir, texts):
    rows = run(spark, sf_dir, "op2_sharding")
    shards = defaultdict(list)
    for r in rows:
        data = (texts[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "rows", None)
        shards[r.shard].append(r.slot)
    assert len(rows) == len(texts) and set(shards) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in run(spark, sf_dir, "op2_sharding")}


def test_op3(spark, sf_dir, texts):
    rows, order = {r.doc_id: r for r in run(spark, sf_dir, "op3_fingerprints")}, sorted(texts, reverse=True)
    for i, following in zip(order, order[1:] + order[:1]):
        t, r = texts[i].text or "", rows[i]
        changed = edited(t, texts[following].text or "")
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest()) and 0 <= r.near_next <= 1
        if len(t) < 800:
            own, other = plain_winnow(t, 10, 51), plain_winnow(changed, 10, 51)
            assert r.fingerprint == "".join(f"{h:08x}" for h, _ in own) and r.positions == [p for _, p in own]
            a, b = {h for h, _ in own}, {h for h, _ in other}
            assert r.near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def test_op4(spark, sf_dir):
    rows = {r.conv_id: r for r in run(spark, sf_dir, "op4_chat_formatting")}
    said = "</s>[INST] ok [/INST]"
    turns = defaultdict(list, {-7: [(0, "user", said), (1, "assistant", said)]})
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    assert set(rows) == set(turns)
    for k, v in turns.items():
        v.sort()
        loss = "".join(t for _, role, t in v if role == "assistant")
        assert (rows[k].n_turns, rows[k].turns_sha256) == (len(v), hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in v).encode()).hexdigest())
        assert (rows[k].loss_chars, rows[k].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_op5(spark, sf_dir, texts):
    """The patterns find secrets that are no seeds, in several texts and with different digests; then the base spans."""
    big, found = "/root/testdata/sf0.01", set()
    whole = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "text").collect()}
    for r in run(spark, big, "op5_personal_data"):
        begun = seed_secrets(whole[r.doc_id], 3)
        for kind, a, b in (x.split(":") for x in filter(None, r.spans.split(","))):
            if kind == "secret" and (kind, int(a), int(b)) not in begun:
                found.add((r.doc_id, whole[r.doc_id][int(a) : int(b)]))
    assert len(found) >= 5 and len({x for _, x in found}) >= 5 and all(re.fullmatch("[0-9a-fA-F]{40}", x) for _, x in found)
    rows = run(spark, sf_dir, "op5_personal_data")
    assert len(rows) == len(texts)
    for r in rows:
        want = base_spans(texts[r.doc_id].text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(filter(None, joined.split(","))) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in want) for kind in ("email", "ip", "card", "phone")]


def test_op6(spark, sf_dir, texts):
    prints = {i: brute_fingerprint(r.text) for i, r in texts.items()}
    assert all(fingerprint(r.text or "") == prints[i] for i, r in texts.items())
    roots, least = brute_components(sorted(set(prints.values()))), {}
    for i in sorted(prints):
        least.setdefault(roots[prints[i]], i)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in run(spark, sf_dir, "op6_simhash")} == {(i, f"{p:016x}", least[roots[p]]) for i, p in prints.items()}


def test_op7(spark, sf_dir, texts):
    rows, sizes, weights = run(spark, sf_dir, "op7_mixing"), defaultdict(int), {}
    for r in texts.values():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        unit = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if unit * weights[s] > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in full} if full else {s: unit * weights[s] for s in open_}
        left -= sum(2 * sizes[s] for s in full)
        open_ = open_ - full if full else set()
    taken = defaultdict(int)
    for r in rows:
        source = texts[r.doc_id].source
        assert r.size == len(WORD.findall(texts[r.doc_id].text or "")) and r.source_size == sizes[source] and r.target == pytest.approx(target[source]) and 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
    assert len(rows) == len(texts) and all(abs(taken[s] - target[s]) <= 1 for s in order)


def test_op8(spark, sf_dir, texts):
    rows = run(spark, sf_dir, "op8_language_id")
    assert len(rows) == len(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    big, lang = "/root/testdata/sf0.01", {}
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in run(spark, big, "op8_language_id") if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_op9(spark, sf_dir, texts):
    for r in run(spark, sf_dir, "op9_license_scan"):
        n, hits = phrase_hits(texts[r.doc_id].text or "")
        starts, base = [i for i, _ in hits], ",".join(sorted({label for _, label in hits}))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, len(hits), min(starts, default=None), max(starts, default=None), base)
        assert set(filter(None, base.split(","))) | {x.split(":")[0] for x in filter(None, r.spans.split(","))} == set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_op10(spark, sf_dir, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert {(r.doc_id, r.item_id) for r in run(spark, sf_dir, "op10_decontamination")} == leaked([(i, r.text) for i, r in texts.items()], items)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_says_the_same(spark, sf_dir, name):
    """Each query that has SQL against it in DuckDB."""
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "conversations"):
        con.sql(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    df, relation = QUERIES[name](spark, sf_dir), con.sql(ORACLES[name])
    columns = sorted(df.columns)
    at = [relation.columns.index(c) for c in columns]
    assert sorted(relation.columns) == columns
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == sorted(repr(tuple(r[i] for i in at)) for r in relation.fetchall())
