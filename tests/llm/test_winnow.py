import hashlib
import random

from loomline.llm.winnow import code_points, edit_report, edited, likeness, rolling_hashes, winnow, winnowing, with_successor


def plain_hashes(text, k):
    """The same polynomial in Python's own numbers, gram by gram."""
    out, base, mix, mask = [], 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 2**64 - 1
    for i in range(len(text) - k + 1):
        h = 0
        for c in text[i : i + k]:
            h = (h * base + ord(c) + 1) & mask
        for _ in range(2):
            h = (h ^ (h >> 32)) * mix & mask
        out.append(h >> 32)
    return out


def brute(text, k, w):
    k = min(k, max(1, len(text) // 4))
    hashes = plain_hashes(text, k)
    w, out = min(w, max(1, len(hashes) // 8)), []
    for i in range(len(hashes) - w + 1):
        least = min(hashes[i : i + w])
        at = max(j for j in range(i, i + w) if hashes[j] == least)
        if (least, at) not in out:
            out.append((least, at))
    return out


def test_rightmost_minimum_of_every_window():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("abcé") for _ in range(rng.randint(0, 200)))
        k, w = rng.randint(1, 9), rng.randint(1, 20)
        hashes, at = winnow(text, k, w)
        assert list(zip(hashes.tolist(), at.tolist())) == brute(text, k, w)


def test_hashes_are_of_the_grams():
    text, k = "abcabcabdé" * 5, 7
    seen = {}
    for i, h in enumerate(rolling_hashes(code_points(text), k).tolist()):
        assert seen.setdefault(text[i : i + k], h) == h
    assert len(set(seen.values())) == len(seen)


def test_shared_passages_are_found():
    rng = random.Random(3)
    for _ in range(100):
        passage, a, b, c, d = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (29, 700, 600, 550, 800))
        assert likeness(winnow(a + passage + b, 10, 20)[0], winnow(c + passage + d, 10, 20)[0]) > 0


def test_report_against_brute_force(docs):
    rows = sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), reverse=True)
    found = {r.doc_id: r for r in edit_report(docs).collect()}
    assert len(found) == len(rows)
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        changed, r = edited(text, following), found[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        for print_, at, t in ((r.fingerprint, r.positions, text), (r.edited_fingerprint, r.edited_positions, changed)):
            if len(t) < 1500:
                assert [(int(print_[8 * n : 8 * n + 8], 16), p) for n, p in enumerate(at)] == brute(t, 10, 51)
            assert len(print_) == 8 * len(at)
        assert abs(r.near_edited - likeness(winnow(text)[0], winnow(changed)[0])) < 1e-9
        assert abs(r.near_next - likeness(winnow(text)[0], winnow(following)[0])) < 1e-9


def test_awkward_rows(awkward, empty, spark):
    rows = edit_report(awkward("n_chars")).collect()
    texts = {r.doc_id: r.text or "" for r in awkward().collect()}
    order = [7, 6, 5, 4, 3, 2, 1, 1, None]
    want = sorted((str(a), hashlib.sha256(edited(texts[a], texts[b]).encode()).hexdigest()) for a, b in zip(order, order[1:] + order[:1]))
    assert sorted((str(r.doc_id), r.edited_sha256) for r in rows) == want
    assert len({r.fingerprint for r in rows if r.doc_id == 1}) == 1
    assert {r.fingerprint for r in rows if r.doc_id in (2, 3)} == {""}
    assert edit_report(empty).count() == 0 and winnowing(empty).count() == 0
    alone = edit_report(spark.createDataFrame([(5, "one single text")], "doc_id long, text string")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    got = winnowing(awkward("hashes")).where("doc_id = 6").first()
    assert len(got.hashes) == len(got.positions) > 100


def test_few_rows_a_range_and_negative_keys(spark):
    rows = [(k, f"text number {k} " * 9) for k in [*range(-40, 40, 3), None]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    order = sorted((r for r in rows if r[0] is not None), reverse=True) + [rows[-1]]
    want = {a[0]: hashlib.sha256(edited(a[1], b[1]).encode()).hexdigest() for a, b in zip(order, order[1:] + order[:1])}

    def report(own, text, other, following):
        return (hashlib.sha256(edited(text, following).encode()).hexdigest(),)

    for size in (1, 4, 1000):
        got = with_successor(df, "doc_id", "text", report, len, "sha string", rows_per_range=size, bytes_per_range=500 * size)
        assert {r.doc_id: r.sha for r in got.collect()} == want
