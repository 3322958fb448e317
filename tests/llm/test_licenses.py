import random
import re
import time

import regex
from loomline.llm.licenses import NOTICES, PHRASES, errors, license_scan, notices, pieces, scan


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    hits = [(i, label) for phrase, label in PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), hits


def test_phrases_against_brute_force():
    rng = random.Random(7)
    parts = ["cc", "by", "CC", "all", "rights", "reserved", "general", "public", "license", " ", "-", ".", "é", "\n", "x", "_", "7", "BY"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 14)))
        n, hits = brute(text)
        got = scan(text)
        assert got[:4] == (n, len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None)), text
        assert got[4] == ",".join(sorted({label for _, label in hits})) and set(filter(None, got[4].split(","))) <= set(got[5].split(","))


def test_edited_notices_are_found_with_their_spans():
    rng = random.Random(8)
    for notice, label in NOTICES:
        assert "".join(p for _, p in pieces(notice)) == notice and len(pieces(notice)) == errors(notice) + 1
        for _ in range(6):
            edited = list(notice)
            for i in rng.sample(range(len(edited)), errors(notice)):
                edited[i] = rng.choice(["#", "", edited[i] + "#"])
            text = "some words before " + "".join(edited) + " and after"
            hits = [x for x in notices(text) if NOTICES[x[0]][1] == label]
            assert hits and all(regex.fullmatch(f"(?:{regex.escape(NOTICES[i][0], literal_spaces=True)}){{e<={errors(NOTICES[i][0])}}}", text[a:b]) for i, a, b, _ in hits)


def test_seeds_lose_nothing():
    rng = random.Random(9)
    for _ in range(60):
        text = "".join(rng.choice([*(n[: rng.randint(5, len(n))] for n, _ in NOTICES), " ", "word "]) for _ in range(8))
        found = {i for i, *_ in notices(text)}
        for i, (notice, _) in enumerate(NOTICES):
            assert (i in found) == bool(regex.search(f"(?:{regex.escape(notice, literal_spaces=True)}){{e<={errors(notice)}}}", text))


def test_every_planted_notice_is_reported_once():
    rng = random.Random(10)
    for _ in range(60):
        text, planted = "", []
        for _ in range(rng.randint(1, 8)):
            i = rng.randrange(len(NOTICES))
            edited = list(NOTICES[i][0])
            edits = rng.randint(0, errors(NOTICES[i][0]))
            for at in rng.sample(range(1, len(edited) - 1), edits):
                edited[at] = rng.choice(["#", "", edited[at] + "#"])
            planted.append((i, len(text), len(text) + len("".join(edited)), edits))
            text += "".join(edited) + rng.choice([" ", ". ", " qqqqqqqq "])
        found = notices(text)
        for i, a, b, edits in planted:
            hits = [x for x in found if x[0] == i and x[1] < b and x[2] > a]
            assert len(hits) == 1 and hits[0][3] <= edits and abs(hits[0][1] - a) <= errors(NOTICES[i][0]), (text, hits)
        for i, a, b, edits in found:
            n = NOTICES[i][0]
            assert edits <= errors(n) and regex.fullmatch(f"(?:{regex.escape(n, literal_spaces=True)}){{e<={edits}}}", text[a:b])
            assert all(y <= a or x >= b for j, x, y, _ in found if j == i and (x, y) != (a, b))


def test_weaker_notices_before_better_ones():
    mpl = [i for i, (n, _) in enumerate(NOTICES) if n == "mozilla public license"][0]
    assert [x[1:] for x in notices("mozilla publik license mozilla public license") if x[0] == mpl] == [(0, 22, 1), (23, 45, 0)]
    assert len([x for x in notices("all rights reservd all rights reserved")]) == 2
    assert len([x for x in notices("all rights resarved. all rights reserved.")]) == 2


def test_many_notices_take_linear_time():
    text = "all rights resarved " * 50_000  # 1 MB
    began = time.time()
    assert len(notices(text)) == 50_000 and time.time() - began < 60


def test_awkward_rows(awkward, empty, docs):
    assert license_scan(awkward("n_base")).count() == 9 and license_scan(empty).count() == 0
    assert "text" not in license_scan(docs).columns and license_scan(docs).where("n_words is null or labels is null").count() == 0
