import random
import re
import time
from collections import Counter

from loomline.llm.pii import AFTER, BASE, KINDS, NEXT_TO, Settings, candidates, contexts, extract, luhn, occurrences, personal_data, scored_patterns, secrets, seeds


def brute(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]


def test_seeds_against_the_plain_expressions():
    rng = random.Random(5)
    parts = ["@", ".", "-", "+", " ", "a", "b.c", "1", "25", "256", "0255", "1.2.3.4", "4111111111111111", "(", ")", "%", "é", "\n", "x@y.z", "--", "4111 1111-1111 1111"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert seeds(text) == brute(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1 " * 60_000, "+" + "1 " * 100_000, "1 " * 100_000 + "x"):
        seeds(text)


def test_whole_table(docs):
    for r, t in zip(personal_data(docs).orderBy("doc_id").collect(), docs.orderBy("doc_id").collect()):
        want = brute(t.text)
        assert [(s.kind, s.start, s.end) for s in r.base] == want and set(r.base) <= set(r.spans)


def test_patterns_discover_unseen_identifiers(spark):
    rows = [(i, f"nothing here, mailto: user{i}@host{i}.example.org soon") for i in range(30)]
    rows += [(100, "some text, mailto: user77@intranet soon after"), (101, "the code is user77@intranet2x and no more"), (102, "year 2024x01 and others")]
    got = {r.doc_id: r for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s.kind, rows[30][1][s.start : s.end]) for s in got[100].spans] == [("email", "user77@intranet")] and not got[100].base
    assert not got[101].spans and not got[102].spans
    common = [(i, f"the user{i}@host{i}.example.org the the the {i}") for i in range(30)] + [(100, "the order 5512345 the")]
    assert not {r.doc_id: r for r in personal_data(spark.createDataFrame(common, "doc_id long, text string")).collect()}[100].spans


def test_awkward_rows(awkward, empty):
    assert personal_data(awkward("base")).count() == 9
    assert personal_data(empty, settings=Settings(support=1)).count() == 0
    assert BASE == ("email", "ip", "card", "phone") and KINDS == (*BASE, "secret")
    for extra in ("_key", "_text", "_row", "seen", "found"):
        assert sum(len(r.spans) for r in personal_data(awkward(extra)).collect()) == 0


def brute_scores(texts, s):
    """Pattern scores by plain loops over all occurrences and all words."""
    seen = [(side, word, shape, token, kind) for t in texts for _, _, kind, shape, token, around in occurrences(t, seeds(t) + [("secret", a, b) for a, b in secrets(t)]) for side, word in around]
    total = Counter()
    for t in (t.lower() for t in texts):
        words = t.split()
        for w in words:
            total["before", w] += 1
            total["after", w] += 1
        for pair in zip(words, words[1:]):
            total["pair", " ".join(pair)] += 1
        for m in re.finditer(r"(?=\b(\w+[^\w\s]+)(?=\S))", t):
            if t[m.end(1)] and re.match(r"[\w]", t[m.end(1)]):
                total["glued", m[1]] += 1
        for m in re.finditer(r"(?<![^\W_])[^\W\d_]{2,}[-_]", t):
            total["begins", m[0]] += 1
    patterns = {}
    for side, word, shape, _, _ in seen:
        for kind in KINDS:
            tokens = {x[3] for x in seen if x[:3] == (side, word, shape) and x[4] == kind}
            near = sum(x[:3] == (side, word, shape) for x in seen)
            if len(tokens) >= s.support and near >= s.confidence * total[side, word]:
                patterns[side, word, shape, kind] = 0.0
    sure = {(x[3], x[4]) for x in seen if x[4]}
    score = {(x[3], kind): float((x[3], kind) in sure) for x in seen for kind in KINDS}
    for _ in range(s.rounds):
        for p in patterns:
            patterns[p] = min(0.999, sum(score[x[3], p[3]] for x in seen if x[:3] == p[:3]) / total[p[0], p[1]])
        for token, kind in score:
            doubt = 1.0
            for p in patterns:
                if p[3] == kind and any(x[3] == token and x[:3] == p[:3] for x in seen):
                    doubt *= 1 - patterns[p]
            score[token, kind] = max(float((token, kind) in sure), 1 - doubt)
    return patterns


def test_scores_against_brute_force(spark):
    rng = random.Random(6)
    texts = []
    for i in range(120):
        mail, other = f"u{i % 17}@h{i}.example.org", f"id{i}x{i}"
        texts.append(" ".join(rng.choice(["reach", "the", mail, other, "mailto:" + mail, "write to " + mail, "code " + other, "write to " + other, "mailto:" + other, "now"]) for _ in range(6)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    s = Settings(confidence=0.3)
    got = {(r.side, r.word, r.shape, r.kind): r.confidence for r in scored_patterns(df, extract(df, "doc_id", "text"), "text", s).collect()}
    want = brute_scores(texts, s)
    assert got.keys() == want.keys() and len(want) >= 3 and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    again = {(r.side, r.word, r.shape, r.kind): r.confidence for r in scored_patterns(df, extract(df, "doc_id", "text"), "text", Settings(confidence=0.3, patterns_per_pass=2)).collect()}
    assert again.keys() == got.keys()


def test_secrets_and_what_their_patterns_add(spark):
    rng = random.Random(7)
    keys = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(12)]
    rows = [(i, f'noise{i} noise token = "{k}" word{i}') for i, k in enumerate(keys)] + [(100, f'TOKEN = "{keys[0].upper()}"!! X'), (101, 'token = "Ab-9912-zz" y'), (102, f"commit {keys[3]} is no secret")]
    got = {r.doc_id: r for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    say = lambda i: [(s.kind, dict(rows)[i][s.start : s.end]) for s in got[i].spans]
    assert say(0) == [("secret", keys[0])] and say(100) == [("secret", keys[0].upper())] and say(101) == [("secret", "Ab-9912-zz")] and say(102) == []
    assert not any(r.base for r in got.values())


def test_identifiers_of_any_length(spark):
    long = "user" + "7" * 5_000
    word = "w" * 3_000
    rows = [(i, f"x, mailto: user{i}@host{i}.example.org soon; {word} user{i}@mail{i}.example.org") for i in range(20)]
    rows += [(50 + i, f"mailto:user{i}@host{i}.example.org") for i in range(9)]
    rows += [(100, f"x, mailto: {long}@intranet soon"), (101, f"y {word} {long}@intranet"), (102, "http://a.b/c?q=1;mailto: " + "pre,fix;" * 400 + " mailto: user5@local;z"), (103, f"mailto:a1@b2.example.org,mailto:{long}@x")]
    got = {r.doc_id: r for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    say = lambda i: [(s.kind, dict(rows)[i][s.start : s.end]) for s in got[i].spans]
    assert say(100) == say(101) == [("email", f"{long}@intranet")] and say(102) == [("email", "user5@local")]
    assert say(103) == [("email", "a1@b2.example.org"), ("email", f"{long}@x")] and got[103].base


def test_candidates_and_contexts_take_linear_time():
    for text in ("a1b2c3," * 150_000, "x" * 1_000_000 + "1", "1.2.3.4," * 100_000, 'k="' * 200_000 + "1", "\u00e91 " * 200_000, "=" * 500_000 + "12345"):
        began = time.time()
        occurrences(text, seeds(text))
        assert time.time() - began < 20
    assert candidates("a;bb77.cc, dd9;;12345-", 0, 22) == [(2, 9), (16, 21)]
    assert contexts("see id: abc-77 then", 0, 8, 14, 19) == [("before", "id:"), ("pair", "see id:"), ("after", "then"), ("begins", "abc-")]
    assert AFTER and NEXT_TO == "\0"
