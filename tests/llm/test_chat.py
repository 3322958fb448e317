import hashlib
import random

import pytest
from loomline.llm.chat import CONTROLS, TURNS, Escape, ReadBack, Template, TemplateError, chat_digests, fold, format_chats, parse, read_back


def test_round_trip_of_hostile_texts():
    rng, template = random.Random(3), Template(TURNS, CONTROLS)
    parts = ["\\", "[INST]", "[/INST]", "</s>", "[", "]", "<", "/s>", "INST]", "a", "\n", "", "é", "\\\\", "[\\INST]"]
    for _ in range(3000):
        turns = [{"role": rng.choice(["user", "assistant", "", "[INST]", "x\\"]), "text": "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))} for _ in range(rng.randint(0, 5))]
        text, spans = template.render(turns)
        assert read_back(text) == [(t["role"], t["text"]) for t in turns]
        assert [Escape.undo(text[a:b]) for a, b in spans] == [t["text"] for t in turns if t["role"] == "assistant"]


def test_language():
    t = Template("{% set x = 'a' ~ 1 %}{% for m in messages %}{% if loop.first %}<{% elif m.role != 'user' and not (m.n == 2) %}+{% else %}-{% endif %}{{ m['text'] | upper }}{{ x }}{% endfor %}!", ())
    assert t.render([{"text": "p", "role": "user"}, {"text": "q", "role": "bot"}, {"text": "r", "role": "user"}])[0] == "<Pa1+Qa1-Ra1!"


def test_constants_are_folded():
    filters = {"upper": lambda x: x.upper()}
    assert fold(parse("a{{ 'b' | upper }}{% if 1 == 1 %}c{% else %}{{ y }}{% endif %}d"), filters) == ("block", [("print", ("const", "aBcd"))])
    assert fold(parse("{{ x ~ ('a' ~ 'b') }}"), filters) == ("block", [("print", ("~", ("name", "x"), ("const", "ab")))])


@pytest.mark.parametrize("source", ["{{ m.__class__ }}", "{{ open('x') }}", "{% import os %}", "{% if x %}", "{{ x | nothing }}", "{{ }}", "{{ 1 + 1 }}", "{% for m in messages %}"])
def test_what_is_not_allowed(source):
    with pytest.raises(TemplateError):
        Template(source, ())


def test_unsafe_control_strings():
    for bad in (("abca",), ("x\\y",), ("<a>", "<<a>]"), ("",)):
        with pytest.raises(TemplateError):
            Escape(bad)


def test_digests(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = {r.conv_id: r for r in chat_digests(turns).collect()}
    groups = {}
    for r in turns.orderBy("conv_id", "turn").collect():
        groups.setdefault(r.conv_id, []).append(r)
    assert set(found) == set(groups)
    for k, rows in groups.items():
        whole, loss = "".join(f"{r.role}\n{r.text}\n" for r in rows), "".join(r.text for r in rows if r.role == "assistant")
        assert (found[k].n_turns, found[k].turns_sha256) == (len(rows), hashlib.sha256(whole.encode()).hexdigest())
        assert (found[k].loss_chars, found[k].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_awkward_rows(spark):
    schema = "conv_id long, turn long, role string, text string, spans int"
    rows = [(1, 0, "user", None, 1), (1, 0, "user", None, 1), (1, None, "assistant", "", 2), (None, 1, None, "x" * 50_000, 3), (None, 1, "assistant", "y", 4)]
    got = {r.conv_id: r for r in format_chats(spark.createDataFrame(rows, schema)).collect()}
    assert got[1].n_turns == 3 and read_back(got[1].formatted)[0] == ("assistant", "") and got[None].n_turns == 2
    assert chat_digests(spark.createDataFrame([], schema)).count() == 0 and format_chats(spark.createDataFrame([], schema)).count() == 0
    for r in chat_digests(spark.createDataFrame(rows, schema)).collect():
        assert (r.n_turns, r.formatted_chars) == (got[r.conv_id].n_turns, len(got[r.conv_id].formatted))


def test_streaming_holds_one_turn():
    class Watched(ReadBack):
        most = 0

        def add(self, text):
            super().add(text)
            self.most = max(self.most, len(self.held) + sum(map(len, self.parts)) + len(self.spans))

    out = Template(TURNS, CONTROLS).stream(({"role": "assistant" if i % 2 else "user", "text": f"turn {i} </s>\\"} for i in range(50_000)), Watched())
    assert out.n_turns == 50_000 and out.most < 200 and out.result()[2] == sum(len(f"turn {i} </s>\\") for i in range(1, 50_000, 2))


def test_whole_and_streamed_agree(spark):
    rng = random.Random(4)
    parts = ["\\", "[INST]", "[/INST]", "</s>", "[", "a", "\n", "é", "🙂"]
    rows = [(c, i, rng.choice(["user", "assistant", None]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) or None) for c in (1, 2, None, 4) for i in range(rng.randint(1, 30))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {r.conv_id: r for r in format_chats(df).collect()}
    for r in chat_digests(df).collect():
        text, turns = whole[r.conv_id].formatted, read_back(whole[r.conv_id].formatted)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest() and r.formatted_chars == len(text)
        assert r.loss_sha256 == hashlib.sha256("".join(Escape.undo(text[s.start : s.end]) for s in whole[r.conv_id].spans).encode()).hexdigest()
