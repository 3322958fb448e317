"""Chat formatting by a template compiler.

Templates are written in a small sandboxed language: text, `{{ expression | filter }}`, `{% for x in y %}`,
`{% if %} {% elif %} {% else %} {% endif %}`, `{% set x = expression %}` and `{% generation %} ... {% endgeneration %}`,
which marks what a model is trained on. Expressions know literals, names, `.field` and `["field"]` of messages, `==`,
`!=`, `~`, `in`, `not`, `and`, `or`, `loop.first`, `loop.last`, `loop.index0`; nothing can be called but the filters below.
A template is parsed into a syntax tree, constant parts of which are folded, and turned into Python closures.

Texts are escaped so that no control string of the template can occur in them, and reading back is exact: control
strings may not begin and end alike, hence none can arise across the border of a text and a control string.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import extended

TOKEN = re.compile(r"""\s*(?:(?P<string>"[^"]*"|'[^']*')|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[|.~()\[\]]))""")
PIECES = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
CONSTANTS = {"true": True, "false": False, "none": None}


class TemplateError(ValueError):
    pass


# ---------------------------------------------------------------- parsing: nodes are tuples (kind, ...)


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at, source = [], 0, source.strip()
    while at < len(source):
        m = TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:]!r}")
        out.append((str(m.lastgroup), m[m.lastgroup]))
        at = m.end()
    return out


class _Expression:
    """Recursive descent over one expression."""

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def take(self, *texts: str) -> str | None:
        if self.peek() in texts and self.tokens[self.at][0] != "string":
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def whole(self) -> tuple:
        node = self.either()
        while self.take("|"):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "name":
                raise TemplateError("a filter's name is missing")
            self.at += 1
            node = ("filter", name, node)
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.peek()!r}")
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        node = self.joined()
        while op := self.take("==", "!=", "in"):
            node = (op, node, self.joined())
        return node

    def joined(self) -> tuple:
        node = self.single()
        while self.take("~"):
            node = ("~", node, self.single())
        return node

    def single(self) -> tuple:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "string":
            node: tuple = ("const", text[1:-1])
        elif kind == "number":
            node = ("const", int(text))
        elif kind == "name":
            node = ("const", CONSTANTS[text.lower()]) if text.lower() in CONSTANTS else ("name", text)
        elif text == "(":
            node = self.either()
            if not self.take(")"):
                raise TemplateError("a bracket is not closed")
        else:
            raise TemplateError(f"unexpected {text!r}")
        while op := self.take(".", "["):
            kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            self.at += 1
            if op == "." and kind == "name":
                field = text
            elif op == "[" and kind == "string" and self.take("]"):
                field = text[1:-1]
            else:
                raise TemplateError("a field's name is missing")
            if field.startswith("_"):
                raise TemplateError(f"field {field!r} is not allowed")
            node = ("field", node, field)
        return node


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    pieces, at = PIECES.split(source), 0

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal at
        body: list[tuple] = []
        while at < len(pieces):
            piece = pieces[at]
            at += 1
            if piece.startswith("{{"):
                body.append(("print", _Expression(piece[2:-2]).whole()))
            elif piece.startswith("{%"):
                tag = piece[2:-2].strip()
                word = tag.split(None, 1)[0] if tag else ""
                if word in ends:
                    return ("block", body), tag
                if m := re.fullmatch(r"for\s+([A-Za-z]\w*)\s+in\s+(.+)", tag, re.S):
                    body.append(("for", m[1], _Expression(m[2]).whole(), block("endfor")[0]))
                elif m := re.fullmatch(r"set\s+([A-Za-z]\w*)\s*=\s*(.+)", tag, re.S):
                    body.append(("set", m[1], _Expression(m[2]).whole()))
                elif word == "if":
                    body.append(branches(tag[2:]))
                elif tag == "generation":
                    body.append(("generation", block("endgeneration")[0]))
                else:
                    raise TemplateError(f"unknown tag {tag!r}")
            elif piece:
                body.append(("print", ("const", piece)))
        if ends:
            raise TemplateError(f"{ends[0]} is missing")
        return ("block", body), ""

    def branches(condition: str) -> tuple:
        test = _Expression(condition).whole()
        yes, tag = block("elif", "else", "endif")
        if tag.startswith("elif"):
            return ("if", test, yes, ("block", [branches(tag[4:])]))
        return ("if", test, yes, block("endif")[0] if tag == "else" else ("block", []))

    return block()[0]


# ---------------------------------------------------------------- folding


def fold(node: tuple, filters: dict[str, Callable]) -> tuple:
    """Evaluate constant parts, drop branches that cannot be taken and join neighbouring texts."""
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "block":
        body: list[tuple] = []
        for x in (fold(x, filters) for x in node[1]):
            for y in x[1] if x[0] == "block" else [x]:
                if y[0] == "print" and y[1][0] == "const" and body and body[-1][0] == "print" and body[-1][1][0] == "const":
                    body[-1] = ("print", ("const", _text(body[-1][1][1]) + _text(y[1][1])))
                else:
                    body.append(y)
        return ("block", body)
    if kind == "for":
        return ("for", node[1], fold(node[2], filters), fold(node[3], filters))
    if kind == "set":
        return ("set", node[1], fold(node[2], filters))
    if kind == "if":
        test, yes, no = (fold(x, filters) for x in node[1:])
        return (yes if test[1] else no) if test[0] == "const" else ("if", test, yes, no)
    parts = tuple(fold(x, filters) if isinstance(x, tuple) else x for x in node[1:])
    out = (kind, *parts)
    if kind not in ("print", "generation", "field") and all(x[0] == "const" for x in parts if isinstance(x, tuple)):
        return ("const", _value(out, filters)({}))
    return out


# ---------------------------------------------------------------- closures


def _text(x: Any) -> str:
    return "" if x is None else str(x)


def _value(node: tuple, filters: dict[str, Callable]) -> Callable[[dict], Any]:
    kind = node[0]
    if kind == "const":
        return lambda env, x=node[1]: x
    if kind == "name":
        return lambda env, n=node[1]: env.get(n)
    if kind == "field":
        inner = _value(node[1], filters)
        return lambda env, n=node[2]: x.get(n) if isinstance(x := inner(env), dict) else None
    if kind == "filter":
        if node[1] not in filters:
            raise TemplateError(f"unknown filter {node[1]!r}")
        return lambda env, f=filters[node[1]], inner=_value(node[2], filters): f(inner(env))
    if kind == "not":
        return lambda env, inner=_value(node[1], filters): not inner(env)
    a, b = _value(node[1], filters), _value(node[2], filters)
    return {
        "or": lambda env: a(env) or b(env),
        "and": lambda env: a(env) and b(env),
        "==": lambda env: a(env) == b(env),
        "!=": lambda env: a(env) != b(env),
        "in": lambda env: a(env) in (b(env) or ()),
        "~": lambda env: _text(a(env)) + _text(b(env)),
    }[kind]


class Output:
    """The text so far, and the spans between generation markers (code points)."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def generate(node: tuple, filters: dict[str, Callable]) -> Callable[[dict, Output], None]:
    """A closure that renders the node."""
    kind = node[0]
    if kind == "block":
        steps = [generate(x, filters) for x in node[1]]

        def block(env: dict, out: Output) -> None:
            for step in steps:
                step(env, out)

        return block
    if kind == "print":
        if node[1][0] == "const":
            return lambda env, out, text=_text(node[1][1]): out.add(text)
        return lambda env, out, value=_value(node[1], filters): out.add(_text(value(env)))
    if kind == "set":
        return lambda env, out, name=node[1], value=_value(node[2], filters): env.__setitem__(name, value(env))
    if kind == "if":
        test, yes, no = _value(node[1], filters), generate(node[2], filters), generate(node[3], filters)
        return lambda env, out: (yes if test(env) else no)(env, out)
    if kind == "generation":
        inner = generate(node[1], filters)

        def marked(env: dict, out: Output) -> None:
            start = out.length
            inner(env, out)
            out.spans.append((start, out.length))

        return marked
    name, items, body = node[1], _value(node[2], filters), generate(node[3], filters)

    def loop(env: dict, out: Output) -> None:
        rows, nothing = iter(items(env) or ()), object()  # taken one by one, so that a stream of turns is never held whole
        i, x = 0, next(rows, nothing)
        while x is not nothing:
            following = next(rows, nothing)
            body(env | {name: x, "loop": {"index0": i, "first": i == 0, "last": following is nothing}}, out)
            i, x = i + 1, following

    return loop


class ReadBack(Output):
    """Takes the formatted text piece by piece and reads it back turn by turn: digests of all turns and of what is trained on. Holds one turn."""

    def __init__(self) -> None:
        super().__init__()
        self.held, self.begun, self.n_turns, self.loss_chars = "", 0, 0, 0
        self.whole, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)
        if CONTROLS[2] in text:
            self.settle()

    def settle(self) -> None:
        """Read what has come so far, up to the end of the last whole turn."""
        self.held += "".join(self.parts)
        self.parts.clear()
        for a, b in self.spans:
            trained = Escape.undo(self.held[a - self.begun : b - self.begun])
            self.loss_chars += len(trained)
            self.loss.update(trained.encode("utf-8", "surrogatepass"))
        self.spans.clear()
        end = self.held.rfind(CONTROLS[2]) + len(CONTROLS[2])
        for role, said in read_back(self.held[:end]):
            self.n_turns += 1
            self.whole.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
        self.held, self.begun = self.held[end:], self.begun + end

    def result(self) -> tuple[int, str, int, str, int]:
        if self.parts or self.held or self.spans:
            raise ValueError("the last turn has no end")
        return self.n_turns, self.whole.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.length


class Escape:
    """Reversible escaping: a backslash is doubled, and one is put inside every control string, after its first character."""

    def __init__(self, controls: tuple[str, ...]):
        for c in controls:
            if not c or "\\" in c or any(c[:i] == c[-i:] for i in range(1, len(c))) or any(c in d for d in controls if d != c):
                raise TemplateError(f"control string {c!r} is empty, holds a backslash or another control string's end, or begins as it ends")
        self.find = re.compile("|".join([r"\\", *map(re.escape, controls)]))

    def __call__(self, text: Any) -> str:
        return self.find.sub(lambda m: m[0][0] + "\\" + m[0][1:], _text(text))

    @staticmethod
    def undo(text: str) -> str:
        return re.sub(r"(.)\\|(?s:.)", lambda m: m[1] or m[0], text) if "\\" in text else text


class Template:
    """A compiled template: `render(messages)` gives the formatted text and the trained spans."""

    def __init__(self, source: str, controls: tuple[str, ...]):
        self.escape = Escape(controls)
        self.filters: dict[str, Callable] = {"escape": self.escape, "trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower()}
        self.tree = fold(parse(source), self.filters)
        self.run = generate(self.tree, self.filters)

    def stream(self, messages: Iterator[dict], out: Output, **names: Any) -> Output:
        """Render into `out`, taking the messages one by one."""
        self.run({"messages": messages, **names}, out)
        return out

    def render(self, messages: list[dict], **names: Any) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        self.run({"messages": messages, **names}, out)
        return "".join(out.parts), out.spans


#: The production template: a turn is [INST]role[/INST]text</s>, and only the assistant's texts are trained on.
CONTROLS = ("[INST]", "[/INST]", "</s>")
TURNS = (
    "{% for m in messages %}[INST]{{ m.role | escape }}[/INST]"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "</s>{% endfor %}"
)


@functools.cache
def compiled(source: str, controls: tuple[str, ...]) -> Template:
    return Template(source, controls)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a text that TURNS has formatted: roles and texts without escapes."""
    out, at, (begin, middle, end) = [], 0, CONTROLS
    while at < len(formatted):
        if not formatted.startswith(begin, at):
            raise ValueError(f"no turn begins at {at}")
        a = formatted.index(middle, at)
        b = formatted.index(end, a)
        out.append((Escape.undo(formatted[at + len(begin) : a]), Escape.undo(formatted[a + len(middle) : b])))
        at = b + len(end)
    return out


def format_chats(df: DataFrame, source: str = TURNS, controls: tuple[str, ...] = CONTROLS, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: `key`, n_turns (long), formatted (string), spans (array of struct of start and end, trained code points).

    Turns are ordered by turn (null first), then role and text, so ties and repeated rows have a defined order and all
    are kept. A null role or text counts as empty; rows with a null key form one conversation. Columns other than the
    four named are ignored; an empty table gives no rows. One exchange, of the turns by key; a conversation must fit in
    memory here, as its text is one value of the result. `chat_digests` streams.
    """
    turns = df.select(F.col(key).alias("_key"), F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("m"))
    grouped = turns.groupBy("_key").agg(F.sort_array(F.collect_list("m")).alias("turns"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = compiled(source, controls)
        for batch in batches:
            done = [(len(m), *template.render(m)) for m in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.string()), pa.array([[{"start": a, "end": b} for a, b in x[2]] for x in done], span)]
            yield pa.RecordBatch.from_arrays(columns, [key, "n_turns", "formatted", "spans"])

    schema = extended(grouped.select(F.col("_key").alias(key)).schema, "n_turns long, formatted string, spans array<struct<start:bigint,end:bigint>>")
    return grouped.mapInArrow(run, schema)


def chat_digests(df: DataFrame, source: str = TURNS, controls: tuple[str, ...] = CONTROLS, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: `key`, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the formatted text.

    Order, ties, nulls and other columns as in `format_chats`; `source` has to write turns as TURNS does. No conversation
    is held whole: a task sorts its turns (spilling as it has to), formats them one by one and reads them back as they
    come, so a conversation of any number of turns takes the memory of its longest one. An empty table gives no rows.
    """
    named = df.select(F.col(f"`{key}`").alias("k"), F.coalesce(f"`{role}`", F.lit("")).alias("role"), F.coalesce(f"`{text}`", F.lit("")).alias("text"), F.col(f"`{turn}`").alias("turn"))
    ordered = named.repartition("k").sortWithinPartitions("k", "turn", "role", "text").select("k", "role", "text")
    schema = extended(ordered.select(F.col("k").alias(key)).schema, "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template, kinds = compiled(source, controls), to_arrow_schema(schema)
        turns = ((k.as_py(), {"role": r.as_py(), "text": t.as_py()}) for batch in batches for k, r, t in zip(*batch.columns))
        rows: list[tuple] = []
        for k, said in itertools.groupby(turns, lambda x: x[0]):
            rows.append((k, *template.stream((m for _, m in said), ReadBack()).result()))
            if len(rows) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)
                rows = []
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], schema=kinds)

    return ordered.mapInArrow(run, schema)
