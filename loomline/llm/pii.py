"""Personal data by bootstrapped contextual extraction.

Exact expressions find seed entities: four base kinds, and a small set of secrets, one in `seed_share` (by its CRC-32) of the
quoted lower-case hexadecimal digests that are assigned to a name. All other secrets have to be found by patterns. What stands around a seed, together with the seed's shape, gives lexical patterns: the word before (`=`), the
two words before (`token =`), a name glued to it (`mailto:`), the word after, and how the token itself begins (`sk-`).
Spark builds the graph of patterns and instances and scores it in turns: a pattern is as good as the share of all its
occurrences in the corpus that stand at good instances, an instance as good as the patterns that point to it say
together. Identifier-like tokens that a pattern of high confidence points to are added; the seeds all stay.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, extended

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")

# The runs are possessive and begin where no run could have begun before, so that each text is read once.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT = re.compile(r"[0-9]")
DIGEST = re.compile(r'"([0-9a-f]{32,}+)"')


def emails(text: str) -> list[tuple[int, int]]:
    """`[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, searched for from the @ to both sides."""
    out, least, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > least and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            least = m.end()
        else:
            least = at + 1
        at = text.find("@", least)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def secrets(text: str) -> list[tuple[int, int]]:
    """`name = "digest"` or `name: "digest"`: spans of the digests, of letters and digits both."""
    out = []
    for m in DIGEST.finditer(text):
        before = m.start()
        while before and text[before - 1].isspace():
            before -= 1
        if before and text[before - 1] in "=:" and DIGIT.search(m[1]) and not m[1].isdigit():
            before -= 1
            while before and text[before - 1].isspace():
                before -= 1
            if before and text[before - 1].isalnum():
                out.append(m.span(1))
    return out


def seeds(text: str) -> list[tuple[str, int, int]]:
    """Base entities as (kind, start, end), by kind as listed, then start; code points, end exclusive."""
    out = [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if 16 <= m.end() - m.start() and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


MARK = re.compile(r"[0-9@]")
DELIMITERS = frozenset(" \t\n\r\x0b\x0c\"'()[]{}<>|,;:=&?!*#$/\\")
EDGES = ".%-_+~^`"
AFTER = re.compile(r"\S*+\s++(\S++)")
GLUED = re.compile(r"\w++[^\w\s]++(?=\S)")
BEGINNING = re.compile(r"[^\W\d_]{2,}+[-_]")
NEXT_TO = "\0"  # stands for the occurrence before

#: Kinds of patterns; the counts of all their places in the corpus are those of words, pairs of words, and glued names.
SIDES = ("before", "pair", "glued", "after", "begins")


def shape(token: str) -> str:
    """What kind of characters a token has: an @, letters and digits, or digits only. How rare its context is otherwise decides."""
    return "@" if "@" in token else "a9" if any(c.isalpha() for c in token) else "9"


def candidates(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Identifier-like parts of a text between two places: cut at white space and delimiters, of any length, with a digit or an @."""
    out, at = [], start
    while m := MARK.search(text, at, end):
        a, b = m.start(), m.end()
        while a > at and text[a - 1] not in DELIMITERS and not text[a - 1].isspace():
            a -= 1
        while b < end and text[b] not in DELIMITERS and not text[b].isspace():
            b += 1
        at = b
        while a < b and text[a] in EDGES:
            a += 1
        while a < b and text[b - 1] in EDGES:
            b -= 1
        if b - a >= 5 and MARK.search(text, a, b):
            out.append((a, b))
    return out


def contexts(text: str, floor: int, start: int, end: int, following: int) -> list[tuple[str, str]]:
    """Patterns of what stands from `start` to `end`, between the occurrence that ends at `floor` and the one that begins at `following`."""
    out: list[tuple[str, str]] = []
    words = ((NEXT_TO if floor else "") + text[floor:start]).rsplit(None, 3)
    glue = "" if start == floor or text[start - 1].isspace() else words.pop() if words else ""
    i = len(glue)
    while i and not (glue[i - 1].isalnum() or glue[i - 1] == "_"):
        i -= 1
    j = i
    while j and (glue[j - 1].isalnum() or glue[j - 1] == "_"):
        j -= 1
    if any(c.isalpha() for c in glue[j:i]):
        if i < len(glue):
            out.append(("glued", glue[j:].lower()))
    elif words:
        out.append(("before", words[-1].lower()))
        if len(words) > 1:
            out.append(("pair", f"{words[-2]} {words[-1]}".lower()))
    if (m := AFTER.match(text, end, following)) and (m.end() < following or following == len(text)):  # not cut off by the next occurrence
        out.append(("after", m[1].lower()))
    if m := BEGINNING.match(text, start, end):
        out.append(("begins", m[0].lower()))
    return [(side, word) for side, word in out if NEXT_TO not in word]


def occurrences(text: str, found: list[tuple[str, int, int]]) -> list[tuple[int, int, str | None, str, str, list[tuple[str, str]]]]:
    """Seeds and candidates between them: start, end, kind (null: none), shape, token, contexts. Every part of the text is read a bounded number of times."""
    places: list[tuple[int, int, str | None]] = []
    done = 0
    for a, b, kind in sorted((a, b, k) for k, a, b in found):
        if a > done:
            places += [(x, y, None) for x, y in candidates(text, done, a)]
        places.append((a, b, kind))
        done = max(done, b)
    places += [(x, y, None) for x, y in candidates(text, done, len(text))]
    out, floor = [], 0
    for i, (a, b, kind) in enumerate(places):
        following = places[i + 1][0] if i + 1 < len(places) else len(text)
        out.append((a, b, kind, shape(text[a:b]), text[a:b].lower(), contexts(text, min(floor, a), a, b, max(b, following))))
        floor = max(floor, b)
    return out


@dataclass(frozen=True)
class Settings:
    support: int = 3  # different seeds that a pattern must stand at
    confidence: float = 0.6
    rounds: int = 3
    seed_share: int = 3  # one secret in so many is a seed
    patterns_per_pass: int = 100_000  # how many patterns one pass over the texts counts


OCCURRENCE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("shape", pa.string()), ("token", pa.string()), ("contexts", pa.list_(pa.struct([("side", pa.string()), ("word", pa.string())])))])


def seed_secrets(text: str, share: int) -> list[tuple[str, int, int]]:
    """The secrets that begin the search: of equal digests all or none."""
    return [("secret", a, b) for a, b in secrets(text) if zlib.crc32(text[a:b].encode()) % share == 0]


def extract(df: DataFrame, key: str, text: str, share: int = Settings.seed_share) -> DataFrame:
    """_key, _row (a number of its own), base, found (arrays of struct of kind, start, end; without and with seed secrets) and seen (array of occurrences)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            base, every, seen = [], [], []
            for t in batch.column(1):
                t = t.as_py() or ""
                first = seeds(t)
                more = first + seed_secrets(t, share)
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in first])
                every.append([{"kind": k, "start": a, "end": b} for k, a, b in more])
                seen.append([{"start": a, "end": b, "kind": k, "shape": s, "token": w, "contexts": [{"side": x, "word": y} for x, y in c]} for a, b, k, s, w, c in occurrences(t, more)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, span), pa.array(every, span), pa.array(seen, pa.list_(OCCURRENCE))], ["_key", "base", "found", "seen"])

    spans = "array<struct<kind:string,start:int,end:int>>"
    own = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    schema = extended(own.select("_key").schema, f"base {spans}, found {spans}, seen array<struct<start:int,end:int,kind:string,shape:string,token:string,contexts:array<struct<side:string,word:string>>>>")
    return cut(own.mapInArrow(run, schema)).withColumn("_row", F.monotonically_increasing_id())  # over files that stay as they are


def count_patterns(df: DataFrame, text: str, patterns: list[tuple[str, str]]) -> DataFrame:
    """How often each of the patterns (side, word) stands anywhere in the texts, whatever follows: side, word, total. Counted by part before the exchange."""
    shared = df.sparkSession.sparkContext.broadcast({s: frozenset(w for side, w in patterns if side == s) for s in SIDES})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            counts: Counter[tuple[str, str]] = Counter()
            for t in batch.column(0):
                t = (t.as_py() or "").lower()
                words = t.split() if wanted["before"] or wanted["after"] or wanted["pair"] else []
                for side in ("before", "after"):
                    if wanted[side]:
                        counts.update((side, w) for w in words if w in wanted[side])
                if wanted["pair"]:
                    counts.update(("pair", p) for p in map(" ".join, zip(words, words[1:])) if p in wanted["pair"])
                if wanted["glued"]:
                    counts.update(("glued", g) for g in GLUED.findall(t) if g in wanted["glued"])
                if wanted["begins"]:
                    counts.update(("begins", g) for g in WORD_BEGINNING.findall(t) if g in wanted["begins"])
            rows = [(*p, n) for p, n in counts.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 3, (pa.string(), pa.string(), pa.int64()))], ["side", "word", "total"])

    return df.select(F.col(f"`{text}`").alias("_text")).mapInArrow(run, "side string, word string, total long").groupBy("side", "word").agg(F.sum("total").alias("total"))


WORD_BEGINNING = re.compile(r"(?<![^\W_])[^\W\d_]{2,}+[-_]")


def _instances(found: DataFrame) -> DataFrame:
    """Occurrences by pattern: _row, start, end, kind, token, and the pattern's side, word and shape."""
    rows = found.select("_row", F.explode("seen").alias("o")).select("_row", "o.*")
    return rows.withColumn("p", F.explode("contexts")).select("_row", "start", "end", "kind", "token", "p.side", "p.word", "shape")


def scored_patterns(df: DataFrame, found: DataFrame, text: str, s: Settings) -> DataFrame | None:
    """Patterns with enough seeds: side, word, shape, kind, seeds, total and confidence. None if there are none."""
    pattern = ["side", "word", "shape"]
    edges = _instances(found).groupBy(*pattern, "token").agg(F.max("kind").alias("seed"), F.count("*").alias("n"))
    supported = edges.where("seed is not null").groupBy(*pattern, F.col("seed").alias("kind")).agg(F.count("*").alias("seeds")).where(F.col("seeds") >= s.support)
    near = edges.groupBy(*pattern).agg(F.sum("n").alias("near"))
    likely = cut(supported.join(near, pattern))
    words = cut(likely.select("side", "word").distinct())
    n, totals = words.count(), None
    if not n:
        return None
    passes = -(-n // s.patterns_per_pass)
    for i in range(passes):  # bounded parts of the patterns, each against all texts
        part = words if passes == 1 else words.where(F.pmod(F.xxhash64("side", "word"), F.lit(passes)) == i)
        counted = count_patterns(df, text, [tuple(r) for r in part.collect()])
        totals = counted if totals is None else totals.unionByName(counted)
    # no pattern can be better than all its occurrences at identifiers would make it
    patterns = cut(likely.join(totals, ["side", "word"]).where(F.col("near") >= s.confidence * F.col("total")).select(*pattern, "kind", "seeds", "total"))
    if patterns.isEmpty():
        return None
    graph = cut(edges.join(patterns, pattern))
    certain = F.max(F.when(F.col("seed") == F.col("kind"), 1.0).otherwise(0.0))
    scores, good = graph.groupBy("token", "kind").agg(certain.alias("score")), None
    for _ in range(s.rounds):
        good = graph.join(scores, ["token", "kind"]).groupBy(*pattern, "kind").agg(F.max("seeds").alias("seeds"), F.max("total").alias("total"), (F.sum(F.col("score") * F.col("n")) / F.max("total")).alias("confidence"))
        good = cut(good.withColumn("confidence", F.least("confidence", F.lit(0.999))))
        doubt = F.exp(F.sum(F.log(1 - F.col("confidence"))))
        by = graph.join(good.select(*pattern, "kind", "confidence"), [*pattern, "kind"]).groupBy("token", "kind").agg(certain.alias("seed"), (1 - doubt).alias("by"))
        scores = cut(by.select("token", "kind", F.greatest("seed", "by").alias("score")))
    return good


def discover(df: DataFrame, found: DataFrame, text: str, s: Settings) -> DataFrame | None:
    """Spans that patterns of high confidence add: _row, kind, start, end. None if no pattern has enough seeds."""
    good = scored_patterns(df, found, text, s)
    if good is None:
        return None
    accepted = good.where(F.col("confidence") >= s.confidence).select("side", "word", "shape", F.col("kind").alias("as"), "confidence")
    hits = _instances(found).where("kind is null").join(accepted, ["side", "word", "shape"])
    return hits.groupBy("_row", "start", "end").agg(F.max_by("as", F.struct("confidence", "as")).alias("kind"))


def personal_data(df: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per row of `df`: `key`, base and spans (arrays of struct of kind, start, end; by kind as listed, then start).

    base holds the seeds of the four base kinds; spans also the seed secrets and what the patterns add, never overlapping a seed.
    A null text counts as empty, an empty one has no spans; a null key is kept. Repeated rows and equal keys are rows of
    their own; of patterns tied in confidence the kind later in the alphabet wins. An empty table gives no rows; other
    columns are ignored, whatever their names. Whole texts are read, tokens and context words of any length. What is
    shuffled grows with the number of identifiers, not of words.
    """
    found = extract(df, key, text, settings.seed_share)
    added = discover(df, found, text, settings)
    spans = F.col("found")
    if added is not None:
        more = added.groupBy("_row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
        found = found.join(more, "_row", "left")
        spans = F.concat("found", F.coalesce("more", F.array().cast("array<struct<kind:string,start:int,end:int>>")))
    order = F.transform(spans, lambda x: F.struct(F.array_position(F.array(*[F.lit(k) for k in KINDS]), x["kind"]).alias("rank"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    sorted_ = F.transform(F.array_sort(order), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return found.select(F.col("_key").alias(key), "base", sorted_.alias("spans"))


def joined(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
