"""License scans: fuzzy search for short notices.

A notice that may have e edits is split into e + 1 pieces; wherever it stands with at most e edits, one piece stands
there unchanged (pigeonhole). All pieces of all notices are looked up in one pass of an Aho-Corasick automaton; around
each hit, where the notice could lie, the regex library's bounded-error matching verifies it and reports the span.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import extended

# Exact phrases (words that stand consecutively) with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Notices in lower case with their labels.
NOTICES = (
    ("licensed under the apache license", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted, free of charge, to any person", "mit"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("creative commons attribution", "cc-by"),
    ("licensed under cc by", "cc-by"),
    ("dedicated to the public domain", "public-domain"),
    ("all rights reserved", "reserved"),
    ("this work is licensed under", "licensed"),
)
ERRORS_PER_CHARACTER = 0.1

WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x61:0x7B] = WORD_BYTES[0x80:] = True
GAP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]++"
PHRASE = tuple((re.compile(GAP.join(w.encode() for w in phrase.split())), label) for phrase, label in PHRASES)


def errors(notice: str) -> int:
    return max(1, int(len(notice) * ERRORS_PER_CHARACTER))


def pieces(notice: str) -> list[tuple[int, str]]:
    """The notice cut into one piece more than it may have edits, with their offsets."""
    n, parts = len(notice), errors(notice) + 1
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@functools.cache
def automaton() -> tuple[ahocorasick.Automaton, list[regex.Pattern]]:
    found: dict[str, list[tuple[int, int]]] = {}
    for i, (notice, _) in enumerate(NOTICES):
        for offset, piece in pieces(notice):
            found.setdefault(piece, []).append((i, offset))
    out = ahocorasick.Automaton()
    for piece, where in found.items():
        out.add_word(piece, (len(piece), where))
    out.make_automaton()
    return out, [regex.compile(f"(?b)(?:{regex.escape(n, literal_spaces=True)}){{e<={errors(n)}}}") for n, _ in NOTICES]


def notices(lower: str) -> list[tuple[int, int, int, int]]:
    """(notice, start, end, edits) of the notices in a lower-cased text, by start; non-overlapping for each notice.

    Around every seed hit the best match is verified on its own; of matches of one notice that overlap the one with the
    fewest edits stays (then the first, then the shorter). Time grows with the number of hits.
    """
    pieces_of, patterns = automaton()
    spots: dict[int, set[int]] = {}
    for end, (length, where) in pieces_of.iter(lower):
        for i, offset in where:
            spots.setdefault(i, set()).add(end + 1 - length - offset)
    out = []
    for i, begins in spots.items():
        size, slack = len(NOTICES[i][0]), errors(NOTICES[i][0])
        hits = set()
        for begin in begins:
            a, b = max(0, begin - slack), min(len(lower), begin + size + slack)
            if b - a >= size - slack and (m := patterns[i].search(lower, a, b)):
                hits.add((sum(m.fuzzy_counts), m.start(), m.end()))
        taken: list[tuple[int, int]] = []
        for edits, a, b in sorted(hits):
            at = bisect.bisect(taken, (a, b))
            if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
                taken.insert(at, (a, b))
                out.append((i, a, b, edits))
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def phrases(data: bytes) -> tuple[int, list[tuple[int, str]]]:
    """Number of words of a lower-cased text in UTF-8, and the exact phrases in it: (index of the first word, label)."""
    inside = WORD_BYTES[np.frombuffer(data, np.uint8)]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    index, found = None, []
    for pattern, label in PHRASE:
        for m in pattern.finditer(data):
            if begins[m.start()] and (m.end() == len(data) or not inside[m.end()]):
                index = np.cumsum(begins) - 1 if index is None else index
                found.append((int(index[m.start()]), label))
    return int(begins.sum()), found


LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))


def scan(text: str) -> tuple:
    data = text.encode("utf-8", "surrogatepass").translate(LOWER)
    n_words, exact = phrases(data)
    fuzzy = notices(data.decode("utf-8", "surrogatepass"))
    base = sorted({label for _, label in exact})
    labels = sorted({*base, *(NOTICES[i][1] for i, *_ in fuzzy)})
    starts = [at for at, _ in exact]
    score = max([1.0] * bool(exact) + [1 - e / len(NOTICES[i][0]) for i, _, _, e in fuzzy], default=0.0)
    spans = [{"label": NOTICES[i][1], "start": a, "end": b, "edits": e} for i, a, b, e in fuzzy]
    return n_words, len(exact), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), score, spans


def license_scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace the column `text` by what was found in it; other columns stay; no shuffle.

    n_words, n_base (long), first_word, last_word (long, of exact phrases, else null), base_labels, labels (string,
    distinct, sorted, comma-joined; empty if none), score (double: 1 for an exact phrase, else the best notice's share
    of unedited characters), notices (array of struct of label, start, end in code points, and edits). A null text
    counts as empty. Only A-Z are lowered. Very long texts are searched whole, in time linear in their seed hits; ties
    between notices are all reported, those between matches of one are decided by `notices`. Repeated rows are rows of
    their own, an empty table gives no rows. Columns with these names are replaced.
    """
    added = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices array<struct<label:string,start:bigint,end:bigint,edits:bigint>>"
    names = [part.split()[0] for part in added.split(", ")]
    kept = [c for c in df.columns if c not in (*names, text)]
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
    df = df.select(*[f"`{c}`" for c in kept], f"`{text}`")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t.as_py() or "") for t in batch.column(len(kept))]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *columns], [*kept, *names])

    return df.mapInArrow(run, extended(df.select(*[f"`{c}`" for c in kept]).schema, added))
