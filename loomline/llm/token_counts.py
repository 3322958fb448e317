"""Token counts by finite-state tokenizer compilation.

A byte-level BPE vocabulary is compiled into two deterministic transducers.

1. The boundary transducer reads character classes and marks where a pre-token begins. The whole batch of texts is
   one stream cut into chunks; each chunk is reduced to its state map (entry state -> exit state), the maps are
   composed by a parallel prefix scan, and a second pass with the known entry states writes the marks. A long text
   is just many chunks, and a pre-token may cross any number of them.
2. The counting transducer reads the bytes of a pre-token. Its transitions carry the change in the number of tokens,
   so that a count is the sum along the path. A state holds, for each place where a vocabulary entry could still
   be open, the trie node reached, the last token before that place and the token count there relative to now; two
   places in a text with equal such sets behave alike from there on, so the states are finite. They are determinised
   when first reached and kept (bounded by `max_states`, then compiled anew).

Correct because of a property of BPE: the last token of a prefix's encoding is the one token t that ends there, such
that the token before t and t are an encoding together; so an extension by one byte is decided by the open places.
"""

from __future__ import annotations

import functools
import json
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended

# Character classes. The letters that can follow an apostrophe in a contraction have classes of their own.
END, LETTER, NUMBER, SPACE, WHITE, QUOTE, OTHER, L_STMD, L_RV, L_L, L_E = range(11)
CLASSES = 11
# States: nothing open; a run of letters, numbers, others; an apostrophe that may begin a contraction, then with r or v,
# then with l; white space: one or more characters, the last one a plain space or not.
START, IN_L, IN_N, IN_O, APOS, APOS_RV, APOS_L, ONE_SP, MANY_SP, ONE_WH, MANY_WH = range(11)
STATES = 11
NEVER = 1 << 30
HERE, BEFORE = 1, 2  # a pre-token begins at this character, at the one before

#: Unicode's White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

LETTERS = (LETTER, L_STMD, L_RV, L_L, L_E)


def _opened(c: int) -> int:
    """The state after a character that begins a pre-token."""
    return IN_L if c in LETTERS else {NUMBER: IN_N, OTHER: IN_O, QUOTE: APOS, SPACE: ONE_SP, WHITE: ONE_WH}[c]


def _step(state: int, c: int) -> tuple[int, int]:
    """Next state and marks of the boundary transducer."""
    if c == END:
        return START, BEFORE if state in (APOS_RV, APOS_L) else 0
    fresh = _opened(c), HERE
    if state == IN_L:
        return (IN_L, 0) if c in LETTERS else fresh
    if state == IN_N:
        return (IN_N, 0) if c == NUMBER else fresh
    if state == IN_O:
        return (IN_O, 0) if c in (OTHER, QUOTE) else fresh
    if state == APOS:
        if c in (OTHER, QUOTE):
            return IN_O, 0
        return {L_STMD: (START, 0), L_RV: (APOS_RV, 0), L_L: (APOS_L, 0)}.get(c, fresh)
    if state in (APOS_RV, APOS_L):
        if c == (L_E if state == APOS_RV else L_L):
            return START, 0
        return (IN_L, BEFORE) if c in LETTERS else (fresh[0], HERE | BEFORE)
    if state in (ONE_SP, MANY_SP, ONE_WH, MANY_WH):
        if c in (SPACE, WHITE):
            return (MANY_SP if c == SPACE else MANY_WH), 0
        apart = BEFORE if state in (MANY_SP, MANY_WH) else 0
        if state in (ONE_SP, MANY_SP):  # the last space joins what follows, where an apostrophe begins no contraction
            return (IN_O if c == QUOTE else fresh[0]), apart
        return fresh[0], HERE | apart
    return fresh


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes by code point; next states and marks by state * CLASSES + class."""
    classes = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    every = "".join(chr(cp) for cp in range(sys.maxunicode + 1) if not 0xD800 <= cp < 0xE000)
    for c, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for run in regex.findall(pattern, every):
            classes[[ord(x) for x in run]] = c
    classes[WHITE_SPACE] = WHITE
    for c, text in ((SPACE, " "), (QUOTE, "'"), (L_STMD, "stmd"), (L_RV, "rv"), (L_L, "l"), (L_E, "e")):
        classes[[ord(x) for x in text]] = c
    steps = [_step(s, c) for s in range(STATES) for c in range(CLASSES)]
    return classes, np.array([s for s, _ in steps], np.uint8), np.array([m for _, m in steps], np.uint8)


def entry_states(chunks: np.ndarray) -> np.ndarray:
    """Each chunk's entry state (rows: chunks of classes), by composing the chunks' state maps in a parallel prefix scan."""
    _, step, _ = tables()
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (len(chunks), 1))
    for k in range(chunks.shape[1]):
        maps = step[maps * np.uint8(CLASSES) + chunks[:, k, None]]
    shift = 1
    while shift < len(maps):  # after each round a row maps the states before its last 2 * shift chunks to those after it
        maps[shift:] = np.take_along_axis(maps[shift:], maps[:-shift], axis=1)
        shift *= 2
    return np.concatenate(([START], maps[:-1, START])).astype(np.uint8)


def boundaries(classes: np.ndarray, width: int = 512) -> np.ndarray:
    """Positions in a stream of classes at which a pre-token begins."""
    n = len(classes)
    padded = np.zeros(-(-n // width) * width, np.uint8)
    padded[:n] = classes
    chunks = padded.reshape(-1, width)
    _, step, marks = tables()
    state, out = entry_states(chunks), np.empty((width, len(chunks)), np.uint8)
    for k in range(width):
        at = state * np.uint8(CLASSES) + chunks[:, k]
        out[k] = marks[at]
        state = step[at]
    flags = out.T.ravel()[:n]
    begins = (flags & HERE).astype(bool)
    begins[:-1] |= (flags[1:] & BEFORE).astype(bool)
    return np.flatnonzero(begins)


@functools.cache
def byte_alphabet() -> dict[str, int]:
    """The published byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """The counting transducer over bytes for one vocabulary, determinised as far as texts have needed it."""

    def __init__(self, path: str, max_states: int = 200_000, max_words: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("only a byte-level BPE without normalizer and prefix space can be compiled")
        alphabet = byte_alphabet()
        raw = {text: bytes(alphabet[c] for c in text) for text in model["vocab"] if all(c in alphabet for c in text)}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(raw[a], raw[b]): i for i, (a, b) in enumerate(pairs)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.max_states, self.max_words = max_states, max_words
        self.trie: list[dict[int, int]] = [{}]
        self.token: list[bytes | None] = [None]
        for t in raw.values():
            node = 0
            for b in t:
                if b not in self.trie[node]:
                    self.trie[node][b] = len(self.trie)
                    self.trie.append({})
                    self.token.append(None)
                node = self.trie[node][b]
            self.token[node] = t
        self.edge: dict[bytes, tuple[list, list] | None] = {}
        self.words: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.next: dict[int, tuple[int, int]] = {}  # state * 256 + byte -> next state * 256, change in the count
        self.heads: dict[str, tuple[int, int]] = {}  # what the first characters of a pre-token lead to
        self._state(((0, None, 0),))

    def _state(self, places: tuple) -> int:
        if places not in self.ids:
            self.ids[places] = len(self.sets)
            self.sets.append(places)
        return self.ids[places]

    def edges(self, token: bytes) -> tuple[list, list] | None:
        """BPE of a token's own bytes: the pieces at its left and right edge, each with the rank of the merge that uses it up.

        None if the bytes do not merge into the token.
        """
        if token not in self.edge:
            parts = [token[i : i + 1] for i in range(len(token))]
            left, right = [], []
            while len(parts) > 1:
                rank, i = min((self.ranks.get(pair, NEVER), i) for i, pair in enumerate(zip(parts, parts[1:])))
                if rank == NEVER:
                    break
                if i == 0:
                    left.append((parts[0], rank))
                if i == len(parts) - 2:
                    right.append((parts[-1], rank))
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.edge[token] = ([*left, (token, NEVER)], [*right, (token, NEVER)]) if len(parts) == 1 else None
        return self.edge[token]

    def fits(self, before: bytes | None, token: bytes) -> bool:
        """Whether the token stays whole at the beginning of a pre-token (None) or after another one.

        Ranks of merges only rise, so two tokens stay apart unless a pair across their border, while both pieces
        exist, is merged before a merge inside either token uses a piece up (of equal ranks the leftmost goes first).
        """
        own = self.edges(token)
        if before is None or own is None:
            return own is not None
        xs, ys, i, j = self.edges(before)[1], own[0], 0, 0
        while True:
            (x, x_ends), (y, y_ends) = xs[i], ys[j]
            across = self.ranks.get((x, y), NEVER)
            if across < x_ends and across <= y_ends and across != NEVER:
                return False
            if x_ends == y_ends == NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def _compile(self, at: int) -> tuple[int, int]:
        opened, last, n, byte = [], None, None, at & 255
        for node, before, count in self.sets[at >> 8]:
            child = self.trie[node].get(byte)
            if child is None:
                continue
            if n is None and (t := self.token[child]) is not None and self.fits(before, t):
                last, n = t, count + 1
            if self.trie[child]:
                opened.append((child, before, count))
        if n is None:
            raise ValueError(f"byte {byte} is not in the vocabulary")
        places = (*((node, before, count - n) for node, before, count in opened), (0, last, 0))
        self.next[at] = out = (self._state(places) << 8, n)
        return out

    def _walk(self, state: int, total: int, data: bytes) -> tuple[int, int]:
        get, compile_ = self.next.get, self._compile
        for b in data:
            state, n = get(state | b) or compile_(state | b)
            total += n
        return state, total

    def count_word(self, word: str) -> int:
        """Tokens of one pre-token: the sum of the counts along its path."""
        if len(self.sets) > self.max_states:
            self._reset()
        head = word[:6]
        begun = self.heads.get(head)
        if begun is None:
            begun = self.heads[head] = self._walk(0, 0, head.encode())
        return self._walk(*begun, word[6:].encode())[1]

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text, special strings counted as one token as the library does by default."""
        totals, pieces, owner = [0] * len(texts), [], []
        for i, text in enumerate(texts):
            parts = [text]
            for s in self.special:
                if s in text:
                    split = [p.split(s) for p in parts]
                    totals[i] += sum(len(p) - 1 for p in split)
                    parts = [x for p in split for x in p]
            pieces += parts
            owner += [i] * len(parts)
        stream = "\x00".join(pieces)
        if not stream:
            return totals
        points = np.frombuffer(stream.encode("utf-32-le"), np.uint32)
        classes = tables()[0][points]
        ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
        classes[ends[:-1]] = END
        starts = boundaries(classes)
        which = np.searchsorted(ends, starts, side="right")
        stops = np.minimum(np.append(starts[1:], len(stream)), ends[which])
        words, get, missed = self.words, self.words.get, self._missed
        counts = np.fromiter((get(w) or missed(w) for w in (stream[a:b] for a, b in zip(starts.tolist(), stops.tolist()))), np.int64, len(starts))
        if len(words) > self.max_words:
            words.clear()
        for i, n in zip(owner, np.bincount(which, counts, len(pieces)).astype(np.int64).tolist()):
            totals[i] += n
        return totals

    def _missed(self, word: str) -> int:
        n = self.count_word(word)
        if len(word) <= 32:
            self.words[word] = n
        return n


@functools.cache
def compiled(path: str) -> Counter:
    """One transducer for each Python worker and vocabulary file."""
    return Counter(path)


def token_counts(df: DataFrame, path: str, text: str = "text", into: str = "n_tokens", batch_chars: int = 2_000_000) -> DataFrame:
    """Add a column `into` with the number of tokens of `text` under the byte-level BPE file at `path`.

    `path` must be readable on each executor. A null text counts as empty (0 tokens). Rows keep their order and all
    other columns, whatever their names; repeated rows give equal counts, nothing is decided by ties, an empty table gives no rows. No shuffle. Memory: a
    batch of texts is processed in pieces of about `batch_chars` characters (one longer text at a time).
    """
    df = df.drop(into)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = compiled(path)
        for batch in batches:
            texts, out, held, size = batch.column(batch.schema.get_field_index(text)), [], [], 0
            for t in texts:
                held.append(t.as_py() or "")
                size += len(held[-1])
                if size >= batch_chars:
                    out += counter.count(held)
                    held, size = [], 0
            out += counter.count(held) if held else []
            columns = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.int64())], [*batch.schema.names, into])

    return df.mapInArrow(count, extended(df.schema, f"{into} long"))


def narrow_token_counts(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`token_counts`, with the texts dropped again after counting and their UTF-8 size kept: keep..., n_bytes, n_tokens."""
    sized = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return token_counts(sized, path, text="_text").drop("_text")
