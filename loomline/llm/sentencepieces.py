"""SentencePiece encoding and decoding: exact merge-type (BPE) encoding by backtracking.

An encoding by merges is the one sequence of pieces in which each piece is what its own characters merge to, and each
two neighbours stay apart when their joined characters are merged anew: a merge across a border would be the best one
among the two neighbours too. So the encoding is found from left to right without merging the text: an Aho-Corasick
automaton gives the longest piece that begins at each position, a piece is taken if it is compatible with the one
before it, else the next shorter one is tried; where none is left the position is marked in a bitfield as failed and
the piece before it is taken back. A position fails once at most, so the time is linear in the text.

Texts are cut beforehand where no piece of the vocabulary reaches across (found from the vocabulary: at a mark of white
space that never follows another character inside a piece, and around characters that no piece holds); the encodings of
short stretches are kept.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended

SPACE = "▁"  # stands for a blank in pieces
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # types of pieces in model files
MERGES = 2  # type of a model made by merges


class Pieces:
    """The pieces of a model file with what encoding and decoding need: automaton, scores, shorter pieces, bytes."""

    def __init__(self, path: str, max_stretches: int = 500_000, max_pairs: int = 1_000_000):
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        rules, trained, types = model.normalizer_spec, model.trainer_spec, {p.type for p in model.pieces}
        plain = rules.escape_whitespaces and not rules.remove_extra_whitespaces and not rules.precompiled_charsmap and not trained.treat_whitespace_as_suffix
        if trained.model_type != MERGES or not trained.byte_fallback or not plain or types - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path}: only merge-type models with byte fallback, without normalisation and pieces of the user's own are supported")
        self.prefix = SPACE if rules.add_dummy_prefix else ""
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.controls = {i for i, p in enumerate(model.pieces) if p.type == CONTROL}
        self.marked = {i for p, i in self.ids.items() if p.startswith(SPACE)}
        surface = {NORMAL: lambda p: p.replace(SPACE, " ").encode(), BYTE: lambda p: bytes([int(p[3:5], 16)]), CONTROL: lambda p: b"", UNKNOWN: lambda p: trained.unk_surface.encode()}
        self.surfaces = [surface[p.type](p.piece) for p in model.pieces]
        self.is_byte = [p.type == BYTE for p in model.pieces]
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.longest = max(map(len, self.ids))
        self.stretches = Stretches(self, max_stretches)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.shorts: dict[str, str] = {}
        self.max_pairs = max_pairs

    @functools.cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """Finds every place of every piece of two characters and more; gives their lengths."""
        out = ahocorasick.Automaton()
        for p in self.ids:
            if len(p) > 1:
                out.add_word(p, len(p))
        out.make_automaton()
        return out

    @functools.cached_property
    def stretch(self) -> re.Pattern:
        return re.compile(self._stretch_pattern(), re.S)

    def _stretch_pattern(self) -> str:
        """An expression for the longest runs of characters that pieces can reach across.

        Characters that stand side by side in a piece are of one kind, and so are those linked through others; no piece
        joins characters of two kinds. The mark of white space belongs to what follows it, unless a piece holds it further inside.
        """
        kind = {c: c for p in self.ids for c in p}

        def root(c: str) -> str:
            while kind[c] != c:
                kind[c] = c = kind[kind[c]]
            return c

        leads = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        for p in self.ids:
            for a, b in zip(p, p[1:]):
                if not (leads and SPACE in (a, b)):
                    kind[root(a)] = root(b)
        twice = {a for p in self.ids for a, b in zip(p, p[1:]) if a == b}
        kinds: dict[str, list[str]] = {}
        for c in sorted(kind):
            kinds.setdefault(root(c), []).append(c)
        ordered = sorted((k for k in kinds.values() if k != [SPACE]), key=len, reverse=True)
        runs = [re.escape("".join(k)) for k in ordered if len(k) > 1 or k[0] in twice]
        alone = re.escape("".join(k[0] for k in ordered if len(k) == 1 and k[0] not in twice))
        lead = f"{SPACE}*" if leads else ""
        options = [f"{lead}[{r}]+" for r in runs] + ([f"{lead}[{alone}]"] if alone else []) + [f"{SPACE}+", "."]
        return "|".join(options)

    def merged(self, text: str) -> list[str]:
        """What characters merge to: always the pair whose piece has the best score, the leftmost of equals."""
        get, none, parts = self.scores.get, -float("inf"), list(text)
        scores = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) > none:
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(scores):
                scores[i] = get(parts[i] + parts[i + 1], none)
        return parts

    def fits(self, before: str, piece: str) -> bool:
        """Whether a piece can follow another one (or, after "", begin a stretch): merging both anew gives both again."""
        fit = self.pairs.get((before, piece))
        if fit is None:
            if len(self.pairs) >= self.max_pairs:
                self.pairs.clear()
            fit = self.pairs[before, piece] = self.merged(before + piece) == ([before, piece] if before else [piece])
        return fit

    def shorter(self, piece: str) -> str:
        """The longest piece, or first character, that properly begins a piece; "" if there is none."""
        found = self.shorts.get(piece)
        if found is None:  # each piece of the vocabulary once
            found = self.shorts[piece] = next((piece[:n] for n in range(len(piece) - 1, 1, -1) if piece[:n] in self.ids), piece[:1] if len(piece) > 1 else "")
        return found

    def split(self, text: str) -> list[str]:
        """The pieces of one stretch; a character that is no piece stands for itself."""
        longest = bytearray(b"\1") * len(text) if self.longest < 256 else array("L", [1]) * len(text)
        for end, size in self.automaton.iter(text):  # later ends are those of longer pieces
            longest[end - size + 1] = size
        failed, any_failed = bytearray(len(text) // 8 + 1), False
        out: list[str] = []
        known, fits, at, piece, before = self.pairs.get, self.fits, 0, text[: longest[0]], ""
        while at < len(text):
            end = at + len(piece)
            fit = known((before, piece))
            if (fits(before, piece) if fit is None else fit) and not (any_failed and failed[end >> 3] >> (end & 7) & 1):
                out.append(piece)
                at, before = end, piece
                piece = text[end : end + longest[end]] if end < len(text) else ""
                continue
            piece = self.shorter(piece)
            while not piece:
                any_failed = True
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)
                before = out[-1] if out else ""
                piece = self.shorter(piece)
        return out

    def encoded(self, stretch: str) -> bytes:
        """The ids of one stretch, four bytes each."""
        ids: list[int] = []
        for piece in self.split(stretch):
            i = self.ids.get(piece)
            if i is None:
                ids += [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
            else:
                ids.append(i)
        return array("i", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, four bytes each."""
        if not text:
            return b""
        return b"".join(map(self.stretches.__getitem__, self.stretch.findall(self.prefix + text.replace(" ", SPACE))))

    def known(self, ids: list[int | None]) -> list[int]:
        """Null ids are passed over, ids outside the vocabulary are unknown."""
        return [i if 0 <= i < len(self.surfaces) else self.unknown for i in ids if i is not None]

    def decode(self, ids: list[int]) -> str:
        """The text of known ids: the blank put in front is taken away again, and each byte that is part of no character becomes U+FFFD."""
        data = b"".join(map(self.surfaces.__getitem__, ids))
        first = next((i for i in ids if i not in self.controls), None)
        skip = 1 if self.prefix and first in self.marked else 0
        try:
            return data.decode()[skip:]
        except UnicodeDecodeError:
            return self._repaired(ids)[skip:]

    def _repaired(self, ids: list[int]) -> str:
        out, held = [], b""
        for i in ids:
            if self.is_byte[i]:
                held += self.surfaces[i]
            else:
                out += [characters(held), self.surfaces[i].decode()]
                held = b""
        return "".join([*out, characters(held)])


class Stretches(dict):
    """Encodings of stretches that were met, short ones kept; when there are too many, those not used since the last time go."""

    def __init__(self, model: Pieces, most: int):
        self.model, self.most, self.older = model, most, {}

    def __missing__(self, stretch: str) -> bytes:
        out = self.older.get(stretch)
        if out is None:
            out = self.model.encoded(stretch)
        if len(stretch) <= 32:
            if len(self) >= self.most // 2:
                self.older = dict(self)
                self.clear()
            self[stretch] = out
        return out


def characters(data: bytes) -> str:
    """UTF-8 bytes as text, one U+FFFD for each byte that is not part of a whole character."""
    out, at = [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@functools.cache
def pieces(path: str) -> Pieces:
    """One for each Python worker and model file."""
    return Pieces(path)


def encode(df: DataFrame, path: str, text: str = "text", into: str = "ids", batch_chars: int = 1_000_000) -> DataFrame:
    """Add a column `into` (array<int>) with the ids of `text` under the model file at `path`, without begin or end ids.

    `path` must be readable on each executor. Null and empty texts have no ids; texts are encoded whole, however long;
    ties between merges go to the leftmost pair; repeated rows give equal results; an empty table gives no rows. Other
    columns are kept, whatever their names; one called `into` is replaced. No shuffle. Rows go out in pieces of about
    `batch_chars` characters (one longer text at a time).
    """
    df = df.drop(into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            begin, found, size = 0, [], 0
            for n, t in enumerate(texts, 1):
                whole = t.as_py() or ""
                found.append(model.encode(whole))
                size += len(whole)
                if size >= batch_chars or n == len(texts):
                    ends = np.cumsum([0, *map(len, found)]) // 4
                    column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))
                    part = batch.slice(begin, n - begin)
                    yield pa.RecordBatch.from_arrays([*part.columns, column], [*batch.schema.names, into])
                    begin, found, size = n, [], 0

    return df.mapInArrow(run, extended(df.schema, f"`{into}` array<int>"))


def decode(df: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add a column `into` with the text of an array of ids: null and empty arrays give an empty text, null ids are passed over, ids outside the vocabulary are unknown.

    Other columns are kept, whatever their names; one called `into` is replaced. Arrays of any length; an empty table gives no rows. No shuffle.
    """
    df = df.drop(into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids)).fill_null([])
            values, ends = column.flatten(), np.append(0, np.cumsum(column.value_lengths().to_numpy()))
            own = values.fill_null(-1).to_numpy()
            if values.null_count or (len(own) and (own.min() < 0 or own.max() >= len(model.surfaces))):
                texts = [model.decode(model.known(values[a:b].to_pylist())) for a, b in zip(ends[:-1], ends[1:])]
            else:
                texts = [model.decode(own[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, into])

    return df.mapInArrow(run, extended(df.schema, f"`{into}` string"))


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 of each whole text, its ids decoded again."""
    coded = encode(df.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("_text")), path, "_text", "_ids").drop("_text")
    both = decode(coded, path, "_ids", "_decoded")
    return both.select(F.col(f"`{key}`"), F.size("_ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("_ids", ","), 256).alias("ids_sha256"), F.sha2("_decoded", 256).alias("decoded_sha256"))
