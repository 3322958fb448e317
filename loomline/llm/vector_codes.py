"""Vector code compression: product codes whose distances are read from tables of each dimension's own values.

Components become small integers, so a dimension has few distinct ones however many vectors there are. Vectors are kept
in blocks; a block holds, for each dimension, the dictionary of its distinct integers and the position of each vector's
integer in it. To compare a part of all vectors with all entries of its codebook, the squared differences of each
dictionary value to each entry are tabulated once for a block, and the distance of a part is a gather from these tables
for each dimension and an addition: no difference is squared twice. Codebooks, which have a fixed size, come to the
driver after each round; sums by part, entry and dimension are added up in tasks first and then by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, extended, small

#: Components are held within these bounds, so that errors of 2,047 dimensions fit a long. Rows beyond keep their code and lose nothing else.
LEAST, MOST = -(1 << 25), (1 << 25) - 1
#: A block of vectors: keys, labels, each dimension's distinct integers, and where in them each vector's integer is.
BLOCK = ("keys", "labels", "dictionaries", "codes")


@dataclass(frozen=True)
class Codebooks:
    """One codebook a part: entries[part] is an array of (entry, position in the part)."""

    entries: tuple[np.ndarray, ...]

    @property
    def width(self) -> int:
        return self.entries[0].shape[1] if self.entries else 0

    @property
    def sha256(self) -> str:
        """Digest of all integers in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for x in part.ravel().tolist()).encode()).hexdigest()


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    v = F.col(vector)
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(256 x), held within LEAST and MOST."""
    return np.clip(np.floor(vectors.astype(np.float64) * 256), LEAST, MOST).astype(np.int64)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as rows of `dims` numbers; missing ones at the end are zero."""
    flat, lengths = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(column), dims), flat.dtype)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def blocks(df: DataFrame, dims: int, rows: int = 4096) -> DataFrame:
    """The vectors of `df` (columns _key, _label, _vector) in blocks of at most `rows`. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                values = integers(matrix(part.column(2), dims))
                dictionaries, codes = [], []
                for d in range(dims):
                    known, code = np.unique(values[:, d], return_inverse=True)
                    dictionaries.append(known.astype(np.int32).tobytes())
                    codes.append(code.astype(np.uint8 if len(known) <= 256 else np.uint16).tobytes())
                whole = pa.array([0, part.num_rows], pa.int32())
                own = [pa.ListArray.from_arrays(whole, pa.concat_arrays([part.column(i)])) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array([dictionaries], pa.list_(pa.binary())), pa.array([codes], pa.list_(pa.binary()))], list(BLOCK))

    key, label = (df.schema[c].dataType.simpleString() for c in ("_key", "_label"))
    return df.select("_key", "_label", "_vector").mapInArrow(run, f"keys array<{key}>, labels array<{label}>, dictionaries array<binary>, codes array<binary>")


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, list[np.ndarray], list[np.ndarray]]]:
    """Keys, labels, dictionaries and codes of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            known = [np.frombuffer(b, np.int32).astype(np.int64) for b in batch.column(2)[i].as_py()]
            codes = [np.frombuffer(b, np.uint8 if len(k) <= 256 else np.uint16) for b, k in zip(batch.column(3)[i].as_py(), known)]
            yield batch.column(0)[i].values, batch.column(1)[i].values, known, codes


def nearest(known: list[np.ndarray], codes: list[np.ndarray], entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a part of a block's vectors (its dimensions' dictionaries and codes) the nearest entry, the first of equals, and the squared distance."""
    span = max(int(max(k[-1], e.max())) - int(min(k[0], e.min())) for k, e in zip(known, entries.T))
    kind = np.int32 if span * span * len(known) < 1 << 31 else np.int64
    total = np.zeros((len(codes[0]), len(entries)), kind)
    for k, c, e in zip(known, codes, entries.T):
        table = np.square(k[:, None] - e[None, :]).astype(kind)
        total += table[c]
    best = total.argmin(1)
    return best, total[np.arange(len(best)), best].astype(np.int64)


def improved(held: DataFrame, books: Codebooks) -> Codebooks:
    """Codebooks with each entry moved to the componentwise floor of the mean of the parts that are nearest to it; unused entries stay."""
    parts, width = len(books.entries), books.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.shape, np.int64) for b in books.entries]
        counts = [np.zeros(len(b), np.int64) for b in books.entries]
        for _, _, known, codes in opened(batches):
            for p, entries in enumerate(books.entries):
                own = range(p * width, (p + 1) * width)
                best, _ = nearest([known[d] for d in own], [codes[d] for d in own], entries)
                counts[p] += np.bincount(best, minlength=len(entries))
                for j, d in enumerate(own):
                    # exact: a block's sums stay far below 2^53
                    sums[p][:, j] += np.bincount(best, known[d][codes[d]], len(entries)).astype(np.int64)
        used = [(p, e) for p in range(parts) for e in np.flatnonzero(counts[p]).tolist()]
        columns = [[p for p, _ in used], [e for _, e in used], [int(counts[p][e]) for p, e in used], [sums[p][e].tolist() for p, e in used]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], ["part", "entry", "n", "sums"])

    added = held.mapInArrow(run, "part int, entry int, n long, sums array<long>")
    each = added.select("part", "entry", "n", F.posexplode("sums").alias("position", "sum"))
    found = each.groupBy("part", "entry", "position").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"))
    moved = [b.copy() for b in books.entries]
    for r in found.collect():  # parts x entries x positions, whatever the number of vectors
        moved[r["part"]][r["entry"], r["position"]] = int(r["sum"]) // int(r["n"])
    return Codebooks(tuple(moved))


def coded(held: DataFrame, books: Codebooks) -> DataFrame:
    """Each vector's key, label, code (two hexadecimal digits a part) and squared error."""
    width = books.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, labels, known, codes in opened(batches):
            out, error = np.zeros((len(keys), len(books.entries)), np.uint8), np.zeros(len(keys), np.int64)
            for p, entries in enumerate(books.entries):
                own = range(p * width, (p + 1) * width)
                out[:, p], off = nearest([known[d] for d in own], [codes[d] for d in own], entries)
                error += off
            digits, n = out.tobytes().hex(), 2 * len(books.entries)
            yield pa.RecordBatch.from_arrays([keys, labels, pa.array([digits[i : i + n] for i in range(0, len(digits), n)], pa.string()), pa.array(error)], ["_key", "_label", "code", "error"])

    key, label = (held.schema[c].dataType.elementType.simpleString() for c in ("keys", "labels"))
    return held.mapInArrow(run, f"_key {key}, _label {label}, code string, error long")


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, Codebooks]:
    """Codes of all vectors, and the codebooks that explain them.

    Rows whose vector is null or holds null, NaN or infinite components are left out. Each component becomes
    floor(256 x); integers below -2^25 or from 2^25 on are held at these bounds. Codebooks begin with the parts of the
    `entries` (at most 256) smallest keys, ties by vector, null keys last, and are improved `rounds` times.

    Returned columns: `key`, `label`, code, error (long) and label_error (errors summed over rows with equal labels, nulls
    together; null where the sum exceeds a long). Vectors shorter than the longest one, or than a whole number of parts,
    count as filled up with zeros. Repeated rows are rows like others; ties in distance go to the lower entry; other columns
    are ignored, whatever their names. An empty table, or one without components, gives no rows and empty codebooks.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes have two hexadecimal digits: 1 to 256 entries")
    own = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{label}`").alias("_label"), F.col(f"`{vector}`").alias("_vector")).where(usable("_vector"))
    longest = own.agg(F.max(F.size("_vector"))).first()[0] or 0
    dims = -(-longest // parts) * parts
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, `{label}` {df.schema[label].dataType.simpleString()}, code string, error long, label_error long"
    if dims == 0:
        return df.sparkSession.createDataFrame([], schema), Codebooks(())
    first = [r[0] for r in own.orderBy(F.col("_key").asc_nulls_last(), "_vector").limit(entries).select("_vector").collect()]
    begun = integers(matrix(pa.array(first, pa.list_(pa.float64())), dims))
    books = Codebooks(tuple(begun[:, p * dims // parts : (p + 1) * dims // parts] for p in range(parts)))
    held = cut(blocks(own, dims))
    for _ in range(rounds):
        books = improved(held, books)
    return with_label_error(cut(coded(held, books))).select(F.col("_key").alias(key), F.col("_label").alias(label), "code", "error", "label_error"), books


def with_label_error(found: DataFrame, salts: int = 32) -> DataFrame:
    """Add the sum of errors over equal labels. The sums are broadcast if they measure small; else each is joined in `salts` copies, so that a frequent label is spread over as many tasks."""
    total = found.groupBy("_label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    total = cut(total.withColumnRenamed("_label", "_of"))
    few = small(total)
    if few is not total:
        return found.join(few, F.col("_label").eqNullSafe(F.col("_of")), "left")
    spread = total.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = found.withColumn("_own", F.pmod(F.xxhash64("_key", "code"), F.lit(salts)).cast("int"))
    return salted.join(spread, F.col("_label").eqNullSafe(F.col("_of")) & (F.col("_own") == F.col("_salt")), "left")


def decompress(df: DataFrame, books: Codebooks, code: str = "code", into: str = "approximate") -> DataFrame:
    """Add the approximate vector of each code as array<double>; a null code gives null. Other columns are kept; one called `into` is replaced."""
    df = df.drop(into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [None if c is None else np.concatenate([b[i] for b, i in zip(books.entries, bytes.fromhex(c))]) / 256 for c in batch.column(batch.schema.get_field_index(code)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float64()))], [*batch.schema.names, into])

    return df.mapInArrow(run, extended(df.schema, f"`{into}` array<double>"))
