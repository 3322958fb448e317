"""Document fingerprints by winnowing.

Every k-gram of code points is hashed with a rolling polynomial hash; of each window of w consecutive hashes the
smallest is kept, the rightmost one on ties, together with its position. Any passage of w + k - 1 code points that two
texts of at least 4 k code points share gives them a common fingerprint; a passage shorter than k gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import extended

K, W = 10, 51  # finds every shared passage of 60 code points
BASE = np.uint64(0x9E3779B97F4A7C15)


def gram(points: int, k: int) -> int:
    """Length of the grams of a text: k, less in a text of under 4 k code points."""
    return min(k, max(1, points // 4))


def window(hashes: int, w: int) -> int:
    """Hashes in a window: w, less in a short text, so that it keeps several. What a wider window keeps, a narrower one keeps too."""
    return min(w, max(1, hashes // 8))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def rolling_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """32-bit hashes of all k-grams: a polynomial modulo 2^64 built by doubling, then mixed. Fewer than k points: none."""
    if len(points) < k:
        return np.zeros(0, np.uint32)
    with np.errstate(over="ignore"):
        power, width, grown = BASE, 1, points.astype(np.uint64) + np.uint64(1)
        out, done = None, 0
        rest = k
        while rest:  # binary digits of k, lowest first: out covers `done` points, the next part stands before or after
            if rest & 1:
                if out is None:
                    out, done, out_power = grown, width, power
                else:
                    m = len(points) - done - width + 1
                    out = grown[:m] * out_power + out[width : width + m]
                    done, out_power = done + width, out_power * power
            rest >>= 1
            if rest:
                m = len(points) - 2 * width + 1
                grown, power, width = grown[:m] * power + grown[width : width + m], power * power, 2 * width
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (out >> np.uint64(32)).astype(np.uint32)


def winnow(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """Hashes kept and their positions, in order of position. An empty text has none."""
    points = code_points(text)
    hashes = rolling_hashes(points, gram(len(points), k))
    n = len(hashes)
    if n == 0:
        return hashes, np.zeros(0, np.int64)
    w = window(n, w)
    # the smallest hash first, then the rightmost position
    least = (hashes.astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    have = 1
    while 2 * have <= w:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < w:
        least = np.minimum(least[: n - w + 1], least[w - have : w - have + n - w + 1])
    kept = least[np.append(True, least[1:] != least[:-1])]
    return (kept >> np.uint64(32)).astype(np.uint32), (np.uint64(0xFFFFFFFF) - (kept & np.uint64(0xFFFFFFFF))).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common hashes among all of both (two empty ones: 1)."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 1.0


def winnowing(df: DataFrame, text: str = "text", k: int = K, w: int = W) -> DataFrame:
    """Add `hashes` (array<long>, 32-bit values) and `positions` (array<int>, code points) to `df`; no shuffle.

    A null text counts as empty and has no fingerprints. Short texts have shorter grams and windows. Repeated rows give equal results; an empty table gives no rows; other columns are kept, and
    columns called hashes or positions are replaced.
    """
    df = df.drop("hashes", "positions")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [winnow(t.as_py() or "", k, w) for t in batch.column(batch.schema.get_field_index(text))]
            columns = [*(batch.column(i) for i in range(batch.num_columns)), pa.array([h.astype(np.int64) for h, _ in found], pa.list_(pa.int64())), pa.array([p.astype(np.int32) for _, p in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "hashes", "positions"])

    return df.mapInArrow(run, extended(df.schema, "hashes array<long>, positions array<int>"))


def with_successor(df: DataFrame, key: str, text: str, use: Callable[[Any, str, Any, str], tuple], measure: Callable[[str], Any], schema: str, bytes_per_range: int = 4 << 20, rows_per_range: int = 1024, most_ranges: int = 1 << 16) -> DataFrame:
    """Apply `use(measured, text, next_measured, next_text)` to each row and the row after it in descending order of `key` (after the last: the first).

    Returns `key` and the columns of `schema`, which `use` gives as a tuple; `measure(text)` is called once a text and
    task. Null texts count as empty; null keys come last; rows with equal keys are ordered by text.

    One exchange of the rows: they are dealt into ranges of `key` (a whole number) with about equal numbers of rows, and
    the highest row of each range also goes to the range above it as a guest, to follow its lowest row. There are as many
    ranges as rows and bytes ask for; the borders come to the driver, at most `most_ranges`. A task sorts its range
    and streams through it, holding a batch and a row. Rows of one key share a range. An empty table gives no rows;
    other columns are ignored.
    """
    spark = df.sparkSession
    df = df.select(F.col(f"`{key}`").alias("_key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    keys = df.select(F.col("_key").cast("long").alias("_key")).where(F.col("_key").isNotNull())
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()
    ranges = max(1, min(most_ranges, max(-(-rows // rows_per_range), -(-size // bytes_per_range))))
    cuts = sorted({int(x) for x in keys.approxQuantile("_key", [i / ranges for i in range(1, ranges)], 0.1 / ranges)}) if ranges > 1 else []
    cuts = cuts or [0]
    groups = [cuts[i : i + 64] for i in range(0, len(cuts), 64)]
    coarse, fine = F.lit(np.array([g[0] for g in groups], np.int64)), F.array(*[F.lit(np.array(g, np.int64)) for g in groups])
    group = F.size(F.filter(coarse, lambda x: x <= F.col("_key"))) - 1
    # range 0 holds the null keys, range 1 those below the first border
    ranged = df.withColumn("_group", group).withColumn("_range", F.when(F.col("_key").isNull(), 0).when(F.col("_group") < 0, 1).otherwise(1 + 64 * F.col("_group") + F.size(F.filter(fine[F.greatest(F.col("_group"), F.lit(0))], lambda x: x <= F.col("_key")))).cast("int"))
    tops = sorted(tuple(r) for r in ranged.groupBy("_range").agg(F.max("_key")).collect())
    guests = spark.createDataFrame([(r, top, tops[(i + 1) % len(tops)][0]) for i, (r, top) in enumerate(tops)], f"_range int, _top {df.schema['_key'].dataType.simpleString()}, _above int")
    own, guest = F.struct(F.col("_range").alias("to"), F.lit(0).alias("guest")), F.struct(F.col("_above").alias("to"), F.lit(1).alias("guest"))
    dealt = ranged.join(F.broadcast(guests), "_range").withColumn("_as", F.explode(F.when(F.col("_key").eqNullSafe(F.col("_top")), F.array(own, guest)).otherwise(F.array(own))))
    ordered = dealt.select("_key", "_text", "_as.to", "_as.guest").repartitionById(len(cuts) + 2, F.col("to")).sortWithinPartitions("guest", F.col("_key").desc_nulls_last(), "_text")
    out = extended(df.select(F.col("_key").alias(key)).schema, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, before = to_arrow_schema(out), None
        for batch in batches:
            rows = []
            for k, t, g in zip(batch["_key"], batch["_text"], batch["guest"].to_pylist()):
                if g and before is None:
                    break
                t = t.as_py()
                measured = measure(t)
                if before is not None:
                    rows.append((before[0], *use(*before[1:], measured, t)))
                before = None if g else (k.as_py(), measured, t)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(target), target)], schema=target)

    return ordered.select("_key", "_text", "guest").mapInArrow(run, out)


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as much of the beginning of the following one."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def hexed(hashes: np.ndarray) -> str:
    """A fingerprint as text: the kept hashes in order of position, 8 hexadecimal digits each."""
    return hashes.astype(">u4").tobytes().hex()


def edit_report(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, w: int = W) -> DataFrame:
    """Winnowed fingerprints of each text and its edited text, with their positions, and the likeness to both that and the next document.

    The columns are `key`, n_chars, edited_sha256, fingerprint and edited_fingerprint (hexadecimal), near_edited, near_next,
    positions and edited_positions (arrays of the code points where the kept grams begin, one for each hash). A null text
    counts as empty and has an empty fingerprint; two empty ones are alike (1). Null keys are the last documents, rows
    with equal keys are ordered by text, repeated rows follow each other. Very long texts are hashed whole. An empty table
    gives no rows; other columns are ignored, whatever their names.
    """

    def report(own: tuple, t: str, following: tuple, next_text: str) -> tuple:
        changed = edited(t, next_text)
        other, at = winnow(changed, k, w)
        return len(t), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), hexed(own[0]), hexed(other), likeness(own[0], other), likeness(own[0], following[0]), own[1], at

    return with_successor(df, key, text, report, lambda t: winnow(t, k, w), "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<int>, edited_positions array<int>")
