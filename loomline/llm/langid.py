"""Language identification: averaged hashed subword embeddings with a linear softmax, and calibrated rejection.

A text is the average of the embeddings of its subwords (1- to 4-grams of code points within words and across one
border), hashed into a fixed number of buckets; a linear layer and a softmax give probabilities. Trained by mini-batch
stochastic gradient descent in numpy on a bounded sample of labelled rows. What comes to the driver of a row is how often
each bucket occurs in its whole text, counted on the executors: all that the average depends on, and bounded however
long the text is. As both layers are linear, they are multiplied after training, so that predicting is a sum of table rows. A temperature fitted on rows kept from training
calibrates the probabilities, and the rejection threshold is set so that nearly no kept row is rejected wrongly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import extended

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
ORDERS = (1, 2, 3, 4)
SPACES = np.array([9, 10, 11, 12, 13, 32, 0xA0, 0x3000], np.uint32)


@dataclass(frozen=True)
class Settings:
    """What training depends on. The sample that comes to the driver has at most `rows_per_language` rows for each of at most
    `most_languages` labels, and at most `buckets` numbers a row; more labels are an error, not cut off."""

    rows_per_language: int = 300
    most_languages: int = 200
    buckets: int = 1 << 15
    dimensions: int = 16
    epochs: int = 16
    rate: float = 0.5
    batch: int = 32
    kept: float = 0.2
    wrongly_rejected: float = 0.001
    seed: int = 5


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # buckets x languages, float32: embedding times linear layer
    bias: np.ndarray
    temperature: float
    threshold: float
    tried: int
    right: int


def subwords(text: str, buckets: int) -> np.ndarray:
    """Bucket of every subword of the lower-cased text; runs of white space count as one border."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = np.isin(points, SPACES) | (points < 32)
    points = np.where(blank, np.uint32(32), points)
    keep = ~(blank & np.append(False, blank[:-1]))
    points = points[keep].astype(np.uint64)
    mul = np.uint64(0x9E3779B97F4A7C15)
    out, grown = [], np.zeros(len(points), np.uint64)
    with np.errstate(over="ignore"):
        for n in ORDERS:
            if len(points) < n:
                break
            grown = (grown[: len(points) - n + 1] + points[n - 1 :] + np.uint64(n)) * mul
            grown ^= grown >> np.uint64(29)
            out.append((grown >> np.uint64(40)) % np.uint64(buckets))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def bucket_counts(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a whole text's subwords and how often each occurs."""
    total = np.zeros(buckets, np.int64)
    for a in range(0, len(text), 1 << 18):  # a long text in parts that overlap by the longest subword
        part = text[a : a + (1 << 18) + max(ORDERS) - 1]
        found = np.bincount(subwords(part, buckets), minlength=buckets)
        total += found
    used = np.flatnonzero(total)
    return used, total[used]


def train(rows: list[tuple[tuple[np.ndarray, np.ndarray], str]], s: Settings = Settings()) -> Model:
    """Fit on (bucket counts, language) rows. Without rows the model knows no language."""
    rows = [x for x in rows if len(x[0][0])]
    languages = tuple(sorted({lang for _, lang in rows}))
    if not languages:
        return Model((), np.zeros((s.buckets, 0), np.float32), np.zeros(0), 1.0, 0.0, 0, 0)
    rng, at = np.random.default_rng(s.seed), {lang: i for i, lang in enumerate(languages)}
    fitted: list[tuple[np.ndarray, np.ndarray, int]] = []
    held: list[tuple[np.ndarray, np.ndarray, int]] = []
    for (used, n), lang in rows:
        (held if rng.random() < s.kept else fitted).append((used, n / n.sum(), at[lang]))
    counts = np.bincount([y for *_, y in fitted], minlength=len(languages)) if fitted else np.ones(len(languages))
    weight = len(fitted) / np.maximum(1, counts) / len(languages)
    embedding = rng.normal(0, 0.1, (s.buckets, s.dimensions))
    linear, bias = rng.normal(0, 0.1, (s.dimensions, len(languages))), np.zeros(len(languages))
    steps, done = max(1, s.epochs * -(-len(fitted) // s.batch)), 0
    for _ in range(s.epochs):
        order = rng.permutation(len(fitted))
        for i in range(0, len(order), s.batch):
            part = [fitted[k] for k in order[i : i + s.batch]]
            y = np.array([y for *_, y in part])
            used, where = np.unique(np.concatenate([f for f, *_ in part]), return_inverse=True)
            share = np.zeros((len(part), len(used)))
            share[np.repeat(np.arange(len(part)), [len(f) for f, *_ in part]), where] = np.concatenate([w for _, w, _ in part])
            average = share @ embedding[used]
            error = _softmax(average @ linear + bias)
            error[np.arange(len(part)), y] -= 1
            error *= weight[y][:, None] / len(part)
            rate = s.rate * (1 - done / steps)
            done += 1
            change = share.T @ (error @ linear.T) * (s.buckets / 1024)
            linear -= rate * 4 * average.T @ error
            bias -= rate * error.sum(axis=0)
            embedding[used] -= rate * change
    table = (embedding @ linear).astype(np.float32)
    temperature, threshold, right = 1.0, 0.0, 0
    if held:
        logits = np.array([w @ table[f].astype(np.float64) + bias for f, w, _ in held])
        y = np.array([y for *_, y in held])
        tried = [0.02 * 1.25**i for i in range(28)]
        temperature = min(tried, key=lambda t: -np.log(np.maximum(1e-12, _softmax(logits / t)[np.arange(len(y)), y])).mean())
        sure = _softmax(logits / temperature)
        good = sure.argmax(axis=1) == y
        right = int(good.sum())
        if right:
            # no stricter than halfway between even odds and what kept rows reach
            even = 1 / len(languages)
            threshold = float(min(np.quantile(sure.max(axis=1)[good], s.wrongly_rejected), even + (1 - even) / 5))
    return Model(languages, table, bias, temperature, threshold, len(held), right)


def predict(text: str | None, model: Model) -> tuple[str, float]:
    """Language and calibrated probability; UNKNOWN and 0 for a text that is null or has no letter."""
    if not text or not model.languages or not LETTER.search(text):
        return UNKNOWN, 0.0
    total, n, buckets = np.zeros(len(model.languages)), 0, len(model.table)
    for a in range(0, len(text), 1 << 18):
        found = subwords(text[a : a + (1 << 18) + max(ORDERS) - 1], buckets)
        total += np.bincount(found, minlength=buckets) @ model.table if len(found) > buckets // 8 else model.table[found].sum(axis=0, dtype=np.float64)
        n += len(found)
    sure = _softmax((total / max(1, n) + model.bias) / model.temperature)
    best = int(sure.argmax())
    return model.languages[best], float(min(1.0, sure[best]))


def held_out(key: Column) -> Column:
    """Rows that are never learned from: the CRC-32 of the key as text is a multiple of 5 (a null key counts as empty)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5 == 0


def sample(df: DataFrame, text: str, label: str, key: str, s: Settings) -> list[tuple[tuple[np.ndarray, np.ndarray], str]]:
    """Bucket counts of a bounded sample of labelled rows that may be learned from: a seeded hash of key and text below a limit for each language.

    Of more than `most_languages` labels the most frequent ones are learned (ties by name).
    """
    own = df.select(F.col(f"`{label}`").alias("l"), F.col(f"`{text}`").alias("t"), F.col(f"`{key}`").alias("k"))
    usable = own.where(F.col("l").isNotNull() & F.col("t").isNotNull() & ~held_out(F.col("k")))
    counts = usable.groupBy("l").count().orderBy(F.col("count").desc(), "l").limit(s.most_languages).collect()
    if not counts:
        return []
    limits = df.sparkSession.createDataFrame([(r[0], int(min(1.0, s.rows_per_language / r[1]) * (1 << 30))) for r in counts], "l string, below long")
    drawn = usable.withColumn("d", F.pmod(F.xxhash64(F.lit(s.seed), "k", "t"), F.lit(1 << 30))).join(F.broadcast(limits), "l").where("d < below")
    # a draw can exceed its mean a little; what is above is left out by the draw's order
    first = drawn.withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy("d", "t"))).where(F.col("n") <= s.rows_per_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bucket_counts(t.as_py(), s.buckets) for t in batch.column(2)]
            packed = [pa.array([x[i].astype(np.int32).tobytes() for x in found], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *packed], ["l", "d", "used", "counts"])

    rows = first.select("l", "d", "t").mapInArrow(run, "l string, d long, used binary, counts binary").collect()
    rows.sort(key=lambda r: (r["d"], r["l"], bytes(r["used"]), bytes(r["counts"])))
    return [((np.frombuffer(r["used"], np.int32).astype(np.int64), np.frombuffer(r["counts"], np.int32).astype(np.float64)), r["l"]) for r in rows]


def learn(df: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", settings: Settings = Settings()) -> Model:
    """A model of the labels in `label`. Rows with a null text or label and held-out ones are not learned from; a null key counts as empty.

    Repeated rows and tied draws are taken in the order of the draw, then the text; without usable rows, as in an empty
    table, the model knows no language. Other columns are ignored.
    """
    return train(sample(df, text, label, key, settings), settings)


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred (string), score (double, 0 to 1) and rejected (boolean) to `df`, from the whole text alone; no shuffle.

    A text that is null or has no letter gets `und`, score 0 and is rejected, as is any text if the model knows no
    language. Rejected are also texts whose calibrated probability is below the model's threshold. Columns with these
    names are replaced, all others kept; equal texts and repeated rows get equal results, of tied languages the first by
    code point wins. Very long texts are read whole, in parts. An empty table gives no rows.
    """
    df = df.drop("lang_pred", "score", "rejected")
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [predict(t.as_py(), shared.value) for t in batch.column(batch.schema.get_field_index(text))]
            rejected = [lang == UNKNOWN or score < shared.value.threshold for lang, score in found]
            columns = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), *columns], [*batch.schema.names, "lang_pred", "score", "rejected"])

    return df.mapInArrow(run, extended(df.schema, "lang_pred string, score double, rejected boolean"))
