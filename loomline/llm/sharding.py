"""Uniform sharding with exact shard sizes by a hypergeometric communication matrix.

A uniform random shuffle of N rows into shards of fixed sizes sends a random number of each partition's rows to each
shard. Those numbers follow a multivariate hypergeometric law, so they can be drawn first, on the driver, from the
partitions' row counts alone. Then each partition permutes its own rows and deals them out by its row of the matrix,
the rows are exchanged, and each shard permutes what it got. The result is a uniform shuffle, yet no step sees all rows.

Partitions here are hash buckets of the key columns, not Spark's own, whose borders can differ when a stage is run
again; all random orders are hashes of a seed and the row, so a recomputed task deals out the same rows again.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import aside


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` items taken without replacement from good + bad are good; exact for populations of any size.

    Large ones by inverting the distribution over twelve standard deviations around the mode, built from ratios of neighbours.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low >= high:
        return low
    total = good + bad
    if total < 1_000_000_000:  # what numpy's own draws are made for
        return int(rng.hypergeometric(good, bad, draws))
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    spread = math.sqrt(draws * (good / total) * (bad / total) * max(1, total - draws) / max(1, total - 1))
    reach = int(12 * spread) + 30
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    rise = np.cumsum(np.log((good - up) * (draws - up)) - np.log((up + 1) * (bad - draws + up + 1)))
    fall = np.cumsum(np.log(down * (bad - draws + down)) - np.log((good - down + 1) * (draws - down + 1)))
    weights = np.exp(np.concatenate((fall[::-1], [0.0], rise)))
    at = np.searchsorted(np.cumsum(weights), rng.random() * weights.sum(), side="right")
    return int(mode - len(down) + min(at, len(weights) - 1))


def communication_matrix(rows: list[int], shard_sizes: list[int], seed: int) -> np.ndarray:
    """Rows that partition i sends to shard j: a random matrix with exactly these row sums and column sums."""
    rng, left = np.random.default_rng(seed), [int(x) for x in shard_sizes]
    matrix = np.zeros((len(rows), len(left)), np.int64)
    for i, n in enumerate(rows):
        rest = sum(left)
        for j, room in enumerate(left):
            rest -= room
            matrix[i, j] = k = hypergeometric(rng, room, rest, n)
            n -= k
        left = [room - int(k) for room, k in zip(left, matrix[i])]
    return matrix


def even_sizes(rows: int, shards: int) -> list[int]:
    """Shard sizes at most one apart."""
    return [rows // shards + (j < rows % shards) for j in range(shards)]


def _seeded(seed: int, salt: int, columns: list[str]) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(salt), *columns)


def hypergeometric_shards(df: DataFrame, shards: int, keys: list[str], seed: int = 20_261, rows_per_block: int = 1 << 12, most_blocks: int = 1 << 14, most_senders: int = 256) -> DataFrame:
    """Add `shard` (int, 0 to shards - 1) and `slot` (long, gapless from 0 in each shard): a seeded uniform shuffle.

    Shards differ by one row at most. `keys` name the columns whose hash spreads the rows over the sending partitions;
    they should be near unique (rows with equal keys, nulls included, share a partition, not a shard). Rows equal in
    all columns are interchangeable, so every rerun gives the same rows. Null and very long values are rows like others;
    an empty table gives no rows. Columns of `df`
    called shard or slot are replaced; all others stay, whatever their names.

    No task needs a whole partition or shard: a sender's random order goes through parts, whose row counts give the
    ranks at which they begin, and a shard is dealt out as equal blocks of consecutive slots. Two exchanges of the
    rows, each into up to `most_blocks` parts. The parts' row counts come to the driver, from a scan of the key columns
    alone; what is broadcast has at most most_senders * most_blocks numbers, 32 MB.
    """
    spark, df = df.sparkSession, df.drop("shard", "slot")
    names = df.columns
    df, back = aside(df, ("_sender", "_part", "_order", "_tie", "_rank", "_begun", "_shards", "_blocks", "_block", "_again", "_at", "_slot"))
    keyed, bare = [f"`{df.columns[names.index(c)]}`" for c in keys], [f"`{c}`" for c in df.columns]
    fine = F.pmod(_seeded(seed, 1, keyed), F.lit(most_blocks)).cast("int")
    counts = {r[0]: r[1] for r in df.select(fine.alias("p")).groupBy("p").count().collect()}
    total = sum(counts.values())
    senders = min(most_senders, max(64, 1 << (-(-total // rows_per_block) - 1).bit_length() if total else 1))
    parts = max(1, min(most_blocks // senders, 1 << max(0, -(-total // (rows_per_block * senders)) - 1).bit_length()))
    blocks = max(1, min(most_blocks // shards, -(-total // (rows_per_block * shards))))
    held = np.zeros((senders, parts), np.int64)
    for p, n in counts.items():
        held[p % senders, p // senders % parts] += n
    sizes = [even_sizes(n, blocks) for n in even_sizes(total, shards)]
    matrix = communication_matrix(held.sum(axis=1).tolist(), [n for shard in sizes for n in shard], seed)
    first = (np.cumsum(matrix, axis=1) - matrix).reshape(senders, shards, blocks)
    begun = np.cumsum(held, axis=1) - held
    dealt = spark.createDataFrame([(p, begun[p].tolist(), first[p, :, 0].tolist(), first[p].tolist()) for p in range(senders)], "_sender int, _begun array<long>, _shards array<long>, _blocks array<array<long>>")
    slots = spark.createDataFrame([(j, b, sum(sizes[j][:b])) for j in range(shards) for b in range(blocks)], "shard int, _block int, _slot long")

    def place(firsts: Column) -> Column:
        """The last place that begins at or before the rank; one without rows begins where the next one does."""
        return (F.size(F.filter(firsts, lambda x: x <= F.col("_rank"))) - 1).cast("int")

    send = Window.partitionBy("_sender", "_part").orderBy("_order", "_tie")
    receive = Window.partitionBy("shard", "_block").orderBy("_again", "_sender", "_rank")
    spread = df.withColumns({"_sender": F.pmod(fine, F.lit(senders)), "_part": F.pmod(F.floor(fine / F.lit(senders)), F.lit(parts)).cast("int"), "_order": _seeded(seed, 2, keyed), "_tie": _seeded(seed, 3, bare)})
    ranked = spread.withColumn("_rank", (F.row_number().over(send) - 1).cast("long")).join(F.broadcast(dealt), "_sender").withColumn("_rank", F.col("_rank") + F.col("_begun")[F.col("_part")])
    placed = ranked.withColumn("shard", place(F.col("_shards"))).withColumn("_block", place(F.col("_blocks")[F.col("shard")])).drop("_begun", "_shards", "_blocks")
    mixed = placed.withColumn("_again", F.xxhash64(F.lit(seed), F.lit(4), "_sender", "_rank")).withColumn("_at", F.row_number().over(receive) - 1)
    slotted = mixed.join(F.broadcast(slots), ["shard", "_block"])
    return slotted.select(*back, "shard", (F.col("_slot") + F.col("_at")).cast("long").alias("slot"))
