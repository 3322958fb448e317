"""Ranking of a linked list that is spread over many tasks: sums of weights in front of each item."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small


def chains(ids: np.ndarray, nexts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Follow the links between the items at hand (a link to -1 or to no item at hand ends a chain).

    Returns, for each item, the first item of its chain and the weights in front of it there, and the last items of the
    chains (all as places in the arrays). By pointer jumping: as many passes as the longest chain has binary digits.
    """
    order = np.argsort(ids)
    at = np.minimum(np.searchsorted(ids, nexts, sorter=order), max(len(ids) - 1, 0))
    follower = np.where(ids[order][at] == nexts, order[at], -1) if len(ids) else at
    before = np.full(len(ids), -1)
    linked = np.flatnonzero(follower >= 0)
    before[follower[linked]] = linked
    first = np.where(before < 0, np.arange(len(ids)), before)
    ahead = np.where((before >= 0)[:, None], weights[before], 0)
    while len(live := np.flatnonzero(before >= 0)):
        jump = before[live]
        ahead[live] += ahead[jump]
        first[live] = first[jump]
        before[live] = before[jump]
    return first, ahead, np.flatnonzero(follower < 0)


def contracted(items: DataFrame, weights: list[str]) -> DataFrame:
    """Rows for each item of a partition (`head` of its chain, the weights in front of it) and for each chain (`head` null: an item of the shorter list)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # a partition has about `rows_per_part` items, see rank()
        if not held:
            return
        ids, nexts, place, *own = (pa.chunked_array([b.column(i) for b in held]) for i in range(3 + len(weights)))
        ids, nexts, place = ids.to_numpy(), nexts.fill_null(-1).to_numpy(), place.to_numpy()
        load = np.stack([w.to_numpy() for w in own], 1)
        first, ahead, last = chains(ids, nexts, load)
        head = first[last]
        total = ahead[last] + load[last]
        for columns in ((ids, ids[first], None, place, ahead), (ids[head], None, nexts[last], place[head], total)):
            for a in range(0, len(columns[0]), 65_536):
                part = slice(a, a + 65_536)
                own_id, chain, following, where, sums = (None if c is None else c[part] for c in columns)
                nothing = pa.nulls(len(own_id), pa.int64())
                arrays = [pa.array(own_id), nothing if chain is None else pa.array(chain), nothing if following is None else pa.array(following, mask=following < 0), pa.array(where), *(pa.array(np.ascontiguousarray(sums[:, j])) for j in range(len(weights)))]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "head", "next", "place", *weights])

    return items.select("id", "next", "place", *weights).mapInArrow(run, ", ".join(f"{c} long" for c in ("id", "head", "next", "place", *weights)))


def rank(items: DataFrame, weights: list[str], rows_per_part: int = 50_000) -> DataFrame:
    """For each item of one linked list the sum of each weight over all items in front of it: columns id and the weights.

    `items` has id (long, not negative), next (the id that follows, null at the end), place (long: items near each other
    in the list should mostly have near places) and the weights (long). In each round the items are dealt to tasks of
    about `rows_per_part`, links within a task are followed, and each chain becomes one item of a shorter list, until one
    task holds the rest; then the sums are handed back round by round. Items are dealt by place; where that shortens the
    list by less than half, the next round draws lots instead and deals an item to where its follower is if it drew 0 and
    the follower 1, which joins a quarter of all links whatever the places. No key has more than two items. An empty list
    gives no rows.
    """
    rounds, left, by_place = [], items, True
    n = items.count()
    while n:
        parts = -(-n // rows_per_part)
        if parts == 1:
            dealt = left.coalesce(1)
        elif by_place:
            dealt = left.repartitionByRange(parts, "place")
        else:
            lot = F.pmod(F.xxhash64("id", F.lit(len(rounds))), F.lit(2)) == 0
            dealt = left.repartition(parts, F.when(lot, F.coalesce("next", "id")).otherwise(F.col("id")))
        done = cut(contracted(dealt, weights))
        rounds.append(done.where("head is not null"))
        left = done.where("head is null").drop("head")
        shorter = left.count()
        by_place, n = not by_place or 2 * shorter <= n, 0 if parts == 1 else shorter
    if not rounds:
        return items.select("id", *weights).limit(0)
    found = rounds.pop().select("id", *weights)
    for items_then in reversed(rounds):
        front = small(found.select(F.col("id").alias("head"), *[F.col(w).alias(f"_{w}") for w in weights]))
        found = items_then.join(front, "head").select("id", *[(F.col(w) + F.col(f"_{w}")).alias(w) for w in weights])
    return found
