"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are aggregated by the set of sources they belong to. A flow then routes each set's token capacity to the
quotas of its sources: a first copy of its tokens costs nothing, each further one more than the one before (convex
costs), so repetition is spread as thin as the quotas allow. The flow runs on the driver over sets and sources only.
Last, each set's share is filled with whole copies of its documents and a seeded random part of one more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import aside, cut, fresh

WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Number of words, null: 0: the places where a word begins."""
    spaces = " \t\n\x0b\x0c\r"
    plain = F.translate(F.coalesce(text, F.lit("")), spaces, " " * 6)
    return F.coalesce(F.regexp_count(plain, F.lit("[^ ]+")), F.lit(0)).cast("long")


def capped_targets(sizes: list[int], weights: list[int], total: float, most: float) -> list[float]:
    """Shares of `total` by weight, none above `most` times its size; the excess goes to the others by weight."""
    left, open_, out = total, set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if unit * weights[i] >= most * sizes[i]}
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


def min_cost_flow(supplies: list[int], members: list[list[int]], quotas: list[int], copies: int) -> list[int]:
    """Tokens taken from each set of sources at least cost: set i reaches the sources in members[i], its c-th copy of supplies[i] costs c - 1 a token.

    Costs stand on the sets alone, and adding flow never has to take any from a set that gives some (paths that end at
    the sets' source can be cut short). So a maximum flow with one copy of each set, raised to two copies, and so on, is
    a maximum flow of least convex cost. Each level is raised by blocking flows over shortest paths, sets and sources in turn.
    """
    n, m = len(supplies), len(quotas)
    taken, left = [0] * n, list(quotas)
    flow: list[dict[int, int]] = [{} for _ in range(n)]  # set -> source -> tokens
    givers: list[dict[int, None]] = [{} for _ in range(m)]  # sets that give to a source

    for level in range(1, copies + 1):
        while True:
            # layers: sets with room, their sources, the sets that give to these and could give elsewhere, ...
            depth_set, depth_source = [-1] * n, [-1] * m
            layer = [i for i in range(n) if taken[i] < level * supplies[i]]
            for i in layer:
                depth_set[i] = 0
            depth, reached = 0, False
            while layer and not reached:
                sources = []
                for i in layer:
                    for j in members[i]:
                        if depth_source[j] < 0:
                            depth_source[j] = depth
                            sources.append(j)
                            reached = reached or left[j] > 0
                depth, layer = depth + 1, []
                if not reached:
                    for j in sources:
                        for i in givers[j]:
                            if depth_set[i] < 0:
                                depth_set[i] = depth
                                layer.append(i)
            if not reached:
                break
            next_member = [0] * n
            next_giver: list[list[int] | None] = [None] * m
            for start in range(n):
                while depth_set[start] == 0 and taken[start] < level * supplies[start]:
                    path = _path(start, depth_set, depth_source, members, givers, next_member, next_giver, left)
                    if not path:
                        break
                    step = min(level * supplies[start] - taken[start], left[path[-1]], *(flow[path[k + 1]][path[k]] for k in range(1, len(path) - 1, 2)))
                    for k in range(0, len(path), 2):
                        i, j = path[k], path[k + 1]
                        flow[i][j] = flow[i].get(j, 0) + step
                        givers[j][i] = None
                        if k:
                            flow[i][path[k - 1]] -= step
                            if not flow[i][path[k - 1]]:
                                del flow[i][path[k - 1]], givers[path[k - 1]][i]
                    taken[start] += step
                    left[path[-1]] -= step
    return taken


def _path(start: int, depth_set: list[int], depth_source: list[int], members: list[list[int]], givers: list[dict[int, None]], next_member: list[int], next_giver: list, left: list[int]) -> list[int]:
    """A way down the layers from a set to a source with room: set, source, set, ..., source; empty if none is left. Dead ends are not tried again."""
    path = [start]
    while path:
        if len(path) % 2:  # at a set
            i = path[-1]
            while next_member[i] < len(members[i]) and depth_source[members[i][next_member[i]]] != depth_set[i]:
                next_member[i] += 1
            if next_member[i] < len(members[i]):
                path.append(members[i][next_member[i]])
                continue
            path.pop()
            if path:
                next_giver[path[-1]].pop()
        else:
            j = path[-1]
            if left[j] > 0:
                return path
            if next_giver[j] is None:
                next_giver[j] = [i for i in givers[j] if depth_set[i] == depth_source[j] + 1]
            waiting = next_giver[j]
            while waiting and waiting[-1] not in givers[j]:
                waiting.pop()
            if waiting:
                path.append(waiting[-1])
                continue
            path.pop()
            next_member[path[-1]] += 1
    return []


def mix(df: DataFrame, memberships: Column, size: Column, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, keys: tuple[str, ...] = ("doc_id",), seed: int = 11, buckets: int = 4096, most_sets: int = 250_000) -> DataFrame:
    """Add size, taken (long: tokens the mix takes, repeats counted), sources (array<string>), target and source_size (arrays of double and long, by source).

    `memberships` is an array of source names (a null array or name: the source null), `size` a token count. The
    sources, ordered by code point with null last, have the given weights in turn; together they get `share` times all
    tokens, but none more than `most` times its own. Which documents a set gives one copy more is decided by a hash of
    the seed and `keys`; the last of them is taken in part, so that every set gives exactly its flow. Rows equal in
    `keys` stand at one place of that order and share its part evenly (rounded down). An empty table gives no rows;
    columns of `df` with the new columns' names are replaced (`size` may read an old one), all others kept, whatever their names.

    To the driver come the sizes of the sets of sources, refused beyond `most_sets`, which bounds what is broadcast.
    The rows are ordered by hash in `buckets` parts of each set, whose sums tell in which part the cut falls; only
    that part is summed by row. Rows are not shuffled.
    """
    spark, added = df.sparkSession, ("size", "sources", "target", "source_size", "taken")
    own = list(df.columns)
    members, size_of, place = fresh(own, "_mix_members", "_mix_size", "_mix_key")
    df = df.withColumns({members: memberships, size_of: size.cast("long"), place: F.struct(*keys)})
    df, back = aside(df, ("_sources", "_order", "_set", "_bucket", "_size", "_tokens", "_whole", "_part", "_target", "_source_size", "_end", "_cut", "_left", "_tied", "_room", "_before"))
    memberships, size = F.col(members), F.col(size_of)
    kept = [c for c, name in zip(back, own) if name.lower() not in added]
    names = F.array_sort(F.array_distinct(F.when(F.size(F.coalesce(memberships, F.array().cast("array<string>"))) > 0, memberships).otherwise(F.array(F.lit(None).cast("string")))))
    base = df.withColumns({"_sources": names, "_order": F.xxhash64(F.lit(seed), place)})
    base = base.withColumns({"_set": F.to_json(F.struct(F.transform("_sources", lambda s: F.coalesce(F.concat(F.lit("="), s), F.lit("null"))).alias("s"))), "_bucket": F.pmod(F.shiftrightunsigned("_order", 20), F.lit(buckets)).cast("int")})
    sums = cut(base.select("_set", "_bucket", "_sources", size.alias("_size")).groupBy("_set", "_bucket").agg(F.sum("_size").alias("_tokens"), F.first("_sources").alias("_sources")))
    sets = sums.groupBy("_set").agg(F.sum("_tokens").alias("tokens"), F.first("_sources").alias("sources")).limit(most_sets + 1).collect()
    if len(sets) > most_sets:
        raise ValueError(f"over {most_sets} different sets of sources")
    sets.sort(key=lambda r: r["_set"])
    every = sorted({s for r in sets for s in r["sources"]}, key=lambda s: (s is None, (s or "").encode()))
    at = {s: j for j, s in enumerate(every)}
    members = [[at[s] for s in r["sources"]] for r in sets]
    sizes = [sum(r["tokens"] for r, ms in zip(sets, members) if j in ms) for j in range(len(every))]
    targets = capped_targets(sizes, [weights[j % len(weights)] for j in range(len(every))], share * sum(r["tokens"] for r in sets), most)
    flow = min_cost_flow([r["tokens"] for r in sets], members, [round(t) for t in targets], most)
    plan = [(r["_set"], f // max(1, r["tokens"]), f % max(1, r["tokens"]), [targets[j] for j in ms], [sizes[j] for j in ms]) for r, f, ms in zip(sets, flow, members)]
    plans = spark.createDataFrame(plan, "_set string, _whole long, _part long, _target array<double>, _source_size array<long>")
    # the bucket in which a set's part ends: those before it are full; of its own rows those before a cut in hash order
    before = Window.partitionBy("_set").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    summed = sums.withColumn("_before", F.coalesce(F.sum("_tokens").over(before), F.lit(0))).join(F.broadcast(plans), "_set")
    ends = cut(summed.where("_before < _part and _before + _tokens >= _part").select("_set", "_bucket", (F.col("_part") - F.col("_before")).alias("_room")))
    within = Window.partitionBy("_set").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    tied = base.join(F.broadcast(ends), ["_set", "_bucket"]).groupBy("_set", "_bucket", "_order", "_room").agg(F.sum(size).alias("_tied"))
    cuts = tied.withColumn("_left", F.col("_room") - F.coalesce(F.sum("_tied").over(within), F.lit(0))).where("_left > 0 and _left <= _tied")
    cuts = cut(cuts.select("_set", F.col("_bucket").alias("_end"), F.col("_order").alias("_cut"), "_left", "_tied"))
    known = base.withColumn("_size", size).join(F.broadcast(plans), "_set").join(F.broadcast(cuts), "_set", "left")
    whole = (F.col("_bucket") < F.col("_end")) | ((F.col("_bucket") == F.col("_end")) & (F.col("_order") < F.col("_cut")))
    partly = (F.col("_bucket") == F.col("_end")) & (F.col("_order") == F.col("_cut"))
    more = F.when(whole, F.col("_size")).when(partly, F.floor(F.col("_size") * F.col("_left") / F.col("_tied"))).otherwise(0)
    new = (F.col("_size"), F.col("_sources"), F.col("_target"), F.col("_source_size"), F.col("_size") * F.col("_whole") + more)
    return known.select(*kept, *[c.cast("long").alias(n) if n in ("size", "taken") else c.alias(n) for c, n in zip(new, added)])


def mix_by_source(df: DataFrame, source: str = "source", text: str = "text", **settings: object) -> DataFrame:
    """`mix` for documents with one source each; sizes are words."""
    return mix(df, F.array(F.col(source)), word_count(F.col(text)), **settings)
