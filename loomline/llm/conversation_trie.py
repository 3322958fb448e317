"""The trie of rebuilt conversations by an Euler tour.

A node is a sequence of first turns. It is known by its depth and a hash of its turns that can be put together from
parts (the sum of turn hashes times powers of a base, modulo four primes), so that a conversation of any length is
hashed in pieces. The tour enters and leaves each node once: an enter arc is followed by the enter arc of the first
child or, in a leaf, by the exit arc; an exit arc by the enter arc of the next sibling or the exit arc of the parent. The
tour is ranked as a linked list over many tasks; what lies between the arcs of a node is its subtree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut
from .list_ranking import rank
from .mixing import word_count

PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1566083941, 1812433253, 1289706101)
LANES = range(4)
BLOCK, SHARED = 20, 4  # conversations that share their beginnings, and below which number of turns
CELL = 4096  # turns of one conversation that go to one task at most when its rows are joined


def lanes(prefix: str) -> list[str]:
    return [f"{prefix}{i}" for i in LANES]


def powers(exponents: np.ndarray) -> np.ndarray:
    """Each base to each exponent, modulo its prime: (exponent, lane)."""
    primes = np.array(PRIMES, np.uint64)
    out, square, left = np.ones((len(exponents), len(LANES)), np.uint64), np.array(BASES, np.uint64), exponents.astype(np.uint64)
    while left.any():
        out = np.where((left & np.uint64(1)).astype(bool)[:, None], out * square % primes, out)
        square, left = square * square % primes, left >> np.uint64(1)
    return out


def scanned(turns: DataFrame) -> DataFrame:
    """Numbers and hashes of the turns of each conversation (columns conv, digest, words, in order) as far as a partition shows them.

    `at` counts from 1, s0.. is the hash with the turn and e0.. the one before it; `part` is the number of the partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, primes = TaskContext.get().partitionId(), np.array(PRIMES, np.uint64)
        last, count, total = None, 0, np.zeros(len(LANES), np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0).to_numpy()
            own = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(-1, len(LANES)).astype(np.uint64) % (primes - np.uint64(1)) + np.uint64(1)
            fresh = np.append(last is None or conv[0] != last, conv[1:] != conv[:-1])
            start = np.maximum.accumulate(np.where(fresh, np.arange(len(conv)), 0))
            carried = np.cumsum(fresh) == 0  # rows of the conversation that was open before this batch
            at = np.arange(len(conv)) - start + 1 + np.where(carried, count, 0)
            term = own * powers(at) % primes
            running = np.vstack([np.zeros((1, len(LANES)), np.uint64), np.cumsum(term, 0)])
            with_turn = (running[1:] - running[start] + np.where(carried[:, None], total, np.uint64(0))) % primes
            before = (with_turn + primes - term) % primes
            last, count, total = conv[-1], int(at[-1]), with_turn[-1]
            arrays = [pa.array(np.full(len(conv), part, np.int32)), pa.array(conv), pa.array(at), batch.column(2), *(pa.array(x[:, i].astype(np.int64)) for x in (with_turn, before) for i in LANES)]
            yield pa.RecordBatch.from_arrays(arrays, ["part", "conv", "at", "words", *lanes("s"), *lanes("e")])

    return turns.select("conv", "digest", "words").mapInArrow(run, "part int, conv long, at long, words long, " + ", ".join(f"{c} long" for c in (*lanes("s"), *lanes("e"))))


def carried_over(part_ends: list, spark: SparkSession) -> DataFrame | None:
    """What conversations that go on in a partition bring along: (part, conv, n, the hash so far, powers of the bases). One row a partition at most."""
    rows, open_conv, n, total = [], None, 0, (0,) * len(LANES)
    for r in part_ends:
        so_far, sums = 0, (0,) * len(LANES)
        if r["least"] == open_conv:
            rows.append((r["part"], open_conv, n, *total, *(pow(b, n, p) for b, p in zip(BASES, PRIMES))))
            if r["least"] == r["most"]:
                so_far, sums = n, total
        total = tuple((t + pow(b, so_far, p) * r["end"][s]) % p for t, s, b, p in zip(sums, lanes("s"), BASES, PRIMES))
        open_conv, n = r["most"], so_far + r["end"]["at"]
    names = ["part", "conv", "n", *lanes("t"), *lanes("m")]
    return spark.createDataFrame(rows, "part int, " + ", ".join(f"{c} long" for c in names[1:])) if rows else None


def numbered_turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """All turns in order: conv, at (from 1), words, the hash of the first `at` turns (s0..) and of those before (e0..).

    Turns are ordered by sorting ranges of (conv, turn, role, text), so that a long conversation is spread over ranges,
    and each range is scanned by itself; what a conversation brings along from the ranges before is added afterwards.
    """
    own = df.select(F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).where("conv is not null")
    order = [F.col("conv"), F.col("turn").asc_nulls_first()]
    ranged = own.repartitionByRange(*order, F.substring("role", 1, 32), F.substring("text", 1, 64)).sortWithinPartitions(*order, "role", "text")
    said = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    turns = cut(scanned(ranged.select("conv", F.unhex(F.md5(said)).alias("digest"), word_count(F.col("text")).cast("long").alias("words"))))
    ends = turns.groupBy("part").agg(F.min("conv").alias("least"), F.max("conv").alias("most"), F.max_by(F.struct("at", *lanes("s")), F.struct("conv", "at")).alias("end"))
    brought = carried_over(sorted(ends.collect(), key=lambda r: r["part"]), df.sparkSession)
    if brought is None:
        return turns.drop("part")
    joined = turns.join(F.broadcast(brought), ["part", "conv"], "left")

    def shifted(prefix: str) -> list[Column]:
        return [F.when(F.col("n").isNull(), F.col(f"{prefix}{i}")).otherwise((F.col(f"t{i}") + F.col(f"m{i}") * F.col(f"{prefix}{i}")) % PRIMES[i]).alias(f"{prefix}{i}") for i in LANES]

    return joined.select("conv", (F.col("at") + F.coalesce("n", F.lit(0))).alias("at"), "words", *shifted("s"), *shifted("e"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """One row a conversation: n (own turns), h, k (turns taken from its base), b1.. (these turns), g0.. and o0.. (hashes of the k and of its own first h), i0.. (the shift), where it ends."""

    def prefix(j: int) -> Column:
        return F.max(F.when(F.col("at") == j, F.struct(*lanes("s"), "words"))).alias(f"p{j}")

    early = range(1, SHARED)
    whole = turns.groupBy("conv").agg(F.max("at").alias("n"), F.max_by(F.struct(*lanes("s")), "at").alias("last"), *[prefix(j) for j in early])
    whole = cut(whole)
    bases = whole.select(F.col("conv").alias("base"), F.col("n").alias("base_n"), *[F.col(f"p{j}").alias(f"b{j}") for j in early])
    c = whole.withColumn("h", F.crc32(F.col("conv").cast("string")) % SHARED).withColumn("base", F.col("conv") - F.col("conv") % BLOCK)
    c = c.join(bases.where(F.col("base") % BLOCK == 0), "base", "left").withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0))))

    def nth(letter: str, n: Column, lane: int) -> Column:
        return F.coalesce(F.array(F.lit(0).cast("long"), *[F.col(f"{letter}{j}.s{lane}") for j in early])[n], F.lit(0))

    for i in LANES:
        shifts = F.array(*[F.lit(pow(BASES[i], -j, PRIMES[i])).cast("long") for j in range(SHARED)])
        taken, own, shift = nth("b", F.col("k").cast("int"), i), nth("p", F.least("h", "n").cast("int"), i), shifts[(F.col("h") - F.col("k")).cast("int")]
        c = c.withColumns({f"g{i}": taken, f"o{i}": own, f"i{i}": shift})
    goes_on = F.col("n") > F.col("h")
    ends = [F.when(goes_on, moved(F.col(f"last.s{i}"), i)).otherwise(F.col(f"g{i}")).alias(f"s{i}") for i in LANES]
    return c.select("conv", "n", "h", "k", *[f"b{j}" for j in early], *lanes("g"), *lanes("o"), *lanes("i"), (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("end_depth"), F.struct(*ends).alias("end"))


def moved(own: Column, lane: int) -> Column:
    """The hash of a conversation's own first turns as that of its rebuilt ones."""
    p = PRIMES[lane]
    return (F.col(f"g{lane}") + F.pmod(own - F.col(f"o{lane}"), F.lit(p)) * F.col(f"i{lane}")) % p


def paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """All turns of the rebuilt conversations: conv, depth, words, the node's hash (s0..) and its parent's (p0..)."""
    zero = [F.lit(0).cast("long").alias(f"p{i}") for i in LANES]

    def taken(j: int) -> Column:
        parent = zero if j == 1 else [F.col(f"b{j - 1}.s{i}").alias(f"p{i}") for i in LANES]
        return F.struct(F.lit(j).cast("long").alias("depth"), F.col(f"b{j}.words").alias("words"), *[F.col(f"b{j}.s{i}").alias(f"s{i}") for i in LANES], *parent)

    begun = convs.where("k > 0").select("conv", F.explode(F.slice(F.array(*map(taken, range(1, SHARED))), 1, F.col("k").cast("int"))).alias("t")).select("conv", "t.*")
    # a long conversation's rows are joined in cells of its turns
    known = convs.where("n > h").select("conv", "h", "k", *lanes("g"), *lanes("o"), *lanes("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / CELL))).alias("cell"))
    own = turns.withColumn("cell", F.floor(F.col("at") / CELL)).join(known, ["conv", "cell"]).where("at > h")
    rest = own.select("conv", (F.col("k") + F.col("at") - F.col("h")).alias("depth"), "words", *[moved(F.col(f"s{i}"), i).alias(f"s{i}") for i in LANES], *[moved(F.col(f"e{i}"), i).alias(f"p{i}") for i in LANES])
    return begun.unionByName(rest)


def end_digests(convs: DataFrame, chunk: int = 4096) -> DataFrame:
    """For each node where conversations end, the SHA-256 (binary) of their ids in ascending order, joined by commas.

    Ids are sorted in ranges of (node, id) and put together to strings of `chunk` characters, so that a node where very many
    conversations end is dealt as few rows; these are then hashed in order, one at a time.
    """
    node = ["depth", *lanes("s")]
    own = convs.select(F.col("end_depth").alias("depth"), "end.*", "conv")
    sorted_ids = own.repartitionByRange(*node, "conv").sortWithinPartitions(*node, "conv").select(F.struct(*node).alias("node"), "conv")
    schema = "node struct<" + ", ".join(f"{c}: bigint" for c in node) + ">"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(("node", "least", "ids"), d)) for d in done], schema=pa.schema([("node", kind), ("least", pa.int64()), ("ids", pa.string())]))

        kind, open_node, held, size, done = None, None, [], 0, []
        for batch in batches:
            kind = batch.column(0).type
            for at, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and (at != open_node or size >= chunk):
                    done.append((open_node, held[0], ",".join(map(str, held))))
                    held, size = [], 0
                open_node = at
                held.append(c)
                size += len(str(c)) + 1
            if done:
                yield rows(done)
                done = []
        if held:
            yield rows([(open_node, held[0], ",".join(map(str, held)))])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, open_node, state, done = None, None, None, []
        for batch in batches:
            kind = batch.column(0).type
            for at, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if state is not None and at == open_node:
                    state.update(b"," + ids.encode())
                    continue
                if state is not None:
                    done.append((open_node, state.digest()))
                open_node, state = at, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.binary())], ["node", "ends"])
                done = []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([open_node], kind), pa.array([state.digest()], pa.binary())], ["node", "ends"])

    packed = sorted_ids.mapInArrow(pack, f"{schema}, least long, ids string")
    return packed.repartition("node").sortWithinPartitions("node", "least").select("node", "ids").mapInArrow(digest, f"{schema}, ends binary").select("node.*", "ends")


def with_family(nodes: DataFrame) -> DataFrame:
    """Add n_children, first_child, parent and parent_conv_id to nodes (node: their number).

    A parent of more than a thousandth of all nodes is handed to its children by a broadcast (there are under a thousand
    such parents), any other by a shuffle.
    """
    key = ["depth", *lanes("s")]
    born = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), *[F.col(f"p{i}").alias(f"s{i}") for i in LANES])
    kids = born.agg(F.count("*").alias("n_children"), F.min_by("node", "conv_id").alias("first_child"))
    known = cut(nodes.join(kids, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    most = max(100, known.count() // 1000)
    parents = known.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), *[F.col(f"s{i}").alias(f"p{i}") for i in LANES], F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), (F.col("n_children") > most).alias("large"))
    above = ["depth", *lanes("p")]
    first = known.where("depth > 0").join(F.broadcast(parents.where("large")), above, "left")
    other = first.where("parent is null").drop("parent", "parent_conv_id", "large").join(parents.where("not large"), above)
    root = known.where("depth = 0").withColumns({"parent": F.lit(None).cast("long"), "parent_conv_id": F.lit(None).cast("long")})
    kept = ["node", "conv_id", "depth", "n_convs", "words", "ends", "n_children", "first_child", "parent", "parent_conv_id"]
    return reduce(DataFrame.union, [d.select(*kept) for d in (first.where("parent is not null"), other, root)])


def with_siblings(family: DataFrame) -> DataFrame:
    """Add `sibling`, the node after each one among the children of its parent in order of conv_id, and `place`, its place in that order of all nodes.

    Ranges of (parent, conv_id) are sorted by themselves; the first node of each range comes to the driver to follow the last one before it.
    """
    order = ["parent_conv_id", "depth", "conv_id"]
    ranged = family.repartitionByRange(*order).sortWithinPartitions(*order)
    names = family.columns
    own_node, own_parent = names.index("node"), names.index("parent")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, held = TaskContext.get().partitionId(), 0, None

        def linked(batch: pa.RecordBatch, following: tuple | None) -> pa.RecordBatch:
            nodes, parents = batch.column(own_node).to_numpy(), batch.column(own_parent).fill_null(-1).to_numpy()
            after, same = np.append(nodes[1:], -1 if following is None else following[0]), np.append(parents[1:] == parents[:-1], following is not None and following[1] == parents[-1])
            places = (np.int64(part) << np.int64(40)) + seen + np.arange(len(nodes))
            edge = np.append(np.zeros(len(nodes) - 1, bool), following is None)
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(after, mask=~same), pa.array(places), pa.array(np.full(len(nodes), part, np.int32)), pa.array(edge)], [*names, "sibling", "place", "part", "edge"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield linked(held, (batch.column(own_node)[0].as_py(), batch.column(own_parent).fill_null(-1)[0].as_py()))
                seen += held.num_rows
            held = batch
        if held is not None:
            yield linked(held, None)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in family.schema.fields)
    linked = cut(ranged.mapInArrow(run, f"{fields}, sibling long, place long, part int, edge boolean"))
    ends = linked.groupBy("part").agg(F.min_by(F.struct("parent", "node"), "place").alias("first"), F.max_by("parent", "place").alias("last"))
    found = sorted(ends.collect(), key=lambda r: r["part"])
    over = [(a["part"], True, b["first"]["node"]) for a, b in zip(found, found[1:]) if a["last"] is not None and a["last"] == b["first"]["parent"]]
    if not over:
        return linked
    joined = linked.join(F.broadcast(linked.sparkSession.createDataFrame(over, "part int, edge boolean, across long")), ["part", "edge"], "left")
    return joined.withColumn("sibling", F.coalesce("sibling", "across"))


def tour(family: DataFrame) -> DataFrame:
    """The arcs of the tour: even ids enter a node, odd ones leave it. Leaves and savings are weights of enter arcs."""
    enter, leave, none = F.col("node") * 2, F.col("node") * 2 + 1, F.lit(0).cast("long")
    inward = F.struct(enter.alias("id"), F.when(F.col("n_children") > 0, F.col("first_child") * 2).otherwise(leave).alias("next"), (F.col("place") * 2).alias("place"), (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    outward = F.struct(leave.alias("id"), F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1).alias("next"), (F.col("place") * 2 + 1).alias("place"), none.alias("leaves"), none.alias("saved"))
    return family.select(F.explode(F.array(inward, outward)).alias("arc")).select("arc.*")


def prefix_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rows_per_part: int = 50_000) -> DataFrame:
    """All nodes of the trie of rebuilt conversations: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by (turn, null first; role; text), so ties have one order and repeated rows are turns of their own;
    null roles and texts are empty. A conversation takes the first h = crc32(id) % 4 turns from the one whose id is the
    next lower multiple of 20, and then its own turns after its first h. Rows without a conversation are left out; very
    long texts are hashed and counted whole; an empty table gives no rows; other columns are ignored, whatever their
    names. A conversation, a turn or a node with most of all rows is spread over tasks at each step.
    """
    turns = cut(numbered_turns(df, conv, turn, role, text))
    convs = cut(rebuilt(turns))
    key = ["depth", *lanes("s")]
    grouped = paths(turns, convs).groupBy(*key).agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), *[F.max(f"p{i}").alias(f"p{i}") for i in LANES])
    none = [F.lit(0).cast("long").alias(c) for c in (*key, "words", *lanes("p"))]
    root = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select("conv_id", "n_convs", *none)
    nodes = grouped.unionByName(root).join(end_digests(convs), key, "left")
    family = with_siblings(with_family(cut(nodes.withColumn("node", F.monotonically_increasing_id()))))
    ahead = rank(tour(family), ["leaves", "saved"], rows_per_part)

    def between(weight: str) -> Column:
        return F.sum(F.when(F.col("id") % 2 == 1, F.col(weight)).otherwise(-F.col(weight))).alias(weight)

    sums = ahead.groupBy(F.floor(F.col("id") / 2).alias("node")).agg(between("leaves"), between("saved"))
    nobody = hashlib.sha256(b"").hexdigest()
    return family.join(sums, "node").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce(F.lower(F.hex("ends")), F.lit(nobody)).alias("ends_sha256"))
