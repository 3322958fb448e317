"""SimHash near-duplicates by multi-index hashing.

A fingerprint's 64 bits are cut into m segments. If two fingerprints differ in at most r bits, then in at most
floor(r / m) bits in one of their segments (pigeonhole). So every distinct fingerprint is entered in m tables, each keyed
by one segment, the Hamming ball of that radius is enumerated within each segment of each fingerprint, the table matches
are fetched, and their complete distances are verified.

A table's cell can hold any number of fingerprints that are alike in one segment only. Cells with more than `most` are
not paired: their entries go on to tables keyed by the segment and one of the rest, again by pigeonhole over what is
left of the r bits, and so on until the whole fingerprint is the key, where a cell holds one. So no pair is lost and no
cell gives all its pairs, however many fingerprints share a segment.

Links can be verified on the texts too (`similar_groups`): then a wide radius finds candidates, and two texts are linked if
their sets of word shingles are alike enough. Pairs are listed only between texts that are in different groups by then
and whose shingles, by what is known of each text alone, could be alike enough.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import aside, cut, extended, small

BITS, SEED, MINS = 64, 42, 16


def shingle_hashes(text: str, words: int, seed: int = SEED) -> list[int]:
    """The XXH64 of each run of so many words, repeats included; of the whole sequence if it is shorter; none without words."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(parts) < words:
        return [digest(join(parts), seed)] if parts else []
    return [digest(join(x), seed) for x in zip(*(parts[i:] for i in range(words)))]


def fingerprint(text: str, words: int = 3, seed: int = SEED, distinct: bool = False) -> int:
    """64-bit SimHash of the word shingles (each once if `distinct`); a bit is set if it is in over half of their hashes. No word: 0."""
    hashes = shingle_hashes(text, words, seed)
    if distinct:
        hashes = list(set(hashes))
    if not hashes:
        return 0
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(np.array(hashes[i : i + (1 << 16)], np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text: str = "text", into: str = "fingerprint", words: int = 3, seed: int = SEED, distinct: bool = False) -> DataFrame:
    """Replace the column `text` by `into` (long, the 64 bits as a signed number). A null text counts as empty: 0. No shuffle."""
    kept = [c for c in df.columns if c not in (text, into)]
    df = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py() or "", words, seed, distinct) for t in batch.column(len(kept))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(found)], [*kept, into])

    return df.mapInArrow(run, extended(df.select(*[F.col(f"`{c}`") for c in kept]).schema, f"{into} long"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def split(mask: int, segments: int) -> list[list[int]]:
    """The bits that are not in `mask`, cut into segments as equal as can be."""
    free = [1 << b for b in range(BITS) if not mask >> b & 1]
    ends = [len(free) * i // segments for i in range(segments + 1)]
    return [free[x:y] for x, y in zip(ends, ends[1:]) if x < y]


def ball(bits: list[int], radius: int) -> list[int]:
    """All masks of at most `radius` of the given bits."""
    return [sum(c) for n in range(min(radius, len(bits)) + 1) for c in combinations(bits, n)]


def _enter(df: DataFrame, masks: list[int], segments: int, radius: int | None) -> DataFrame:
    """Entries of the tables keyed by each mask and one more segment; with a radius, one for each value of the ball there.

    `mask` holds the bits that are key so far, `cell` their values. What is left of the radius follows from both. All
    other columns are kept. One pass over `df`, in as many tasks as it has parts, however many tables there are.
    """
    own, found = [c for c in df.columns if c not in ("mask", "cell")], None
    for mask in masks:
        parts, here = split(mask, segments), F.col("mask") == F.lit(signed(mask))
        left = radius - distance(F.col("fingerprint").bitwiseAND(F.col("mask")), F.col("cell")) if mask and radius is not None else F.lit(radius or 0)
        for r in range((radius or 0) // len(parts) + 1) if mask else [(radius or 0) // len(parts)]:
            keys = ", ".join(f"named_struct('at', {signed(sum(bits))}L, 'f', {signed(m)}L)" for bits in parts for m in ball(bits, r))
            case, table = here & (F.floor(left / len(parts)) == r), F.expr(f"array({keys})")
            found = F.when(case, table) if found is None else found.when(case, table)
    met = df.select(*own, "mask", "cell", F.explode(found).alias("_x"))
    cell = F.col("cell").bitwiseOR(F.col("fingerprint").bitwiseAND(F.col("_x.at")).bitwiseXOR(F.col("_x.f")))
    return met.select(*own, F.col("mask").bitwiseOR(F.col("_x.at")).alias("mask"), cell.alias("cell"))


def _met(rows: DataFrame, radius: int, segments: int, most: int, which: Column, out: list[Column], how: str = "inner", once: bool = False) -> DataFrame:
    """`out` of the rows `p` and `t` whose fingerprints differ in at most `radius` bits and for which `which` holds; repeats are possible.

    Cells of at most `most` entries are paired with the probes that reach them; larger ones are keyed by more bits, until
    the whole fingerprint is the key. All conditions are part of the join, so only what meets them leaves it. Only masks
    of large cells come to the driver. With `once`, a pair that is near in several segments is taken in the first of them.
    """
    held = rows.withColumns({"mask": F.lit(0).cast("long"), "cell": F.lit(0).cast("long")})
    probes, masks, found = held, [0], []
    near = which & (distance(F.col("p.fingerprint"), F.col("t.fingerprint")) <= radius)
    parts, first, apart = split(0, segments), F.lit(False), F.lit(True)
    for bits in parts:
        at = F.lit(signed(sum(bits)))
        first = first | ((F.col("p.mask") == at) & apart)
        apart = apart & (F.bit_count(F.col("p.fingerprint").bitwiseXOR(F.col("t.fingerprint")).bitwiseAND(at)) > radius // len(parts))
    while masks:
        held, probes = _enter(held, masks, segments, None), _enter(probes, masks, segments, radius)
        if len(found):  # cells that are reached in more than one way
            held, probes = cut(held.distinct()), cut(probes.distinct())
        large = cut(held.groupBy("mask", "cell").agg(F.count("*").alias("n")).where((F.col("n") > most) & (F.col("mask") != -1)).select("mask", "cell"))
        masks = [r[0] & ((1 << BITS) - 1) for r in large.select("mask").distinct().collect()]
        few, next_held, next_probes = held, None, None
        if masks:
            few = held.join(small(large), ["mask", "cell"], "left_anti")
            next_held, next_probes = (cut(x.join(small(large), ["mask", "cell"], "left_semi")) for x in (held, probes))
        here = near & first if once and not found else near
        found.append(probes.alias("p").join(few.alias("t"), (F.col("p.mask") == F.col("t.mask")) & (F.col("p.cell") == F.col("t.cell")) & here, how).select(*out))
        held, probes = next_held, next_probes
    pairs = found[0]
    for x in found[1:]:
        pairs = pairs.unionByName(x)
    return pairs


def links(distinct: DataFrame, radius: int = 2, segments: int = 2, most: int = 1024) -> DataFrame:
    """All pairs (a, b), a > b, of the distinct values in `fingerprint` that differ in at most `radius` bits, each once."""
    above = F.col("p.fingerprint") > F.col("t.fingerprint")
    return _met(distinct.select("fingerprint"), radius, segments, most, above, [F.col("p.fingerprint").alias("a"), F.col("t.fingerprint").alias("b")]).distinct()


def touched(distinct: DataFrame, radius: int = 2, segments: int = 2, most: int = 1024) -> DataFrame:
    """The distinct values in `fingerprint` that differ from another in at most `radius` bits; no pairs are listed."""
    other = F.col("p.fingerprint") != F.col("t.fingerprint")
    return _met(distinct.select("fingerprint"), radius, segments, most, other, [F.col("p.fingerprint").alias("fingerprint")], "left_semi").distinct()


def _stars(edges: DataFrame) -> DataFrame:
    """Links (a, b), a > b, with the same connected components: each node but the least of its component with the least.

    Alternates large-star and small-star steps, which keep the number of links bounded by their first number, until
    every node hangs on a root of its own (tested on all links). Each round is written to the checkpoint folder; a
    node's least neighbour is found by an aggregate, never by gathering its neighbours. Only a count comes to the driver.
    """
    while True:
        edges = cut(edges)
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count_if(F.col("b") < F.col("a")).alias("down"), F.count("*").alias("n"))
        if not least.agg(F.count_if(F.expr("down > 1 or (down = 1 and n > 1)"))).first()[0]:
            return edges
        large = both.join(least.select("a", "m"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = star.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links (a, b), a > b: one row (node, root) for each node in a link; root is the least node."""
    stars = _stars(edges)
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _roots(printed: DataFrame, radius: int, segments: int) -> DataFrame:
    """fingerprint and root (the least fingerprint reachable) of all distinct fingerprints."""
    distinct = cut(printed.select("fingerprint").distinct())
    roots = _stars(links(distinct, radius, segments))
    return cut(distinct.join(roots, F.col("fingerprint") == F.col("a"), "left").select("fingerprint", F.coalesce("b", "fingerprint").alias("root")))


def _mins(held: np.ndarray) -> np.ndarray:
    """The least of the hashes under each of MINS mixing functions; zeros if there is none."""
    if not len(held):
        return np.zeros(MINS, np.int64)
    mixed = [held * np.uint64(xxhash.xxh64_intdigest(str(k), SEED) | 1) for k in range(MINS)]
    return np.array([((x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)).min() for x in mixed], np.uint64).view(np.int64)


def _shingled(texts: DataFrame, words: int) -> DataFrame:
    """(node, text) to (node, shingles, mins): the sorted distinct hashes of the text's word shingles, and their MinHashes. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in enumerate(batch.column("text")):  # a text at a time: sets may be long
                held = np.unique(np.array(shingle_hashes(t.as_py() or "", words), np.uint64))
                lists = [pa.array([x], pa.list_(pa.int64())) for x in (held.view(np.int64), _mins(held))]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(i, 1), *lists], ["node", "shingles", "mins"])

    return texts.select("node", "text").mapInArrow(run, "node binary, shingles array<long>, mins array<long>")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: Fraction) -> DataFrame:
    """Of `pairs` those whose nodes a and b have sets of at least this Jaccard similarity, in whole numbers; two empty sets are alike."""
    up, down = similarity.numerator, similarity.denominator
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_y"))
    met = F.size(F.array_intersect("_x", "_y")) * (down + up) >= (F.size("_x") + F.size("_y")) * up
    return pairs.join(x, "a").join(y, "b").where(met).select(*pairs.columns)


def _merged(named: DataFrame, pairs: DataFrame) -> DataFrame:
    """`named` (node, fingerprint, root) once the groups whose roots `pairs` links (x, y) are one; root is the least node again.

    Only roots are linked, so what was joined before costs nothing anew.
    """
    stars = _stars(pairs.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    return cut(named.join(stars.select(F.col("a").alias("root"), F.col("b").alias("_r")), "root", "left").select("node", "fingerprint", F.coalesce("_r", "root").alias("root")))


def _sized(n: str, m: str, similarity: Fraction) -> Column:
    """Whether sets of these sizes can be so alike."""
    return F.least(n, m) * similarity.denominator >= F.greatest(n, m) * similarity.numerator


def _drawn(named: DataFrame, sets: DataFrame, radius: int, similarity: Fraction, turn: int) -> DataFrame:
    """Pairs (a, b) of nodes in different groups (x, y) that may be alike: each node with a drawn one of each of its MinHash buckets.

    At most MINS pairs a node, however many share a bucket. A bucket is two MinHashes, other ones each turn.
    """
    keys = F.array(*[F.xxhash64(F.lit(k), F.col("mins")[k], F.col("mins")[(k + 2 * turn + 1) % MINS]) for k in range(MINS)])
    at = named.join(sets, "node").select("node", "root", "fingerprint", F.size("shingles").alias("n"), F.explode(keys).alias("key"))
    lead = at.groupBy("key").agg(F.min_by(F.struct(F.col("node").alias("_b"), F.col("root").alias("_y"), F.col("fingerprint").alias("_f"), F.col("n").alias("_m")), F.xxhash64(F.lit(turn), "key", "node")).alias("_l")).select("key", "_l.*")
    met = at.join(lead, "key").where((F.col("root") != F.col("_y")) & (distance(F.col("fingerprint"), F.col("_f")) <= radius) & _sized("n", "_m", similarity))
    return met.select(F.greatest("node", "_b").alias("a"), F.least("node", "_b").alias("b"), F.greatest("root", "_y").alias("x"), F.least("root", "_y").alias("y")).distinct()


def _open(named: DataFrame, sets: DataFrame, similarity: Fraction, turns: int = 2, rare: int = 64) -> DataFrame:
    """The nodes that can be alike to one of another group: node, fingerprint, root, n (shingles), s (of them held by another group too), bits.

    Two sets share at most what both share with other groups, so a node whose `s` is too small for its `n` has no link
    out of its group; without such nodes others hold less, hence the turns. `bits` marks, by their hash, shared shingles
    of at most `rare` nodes: a bit that only one of two nodes has is a shingle that they don't share.
    """
    up, down = similarity.numerator, similarity.denominator
    left = named.join(sets, "node").select("node", "fingerprint", "root", F.size("shingles").cast("long").alias("n"), "shingles")
    for _ in range(turns):
        at = left.select("node", "root", F.explode("shingles").alias("h"))
        held = at.groupBy("h").agg((F.min("root") == F.max("root")).alias("own"), F.count("*").alias("k")).where(F.col("own") | (F.col("k") <= rare)).select("h", "own")
        bit = F.expr("shiftleft(1L, cast(pmod(h, 64) as int))")
        seen = at.join(held, "h").groupBy("node").agg(F.count_if("own").alias("u"), F.bit_or(F.when(~F.col("own"), bit)).alias("_bits"))
        known = left.drop("s", "bits").join(seen, "node", "left").withColumns({"s": F.col("n") - F.coalesce("u", F.lit(0)), "bits": F.coalesce("_bits", F.lit(0).cast("long"))})
        left = cut(known.where(F.col("s") * down >= F.col("n") * up).drop("u", "_bits"))
    return left.drop("shingles")


def _between(rows: DataFrame, radius: int, segments: int, similarity: Fraction, most: int = 1024) -> DataFrame:
    """All pairs (a, b) of the nodes of `_open` with near or equal fingerprints, in different groups (x, y), that can be so alike by what is known of each."""
    up, down = similarity.numerator, similarity.denominator

    def shared(x: str, y: str) -> Column:
        return F.col(f"{x}.s") - F.bit_count(F.col(f"{x}.bits").bitwiseAND(F.bitwise_not(f"{y}.bits")))

    can = F.least(shared("p", "t"), shared("t", "p")) * (up + down) >= (F.col("p.n") + F.col("t.n")) * up
    which = (F.col("p.node") > F.col("t.node")) & (F.col("p.root") != F.col("t.root")) & _sized("p.n", "t.n", similarity) & can
    return _met(rows, radius, segments, most, which, [F.col("p.node").alias("a"), F.col("t.node").alias("b"), F.greatest("p.root", "t.root").alias("x"), F.least("p.root", "t.root").alias("y")], once=True).distinct()


def similar_groups(nodes: DataFrame, texts: Callable[[DataFrame], DataFrame], radius: int, segments: int, words: int, similarity: float, rounds: int = 3) -> DataFrame:
    """node and root (the least node reachable) of all nodes, over links between texts that are alike in fact.

    `nodes` has one row (node, fingerprint) for each different text; `texts` makes a node's text of the nodes it is given
    (node, text; repeats do no harm). Two nodes are linked if their fingerprints differ in at most `radius` bits and their
    sets of `words`-word shingles have a Jaccard similarity of at least `similarity`. The groups are those of all such links:

    Only nodes that have another within the radius are looked at. For `rounds` turns each is held against a few drawn from
    its MinHash buckets; that joins most of what is alike, for a number of pairs in proportion to the nodes. Then all
    other pairs within the radius are listed that are still in different groups and can be alike by the sizes of what they
    share with other groups (`_open`), and each is verified. So a large group of copies costs a few pairs a node, texts
    that have only a passage in common mostly none, and no link that would join two groups is left out.
    """
    least = Fraction(str(similarity))
    prints = cut(nodes.groupBy("fingerprint").agg(F.count("*").alias("_n")))
    wanted = prints.join(touched(prints, radius, segments).withColumn("_near", F.lit(True)), "fingerprint", "left").where("_n > 1 or _near")
    met = cut(nodes.select("node", "fingerprint").join(wanted, "fingerprint", "left_semi"))
    sets = cut(_shingled(texts(met.select("node")), words).dropDuplicates(["node"]))
    named = met.withColumn("root", F.col("node"))
    for turn in range(rounds):
        named = _merged(named, _alike(_drawn(named, sets, radius, least, turn), sets, least))
    named = _merged(named, _alike(_between(_open(named, sets, least), radius, segments, least), sets, least))
    return nodes.select("node").join(named.select("node", "root"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 2, segments: int = 2, words: int = 3) -> DataFrame:
    """One row per row of `df`: `key`, fingerprint (long) and component_id, the least `key` reachable over links.

    Texts without words have fingerprint 0 and are linked like any other; very long ones are hashed whole, a part at a time. Null keys are given a component but never
    name one, unless it has no other. Copies, repeated rows and ties meet in one row per fingerprint before anything is
    compared. An empty table gives no rows; columns of `df` but the two named are ignored.
    """
    printed = cut(fingerprints(df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")), "_text", words=words))
    roots = _roots(printed, radius, segments)
    firsts = printed.groupBy("fingerprint").agg(F.min("_key").alias("first"))
    named = cut(firsts.join(roots, "fingerprint"))
    labels = named.join(named.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fingerprint", "component_id")
    return printed.join(labels, "fingerprint").select(F.col("_key").alias(key), "fingerprint", "component_id")


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 2, segments: int = 2, words: int = 3, similarity: float | None = None, shingle: int = 5) -> DataFrame:
    """`df` without near-duplicates: of each component exactly one row stays, the one with the least key.

    With a `similarity`, fingerprints are of the distinct shingles of `words` words, and a link within the radius counts only if
    the two texts' sets of `shingle`-word shingles have that Jaccard similarity (see `similar_groups`).

    Keys are compared first (null last), then the XXH64 of the text; of rows equal in both the first in the order of
    all their columns' hash stays. So rows with a null or repeated key are judged by their own texts, like any other.
    An empty table gives no rows; all columns are kept, whatever their names. Rows with unique keys are not shuffled:
    the keys to drop are broadcast if they are few enough. Those with null or repeated keys are.
    """
    names = ("_key", "_hash", "_print", "_root", "_best", "_all", "_n", "fingerprint")
    own, back = aside(df, names)
    k, t = back[df.columns.index(key)], back[df.columns.index(text)]
    digest = F.xxhash64(F.coalesce(t, F.lit("")))
    node = F.unhex(F.md5(F.coalesce(t, F.lit(""))))  # a text's name among the verified links
    unit, rows = "fingerprint", own.select(k.alias("_key"), digest.alias("_hash"), *([node.alias("_node")] if similarity else []), t.alias("_text"))
    printed = cut(fingerprints(rows, "_text", words=words, distinct=similarity is not None))
    if similarity:
        nodes = cut(printed.groupBy(F.col("_node").alias("node")).agg(F.min("fingerprint").alias("fingerprint")))
        unit, roots = "_node", similar_groups(nodes, lambda wanted: own.select(node.alias("node"), t.alias("text")).join(small(wanted), "node", "left_semi"), radius, segments, shingle, similarity).withColumnRenamed("node", "_node")
    else:
        roots = _roots(printed, radius, segments)
    order = F.struct(F.col("_key").isNull().alias("_null"), "_key", "_hash")
    # by fingerprint, then by component, so that no row is dealt by its group; a row stays if its key and text are a winner's
    firsts = printed.groupBy(unit).agg(F.min(order).alias("_best"))
    best = firsts.join(roots, unit).groupBy("root").agg(F.min("_best").alias("_best"))
    winners = cut(best.select("_best._key", "_best._hash", F.col("root").alias("_root")))
    named = printed.where(F.col("_key").isNotNull()).select("_key", "_hash")
    judged = named.join(winners.select("_key", "_hash", F.lit(True).alias("_best")), ["_key", "_hash"], "left")
    # by key: unique ones are kept or dropped at once
    state = cut(judged.groupBy("_key").agg(F.count("*").alias("_n"), F.bool_and(F.coalesce("_best", F.lit(False))).alias("_best")))
    out = small(state.where("_n > 1 or not _best").select("_key"))
    kept = own.withColumn("_key", k).join(out, "_key", "left_anti")
    repeated = state.where("_n > 1").select("_key")
    special = own.withColumn("_key", k).where(F.col("_key").isNull())
    if not repeated.isEmpty():
        special = special.unionByName(own.withColumn("_key", k).join(small(repeated), "_key", "left_semi").select(*special.columns))
    kept = kept.where(F.col("_key").isNotNull())
    if not special.isEmpty():
        hashed = special.withColumns({"_hash": digest, "_all": F.xxhash64(F.lit(1), *[f"`{c}`" for c in own.columns])})
        b = winners.select(F.col("_key").alias("_print"), F.col("_hash").alias("_n"), "_root")
        met = hashed.join(b, F.col("_key").eqNullSafe(F.col("_print")) & (F.col("_hash") == F.col("_n")))
        one = met.withColumn("_best", F.row_number().over(Window.partitionBy("_root").orderBy("_all"))).where("_best = 1")
        kept = kept.select(*back).unionByName(one.select(*back))
        return kept
    return kept.select(*back)
