"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A test item leaks into a document if at least `threshold` of the item's word shingles occur in it. MinHash signatures
of long documents say nothing about short items, so only the items are sketched: items are partitioned by size, and an
item's sketch is its m least shingle hashes under one seeded hash order, where m is one more than the number of
shingles that an item of the partition's largest size may miss. A document with enough of the item holds at least one
of them (pigeonhole), so looking the documents' shingle hashes up in the sketches loses nothing. Candidates are
verified by counting the item's shingles, as words, in the document.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import aside, cut, small

SHINGLE, THRESHOLD = 5, 0.8
WORD_BREAK = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; an empty array for a null text or one without any."""
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK, " "))
    return F.filter(F.split(clean, " "), lambda w: w != "")


def shingles(words: Column, n: int | Column) -> Column:
    """All runs of n words, joined by spaces; an empty array if there are fewer, and so for an empty text; null for null words. Repeats are kept."""
    n = F.lit(n) if isinstance(n, int) else n
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def item_shingles(items: DataFrame, item_key: str, text: str, shingle: int, threshold: float, seed: int) -> DataFrame:
    """The items' distinct shingles: item, n (words in a shingle), size (of the item's set), s, h, sketched.

    An item of fewer words than a shingle is one shingle of all its words; one without words cannot leak.
    """
    cleaned = items.select(F.col(item_key).alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    cleaned = cleaned.withColumn("n", F.least(F.size("w"), F.lit(shingle)))
    sets = cleaned.select("item", "n", F.explode(shingles(F.col("w"), F.col("n"))).alias("s")).distinct()
    per_item = Window.partitionBy("item", "n")
    sized = sets.withColumn("size", F.count("*").over(per_item)).withColumn("h", F.xxhash64(F.lit(seed), "s"))
    # a partition's sizes reach from one power of two to below the next
    top = F.pow(F.lit(2), F.floor(F.log2("size")) + 1) - 1
    missable = top - F.ceil(F.lit(threshold) * top - 1e-9)
    return sized.withColumn("sketched", F.row_number().over(per_item.orderBy("h", "s")) <= missable + 1)


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, seed: int = 7) -> DataFrame:
    """Pairs of a document and an item that leaks into it: `key`, `item_key`, n_shingles and n_found (long), containment.

    n_found counts those of the item's distinct shingles that the document holds; both texts are lower-cased and all but
    letters and digits separates words. Null and empty texts have no shingles. Rows that share a key are one document
    and items that share a key one item (of the shingles of both). Rows with a null key are left out: a pair could not
    name them. Other columns are ignored. Whole documents are searched, words and texts of any length; of hashes that tie
    in a sketch's order the first by its words counts. Documents are split once for all lengths of items. Hashes of
    sketches and the keys of candidate documents are broadcast if they are measured to be small, else shuffled; words
    of shingles are never broadcast by request. Without documents or without items there are no rows.
    """
    parts = cut(item_shingles(items.where(F.col(item_key).isNotNull()), item_key, item_text, shingle, threshold, seed))
    lengths = sorted(r[0] for r in parts.select("n").distinct().collect())  # at most `shingle` different ones
    own = docs.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("_key"), words(F.col(f"`{text}`")).alias("w"))
    if not lengths:
        return own.select(F.col("_key").alias(key)).limit(0).crossJoin(parts.limit(0).select(F.col("item").alias(item_key), F.col("size").alias("n_shingles"), F.col("size").alias("n_found"), F.lit(0.0).alias("containment")))
    sketch = small(cut(parts.where("sketched").select("h", "item").distinct()))
    every = F.flatten(F.array(*[shingles(F.col("w"), n) for n in lengths]))
    # outer, so that no filter on the array is derived, which would compute it twice
    hashes = own.select("_key", F.explode_outer(F.transform(every, lambda s: F.xxhash64(F.lit(seed), s))).alias("h"))
    candidates = cut(hashes.join(sketch, "h").select("_key", "item").distinct())
    again = own.join(small(cut(candidates.select("_key").distinct())), "_key", "left_semi")
    spelled = again.select("_key", F.explode_outer(every).alias("s")).withColumn("h", F.xxhash64(F.lit(seed), "s"))
    # hashes are broadcast, if they are few, and find the shingles worth comparing; the words themselves are joined
    held = spelled.join(small(cut(parts.select("h").distinct())), "h", "left_semi").distinct()
    pairs = held.join(parts.select("item", "size", "n", "h", "s"), ["h", "s"]).join(small(candidates), ["_key", "item"], "left_semi")
    counted = pairs.select("_key", "item", "n", "size", "s").distinct().groupBy("_key", "item", "n", "size").agg(F.count("*").alias("n_found"))
    merged = counted.groupBy("_key", "item").agg(F.sum("size").alias("n_shingles"), F.sum("n_found").alias("n_found"))
    share = F.col("n_found") / F.col("n_shingles")
    return merged.where(share >= threshold).select(F.col("_key").alias(key), F.col("item").alias(item_key), "n_shingles", "n_found", F.round(share, 6).alias("containment"))


def without_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **settings: object) -> DataFrame:
    """`docs` without the documents into which an item leaks; all columns are kept, whatever their names.

    Rows that share a key are one document, as in `leaks`. A row with a null key is a document of its own, known by its text.
    """
    found = cut(leaks(docs, items, key, text, **settings).select(F.col(key).alias("_leaks")).distinct())
    own, back = aside(docs, ("_leaks", "_text"))
    k, t = back[docs.columns.index(key)], back[docs.columns.index(text)]
    kept = own.withColumn("_leaks", k).join(small(found), "_leaks", "left_anti").select(*back)
    unnamed = docs.where(F.col(f"`{key}`").isNull())
    if unnamed.isEmpty():
        return kept
    name = F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)
    lost = cut(leaks(unnamed.select(name.alias(key), f"`{text}`"), items, key, text, **settings).select(F.col(key).alias("_text")).distinct())
    apart = own.withColumn("_text", F.when(k.isNull(), F.sha2(F.coalesce(t, F.lit("")), 256))).join(small(lost), "_text", "left_anti")
    return apart.withColumn("_leaks", k).join(small(found), "_leaks", "left_anti").select(*back)
