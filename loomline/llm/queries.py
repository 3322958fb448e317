"""One query for each operator of this package, over whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, conversation_trie, decontaminate, langid, licenses, mixing, pii, sentencepieces, simhash, vector_codes, winnow
from .common import cut, table
from .sharding import hypergeometric_shards
from .token_counts import narrow_token_counts


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """A public vocabulary file; its place is a parameter of the operator."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narrow_token_counts(table(spark, sf_dir, "documents"), vocabulary()).withColumn("over_limit", F.col("n_tokens") > 1024)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = hypergeometric_shards(sized, 24, ["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edit_report(table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast(turns.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(turns.schema["turn"].dataType).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.chat_digests(turns.unionByName(more))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.BASE), F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = cut(table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")))
    out = mixing.mix(sized, F.array("source"), F.col("size"))
    return out.select("doc_id", "size", F.col("source_size")[0].alias("source_size"), F.col("target")[0].alias("target"), "taken")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.learn(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.transform("notices", lambda x: F.concat_ws(":", x["label"], x["start"], x["end"], x["edits"]))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.array_join(spans, ",").alias("spans"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.round_trip(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_counts, op2_sharding, op3_fingerprints, op4_chat_formatting, op5_personal_data, op6_simhash, op7_mixing, op8_language_id, op9_license_scan, op10_decontamination, op11_prefix_trie, op12_vector_codes, op13_sentencepiece)
}

#: Containment of an item's word 5-grams, for items of five words and more, by brute force.
OP10 = r"""
WITH cleaned AS (
  SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark
  WHERE item_id IS NOT NULL AND regexp_matches(text, '[\p{L}\p{N}]')),
items AS (
  SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS s
  FROM (SELECT *, least(len(w), 5) AS n FROM cleaned)),
sizes AS (SELECT item_id, count(*) AS n_shingles FROM items GROUP BY item_id),
words AS (
  SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents
  WHERE doc_id IS NOT NULL AND text IS NOT NULL),
held AS (
  SELECT DISTINCT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS s
  FROM words, (SELECT DISTINCT n FROM items)),
pairs AS (SELECT doc_id, item_id, count(*) AS n_found FROM held JOIN items USING (n, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(n_shingles AS BIGINT) AS n_shingles, CAST(n_found AS BIGINT) AS n_found, round(n_found / n_shingles, 6) AS containment
FROM pairs JOIN sizes USING (item_id) WHERE n_found / n_shingles >= 0.8
"""

#: Turns, and the characters that escaping adds to them: one for each backslash and control string.
OP4 = r"""
WITH turns AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(COALESCE(SUM(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(COALESCE(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(SUM(17 + length(role) + length(text) + len(regexp_extract_all(role || ' ' || text, '\\|\[/?INST\]|</s>'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


#: Nodes as lists of turns; what a subtree holds is summed by every node's ancestors.
OP11 = r"""
WITH ordered AS (
  SELECT conv_id, COALESCE(role, '') AS role, COALESCE(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, COALESCE(role, ''), COALESCE(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS turns FROM ordered GROUP BY conv_id),
bits AS (SELECT conv_id, list(b ORDER BY i) AS code FROM (SELECT conv_id, i, ord(substr(CAST(conv_id AS VARCHAR), i, 1)) AS b FROM (SELECT conv_id, unnest(range(1, length(CAST(conv_id AS VARCHAR)) + 1)) AS i FROM own)) GROUP BY conv_id),
hashed AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, code), lambda crc, b:
    list_reduce([xor(crc, b), 1, 2, 3, 4, 5, 6, 7, 8], lambda c, i: xor(c >> 1, (c & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT conv_id, list_transform(code, lambda x: CAST(x AS BIGINT)) AS code FROM bits)),
rebuilt AS (
  SELECT o.conv_id, list_concat(COALESCE(b.turns[1:h], []), o.turns[h + 1:]) AS turns
  FROM own AS o JOIN hashed USING (conv_id) LEFT JOIN own AS b ON b.conv_id = o.conv_id - o.conv_id % 20),
members AS (SELECT conv_id, d AS depth, turns[1:d] AS path, d = len(turns) AS ends FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(COALESCE(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256,
    CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(path[depth].text, '[^\x20\x09-\x0D]+')) END AS words
  FROM members GROUP BY path, depth),
born AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
sized AS (SELECT n.*, COALESCE(n_children, 0) AS n_children FROM nodes AS n LEFT JOIN born AS b ON b.path = n.path),
above AS (SELECT path[1:d] AS path, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * words) AS BIGINT) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM sized) GROUP BY ALL)
SELECT s.conv_id, s.depth, p.conv_id AS parent_conv_id, s.n_convs, s.n_children, a.n_leaves, a.saved_tokens, s.ends_sha256
FROM sized AS s JOIN above AS a ON a.path = s.path LEFT JOIN nodes AS p ON s.depth > 0 AND p.path = s.path[1:s.depth - 1]
"""


def op12_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Codebooks by plain arithmetic: every part against every entry, component by component."""

    def assigned(i: int) -> str:
        return f"""
a{i} AS (
  SELECT part, vec_id, arg_min(entry, (d, entry)) AS entry, min(d) AS d
  FROM (SELECT x.part, x.vec_id, b.entry, sum((x.v - b.v) * (x.v - b.v)) AS d FROM pieces AS x JOIN b{i} AS b ON b.part = x.part AND b.pos = x.pos GROUP BY x.part, x.vec_id, b.entry)
  GROUP BY part, vec_id),"""

    moved = "".join(
        f"""{assigned(i)}
m{i} AS (SELECT x.part, a.entry, x.pos, CAST(floor(sum(x.v) / count(*)) AS BIGINT) AS v FROM pieces AS x JOIN a{i} AS a ON a.part = x.part AND a.vec_id = x.vec_id GROUP BY x.part, a.entry, x.pos),
b{i + 1} AS (SELECT b.part, b.entry, b.pos, COALESCE(m.v, b.v) AS v FROM b{i} AS b LEFT JOIN m{i} AS m ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos),"""
        for i in range(rounds)
    )
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, len(embedding) // {parts} AS width
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS (SELECT vec_id, (i - 1) // width AS part, (i - 1) % width AS pos, v[i] AS v FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM kept)),
b0 AS (SELECT part, row_number() OVER (PARTITION BY part, pos ORDER BY vec_id) - 1 AS entry, pos, v FROM pieces WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries})),{moved}{assigned(rounds)}
whole AS (SELECT vec_id, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b{rounds}) AS codebooks_sha256
FROM whole JOIN kept USING (vec_id)
"""


ORACLES: dict[str, str] = {"op4_chat_formatting": OP4, "op10_decontamination": OP10, "op11_prefix_trie": OP11, "op12_vector_codes": op12_sql()}
