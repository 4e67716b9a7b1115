"""The operators' registered queries, each over its whole table with production parameters, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

import corpus_pipeline
from parlance.llm import bpe, chat, exact_dedup, fingerprint, langid, mixing, packing, pii, prefix_trie, simhash, suffix_dedup, token_files, vector_codes
from parlance.llm.shared import table

#: Key of the registered query; a real job brings its own secret.
PSEUDONYM_KEY = b"registered query"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op1_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = bpe.encode(table(spark, sf, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN, decoded="decoded")
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op7_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_components(table(spark, sf, "documents").select("doc_id", "text"), words=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op8_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = exact_dedup.group_copies(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLES["op8_exact_dedup"] = r"""
WITH bare AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY t ORDER BY chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY chars DESC, doc_id) = 1 AS kept,
       sha256(t) AS text_sha256
FROM bare
"""


@query
def op9_language_id(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = langid.train(documents.where(~langid.held_out()))
    found = langid.identify(documents.select("doc_id", "text", langid.held_out().alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("lang_spans").cast("long").alias("n_spans"))


@query
def op10_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    found = mixing.taken_copies(table(spark, sf, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query
def op2_token_files(spark: SparkSession, sf: str) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        tokenizer = file.read()
    path = token_files.new_path(spark)
    token_files.write(table(spark, sf, "documents").select("doc_id", "text"), path, tokenizer)
    files = token_files.read(spark, path)
    found = token_files.placed(token_files.checksums(files), files.select("part", "n_tokens"))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op4_pii_pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.protect(table(spark, sf, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    return found.select("doc_id", "text", "n_values")


@query
def op3_bottom_k_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprint.against_next(table(spark, sf, "documents").select("doc_id", "text"))


@query
def op5_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op6_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    given = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "<|im_end|><|im_start|>assistant ok"
    added = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    found = chat.digests(chat.format_conversations(given.unionByName(added)))
    return found.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


# A turn of the template has 24 characters besides its role and text.
ORACLES["op6_chat_formatting"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length(role) + 24) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


@query
def op11_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    given = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie.build(*prefix_trie.rebuild(*prefix_trie.number_turns(given)))


# DuckDB has no crc32: `crc` is the checksum's table of 256 values, made from its polynomial.
ORACLES["op11_prefix_trie"] = r"""
WITH crc AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS t
  FROM (SELECT CAST(range AS BIGINT) AS b FROM range(256))
), own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), conv AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                         lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM own), crc
), lent AS (
  SELECT c.conv_id, o.n AS pos, o.role, o.text FROM conv c JOIN own o ON o.conv_id = c.base AND o.n <= c.h
), taken AS (
  SELECT c.conv_id, any_value(c.h) AS h, count(l.pos) AS k FROM conv c LEFT JOIN lent l USING (conv_id) GROUP BY c.conv_id
), turns AS (
  SELECT * FROM lent UNION ALL SELECT o.conv_id, o.n - t.h + t.k, o.role, o.text FROM own o JOIN taken t USING (conv_id) WHERE o.n > t.h
), paths AS (
  SELECT conv_id, pos AS depth, length(text) AS chars,
         sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY pos) OVER (PARTITION BY conv_id ORDER BY pos)) AS name
  FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM conv
), members AS (
  SELECT *, lag(name) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM paths
), nodes AS (
  SELECT depth, name, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY depth, name
), children AS (
  SELECT depth - 1 AS depth, parent AS name, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), counted AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (depth, name)
), totals AS (
  SELECT a.depth, a.name, count(*) FILTER (w.n_children = 0) AS n_leaves, sum((w.n_convs - 1) * w.chars) AS saved_tokens
  FROM counted w JOIN members a ON a.conv_id = w.conv_id AND a.depth <= w.depth GROUP BY a.depth, a.name
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, t.n_leaves, CAST(t.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM counted n JOIN totals t USING (depth, name) LEFT JOIN counted p ON p.depth = n.depth - 1 AND p.name = n.parent
"""


@query
def op12_exact_packing(spark: SparkSession, sf: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        tokenizer = file.read()
    found = packing.pack(table(spark, sf, "documents").select("doc_id", "text"), tokenizer)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op13_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    found, books = vector_codes.compress(table(spark, sf, "embeddings").select("vec_id", "embedding", "label"))
    return found.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def _orchard_oracle(rounds: int = vector_codes.ROUNDS, parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES) -> str:
    """All distances instead of searches: `b0` holds the first codebooks, `a1` the first assignment, and so on."""
    steps = [f"""
good AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS (
  SELECT r, vec_id, label, p, list_slice(v, p * (len(v) // {parts}) + 1, (p + 1) * (len(v) // {parts})) AS v FROM good, (SELECT range AS p FROM range({parts}))
), b0 AS (SELECT p, r - 1 AS e, v FROM cut WHERE r <= {entries})"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i + 1} AS (
  SELECT c.r, any_value(c.vec_id) AS vec_id, any_value(c.label) AS label, c.p, any_value(c.v) AS v, min({{'d': list_sum(list_transform(range(1, len(c.v) + 1), lambda k: (c.v[k] - b.v[k]) * (c.v[k] - b.v[k]))), 'e': b.e}}) AS n
  FROM cut c JOIN b{i} b ON b.p = c.p GROUP BY c.r, c.p
)""")  # fmt: skip
        if i < rounds:
            steps.append(f"""
m{i + 1} AS (
  SELECT p, e, list(m ORDER BY k) AS v FROM (
    SELECT p, n.e AS e, k, CAST(floor(sum(v[k]) / count(*)) AS BIGINT) AS m FROM a{i + 1}, (SELECT unnest(range(1, (SELECT max(len(v)) FROM cut) + 1)) AS k) GROUP BY p, n.e, k
  ) GROUP BY p, e
), b{i + 1} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN m{i + 1} m ON m.p = b.p AND m.e = b.e)""")
    return "WITH " + ",".join(steps) + f"""
, done AS (
  SELECT any_value(vec_id) AS vec_id, any_value(label) AS label, string_agg(lower(printf('%02x', CAST(n.e AS INTEGER))), '' ORDER BY p) AS code, CAST(sum(n.d) AS BIGINT) AS error
  FROM a{rounds + 1} GROUP BY r
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
FROM done
"""


ORACLES["op13_vector_codes"] = _orchard_oracle()


@query
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)
