"""The contract queries of this subpackage and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import ann, chat, lm, media, mixing, packing, quality, simhash, substrings, toxicity
from corpusloom.plans.runtime import read, ship, spread


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.clean_vectors(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return ann.nearest(vectors.where("id % 20 = 0"), vectors, k=20)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(_documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(_documents(spark, sf_dir))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(_documents(spark, sf_dir), read(spark, sf_dir, "labels"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(_documents(spark, sf_dir), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    formatted = chat.format_chats(chat.conversation_events(table.unionByName(extra)))
    turns = chat.parse(F.col("formatted"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = formatted.select("conv_id", "formatted", turns.alias("turns"), chat.masked_text(F.col("formatted"), F.col("mask")).alias("loss"))
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.to_media(_documents(spark, sf_dir)).drop("n_bytes")
    facts = stored.withColumns({"media_bytes": F.length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    back = media.read_media(facts)
    tail = F.substring("payload", -64, 64)
    return back.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        "media_bytes", "media_sha256", "feature",
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify_toxicity(_documents(spark, sf_dir), read(spark, sf_dir, "labels"))


_ALL = (op1_nearest_neighbours, op2_substring_dedup, op3_lm_scoring, op4_simhash_near_dedup, op5_quality_classifier, op6_best_fit_packing, op7_source_mixing, op8_chat_formatting, op9_media_columns, op10_toxicity)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: (lambda spark, sf_dir, f=f: f(ship(spark), sf_dir)) for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": _OP2, "op8_chat_formatting": _OP8}


_OP2 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50
), k AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i+49], ' ')) AS h FROM p
), m AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS d0 FROM k
), r AS (
  SELECT DISTINCT doc_id, i FROM m WHERE d0 < doc_id
), t AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM d
), c AS (
  SELECT t.doc_id, j, word, coalesce(max(i) OVER (PARTITION BY t.doc_id ORDER BY j), -100) >= j - 49 AS gone
  FROM t LEFT JOIN r ON r.doc_id = t.doc_id AND r.i = t.j
), o AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY j) FILTER (NOT gone), '') AS kept
  FROM c GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN o USING (doc_id)
"""

_OP8 = r"""
WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), told AS (
  SELECT conv_id, turn, role, text,
         length(replace(replace(replace(text, '\', '\\'), '###', '\#\#\#'), '</turn>', '<\/turn>')) AS escaped
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(4 + length(role) + 2 + escaped + 8)::BIGINT AS formatted_chars
FROM told GROUP BY conv_id
"""
