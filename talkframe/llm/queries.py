"""The registered queries of this package: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.llm import (
    decontaminate, interactions, manifest, neardup, oracles, overlapjoin, packing, pii, quality, secrets, sharding, substrings, toxicity, urlfilter,
)
from talkframe.llm.common import settle, table


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id = component_id)."""
    out = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of the words left."""
    out = substrings.strip_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    out = packing.pack(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


PII_KEY = "talkframe-demo-key"  # queries only; callers pass their own secret


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with surrogates, n_entities and the count of each kind."""
    out = pii.anonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    kinds = [F.expr(f"cast(size(filter(_entities, x -> x.kind = '{k}')) as bigint) as n_{k}") for k in pii.KINDS]
    return out.select("doc_id", "text", F.size("_entities").cast("long").alias("n_entities"), *kinds)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op7_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust."""
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule."""
    measured = settle(quality.measure(table(spark, sf_dir, "documents")), "measured")
    rules = quality.learn(measured, table(spark, sf_dir, "labels"), excluded=toxicity.held_out(F.col("doc_id")))
    return quality.judged(measured, rules).select("doc_id", *quality.COUNTS, "base_failed", "kept", "rule")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    out = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {i})) as bigint) as n_{k}") for i, k in enumerate(secrets.KINDS[:3])]
    return out.select("doc_id", *counts, F.sha2(secrets.listed("base"), 256).alias("base_sha256"), secrets.listed("spans").alias("spans"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (of texts changed for a fifth of the ids), verified."""
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    changed = manifest.leaf({c: F.col(c) for c in manifest.FIELDS[:-1]} | {"text": lowered})
    out = manifest.manifest(docs, carry={"tampered": F.when(hit, changed)})
    folded = manifest.fold(F.coalesce("tampered", "leaf"), F.col("path"))
    out = out.select("doc_id", "leaf", "subroot", "root", manifest.proof(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    return overlapjoin.jaccard_links(table(spark, sf_dir, "documents"))


def op13_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, filter_order, step, and what the step's filter does there."""
    return interactions.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op10_secrets, op9_quality, op8_toxicity, op6_sharding, op7_urlfilter, op3_pii, op2_packing, op1_decontaminate, op5_minhash, op4_substrings,
                                   op11_manifest, op12_jaccard, op13_interactions)}
ORACLES = {"op1_decontaminate": oracles.OP1, "op4_substrings": oracles.OP4, "op5_minhash": oracles.OP5,
           "op11_manifest": oracles.OP11, "op12_jaccard": oracles.OP12, "op13_interactions": oracles.OP13}
