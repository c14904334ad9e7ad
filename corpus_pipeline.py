"""Corpus preparation as a chain of stages over ``documents``: toxicity, near-duplicates, decontamination, PII, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written to the shared folder as Parquet and read
again as the next stage's ``docs``. All stages but the last return the columns of ``documents``. Filtering stages keep whole rows as
they are; null and empty texts are neither toxic nor contaminated and stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.llm import decontaminate, neardup, packing, pii, toxicity
from talkframe.llm.common import settle, table, whole_row
from talkframe.llm.queries import PII_KEY

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.select("text", whole_row(docs).alias("_row"))
    return toxicity.score(rows, model).filter("toxicity < 0.5").select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the row with the group's smallest doc_id. Documents without words stay."""
    verdict = settle(neardup.near_duplicates(docs).select("doc_id", "text_key", "keep"), "verdicts")
    same = verdict.groupBy("doc_id", "text_key").agg(F.max("keep").alias("keep"), F.count("*").alias("rows"))
    keyed = docs.select(whole_row(docs).alias("_row"), F.col("doc_id").alias("_id"), F.md5("text").alias("_key"))
    match = keyed["_id"].eqNullSafe(same["doc_id"]) & keyed["_key"].eqNullSafe(same["text_key"])
    kept = keyed.join(same.filter("keep"), match, "left_semi")
    if not same.filter("keep and rows > 1").isEmpty():  # rows equal in id and text are one document
        kept = kept.dropDuplicates(["_id", "_key"])
    return kept.select("_row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages by the contamination rule go."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), carry=True)
    return found.filter(~F.col("contaminated")).select("_row.*")


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes keyed surrogates; ``n_chars`` follows the new text."""
    rows = docs.select("text", whole_row(docs).alias("_row"))
    out = pii.anonymise(rows, PII_KEY)
    changed = F.size("_entities") > 0
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(changed, F.length("text").cast(kind)).otherwise(F.col("_row.n_chars"))
    return out.select(*[new.get(c, F.col(f"_row.`{c.replace('`', '``')}`")).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs


#: Learned scores, surrogates and token ids have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None
