"""The corpus pipeline: quality, near duplicates, repeated passages, benchmark passages, token ids.

Each stage is written as Parquet and reread as the next one's documents. A
stage keeps all columns of its input; null ids and repeated rows are handled
as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm import _common as c
from loomlog.llm import bpe, decontaminate, jaccard_join, quality, substring_dedup

#: A document goes when label 1 has less than this share of its neighbours' votes.
ACCEPT = 0.3


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects; it learns from the labelled documents that are not held out."""
    space = quality.fit(docs, c.table(spark, sf_dir, "labels").where(c.remainder("doc_id", 5) != 0))
    scored = quality.score(docs, space, keep=F.struct(*(F.col(f"`{x}`") for x in docs.columns)))
    return scored.where(F.col("score") >= ACCEPT).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the document with the least id, and of rows that share an id one: the least text that is not blank, if there is one. Rows with a null id stay."""
    found = jaccard_join.join(docs)
    gone = found.where("component_id < doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    kept = docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    if found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    row = F.struct(*(F.col(f"`{x}`") for x in kept.columns))
    text = F.col("text").cast("string")
    order = F.struct((~F.coalesce(text.rlike(r"\S"), F.lit(False))).alias("blank"), text.alias("text"), F.to_json(row).alias("json"))
    one = kept.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(F.min_by(row, order).alias("__row")).select("__row.*")
    return one.unionByName(kept.where("doc_id IS NULL"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out of the texts; n_chars follows. A text that repeats altogether becomes empty."""
    others = [x for x in docs.columns if x != "text"]
    cut = substring_dedup.dedup(docs, keep=F.struct(*(F.col(f"`{x}`") for x in others)))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in others else None
    return cut.select(*(F.col("kept").alias("text") if x == "text" else n_chars.alias(x) if x == "n_chars" else F.col(f"row.`{x}`") for x in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark."""
    found = decontaminate.find(docs, c.table(spark, sf_dir, "benchmark"), keep_spans=False)
    gone = found.where("contaminated").select(F.col("doc_id").alias("__gone"), F.col("text_key").alias("__key")).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__gone")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__key")), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that is left, with the digests of ids and of the text decoded from them."""
    return bpe.encode_decode(docs, public_tokenizers.path(bpe.VOCABULARY), keep_cache=False).drop("decoded")


STAGES = [
    ("quality classifier", accept_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs, folder = c.table(spark, sf_dir, "documents"), c.scratch(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        docs = c.stored(stage(spark, docs, sf_dir), f"{folder}/{number}")
    return docs


#: SQL cannot express the classifier, the components of near duplicates and the merges; the tests hold run() against a plain version.
ORACLE_SQL = None
