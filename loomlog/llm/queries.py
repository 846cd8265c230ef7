"""The registered queries of the operators, and their SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm import _common as c
from loomlog.llm import bpe, chroma, decontaminate, jaccard_join, katz, quality, substring_dedup, token_files, url_filter, warc
from loomlog.llm.oracle import ORACLE


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = c.scratch(spark, "tokens")
    manifest = token_files.write(c.table(spark, sf_dir, "documents"), path, public_tokenizers.path(token_files.VOCABULARY))
    return token_files.read(manifest, path, keep_ids=False)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(c.table(spark, sf_dir, "documents"), public_tokenizers.path(bpe.VOCABULARY), keep_ids=False)


#: A document is kept when label 1 has at least this share of its neighbours' votes.
ACCEPT = 0.3


def quality_space(spark: SparkSession, sf_dir: str) -> quality.Space:
    """Learned from the labelled documents that are not held out."""
    labels = c.table(spark, sf_dir, "labels").where(c.remainder("doc_id", 5) != 0)
    return quality.fit(c.table(spark, sf_dir, "documents"), labels)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(c.table(spark, sf_dir, "documents"), quality_space(spark, sf_dir))
    held = F.coalesce(c.remainder("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "benchmark"), keep_spans=False)
    return found.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(c.table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = c.scratch(spark, "warc")
    manifest = warc.write(c.table(spark, sf_dir, "pages"), path)
    return warc.read(spark, manifest, path, keep_payload=False).drop("url")


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(c.table(spark, sf_dir, "documents"), c.remainder("doc_id", 5) == 1)


def op8_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings are the rows of embeddings; queries those whose id is divisible by 20. Every match, in two kinds of rows.

    link: the class `id`, which holds a query, matches the class `class_id` (itself too), and how they align.
    member: the recording `id` is of the class `class_id`; a row for each recording, with a null class where a null or short vector cannot match.
    A query's matches are the members of the classes that its class is linked to, itself included; its member row has their number, n_matches (0 without a class).
    """
    prints = c.stored(chroma.fingerprint_vectors(c.table(spark, sf_dir, "embeddings")), c.scratch(spark, "chroma"))
    found = c.stored(chroma.align(prints, F.col("id") % 20 == 0), c.scratch(spark, "chroma"))
    links = found.select(F.lit("link").alias("kind"), F.col("query_class").alias("id"), F.col("match_class").alias("class_id"), "offset", "votes", "overlap", "bit_errors")
    members = chroma.members(prints)
    sizes = members.where("class IS NOT NULL").groupBy(F.col("class").alias("match_class")).agg(F.count(F.lit(1)).alias("copies"))
    counts = found.join(sizes, "match_class").groupBy(F.col("query_class").alias("class")).agg(F.sum("copies").alias("n_matches"))
    n_matches = F.when(F.col("id") % 20 == 0, F.coalesce("n_matches", F.lit(0)))
    members = members.join(counts, "class", "left").select(F.lit("member").alias("kind"), "id", F.col("class").alias("class_id"), n_matches.alias("n_matches"))
    return links.unionByName(members, allowMissingColumns=True)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(c.table(spark, sf_dir, "documents")).drop("kept")


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled page outcomes: a label's document id is the page's id; good is quality 1 without toxicity."""
    labels = c.table(spark, sf_dir, "labels").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int").alias("good"))
    return url_filter.split(c.table(spark, sf_dir, "pages").select("page_id", "url")).join(labels, "page_id").select("host", "good")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(c.table(spark, sf_dir, "pages"), page_outcomes(spark, sf_dir)).drop("reputation", "upper")


QUERIES = {f.__name__: f for f in (op1_token_files, op2_bpe, op3_quality, op4_decontaminate, op5_jaccard_join, op6_warc, op7_katz, op8_chroma, op9_substring_dedup, op10_url_filter)}
__all__ = ["ORACLE", "QUERIES"]
