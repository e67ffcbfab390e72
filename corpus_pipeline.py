"""Corpus pipeline over ``documents``: language ID, near copies, repeated passages, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns of
``documents``.  ``run`` writes every stage's result as Parquet in the cluster's shared folder and reads it back, so that a
lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import bpe_codec, entropy_mix, mixture_langid, rlz_dedup, signature_tree
from tallyspark.llm.common import delete_folders, ranked, recording, unused, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: ``lang`` becomes the predicted one, that of the largest share.

    Null and empty texts and texts without letters have none and go; mixed texts stay.  Repeated rows and null ids stay;
    without labelled documents there is no language and nothing is kept; an empty table stays empty."""
    model = mixture_langid.fit(docs.where(~mixture_langid.held_out(F.col("doc_id"))))
    names = unused(docs.columns, "lang_pred", "score", "languages", "proportions")
    found = mixture_langid.identify(docs, model, keep=docs.columns, names=tuple(names))
    return found.where(F.col(names[0]) != "und").withColumn("lang", F.col(names[0])).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies.

    Rows that share a doc_id are documents like others: the first by a hash of its columns goes by the id, the others by numbers
    behind all ids.  So rows go only where they link, and of linked ones a row that goes by its id stays before others.
    Rows without a doc_id stay; null and empty texts are no copies of each other; an empty table stays empty."""
    key, node, rank = unused(docs.columns, "_key", "_node", "_rank")
    again = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias(key)).agg(F.count(F.lit(1)).alias(rank)).where(F.col(rank) > 1).select(key)
    again = written(again)
    twice = docs.join(again, F.col("doc_id") == F.col(key), "left_semi")
    behind = (docs.agg(F.max("doc_id")).first()[0] or 0) + 1
    numbered = ranked(twice, ["doc_id"], [c for c in docs.columns if c != "doc_id"], rank)
    numbered = written(numbered.withColumn(node, F.when(F.col(rank) == 0, F.col("doc_id")).otherwise(F.lit(behind) + F.monotonically_increasing_id())))
    rows = docs.join(again, F.col("doc_id") == F.col(key), "left_anti").withColumn(node, F.col("doc_id")).unionByName(numbered.drop(rank))
    gone = signature_tree.near_copies(rows.select(F.col(node).alias("doc_id"), "text")).where("doc_id is not null and component_id <> doc_id").select(F.col("doc_id").alias(key))
    return rows.join(gone, F.col(node) == F.col(key), "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 35 words or more that occur elsewhere; a text without any keeps its white space, and one
    of which nothing is left goes.  Null and empty texts stay, repeated rows are passages of each other."""
    key, kept, digest = unused(docs.columns, "_id", "_kept", "_sha")
    done = rlz_dedup.dedup_substrings(docs).where("n_removed > 0").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(digest), F.col("kept").alias(kept)).dropDuplicates([key, digest])
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.sha2("text", 256) == F.col(digest))
    out = docs.join(done, same, "left").withColumn("text", F.coalesce(kept, "text"))
    return out.where(F.col(kept).isNull() | (F.col(kept) != "")).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix to the sources' target weights takes it (0 to 2 times).  Null and empty texts take
    no words and may stay or go; null is a source; rows that repeat are copies of one row."""
    return entropy_mix.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the token ids of every text (none of a null or empty one), their number and digest, and whether
    the text that they decode to is the input, by its digest.  Rows that repeat stay; other columns are left out."""
    import public_tokenizers

    rows = docs.select("doc_id", "lang", "source", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("_given"))
    out = bpe_codec.round_trip(rows, public_tokenizers.path("byte_bpe_50k.json"), ids="ids")
    return out.withColumn("exact", F.col("decoded_sha256") == F.col("_given")).drop("_given")


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_copies),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", tokens),
]

#: Most stages are no SQL; the pipeline is tested against brute force on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``.  Once a stage's result is written, the tables that it was made from are deleted; the last
    one stays, as the returned rows are read from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with recording() as paths:
        for _, stage in STAGES[:-1]:
            docs = written(stage(spark, docs, sf_dir))
            delete_folders(spark, paths[:-1])
            del paths[:-1]
    return STAGES[-1][1](spark, docs, sf_dir)
