"""A training corpus from the documents table, in five stages.

Low-quality documents go, repeated lines go, one document of each group of near copies
stays, sources are mixed to target weights, and what is left is encoded. Every stage
works on all that its predecessor kept; its rows are written to the shared folder and
read again, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from burnish.llm.line_dedup import drop_repeated_lines
from burnish.llm.mixing import mix_sources
from burnish.llm.ngram_join import jaccard_groups
from burnish.llm.quality import score_quality
from burnish.llm.queries import REMAINDER, piece_model
from burnish.llm.sentencepiece_bpe import digests
from burnish.session import checkpointed


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts; it learns from four fifths of the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(docs, labels, train=F.expr(f"{REMAINDER} <> 0")).filter("predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that others share; n_chars, where there is one, follows the text."""
    cut = drop_repeated_lines(docs).select(*docs.columns)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group of near copies.

    Rows of one id are one document and one of them stays, the least by its text; a row
    without an id cannot be told from others of its kind and stays.
    """
    groups = jaccard_groups(docs)
    stay = groups.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("_rows"))
    kept = docs.join(stay, "doc_id").select(*docs.columns, "_rows")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    several = kept.filter("_rows > 1").withColumn("_row", first).filter("_row = 1")
    return (
        kept.filter("_rows = 1")
        .select(*docs.columns)
        .unionByName(several.select(*docs.columns))
        .unionByName(docs.filter("doc_id IS NULL"))
    )


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics have tempered token shares."""
    return mix_sources(docs).filter("mix_kept").select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    return digests(docs, piece_model()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding and decoding", encoding),
]

#: The classifier has no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; returns the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = checkpointed(stage(spark, docs, sf_dir), "stage")
    return docs
