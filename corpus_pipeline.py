"""The training-data pipeline over documents.

Each stage works on the documents its predecessor kept; all but the last return the columns of documents.
A stage's result is written as Parquet and read again before the next one starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.bpe import encode_decode
from vellum.llm.common import shared_dir, written
from vellum.llm.exact_dedup import drop_copies
from vellum.llm.jaccard_join import one_of_each
from vellum.llm.mixing import sample
from vellum.llm.quality_rules import quality_filter

#: Share of the tokens that mixing aims at.
MIXED_SHARE = 0.9


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go."""
    return quality_filter(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id stays."""
    return drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 over five-word shingles the least id stays."""
    return one_of_each(docs, n=5, t=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens are raked to tempered marginals of source, language and topic."""
    return sample(docs, MIXED_SHARE)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and the digest of what they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    made = encode_decode(docs.select("doc_id", "lang", "source", "n_chars", "text"), path, public_tokenizers.PATTERN)
    return made.select("doc_id", "lang", "source", "n_chars", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing", mixing_stage),
    ("byte-level BPE", tokens_stage),
]

#: Components of links, raking and BPE aren't SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_dir(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"{folder}/{i}")
    return docs
