"""The corpus pipeline: quality rules, line dedup, near-duplicate join, source mix, byte-level BPE.

Every stage takes (spark, docs, sf_dir), docs being a table with the columns of ``documents`` that the stage before
has kept, and returns a DataFrame; all but the last return those columns.  Between stages the rows are written as
Parquet to the shared folder and read again, so a lost executor costs no more than the stage at hand.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from halospark.llm import entropy_mix, jaccard_tree, line_dedup, quality, sp_bpe
from halospark.llm.common import table
from halospark.operators.lineage import cut_lineage

#: Near duplicates: shingles of five words, Jaccard similarity of at least 80 %.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table rejects go."""
    return quality.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in the first of them only."""
    return line_dedup.replace_text(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar documents stays."""
    return jaccard_tree.one_of_each(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out until every source has its share of words."""
    return entropy_mix.mix(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    model = sp_bpe.serialise(sp_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    return sp_bpe.round_trip(docs, model, public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE", encode_texts),
]

#: The near-duplicate join, the mix and the encoding cannot be written in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
