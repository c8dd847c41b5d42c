"""A training corpus from ``documents``: rules, languages, near copies, repeated passages, windows of ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each one's result as Parquet in the shared
folder and reads it again for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odflow.llm import language, near_dedup, packing, quality, suffix_dedup
from odflow.llm.common import stored, table

#: A language is rejected if it is undetermined or its share is below this.
LEAST_SCORE = 0.3


def _of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in kept; a null doc_id counts as a value."""
    kept = kept.select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the fences of their language and source keep."""
    return _of(docs, quality.verdicts(docs).filter("kept"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a determined language."""
    return _of(docs, language.predictions(docs).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return near_dedup.without_near_duplicates(docs, words=5, percent=80)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 100 bytes or more that start earlier too."""
    return suffix_dedup.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 1024 ids by sum of squares: one row a piece."""
    import public_tokenizers

    return packing.pack_sum_of_squares(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("MinHash near-dedup", minhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("packing", packed),
]

#: Learned languages, sketches and ids of tokens are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
