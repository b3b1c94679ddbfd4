"""A training corpus from raw documents: five stages, each by one operator of ``talkgauge.llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgauge.llm import bpe, langid, mixing, ngram_join, pii
from talkgauge.llm.common import read_table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language go: those whose score is far below what texts of their length reach, or that have no letter.

    Profiles and expected scores are learned from the labelled folds; without labels nothing can be learned, and only
    documents without a letter go. Null texts have no letter. Repeated rows are judged alike.
    """
    labelled = docs.filter(~langid.train_split() & F.col("lang").isNotNull())
    prototypes = langid.learn(labelled)
    if not prototypes:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    medians = langid.expected(labelled, prototypes)
    judged = langid.identify(docs, prototypes)
    return judged.filter(~langid.rejects(F.col("text"), F.col("lang_pred"), F.col("score"), medians)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id: five-word shingles, Jaccard similarity 0.8.

    Documents without words are copies of nothing and stay; so do rows of one id whose texts are unlike.
    """
    return ngram_join.first_of_each(docs, k=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values, and terms that disclose them, are replaced in the text; its length follows.

    Null and empty texts stay as they are; repeated rows are treated alike, and counted once.
    """
    clean = pii.sanitise(docs).withColumn("text", F.col("sanitised"))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it; those that it does not take go.

    Null and empty texts have no words, so they go. Repeated rows share what the mix takes of them evenly.
    """
    return mixing.apply_mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids (32-bit, little-endian), instead of their texts; null and empty texts have none."""
    import public_tokenizers

    encoded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long")).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("token_ids", token_ids),
]

#: SQL can express neither the profiles, nor the rounding, nor the merges: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on the documents of a folder; each stage's result is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
