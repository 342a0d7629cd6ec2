"""A corpus pipeline of five stages: language, quality, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and gives a table that is written as Parquet and read again
as the next one's ``docs``. All but the last give the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.llm.common import table
from assetloom.llm.jaccard import first_of_classes
from assetloom.llm.langid import fit_with_limit, language_nearness
from assetloom.llm.packing import pack_documents, packed_digest
from assetloom.llm.quality import THRESHOLD, fit_quality, quality_score
from assetloom.llm.secrets import mask_secrets
from assetloom.sources.scratch import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no learned language go: texts that are null or have no letter, those whose ridge scores are about
    what chance n-grams would get, and those that none of the one-versus-rest scores claims, by limits from held-out
    texts; all of them where no document has a language to learn from."""
    docs = docs.select(*COLUMNS)
    model, limit = fit_with_limit(docs, F.lit(True))
    return docs.filter(language_nearness(F.col("text"), model) >= limit)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are unlikely to be of class 1 go; none where there are no labels to learn from."""
    docs = docs.select(*COLUMNS)
    model = fit_quality(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return docs.filter(quality_score(F.col("text"), model) >= THRESHOLD)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of the least id stays, rows that share an id being
    documents of their own; empty ones all stay."""
    return first_of_classes(docs.select(*COLUMNS), shingle=5, percent=80)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; no document goes."""
    return docs.select(*COLUMNS).withColumn("text", mask_secrets(F.col("text"))).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of at most 4096 tokens."""
    import public_tokenizers

    return packed_digest(pack_documents(docs.select(*COLUMNS), public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("language", language_stage), ("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("secrets", secret_stage), ("packing", packing_stage)]
#: Classifiers, entropy windows and tokens can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, on the documents below ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
