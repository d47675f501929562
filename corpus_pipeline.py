"""A training corpus from raw documents: classify, deduplicate twice, redact, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage
returns in the shared folder and gives it to the next. All stages but the last return the
columns of documents. Stages aren't expressible in SQL as a whole; they are tested against
brute-force versions.

Defined cases, for every stage: a null text counts as an empty one and stays null; an empty
table gives an empty result; columns beyond those of documents ride along, whatever their names;
ties and repeated rows as each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellate.llm import packing, quality, secret_scan, simhash, suffix_dedup
from stellate.llm.tables import table, written


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; empty texts and repeated rows are judged like others. If labels hold one class or none, all stay."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: that of the smallest doc_id (nulls last), of equal ones that of the smallest hash; of rows equal in both, one. Texts without words are one component."""
    return simhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated substrings are cut, in repeated rows and repeated doc_ids too; a document that is left empty stays as an empty text."""
    return _counted(suffix_dedup.deduplicated(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; overlapping ones by one mark."""
    return _counted(secret_scan.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences. An empty text is one piece of the closing token; repeated rows are packed each; ties of rank go by doc_id (nulls first) and start."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_classifier", classify), ("simhash_near_dedup", near_duplicates), ("suffix_array_dedup", repeated_passages), ("secret_scans", secrets), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
