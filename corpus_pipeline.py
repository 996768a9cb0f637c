"""The corpus pipeline: stages over documents, each written and read again by its caller.

Each stage gets all that the one before kept; all but the last return the columns
of documents. Null ids and texts: see the operators' modules; a document without an id or text
fails the quality rules or stays as it is, and nothing raises.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringloom.llm import decontaminate, jaccard, pieces, pii, quality
from ringloom.llm.common import cut, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that they reject go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join, five words and 0.8: of each group the smallest doc_id stays."""
    return jaccard.one_of_each(docs, k=5, t=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with an aligned passage of a test item go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: values are replaced in the text, and n_chars is counted anew."""
    out = pii.pseudonymised(docs, pii.key_of(spark)).withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece: ids of each text, with lang and source kept."""
    return pieces.encoded(docs, pieces.model_path(), ["lang", "source"])


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]

#: Random splits, alignment and BPE are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each stage's result written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
