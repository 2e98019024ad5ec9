"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a
DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaguelab.llm.best_fit_packing import packed_documents
from leaguelab.llm.decontamination import without_contaminated
from leaguelab.llm.line_dedup import dedup_lines
from leaguelab.llm.queries import BYTE_TOKENIZER, END_ID
from leaguelab.llm.shared import in_train, table, written
from leaguelab.llm.simhash_bktree import one_of_each_group
from leaguelab.llm.toxicity import scored_rows


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of 0.5 or more go. Learned from the labels of the other rows than
    those held out by crc32(doc_id) mod 5 = 0."""
    labels = table(spark, sf_dir, "labels").where(in_train(F.col("doc_id"), 5, 0))
    scored = scored_rows(docs, labels, score_col="_toxicity")
    return scored.where(F.col("_toxicity") < 0.5).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, all documents stay; n_chars is that of the text that is left."""
    left = dedup_lines(docs, min_words=8, removed_col="_lines_removed").select(*docs.columns)
    if "n_chars" not in docs.columns:
        return left
    kind = docs.schema["n_chars"].dataType
    return left.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return one_of_each_group(docs, width=5, radius=20)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 1,024 tokens.

    The Python workers are those of the stages before, so the words looked up get half the memory."""
    return packed_documents(docs, BYTE_TOKENIZER, END_ID, memo_bytes=60 << 20)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]
# No SQL: learned scores, fingerprint trees and packing are not expressible; tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
