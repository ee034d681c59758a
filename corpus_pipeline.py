"""The corpus pipeline: toxicity, line dedup, near copies, benchmark decontamination, packing.

Every stage reads what the one before has written, and all but the last return the columns of documents.
"""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from designstats.llm import op1_jaccard, op2_lines, op6_packing, op7_toxicity, op9_decontaminate
from designstats.llm.common import free_name, stored, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    model = op7_toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    name = free_name(docs, "toxicity")
    return op7_toxicity.score_documents(docs, model, name).filter(F.col(name) < 0.5).drop(name)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents cut to the first occurrence of each line; n_chars follows the text, where there is such a column."""
    out = op2_lines.dedup_lines(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-copy class: the one with the smallest doc_id, then text hash."""
    return op1_jaccard.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = op9_decontaminate.contaminated(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    doc, copy = free_name(docs, "found_doc"), free_name(docs, "found_copy")
    found = found.select(F.col("doc_id").alias(doc), F.col("copy").alias(copy)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(copy))
    return docs.join(found, same, "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4,096 tokens."""
    return op6_packing.pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_copies", near_copies),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: SQL can express neither the scores nor the tokens; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each returns is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
