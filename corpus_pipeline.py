"""A corpus pipeline over documents: toxicity, exact dedup, near dedup, secrets, packing.

Every stage takes what the stage before it kept. A null doc_id is a document of its own: it is never
rejected by id. Rows equal in all that counts (doc_id and text up to white space) become one row in
the exact dedup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passbook.llm import exact_dedup, jaccard, packing, secrets, toxicity
from passbook.llm.common import BLANKS, materialise, table, text_of


def toxicity_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the toxicity model of the labelled rows does not reject."""
    rejected = toxicity.toxicity(docs, table(spark, folder, "labels")).where("predicted = 1").select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti")


def exact_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of equal texts, up to white space, the document with the smallest doc_id stays."""
    rows = exact_dedup.exact_dedup(docs)
    again = rows.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept")).where("not kept").select("doc_id", "text_sha256")
    marked = docs.withColumn("_sha", F.sha2(F.regexp_replace(text_of(), BLANKS, " "), 256))
    lost = marked.doc_id.eqNullSafe(again.doc_id) & (marked["_sha"] == again.text_sha256)
    return marked.join(again, lost, "left_anti").dropDuplicates(["doc_id", "_sha"]).drop("_sha")


def near_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays."""
    lost = jaccard.jaccard_join(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(lost, "doc_id", "left_anti")


def secret_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Secrets are replaced in place; documents without any stay as they are."""
    return secrets.clean(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The bins of all documents that are left."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("near duplicates", near_stage),
    ("secret scan", secret_stage),
    ("packing", packing_stage),
]

#: Training and the packing order cannot be put in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages in order; what a stage keeps is written and read by the next one."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, folder), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, folder)
