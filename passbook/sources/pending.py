"""The inbox as nested JSON documents, at the file boundary only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from passbook.fixed_values import SOURCES, TYPES
from passbook.operators.inbox import STATES, union_batches
from passbook.operators.skew import salted_left_join
from passbook.operators.tokens import materialise
from passbook.schema import PENDING
from passbook.sources.exports import iso

DOCUMENT_ROWS = 10_000


def _transaction(t: Column) -> Column:
    """One nested transaction with the defaults of missing fields."""
    score = ("confidence", "amount_confidence", "merchant_confidence", "date_confidence", "type_confidence")
    return F.struct(
        t["id"].alias("id"),
        t["date"].try_cast("timestamp_ntz").alias("date"),
        t["amount"].alias("amount"),
        F.coalesce(t["currency"], F.lit("INR")).alias("currency"),
        t["title"].alias("title"),
        t["merchant"].alias("merchant"),
        t["categoryId"].alias("category_id"),
        F.when(t["type"].isin(*TYPES), t["type"]).otherwise("expense").alias("type"),
        *[F.coalesce(t[s], F.lit(1.0)).alias(s) for s in score],
        F.coalesce(t["warnings"], F.array().cast("array<string>")).alias("warnings"),
        t["sourceReference"].alias("source_reference"),
        t["rawText"].alias("raw_text"),
        F.coalesce(t["isDuplicate"], F.lit(False)).alias("is_duplicate"),
        F.when(t["duplicateSource"].isin("existingDb", "intraBatch"), t["duplicateSource"])
        .when(t["duplicateSource"].isNotNull(), "existingDb")
        .alias("duplicate_source"),
        t["note"].alias("note"),
        F.when(t["source"].isNull(), "screenshot")
        .when(t["source"].isin(*SOURCES), t["source"])
        .otherwise("manual")
        .alias("source"),
        t["pos"].alias("pos"),
    )


def read_pending(spark: SparkSession, path: str, one_array_per_file: bool = False) -> DataFrame:
    """Documents with typed fields; empty or unreadable files give no rows.

    A large batch stands in several documents of one id, numbered by ``part``;
    ``read_batches`` gives one row per batch.
    """
    raw = spark.read.schema(PENDING).option("multiLine", one_array_per_file).json(path)
    return raw.where(F.col("id").isNotNull()).select(
        "id",
        F.coalesce("imagePaths", F.array().cast("array<string>")).alias("paths"),
        F.col("createdAt").try_cast("timestamp_ntz").alias("created_at"),
        F.when(F.col("status").isin(*STATES), F.col("status")).otherwise("processing").alias("status"),
        F.coalesce(
            F.transform("extractedTransactions", _transaction),
            F.transform(F.array().cast(PENDING["extractedTransactions"].dataType), _transaction),
        ).alias("transactions"),
        F.col("errorMessage").alias("error_message"),
        F.coalesce("source", F.lit("Shared from another app")).alias("source"),
        F.coalesce("part", F.lit(0).cast("long")).alias("part"),
    )


def headers(docs: DataFrame) -> DataFrame:
    """One row per batch, whatever the number of its documents; the first part's fields hold."""
    fields = [c for c in docs.columns if c not in ("id", "part", "transactions")]
    first = docs.groupBy("id").agg(F.min(F.struct("part", *fields)).alias("h"))
    return first.select("id", *[F.col(f"h.{c}").alias(c) for c in fields])


def read_batches(spark: SparkSession, path: str, one_array_per_file: bool = False) -> tuple[DataFrame, DataFrame]:
    """The inbox as two flat frames: one row per batch, and one per transaction in its original place."""
    docs = read_pending(spark, path, one_array_per_file)
    return headers(docs), union_batches(docs)


def save_pending(current: DataFrame, new: DataFrame) -> DataFrame:
    """Batches of the same id are updated, others added."""
    return current.join(new.select("id"), "id", "left_anti").unionByName(new)


def documents(batches: DataFrame, rows: DataFrame, limit: int = DOCUMENT_ROWS) -> DataFrame:
    """Nested documents of batches and their rows.

    A batch larger than ``limit`` is written as several documents of one id, so
    no document (and no task) holds an unbounded batch. Each transaction keeps its
    place in the batch, and ``read_batches`` puts the parts together again.
    """
    tx = F.struct(
        "pos",
        F.struct(
            "id",
            iso("date").alias("date"),
            "amount",
            "currency",
            "title",
            "merchant",
            F.col("category_id").alias("categoryId"),
            "type",
            "confidence",
            "amount_confidence",
            "merchant_confidence",
            "date_confidence",
            F.when(F.size("warnings") > 0, F.col("warnings")).alias("warnings"),
            F.col("is_duplicate").alias("isDuplicate"),
            F.col("duplicate_source").alias("duplicateSource"),
            "note",
            "source",
            "pos",
        ).alias("t"),
    )
    head = batches.select("id", F.col("paths").alias("imagePaths"), iso("created_at").alias("createdAt"), "status", "source")
    fields = ["id", "imagePaths", "createdAt", "status", "extractedTransactions", "source", "part"]
    found = F.transform(F.array_sort(F.collect_list(tx)), lambda x: x["t"]).alias("extractedTransactions")

    def nested(some: DataFrame, part: Column) -> DataFrame:
        """Rows by batch, which their headers join without another shuffle."""
        return some.groupBy(F.col("batch_id").alias("id")).agg(found).withColumn("part", part)

    # Counted once: what a batch holds is not changed by its duplicate flags.
    sizes = materialise(rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")), "sizes")
    big = sizes.where(F.col("n") > limit).select("batch_id", F.ceil(F.col("n") / limit).alias("parts"))
    if big.isEmpty():
        return head.join(nested(rows, F.lit(0).cast("long")), "id", "left").select(fields)
    placed = salted_left_join(rows, big, ["batch_id"], counts=sizes, spread=["id"])
    many = placed.where("parts is not null").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    in_parts = many.groupBy(F.col("batch_id").alias("id"), "part").agg(found)
    whole = nested(placed.where("parts is null"), F.lit(0).cast("long"))
    large = big.select(F.col("batch_id").alias("id"))
    small = head.join(large, "id", "left_anti").join(whole, "id", "left").select(fields)
    return small.unionByName(head.join(in_parts, "id").select(fields))


def write_pending(docs: DataFrame, path: str, compression: str = "gzip") -> None:
    """JSON lines, one document a line; ``read_pending`` reads compressed and plain files alike."""
    docs.write.mode("overwrite").option("compression", compression).json(path)
