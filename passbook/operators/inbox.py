"""The pending inbox: a table of batches and a flat table of their rows.

A batch may be of any size, so its rows are never collected into one value
here; nested documents are made only at the file boundary.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from passbook.functions.candidates import effective_title, is_valid, needs_review, needs_review_strict, resolved_category
from passbook.functions.text import blank, strip
from passbook.functions.times import at
from passbook.operators.skew import salted_left_join

# States of a batch.
STATES = ("processing", "readyForReview", "failed", "completed", "discarded")
CLOSED = ("completed", "discarded")


def _zero() -> Column:
    return F.lit(0).cast("long")


def active(batches: DataFrame) -> DataFrame:
    return batches.where(~F.col("status").isin(*CLOSED))


def inbox_totals(batches: DataFrame, rows: DataFrame) -> DataFrame:
    """Active batches; rows and amount of those ready for review.

    Rows are folded per batch before the join, so the join key is unique on both sides.
    """
    per_batch = rows.groupBy(F.col("batch_id").alias("id")).agg(
        F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum("amount"), _zero()).alias("_amount")
    )
    ready = F.col("status") == "readyForReview"
    return (
        active(batches)
        .join(per_batch, "id", "left")
        .agg(
            F.count(F.lit(1)).alias("active_batches"),
            F.count_if(ready).alias("ready_batches"),
            F.coalesce(F.sum(F.when(ready, F.col("_n"))), _zero()).alias("ready_transactions"),
            F.coalesce(F.sum(F.when(ready, F.col("_amount"))), _zero()).alias("ready_amount"),
        )
    )


def default_selected(rows: DataFrame) -> DataFrame:
    """Non-duplicates; all rows where there is no other than duplicates."""
    duplicate = F.coalesce("is_duplicate", F.lit(False))
    fresh = rows.agg(F.count_if(~duplicate)).scalar()
    return rows.where(~duplicate | (fresh == 0))


def review_totals(rows: DataFrame, chosen: DataFrame | Column) -> DataFrame:
    """Counts shown above a review list; ``chosen`` holds the selected ids, or is a test of the rows themselves."""
    if isinstance(chosen, DataFrame):
        marks = chosen.select("id").distinct().withColumn("_chosen", F.lit(True))
        rows, chosen = rows.join(marks, "id", "left"), F.col("_chosen")
    picked = F.coalesce(chosen, F.lit(False))
    return (
        rows.agg(
            F.count(F.lit(1)).alias("found"),
            F.count_if(picked).alias("selected"),
            F.coalesce(F.sum(F.when(picked, F.col("amount"))), _zero()).alias("selected_amount"),
            F.count_if(F.coalesce("is_duplicate", F.lit(False))).alias("duplicates"),
            F.count_if(needs_review()).alias("needs_review"),
            F.count_if(needs_review_strict()).alias("needs_review_strict"),
        )
        .withColumn("all_selected", (F.col("found") > 0) & (F.col("selected") == F.col("found")))
    )


def extraction_totals(rows: DataFrame, images: DataFrame) -> DataFrame:
    """Found rows, and images that gave some or none."""
    per_image = rows.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n"))
    good, bad = F.col("images_ok"), F.col("images_failed")
    return (
        images.select("image_id")
        .distinct()
        .join(per_image, "image_id", "left")
        .agg(
            F.coalesce(F.sum("_n"), _zero()).alias("found"),
            F.count_if(F.col("_n").isNotNull()).alias("images_ok"),
            F.count_if(F.col("_n").isNull()).alias("images_failed"),
        )
        .withColumns(
            {
                "full_success": bad == 0,
                "partial_success": (good > 0) & (bad > 0),
                "full_failure": (good == 0) & (bad > 0),
            }
        )
    )


def scan_summary(staged: DataFrame) -> DataFrame:
    """Staged and duplicate counts with the label of the batch."""
    n, d = F.col("staged").cast("string"), F.col("duplicates").cast("string")
    label = F.when(
        F.col("duplicates") > 0,
        F.concat(F.lit("Bank SMS ("), n, F.lit(" detected, "), d, F.lit(" duplicates)")),
    ).otherwise(F.concat(F.lit("Bank SMS ("), n, F.lit(" detected)")))
    return staged.agg(
        F.count(F.lit(1)).alias("staged"), F.count_if(F.col("is_duplicate")).alias("duplicates")
    ).withColumn("label", label)


def stage_batches(staged: DataFrame, as_of: datetime) -> DataFrame:
    """Header rows of the batches that staged rows form."""
    n, d = F.col("transactions").cast("string"), F.col("duplicates").cast("string")
    label = F.when(
        F.col("duplicates") > 0,
        F.concat(F.lit("Bank SMS ("), n, F.lit(" detected, "), d, F.lit(" duplicates)")),
    ).otherwise(F.concat(F.lit("Bank SMS ("), n, F.lit(" detected)")))
    return (
        staged.groupBy(F.col("batch_id").alias("id"))
        .agg(
            F.count(F.lit(1)).alias("transactions"),
            F.count_if(F.col("is_duplicate")).alias("duplicates"),
            F.coalesce(F.sum("amount"), _zero()).alias("amount"),
        )
        .withColumns(
            {
                "status": F.lit("readyForReview"),
                "created_at": at(as_of),
                "source": label,
            }
        )
    )


def to_ledger(candidates: DataFrame, as_of: datetime) -> DataFrame:
    """Valid candidates as ledger rows; see ``not_importable`` for the others."""
    named = candidates.where(is_valid()).withColumn("_title", effective_title())
    return named.select(
        "id",
        "type",
        "amount",
        F.coalesce("currency", F.lit("INR")).alias("currency"),
        F.col("_title").alias("title"),
        F.when(~blank(F.col("merchant")), strip(F.col("merchant"))).alias("merchant"),
        resolved_category(F.col("_title")).alias("category_id"),
        "date",
        "note",
        "source",
        at(as_of).alias("created_at"),
        at(as_of).alias("updated_at"),
    )


def not_importable(candidates: DataFrame) -> DataFrame:
    """Candidates that miss an amount, a name or a date, with the first reason."""
    unnamed = blank(F.col("title")) & blank(F.col("merchant"))
    reason = (
        F.when(F.coalesce(F.col("amount"), F.lit(0)) <= 0, "no amount")
        .when(unnamed, "no title or merchant")
        .when(F.col("date").isNull(), "no date")
    )
    return candidates.where(~is_valid()).withColumn("reason", reason)


def confirm(candidates: DataFrame, chosen: DataFrame, as_of: datetime) -> DataFrame:
    """Ledger rows of the chosen candidates; invalid ones are left out."""
    return to_ledger(candidates.join(chosen.select("id"), "id", "left_semi"), as_of)


def bulk_confirm(
    batches: DataFrame, rows: DataFrame, as_of: datetime, counts: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Ledger rows of all fresh, valid candidates of ready batches, and the batches left over.

    ``counts`` gives at least the rows ``n`` of every batch, where they can be had without flagging the rows.
    """
    ready = batches.where(F.col("status") == "readyForReview").select(
        F.col("id").alias("batch_id"), F.lit(True).alias("_ready")
    )
    fresh = rows.where(~F.coalesce("is_duplicate", F.lit(False)))
    joined = salted_left_join(fresh, ready, ["batch_id"], counts=counts, spread=["id"])
    saved = to_ledger(joined.where("_ready").drop("_ready"), as_of)
    remaining = batches.where(F.col("status") != "readyForReview")
    return saved, remaining


def union_batches(documents: DataFrame) -> DataFrame:
    """Rows of several nested batches as one review set, in their places of the batch."""
    rows = documents.select(
        F.col("id").alias("batch_id"), "created_at", F.posexplode("transactions").alias("_place", "t")
    ).select("batch_id", "created_at", "_place", "t.*")
    return rows.withColumn("pos", F.coalesce("pos", F.col("_place").cast("long"))).drop("_place")


def union_paths(first: DataFrame, second: DataFrame) -> DataFrame:
    """Paths of both sides, each once."""
    return first.select("path").union(second.select("path")).distinct()


def fallback(first: DataFrame, second: DataFrame, key: str = "image_id") -> DataFrame:
    """Rows of the second extractor only where the first gave none."""
    seen = first.select(key).distinct()
    return first.unionByName(second.join(seen, key, "left_anti"))


def _path_key() -> list[Column]:
    paths = F.col("paths")
    return [F.size(paths).alias("_size"), F.array_sort(F.array_distinct(paths)).alias("_set")]


def already_shared(new: DataFrame, open_batches: DataFrame) -> DataFrame:
    """Flags new batches whose path count and path set equal those of an open batch."""
    known = open_batches.select(*_path_key()).distinct().withColumn("_known", F.lit(True))
    keyed = new.select("*", *_path_key())
    return (
        keyed.join(known, ["_size", "_set"], "left")
        .withColumn("already_pending", F.coalesce("_known", F.lit(False)))
        .drop("_size", "_set", "_known")
    )


def latest_state(changes: DataFrame) -> DataFrame:
    """Current state per batch from a table of state changes; unknown states count as processing."""
    state = F.when(F.col("status").isin(*STATES), F.col("status")).otherwise("processing")
    return changes.groupBy("id").agg(
        F.max_by(state, F.struct("ts", "seq")).alias("status"),
        F.max("ts").alias("changed_at"),
        F.min("ts").alias("created_at"),
    )


def recover(batches: DataFrame, files: DataFrame) -> DataFrame:
    """What to do with batches left in processing: resume when all files exist, else fail."""
    wanted = batches.where(F.col("status") == "processing").select("id", F.explode_outer("paths").alias("path"))
    found = files.select("path").distinct().withColumn("_there", F.lit(True))
    per_batch = (
        salted_left_join(wanted, found, ["path"], spread=["id"])
        .groupBy("id")
        .agg(F.count("path").alias("_n"), F.count("_there").alias("_there"))
    )
    all_there = (F.col("_n") > 0) & (F.col("_n") == F.col("_there"))
    return per_batch.select(
        "id",
        F.when(all_there, "resume").otherwise("fail").alias("action"),
        F.when(~all_there, "Processing was interrupted. Tap Retry OCR.").alias("error_message"),
    )
