"""Duplicate detection against the ledger, inside a batch, and against the inbox.

Rows are shuffled once, by fingerprint; ledger, inbox and the rows of the same
batch are met there. Where a fingerprint is hot, all decisions are made once per
fingerprint instead, on frames pre-aggregated before the shuffle. One salted
join then brings them back to the rows, so a fingerprint that a third of all
rows share does not end up in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from passbook.functions.candidates import fingerprint
from passbook.operators.skew import HOT_ROWS, hot_keys, salted_left_join
from passbook.operators.tokens import materialise

_FLAGS = ("_first_pos", "_n", "_in_ledger", "_in_pending")


def with_fingerprint(df: DataFrame) -> DataFrame:
    return df.withColumn("fp", fingerprint())


def written_fingerprints(candidates: DataFrame, *columns: str) -> DataFrame:
    """Candidates without flags, with ``fp`` worked out once and written: they are read several times.

    ``columns`` names those that are needed later beside it, all by default.
    """
    rows = with_fingerprint(candidates.drop("is_duplicate", "duplicate_source"))
    return materialise(rows.select(*columns, "fp") if columns else rows, "fingerprints")


def distinct_fingerprints(df: DataFrame, flag: str) -> DataFrame:
    return df.select(fingerprint().alias("fp")).distinct().withColumn(flag, F.lit(True))


def _with_known(rows: DataFrame, ledger: DataFrame | None, pending: DataFrame | None) -> DataFrame:
    """Adds whether ledger and inbox hold the fingerprint; rows of the inbox bring it as ``fp``."""
    known_elsewhere = {
        "_in_ledger": None if ledger is None else distinct_fingerprints(ledger, "_in_ledger"),
        "_in_pending": None if pending is None else pending.select("fp").distinct().withColumn("_in_pending", F.lit(True)),
    }
    for flag, known in known_elsewhere.items():
        if known is None:
            rows = rows.withColumn(flag, F.lit(False))
        else:
            rows = rows.join(known, "fp", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return rows


def fingerprint_facts(rows: DataFrame, ledger: DataFrame | None, pending: DataFrame | None = None) -> DataFrame:
    """Per batch and fingerprint: first position, number of rows, presence elsewhere.

    These frames hold one row per key, so their joins are plain ones.
    """
    facts = rows.groupBy("batch_id", "fp").agg(
        F.min("pos").alias("_first_pos"), F.count(F.lit(1)).alias("_n")
    )
    return _with_known(facts, ledger, pending)


def _beside(rows: DataFrame, ledger: DataFrame | None, pending: DataFrame | None) -> DataFrame:
    """The same facts beside each row; rows that stand together by fingerprint do so by batch, too."""
    same = Window.partitionBy("fp", "batch_id")
    return _with_known(rows, ledger, pending).withColumns(
        {"_first_pos": F.min("pos").over(same), "_n": F.count(F.lit(1)).over(same)}
    )


def _flagged(rows: DataFrame, ledger: DataFrame | None, pending: DataFrame | None, min_hot: int) -> DataFrame:
    """Rows with ``fp``, the facts of their fingerprints and both flags."""
    counts = rows.groupBy(F.xxhash64("fp").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    if hot_keys(counts, min_hot):
        facts = fingerprint_facts(rows, ledger, pending)
        joined = salted_left_join(rows, facts, ["batch_id", "fp"], min_rows=min_hot, spread=["batch_id", "pos", "id"])
    else:
        joined = _beside(rows, ledger, pending)
    source = F.when(F.col("_in_ledger"), "existingDb").when(F.col("pos") > F.col("_first_pos"), "intraBatch")
    return joined.withColumn("duplicate_source", source).withColumn(
        "is_duplicate", F.col("duplicate_source").isNotNull()
    )


def detect_duplicates(
    candidates: DataFrame, ledger: DataFrame | None, min_hot: int = HOT_ROWS, written: bool = False
) -> DataFrame:
    """Candidates with both flags set anew: ledger hits first, then repeats inside the batch.

    ``written`` says that they come from ``written_fingerprints``.
    """
    rows = candidates if written else written_fingerprints(candidates)
    return _flagged(rows, ledger, None, min_hot).drop(*_FLAGS)


def mark_pending(candidates: DataFrame, pending: DataFrame, min_hot: int = HOT_ROWS) -> DataFrame:
    """Marks rows that already stand in the active inbox as repeats; no row is dropped."""
    rows = with_fingerprint(candidates)
    known = distinct_fingerprints(pending, "_in_pending")
    joined = salted_left_join(rows, known, ["fp"], min_rows=min_hot, spread=["batch_id", "pos", "id"])
    hit = F.coalesce("_in_pending", F.lit(False))
    return joined.withColumns(
        {
            "is_duplicate": F.coalesce("is_duplicate", F.lit(False)) | hit,
            "duplicate_source": F.when(hit, "intraBatch").otherwise(F.col("duplicate_source")),
        }
    ).drop("_in_pending")


def mark_one_by_one(rows: DataFrame, known: DataFrame, order: list[str], min_hot: int = HOT_ROWS) -> DataFrame:
    """Both flags of rows with ``fp`` that are staged one at a time: those after the first of a fingerprint find it in the inbox.

    ``known`` says per fingerprint whether it stands in the ledger and in the inbox; the inbox goes first.
    """
    place = F.struct(*order)
    seen = rows.groupBy("fp").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("n"))
    joined = salted_left_join(
        rows, seen.drop("n").join(known, "fp", "left"), ["fp"], counts=seen.select("fp", "n"), min_rows=min_hot, spread=order
    )
    waiting = F.coalesce("_in_pending", F.lit(False)) | (place > F.col("_first"))
    source = F.when(waiting, "intraBatch").when(F.col("_in_ledger"), "existingDb")
    return (
        joined.withColumn("duplicate_source", source)
        .withColumn("is_duplicate", F.col("duplicate_source").isNotNull())
        .drop("_first", "_in_ledger", "_in_pending")
    )


def rows_to_stage(
    candidates: DataFrame, ledger: DataFrame, pending: DataFrame, min_hot: int = HOT_ROWS, written: bool = False
) -> DataFrame:
    """Rows of a scan to put into the inbox.

    New rows and repeats inside the scan stay, with the first of each repeated
    pair. Rows that already wait in the inbox go, unless they repeat in the scan.
    ``written`` says that candidates and inbox rows come from ``written_fingerprints``.
    """
    rows = candidates if written else written_fingerprints(candidates)
    waiting = pending if written else with_fingerprint(pending)
    flagged = _flagged(rows, ledger, waiting, min_hot)
    repeats = (F.col("_n") > 1) & ~F.col("_in_ledger")
    waiting = F.col("_in_pending") & ~repeats
    keep = ~waiting & (~F.col("is_duplicate") | (F.col("duplicate_source") == "intraBatch") | repeats)
    return flagged.where(keep).drop(*_FLAGS)
