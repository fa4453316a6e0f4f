"""Echo suppression: per key, a row within the hold time of the last accepted row is dropped.

Dropped rows do not extend the hold, so the rule is a chain: each accepted row
decides the next. The chain of one busy key must not run in one task, so time is
cut into blocks:

1. per key and block, in parallel: for every possible first accepted row of the
   block, which row is the last accepted one (chains merge fast, so this is a
   handful of rows);
2. per key: a walk over the blocks with those few rows gives the time at which
   each block may accept again. Its size depends on the time span only;
3. per key and block, in parallel: the accepted rows from that time on.

Rows of equal key and time are folded before the first shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from passbook.functions.text import strip

SMS_HOLD_MS = 2_000
SHARE_HOLD_MS = 8_000
BLOCK_MS = 600_000

_STEP = "key string, block long, entry long, exit long"
_RESUME = "key string, block long, resume long"


def _next(times: np.ndarray, hold: int) -> np.ndarray:
    return np.searchsorted(times, times + hold, side="left")


def _last_reached(times: np.ndarray, hold: int) -> np.ndarray:
    """Index of the last row of the chain that starts at each row, by pointer doubling."""
    n = len(times)
    jump = np.append(_next(times, hold), n)
    last = np.arange(n + 1)
    while True:
        alive = jump < n
        if not alive.any():
            return last[:n]
        last[alive] = last[jump[alive]]
        jump[alive] = jump[jump[alive]]


def _block_steps(hold: int, block: int):
    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["t"].to_numpy())
        number = int(pdf["block"].iloc[0])
        reach = int(np.searchsorted(times, number * block + hold, side="left"))
        entries = times[: min(reach + 1, len(times))]
        exits = times[_last_reached(times, hold)[: len(entries)]]
        # Entries with the same exit are one step; the latest entry bounds it.
        edge = np.append(exits[1:] != exits[:-1], True)
        return pd.DataFrame(
            {"key": pdf["key"].iloc[0], "block": number, "entry": entries[edge], "exit": exits[edge]}
        )

    return steps


def _resume_times(hold: int):
    def walk(key, steps: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        last = int(known["last"].max()) if len(known) else None
        rows = []
        for block, part in steps.sort_values(["block", "entry"]).groupby("block", sort=True):
            resume = last + hold if last is not None else np.iinfo(np.int64).min
            rows.append((key[0], int(block), resume))
            entry = part["entry"].to_numpy()
            at = int(np.searchsorted(entry, resume, side="left"))
            if at < len(entry):
                last = int(part["exit"].iloc[at])
        return pd.DataFrame(rows, columns=["key", "block", "resume"])

    return walk


def _accepted(hold: int):
    def pick(pdf: pd.DataFrame, resume: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        times = pdf["t"].to_numpy()
        if not len(times):
            return pd.DataFrame({"key": [], "t": [], "row_id": []})
        at = int(np.searchsorted(times, int(resume["resume"].iloc[0]), side="left"))
        after = _next(times, hold)
        taken = []
        while at < len(times):
            taken.append(at)
            at = int(after[at])
        return pdf.iloc[taken][["key", "t", "row_id"]]

    return pick


def accepted_rows(
    df: DataFrame, key, time, row_id, hold_ms: int, known: DataFrame | None = None, block_ms: int = BLOCK_MS
) -> DataFrame:
    """Accepted rows as ``(key, t, row_id)``; ``known`` holds ``(key, last)`` of earlier runs, in microseconds."""
    hold, block = hold_ms * 1000, max(block_ms, hold_ms) * 1000
    once = (
        df.select(key.alias("key"), F.unix_micros(time.cast("timestamp")).alias("t"), row_id.alias("row_id"))
        .groupBy("key", "t")
        .agg(F.min("row_id").alias("row_id"))
        .withColumn("block", F.floor(F.col("t") / block))
    )
    id_type = once.schema["row_id"].dataType.simpleString()
    if known is None:
        known = df.sparkSession.createDataFrame([], "key string, last long")
    steps = once.groupBy("key", "block").applyInPandas(_block_steps(hold, block), _STEP)
    resume = steps.groupBy("key").cogroup(known.groupBy("key")).applyInPandas(_resume_times(hold), _RESUME)
    grouped = once.groupBy("key", "block").cogroup(resume.groupBy("key", "block"))
    return grouped.applyInPandas(_accepted(hold), f"key string, t long, row_id {id_type}")


def drop_echoes(df: DataFrame, hold_ms: int = SMS_HOLD_MS, block_ms: int = BLOCK_MS) -> DataFrame:
    """Messages without echoes of the same trimmed body. ``sms_id`` is unique."""
    key = F.md5(strip(F.col("body")))
    kept = accepted_rows(df, key, F.col("ts"), F.col("sms_id"), hold_ms, block_ms=block_ms)
    return df.join(kept.select(F.col("row_id").alias("sms_id")), "sms_id", "left_semi")


def drop_repeated_shares(df: DataFrame, hold_ms: int = SHARE_HOLD_MS, block_ms: int = BLOCK_MS) -> DataFrame:
    """Share batches without those of the same path list inside the hold time. ``id`` is unique."""
    key = F.md5(F.array_join("paths", "|"))
    kept = accepted_rows(df, key, F.col("ts"), F.col("id"), hold_ms, block_ms=block_ms)
    return df.join(kept.select(F.col("row_id").alias("id")), "id", "left_semi")
