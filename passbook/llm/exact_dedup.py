"""Operator 3: Grace hash deduplication.

1. Each task folds its own equal texts (an open-addressing table over a bounded number of bytes) and
   writes one record per different text, with the ids of its rows beside it.
2. The records are partitioned by hash. A partition whose different texts do not fit the table is
   partitioned again by further hash bits into new spill files in the shared folder, until each fits.
3. Each bucket goes through an open-addressing table that compares complete content.

A text that fills a third of all rows leaves each task once; its bucket streams through the table,
which holds it once. Spill files are Spark tables, so a lost executor costs a recomputed task only.

Null text counts as empty. Rows equal in id and text count as copies: one of them is kept. A null id
sorts behind all ids. Further columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passbook.llm.common import BLANKS, Written, materialise, text_of, width

#: Bytes of different texts that a task folds at once, and that a bucket may hold.
TABLE_BYTES = 64 << 20
#: Buckets that an oversized bucket is split into.
FAN_OUT = 16


class OpenTable:
    """Open addressing with linear probing; entries are equal only if the whole texts are."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.texts: list[str] = []
        self.bytes = 0

    def put(self, key: int, text: str) -> int:
        """The entry of a text, new if it was not there."""
        mask = len(self.slots) - 1
        at = (key ^ (key >> 32)) & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == key and self.texts[entry] == text:
                return entry
            at = (at + 1) & mask
        entry = self.slots[at] = len(self.texts)
        self.hashes.append(key)
        self.texts.append(text)
        self.bytes += len(text)
        if 2 * len(self.texts) > len(self.slots):
            self._grow()
        return entry

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for entry, key in enumerate(self.hashes):
            at = (key ^ (key >> 32)) & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


FOLDED = "row_id long, none boolean, id long, sha string, hash long, of_row long, text string"


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Names for each row the first row of this task with the same text; only that one carries the text."""
    table, first = OpenTable(), []
    for batch in batches:
        of_row, texts = [], []
        for row, key, text in zip(batch["row_id"].tolist(), batch["hash"].tolist(), batch["text"].tolist(), strict=True):
            entry = table.put(key, text)
            new = entry == len(first)
            if new:
                first.append(row)
            of_row.append(first[entry])
            texts.append(text if new else None)
        yield batch.assign(of_row=of_row, text=texts)
        if table.bytes > TABLE_BYTES:
            table, first = OpenTable(), []


CLASSED = "of_row long, class_row long"


def _classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One table per bucket; records come sorted by bucket. A class is named by its first record."""
    bucket, table, first = None, OpenTable(), []
    for batch in batches:
        named = []
        for b, key, text, row in zip(*(batch[c].tolist() for c in ("bucket", "hash", "text", "of_row")), strict=True):
            if b != bucket:
                bucket, table, first = b, OpenTable(), []
            entry = table.put(key, text)
            if entry == len(first):
                first.append(row)
            named.append(first[entry])
        yield pd.DataFrame({"of_row": batch["of_row"], "class_row": named})


def _partition(records: DataFrame, limit: int) -> DataFrame:
    """Records with a bucket whose different texts fit the table; oversized ones are split again and again."""
    size = F.length("text") + 64
    total = records.agg(F.sum(size)).first()[0] or 0
    count = max(width(records), -(-total // limit))
    fits: list[DataFrame] = []
    rest, level = records.withColumn("bucket", F.pmod("hash", F.lit(count)).cast("string")), 0
    while True:
        sizes = rest.groupBy("bucket", "hash").agg(F.max(size).alias("b")).groupBy("bucket").agg(F.sum("b").alias("b"), F.count("*").alias("texts"))
        over = sizes.where((F.col("b") > limit) & (F.col("texts") > 1)).select("bucket")
        if over.isEmpty():
            fits.append(rest)
            break
        fits.append(rest.join(over, "bucket", "left_anti"))
        level += 1
        digit = F.pmod(F.xxhash64("hash", F.lit(level)), F.lit(FAN_OUT))
        again = rest.join(over, "bucket", "left_semi").withColumn("bucket", F.concat_ws(".", "bucket", digit))
        rest = materialise(again, f"dedup-spill-{level}")
    out = fits[0]
    for frame in fits[1:]:
        out = out.unionByName(frame)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept and text_sha256 of the text with white space folded."""
    text = F.regexp_replace(text_of(text_col), BLANKS, " ")
    keyed = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).isNull().alias("none"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), text.alias("text"))
    keyed = keyed.select("row_id", "none", "id", F.sha2("text", 256).alias("sha"), F.xxhash64("text").alias("hash"), "text")
    spilled = Written(keyed.mapInPandas(_fold, FOLDED), "dedup-spill-0")
    folded = spilled.rows
    members = materialise(folded.select("row_id", "none", "id", "sha", "of_row"), "dedup-members")
    lows = members.groupBy("of_row").agg(F.min(F.struct("none", "id", "row_id")).alias("low"), F.count("*").alias("n"))
    records = folded.where(F.col("text").isNotNull()).select("of_row", "hash", "text")
    bucketed = _partition(records, table_bytes).repartition("bucket").sortWithinPartitions("bucket")
    classes = materialise(bucketed.mapInPandas(_classes, CLASSED), "dedup-classes")
    spilled.clear()
    # a class has one record per task at most, so these joins stay small whatever is hot
    facts = classes.join(lows, "of_row").groupBy("class_row").agg(F.min("low").alias("low"), F.sum("n").alias("n"))
    found = classes.join(facts, "class_row").select("of_row", "low", "n")
    return members.join(found, "of_row").select(
        F.when(~F.col("none"), F.col("id")).alias("doc_id"),
        F.when(~F.col("low.none"), F.col("low.id")).alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row_id") == F.col("low.row_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
