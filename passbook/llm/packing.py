"""Operator 4: conflict-constrained best-fit packing.

Documents are dealt into shards of bounded length by a hash of their id; each shard is packed on its
own. Bins stand in order of what is left in them, each with one bitmap of the sources and one of the
duplicate clusters it holds. A document goes, longest first, to the tightest bin that it fits and
that holds neither its source nor its cluster: the search steps from residual to residual until such
a bin is found, else a new bin opens.

A document longer than a bin is cut into pieces: full ones fill bins of their own, the rest is
packed. Every document has an end mark, so the length of an empty or null text is 1. A null source
or cluster conflicts with nothing. Rows of one id are packed as separate documents. Extra columns are
not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.llm.common import BLANKS, materialise, text_of

#: Length of a bin, in words with one end mark per document, and the mean length of a shard.
CAPACITY, SHARD = 2048, 1 << 20
PACKED = "doc_id long, shard long, bin long, piece int, start long, length long"


class Bins:
    """Open bins by residual; within a residual by number."""

    def __init__(self, capacity: int):
        self.capacity, self.count = capacity, 0
        self.residuals: list[int] = []
        self.at: dict[int, list[int]] = {}
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def place(self, length: int, source: int, cluster: int) -> int:
        """The bin for a document; source and cluster are single-bit masks, 0 where nothing conflicts."""
        k = bisect_left(self.residuals, length)
        while k < len(self.residuals):
            left = self.residuals[k]
            bins = self.at[left]
            for j, number in enumerate(bins):
                if not (self.sources[number] & source or self.clusters[number] & cluster):
                    bins.pop(j)
                    if not bins:
                        del self.at[left], self.residuals[k]
                    self._hold(number, left - length, source, cluster)
                    return number
            k += 1
        self.sources.append(0)
        self.clusters.append(0)
        self.count += 1
        self._hold(self.count - 1, self.capacity - length, source, cluster)
        return self.count - 1

    def _hold(self, number: int, left: int, source: int, cluster: int) -> None:
        self.sources[number] |= source
        self.clusters[number] |= cluster
        if left:
            if left not in self.at:
                insort(self.residuals, left)
                self.at[left] = []
            insort(self.at[left], number)


def _bits(values: pd.Series) -> list[int]:
    """A bit for each value that occurs more than once; others cannot conflict."""
    counts = values.value_counts()
    bit = {v: 1 << i for i, v in enumerate(sorted(counts[counts > 1].index))}
    return [bit.get(v, 0) for v in values]


def pack_shard(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Packs one shard; rows have doc_id, length, source, cluster and shard."""
    rows = rows.assign(full=rows["length"] // capacity, rest=rows["length"] % capacity)
    rows = rows.sort_values(["rest", "doc_id", "length"], ascending=[False, True, True], kind="stable", na_position="last")
    bins, out, solid = Bins(capacity), [], []
    for doc, shard, full, rest, source, cluster in zip(rows["doc_id"], rows["shard"], rows["full"], rows["rest"], _bits(rows["source"]), _bits(rows["cluster"]), strict=True):
        if rest:
            out.append((doc, shard, bins.place(rest, source, cluster), full, full * capacity, rest))
        solid.extend((doc, shard, piece) for piece in range(full))
    out += [(doc, shard, bins.count + i, piece, piece * capacity, capacity) for i, (doc, shard, piece) in enumerate(solid)]
    return pd.DataFrame(out, columns=["doc_id", "shard", "bin", "piece", "start", "length"])


def words_and_mark(col: str = "text") -> Column:
    """Number of words of a text, plus one for the end mark."""
    body = F.regexp_replace(F.regexp_replace(text_of(col), BLANKS, " "), "^ | $", "")
    return F.when(body == "", 1).otherwise(F.length(body) - F.length(F.replace(body, F.lit(" "))) + 2).cast("long")


def pack(docs: DataFrame, length: Column, source: Column, cluster: Column, id_col: str = "doc_id", capacity: int = CAPACITY, shard_length: int = SHARD) -> DataFrame:
    """Per piece: doc_id, shard, bin (within the shard), piece, start and length."""
    items = docs.select(F.col(id_col).cast("long").alias("doc_id"), length.cast("long").alias("length"), source.cast("string").alias("source"), cluster.cast("string").alias("cluster"))
    items = materialise(items, "packing-items")  # lengths and clusters, no texts
    total = items.agg(F.sum("length")).first()[0] or 0
    shards = max(1, -(-total // shard_length))
    # long documents and copies must not gather: the hash covers more than the id alone
    items = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "length", "cluster"), F.lit(shards)))
    return items.groupBy("shard").applyInPandas(lambda rows: pack_shard(rows, capacity), PACKED)


def text_cluster(col: str = "text") -> Column:
    """Cluster of exact copies up to white space and case; empty texts have none."""
    body = F.lower(F.regexp_replace(text_of(col), BLANKS, " "))
    return F.when(F.trim(body) != "", F.sha2(body, 256))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Documents packed by words; no bin holds a source or a cluster of copies twice."""
    return pack(docs, words_and_mark(), F.col("source"), text_cluster(), capacity=capacity)
