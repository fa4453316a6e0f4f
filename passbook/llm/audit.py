"""Operator 12: what each filter removes, in every order in which the filters could run.

A document is one bit mask of the filters it fails, so a corpus is a few weighted masks per part.
Masks and orders meet as matrices: F (masks x filters) is 0 where a mask fails a filter, else without
bound; P (orders x filters) is the inverse permutation, the step at which an order runs a filter.
Their min-plus product, min over f of F[m, f] + P[o, f], is the step at which order o removes mask m.
These steps scatter the weights of the masks into (order, step) cells: removed and lost documents. A
mask that fails the filter of a later cell than its own is redundant there.

Masks are worked out with column expressions. Equal texts fold by SHA-256 before they are shuffled;
of those only counts and smallest ids travel, so a text that a third of all rows share is one row
per task. The matrices are as small as the filters are few and never see a document.

Null texts are empty: they fail A, and share E with other empty texts. A null lang counts as the
empty string. A row without doc_id is neither smaller nor larger than others, so it never fails E nor
makes others fail it, and has no labels. Rows of one id and text fail E only where a smaller id has
that text. Several labels of one document count as one with the largest values. An empty table has no
parts and no rows. Only doc_id, text and lang are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passbook.llm.common import BLANKS, text_of

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 3
MARKS = r"[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
AUDIT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def text_mask() -> Column:
    """Bits 0 to 3: the filters A to D that the columns ``text`` and ``words`` fail."""
    capitals = F.length("text") - F.length(F.translate("text", CAPITALS, ""))
    fails = (
        F.size("words") < MIN_WORDS,
        F.size(F.array_distinct("words")) * 100 < F.size("words") * DISTINCT_PERCENT,
        capitals * 100 > F.length("text") * CAPITAL_PERCENT,
        F.col("text").rlike(MARKS),
    )
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail, one row per part and mask."""
    rows = (
        docs.select("doc_id", text_of().alias("text"), F.coalesce("lang", F.lit("")).alias("part"))
        .withColumn("words", F.filter(F.split("text", BLANKS), lambda w: w != ""))
        .select("doc_id", "part", text_mask().alias("bits"), F.when(F.col("doc_id").isNotNull(), F.unhex(F.sha2("text", 256))).alias("sha"))
        .groupBy("doc_id", "sha", "part", "bits")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    flags = labels.groupBy("doc_id").agg(*(F.max((F.col(c) == 1).cast("int")).alias(c) for c in ("quality", "toxic")))
    flags = flags.where("doc_id is not null")
    known = rows.join(flags, "doc_id", "left").select(
        "doc_id", "sha", "part", "bits", "n", *((F.coalesce(c, F.lit(0)) * F.col("n")).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic")))
    )
    # rows of one text: all of them, and those of the smallest id, which pass E
    weights = ("n", "good", "toxic")
    texts = known.groupBy("sha", "part", "bits").agg(
        *(F.sum(c).alias(c) for c in weights), F.min(F.struct("doc_id", *weights)).alias("first")
    )
    # a window, not a join, so texts are read once; it sees one row per text, part and mask
    placed = texts.withColumn("low", F.min("first.doc_id").over(Window.partitionBy("sha")))
    passes = F.col("sha").isNull() | (F.col("first.doc_id") == F.col("low"))
    own = lambda c: F.when(F.col("sha").isNull(), F.col(c)).when(passes, F.col(f"first.{c}")).otherwise(F.lit(0))
    split = placed.select(
        "part",
        F.explode(
            F.array(
                F.struct(F.col("bits").alias("mask"), *(own(c).alias(c) for c in weights)),
                F.struct((F.col("bits") + (1 << 4)).alias("mask"), *((F.col(c) - own(c)).alias(c) for c in weights)),
            )
        ).alias("m"),
    ).select("part", "m.*")
    return split.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in weights)).where("n > 0")


def removal_steps(filters: int = len(FILTERS)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Orders (orders x steps, filter numbers), failing filters (masks x filters) and the step at which
    each order removes each mask (masks x orders, from 1; ``filters + 1`` where nothing does)."""
    orders = np.array(list(permutations(range(filters))), np.int64).reshape(-1, filters)
    positions = np.argsort(orders, axis=1) + 1
    fails = (np.arange(1 << filters)[:, None] >> np.arange(filters)) & 1 == 1
    costs = np.where(fails, 0, filters + 1)
    ranks = (costs[:, None, :] + positions[None, :, :]).min(axis=2) if filters else np.ones((1, 1), np.int64)
    return orders, fails, np.minimum(ranks, filters + 1)


def audit_part(weights: np.ndarray, filters: int = len(FILTERS)) -> np.ndarray:
    """(orders, steps, 7) counts of a part from the weights (masks x 3) of its documents, good and toxic ones."""
    orders, fails, ranks = removal_steps(filters)
    count = len(orders)
    cells = np.zeros((count, filters + 2, 3), np.int64)  # by order and removal step
    np.add.at(cells, (np.arange(count)[None, :], ranks), weights[:, None, :])
    removed = cells[:, 1 : filters + 1, :]
    docs = removed[..., 0]
    out = np.zeros((count, filters, 7), np.int64)
    out[..., 0] = weights[:, 0].sum() - np.cumsum(docs, axis=1)
    out[..., 1] = docs
    steps = np.arange(1, filters + 1)
    late = fails[:, orders] & (ranks[:, :, None] < steps)  # masks x orders x steps: fails it, but is gone
    out[..., 2] = np.einsum("mos,m->os", late.astype(np.int64), weights[:, 0])
    out[..., 3] = weights[1 << orders, 0]
    out[..., 4:6] = removed[..., 1:]
    shares = np.zeros(filters, np.int64)
    np.add.at(shares, orders, docs)
    out[..., 6] = shares[orders]
    return out


def _audits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = np.array(list(FILTERS))
    orders = removal_steps()[0]
    texts = ["".join(names[o]) for o in orders]
    for rows in batches:
        for part, masks_, *weights in zip(rows["part"], rows["mask"], rows["n"], rows["good"], rows["toxic"], strict=True):
            table = np.zeros((1 << len(FILTERS), 3), np.int64)
            table[np.asarray(masks_, np.int64)] = np.stack([np.asarray(w, np.int64) for w in weights], axis=1)
            out = audit_part(table).reshape(-1, 7)
            columns = dict(zip(AUDIT.replace(" long", "").split(", ")[3:], out.T, strict=True))
            yield pd.DataFrame(
                {
                    "part": part,
                    "filter_order": np.repeat(texts, len(FILTERS)),
                    "step": np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(texts)),
                    **columns,
                }
            )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, with what the step's filter does there."""
    listed = masks(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))
    flat = listed.select("part", *(F.col(f"m.{c}").alias(c) for c in ("mask", "n", "good", "toxic")))
    return flat.mapInPandas(_audits, AUDIT)
