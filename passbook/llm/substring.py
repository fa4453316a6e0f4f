"""Operator 6: substring dedup by seed and extend.

Seeds: every run of 50 words selects one anchor, the least hash among its runs of 8 words (winnowing);
equal runs of 50 words select the same one. Each anchor travels with the stretch of consecutive runs
that select it and a hash of that stretch, so an anchor stands for all runs around it at once.
Join: anchors meet by hash. A stretch that also stands in a smaller document is a repeat as a whole.
Extension: where an anchor has several different stretches, only the first document of each is
extended word by word: all its runs of 50 words are compared in full (128 bits) with those of the
others. Runs that stand in a smaller document, joined, are the maximal repeats.

Rows travel packed, so an anchor that thousands of documents share costs bytes, not rows; tasks fold
equal stretches before the shuffle. Nothing is paired: each run only needs the smallest document that
holds it, so the work is linear in the number of words.

Null text has no words. Rows equal in id are the same document and do not repeat each other. A null id
counts as larger than all others. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passbook.llm import words
from passbook.llm.common import materialise, text_of, width

#: Words of a repeat and of an anchor.
WINDOW, ANCHOR = 50, 8
#: Characters of text that a task folds at once, and bytes of text in a bucket.
FOLD_CHARS, BUCKET_BYTES = 16 << 20, 16 << 20

SEED = np.dtype([("anchor", "u8"), ("stretch", "u8"), ("id", "i8"), ("key", "i8"), ("at", "i4"), ("n", "u1")])
RUN = np.dtype([("h1", "u8"), ("h2", "u8"), ("id", "i8"), ("key", "i8"), ("at", "i4")])
#: A stretch of n runs of one document; extend: not known to be a repeat yet.
FOUND = np.dtype([("key", "i8"), ("at", "i4"), ("n", "u1"), ("extend", "u1")])
#: kind 0: seeds or runs by hash; kind 1: findings by document.
PACKED = "part int, kind int, data binary"


def seeds_of(hashes: np.ndarray, others: np.ndarray, size: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Anchors of a document: hash, hash of its stretch, first run and number of runs. The second comes from the other word hashes."""
    count = len(hashes) - size + 1
    if count < 1:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    starts = np.arange(len(hashes) - anchor + 1)
    prefix = words.sums(hashes, words.RUN_BASE)
    grams = words.runs(prefix, starts, starts + anchor, words.RUN_BASE)
    chosen = np.lib.stride_tricks.sliding_window_view(grams, size - anchor + 1).argmin(axis=1) + np.arange(count)
    first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    n = np.diff(np.r_[first, count])
    stretch = words.runs(words.sums(others, words.RUN_BASE_2), first, first + n + size - 1, words.RUN_BASE_2)
    at = chosen[first]
    return grams[at], stretch ^ words.mix((at - first).astype(np.uint64) << np.uint64(32) | n.astype(np.uint64)), first, n


def _packed(part: int, kind: int, data: bytes) -> tuple[int, int, bytes]:
    return part, kind, data


def _found(rows: np.ndarray, extend: int) -> np.ndarray:
    out = np.zeros(len(rows), FOUND)
    out["key"], out["at"], out["extend"] = rows["key"], rows["at"], extend
    out["n"] = rows["n"] if "n" in rows.dtype.names else 1
    return out


def _by_document(rows: np.ndarray, parts: int) -> list[tuple[int, int, bytes]]:
    return [_packed(p, 1, data) for p, data in words.dealt(rows, rows["key"] % parts)]


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new group starts in sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _folded(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal stretches those of the smallest document, and the rest, which are repeats."""
    rows = rows[np.lexsort((rows["at"], rows["key"], rows["id"], rows["stretch"], rows["anchor"]))]
    new = _starts(rows["anchor"], rows["stretch"])
    low = rows["id"][np.flatnonzero(new)][np.cumsum(new) - 1] if len(rows) else rows["id"]
    least = rows["id"] == low
    return rows[least], rows[~least]


def _seed_rows(parts: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(held: list[np.ndarray]) -> pd.DataFrame:
            rows, repeats = _folded(np.concatenate(held))
            out = [_packed(p, 0, data) for p, data in words.dealt(rows, (rows["anchor"] % np.uint64(parts)).astype(np.int64))]
            return pd.DataFrame(out + _by_document(_found(repeats, 0), parts), columns=["part", "kind", "data"])

        held, chars = [], 0
        for batch in batches:
            for id_, key, text in zip(batch["id"].tolist(), batch["key"].tolist(), batch["text"].tolist(), strict=True):
                anchor, stretch, at, n = seeds_of(*(words.word_hashes(text.encode("utf-8", "replace"), key=k) for k in (0, 1)))
                rows = np.empty(len(anchor), SEED)
                rows["anchor"], rows["stretch"], rows["at"], rows["n"], rows["id"], rows["key"] = anchor, stretch, at, n, id_, key
                held.append(rows)
                chars += len(text)
                if chars >= FOLD_CHARS:
                    yield flush(held)
                    held, chars = [], 0
        if held:
            yield flush(held)

    return run


def _join_seeds(parts: int):
    """Anchors of one part: whole repeats, and stretches to extend."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows, repeats = _folded(words.unpacked(group["data"][group["kind"] == 0], SEED))
        out = [_packed(p, 1, bytes(d)) for p, k, d in group[["part", "kind", "data"]].itertuples(index=False) if k == 1]
        new = _starts(rows["anchor"])
        group_of = np.cumsum(new) - 1
        several = np.bincount(group_of[_starts(rows["anchor"], rows["stretch"])], minlength=int(new.sum())) > 1
        starts = np.flatnonzero(new)
        apart = np.minimum.reduceat(rows["id"], starts) != np.maximum.reduceat(rows["id"], starts) if len(starts) else several
        extend = rows[(several & apart)[group_of]] if len(rows) else rows
        return pd.DataFrame(out + _by_document(np.concatenate([_found(repeats, 0), _found(extend, 1)]), parts), columns=["part", "kind", "data"])

    return run


def _per_document(found: pd.DataFrame) -> dict[int, np.ndarray]:
    rows = words.unpacked(found["data"], FOUND)
    rows = rows[np.argsort(rows["key"], kind="stable")]
    if not len(rows):
        return {}
    cuts = np.flatnonzero(_starts(rows["key"]))
    return {int(rows["key"][a]): rows[a:b] for a, b in zip(cuts, [*cuts[1:], len(rows)], strict=True)}


def _extend(parts: int):
    """Runs of the stretches to extend, hashed in full."""

    def run(docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        held = [np.zeros(0, RUN)]
        of = _per_document(found)
        for id_, key, text in zip(docs["id"].tolist(), docs["key"].tolist(), docs["text"].tolist(), strict=True):
            mine = of.get(key)
            if mine is None or not (mine := mine[mine["extend"] == 1]).size:
                continue
            at = np.unique(np.repeat(mine["at"].astype(np.int64), mine["n"]) + np.arange(int(mine["n"].sum())) - np.repeat(np.cumsum(mine["n"].astype(np.int64)) - mine["n"], mine["n"]))
            rows = np.empty(len(at), RUN)
            for name, which, base in (("h1", 0, words.RUN_BASE), ("h2", 1, words.RUN_BASE_2)):
                hashes = words.word_hashes(text.encode("utf-8", "replace"), key=which)
                rows[name] = words.runs(words.sums(hashes, base), at, at + WINDOW, base)
            rows["at"], rows["id"], rows["key"] = at, id_, key
            held.append(rows)
        rows = np.concatenate(held)
        return pd.DataFrame([_packed(p, 0, data) for p, data in words.dealt(rows, (rows["h1"] % np.uint64(parts)).astype(np.int64))], columns=["part", "kind", "data"])

    return run


def _join_runs(parts: int):
    """Runs of one part that also stand in a smaller document."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = words.unpacked(group["data"], RUN)
        rows = rows[np.lexsort((rows["id"], rows["h2"], rows["h1"]))]
        new = _starts(rows["h1"], rows["h2"])
        low = rows["id"][np.flatnonzero(new)][np.cumsum(new) - 1] if len(rows) else rows["id"]
        return pd.DataFrame(_by_document(_found(rows[rows["id"] > low], 0), parts), columns=["part", "kind", "data"])

    return run


def removed_words(count: int, found: np.ndarray | None) -> np.ndarray:
    """Which words the repeats cover."""
    edge = np.zeros(count + 1, np.int64)
    if found is not None and len(found):
        np.add.at(edge, found["at"], 1)
        np.add.at(edge, found["at"] + found["n"].astype(np.int64) - 1 + WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """The documents of one bucket without their repeats."""
    of, out = _per_document(found), []
    for id_, none, key, text in zip(docs["id"].tolist(), docs["none"].tolist(), docs["key"].tolist(), docs["text"].tolist(), strict=True):
        data = text.encode("utf-8", "replace")
        _, starts, ends = words.spans(data)
        mine = of.get(key)
        gone = removed_words(len(starts), None if mine is None else mine[mine["extend"] == 0])
        keep = np.flatnonzero(~gone)
        kept = b" ".join([data[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)])
        out.append((id_, none, len(starts), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8")))
    return pd.DataFrame(out, columns=["id", "none", "n_words", "n_removed", "kept_sha256", "kept"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and, if with_text, the kept words."""
    top = F.lit((1 << 63) - 1)
    id_ = F.col(id_col).cast("long")
    source = docs.select(id_.isNull().alias("none"), F.coalesce(id_, top).alias("id"), text_of(text_col).alias("text"))
    source = source.withColumn("key", F.xxhash64("id", "text").bitwiseAND(top))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(width(docs), -(-size // BUCKET_BYTES))
    seeds = source.mapInPandas(_seed_rows(parts), PACKED)
    found = materialise(seeds.groupBy("part").applyInPandas(_join_seeds(parts), PACKED), "repeats")
    bucketed = source.withColumn("part", F.pmod("key", F.lit(parts)).cast("int"))
    runs = bucketed.groupBy("part").cogroup(found.groupBy("part")).applyInPandas(_extend(parts), PACKED)
    extended = runs.groupBy("part").applyInPandas(_join_runs(parts), PACKED)
    whole = found.unionByName(extended)
    cut = bucketed.groupBy("part").cogroup(whole.groupBy("part")).applyInPandas(_cut, "id long, none boolean, n_words long, n_removed long, kept_sha256 string, kept string")
    out = cut.select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept")
    return out if with_text else out.drop("kept")
