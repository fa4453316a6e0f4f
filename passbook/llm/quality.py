"""Operator 1: quality by co-training of a text view and a metadata view.

Each view has its own features and its own additive logistic model (features are cut into steps). They
start from the labelled rows of the training fold. In each round either model scores all rows without
a label, and its most confident ones, good and bad, are added with their pseudo-labels to what the
other model learns from. At the end each view is calibrated on labelled rows that neither was fitted
on, and the calibrated views are combined into the score of every document.

The rows fitted on are bounded by FIT_ROWS labelled ones and PER_ROUND pseudo-labels per round; which
rows get pseudo-labels is decided over the whole table.

Null text counts as empty, null metadata as a value of its own. Null ids are scored, never labelled.
Several labels of one id count as good only if all are. Repeated rows repeat. Extra columns are not
read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.llm.common import materialise, text_of

#: Labelled rows fitted on, rounds, pseudo-labels per round and view, steps per feature, buckets of names.
FIT_ROWS, ROUNDS, PER_ROUND, STEPS, BUCKETS = 20_000, 3, 400, 12, 128
UPPER = bytes(range(65, 91))
LETTER = UPPER + bytes(range(97, 123))
DIGIT = b"0123456789"
MARKS = b"!#$%&*@^~|_<>{}[]\\/=+"
HIGH = bytes(range(128, 256))
TEXT_FEATURES = 14


def text_features(text: str) -> tuple[float, ...]:
    """Shape of a text: size, character classes, repetition of words, word pairs and lines."""
    data = text.encode("utf-8", "replace")
    size = max(len(data), 1)
    without = lambda drop: len(data) - len(data.translate(None, drop))
    words = text.split()
    n = max(len(words), 1)
    count = Counter(words)
    lines = text.split("\n")
    upper, letters = without(UPPER), without(LETTER)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return (
        float(np.log1p(len(words))),
        len(text) / n,
        upper / max(letters, 1),
        without(DIGIT) / size,
        without(MARKS) / size,
        without(b"!") / n,
        without(b".,;:") / n,
        len(count) / n,
        max(count.values(), default=0) / n,
        repeats / n,
        len(set(lines)) / max(len(lines), 1),
        len(lines) / n,
        without(HIGH) / size,
        max(map(len, words), default=0) / 16.0,
    )


def bucket(name: str | None, kind: str) -> int:
    return zlib.crc32(f"{kind}={name}".encode()) % BUCKETS


class View:
    """An additive logistic model over numbers cut into steps, and over named buckets."""

    def __init__(self, numbers: np.ndarray, names: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        cuts = np.linspace(0, 1, STEPS + 1)[1:-1]
        self.steps = [np.unique(np.quantile(numbers[:, k], cuts)) for k in range(numbers.shape[1])]
        x = self._wide(numbers, names)
        balance = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
        self.w = np.zeros(x.shape[1])
        penalty = np.full(x.shape[1], ridge)
        penalty[-1] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ self.w, -30, 30)))
            h = (x * (balance * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
            step = np.linalg.solve(h, x.T @ (balance * (p - y)) + penalty * self.w)
            self.w -= step
            if np.abs(step).max() < 1e-6:
                break

    def _wide(self, numbers: np.ndarray, names: np.ndarray) -> np.ndarray:
        columns = [numbers[:, k, None] > s[None, :] for k, s in enumerate(self.steps) if len(s)]
        columns += [names[:, k, None] == np.arange(BUCKETS)[None, :] for k in range(names.shape[1])]
        return np.hstack([*columns, np.ones((len(numbers), 1))]).astype(np.float64)

    def margin(self, numbers: np.ndarray, names: np.ndarray) -> np.ndarray:
        return np.clip(self._wide(numbers, names) @ self.w, -20, 20)


FEATURES = "doc_id long, text array<float>, meta array<float>, names array<int>"


def features(docs: DataFrame) -> DataFrame:
    """Both views' features of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            meta = [[float(np.log1p(max(c, 0)))] for c in batch["n_chars"].tolist()]
            names = [[bucket(s, "source"), bucket(g, "lang")] for s, g in zip(batch["source"], batch["lang"], strict=True)]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text": [text_features(t) for t in batch["text"]], "meta": meta, "names": names})

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.coalesce(F.col("n_chars").cast("long"), F.lit(0)).alias("n_chars"), "source", "lang")
    return source.mapInPandas(run, FEATURES)


def _arrays(rows: list) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    none = np.zeros((len(rows), 0), int)
    text = np.array([r["text"] for r in rows], float).reshape(len(rows), TEXT_FEATURES)
    meta = np.array([r["meta"] for r in rows], float).reshape(len(rows), 1)
    return {"text": (text, none), "meta": (meta, np.array([r["names"] for r in rows], int).reshape(len(rows), 2))}


def scored(rows: DataFrame, views: dict[str, View]) -> DataFrame:
    """Margins of both views beside the features."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                found = _arrays(batch[["text", "meta", "names"]].to_dict("records"))
                yield batch.assign(doc_id=batch["doc_id"].astype("Int64"), m_text=views["text"].margin(*found["text"]), m_meta=views["meta"].margin(*found["meta"]))

    return rows.select("doc_id", "text", "meta", "names").mapInPandas(run, FEATURES + ", m_text double, m_meta double")


def fold() -> Column:
    """0: held out for tests, 1: calibration, 2 to 4: fitting; null ids have none."""
    return F.crc32(F.col("doc_id").cast("string")) % 5


def stacked(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights of the calibrated views and an offset."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.array([0.5] * (x.shape[1] - 1) + [0.0]), np.diag([0.1] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1, higher is better), predicted and kept."""
    rows = materialise(features(docs), "quality-features")
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("y"))
    known = rows.join(marked, "doc_id")
    order = (F.xxhash64("doc_id"), "doc_id")
    fit = known.where(fold() > 1).orderBy(*order).limit(FIT_ROWS).collect()
    tune = known.where(fold() == 1).orderBy(*order).limit(FIT_ROWS).collect()
    ys = {r["y"] for r in fit}
    score = F.lit(float(np.mean([r["y"] for r in fit])) if fit else 0.5)
    if len(ys) == 2:
        pools = {view: [(r, r["y"]) for r in fit] for view in ("text", "meta")}
        unlabelled = rows.join(marked.select("doc_id"), "doc_id", "left_anti").where("doc_id is not null")
        share = float(np.mean([r["y"] for r in fit]))
        n_good = max(1, round(PER_ROUND * share))
        taken: set[int] = set()
        for round_ in range(ROUNDS + 1):
            views = {v: View(*_arrays([r for r, _ in pool])[v], np.array([y for _, y in pool], float)) for v, pool in pools.items()}
            if round_ == ROUNDS:
                break
            found = materialise(scored(unlabelled, views), f"quality-round-{round_}")
            for view, other in (("text", "meta"), ("meta", "text")):
                for label, count, by in ((1, n_good, F.desc(f"m_{view}")), (0, PER_ROUND - n_good, F.asc(f"m_{view}"))):
                    sure = found.where((F.col(f"m_{view}") > 0) == F.lit(bool(label)))
                    best = sure.orderBy(by, *order).limit(count + len(taken)).collect()
                    new = [r for r in best if r["doc_id"] not in taken][:count]
                    taken |= {r["doc_id"] for r in new}
                    pools[other] += [(r, label) for r in new]
        base = tune if len({r["y"] for r in tune}) == 2 else fit
        held = _arrays(base)
        w = stacked(np.column_stack([views[v].margin(*held[v]) for v in ("text", "meta")]), np.array([r["y"] for r in base], float))
        rows = scored(rows, views)
        score = 1 / (1 + F.exp(-(F.col("m_text") * float(w[0]) + F.col("m_meta") * float(w[1]) + float(w[2]))))
    predicted = (score >= 0.5).cast("int")
    return rows.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), score.alias("score"), predicted.alias("predicted"), (predicted == 1).alias("kept"))
