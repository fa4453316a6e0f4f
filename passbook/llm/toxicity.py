"""Operator 9: toxicity by a subsequence string-kernel SVM with Nyström landmarks.

Kernel: two words are as alike as the weighted subsequences of four letters that they share; a
subsequence may have gaps up to a span of six and counts less the wider it is. Marks that are no
letters are skipped and single letters in a row are joined, so words with inserted characters, gaps or
separators keep most of their subsequences. The kernel of a sentence is its best word's.

Training: the labelled sentences of the training fold, each different sentence once (a sentence that
also stands in a clean document is clean). Words that toxic sentences hold far more often than chance
are the witnesses; frequent words of clean sentences, and in later rounds those that score highest, are
the other class. Landmarks are picked by pivoted Cholesky; the SVM (squared hinge) is linear in the
Nyström features, and as the kernel has explicit features it folds into one weight per subsequence.
A document's evidence is its best and second best word and the sum over all its words above 0; a
logistic calibration on labelled rows of the training fold makes the score of it.

What is fitted on is bounded: FIT_ROWS labelled rows, chosen by a hash of their id; of their words
WITNESSES, OTHERS and HARD; CALIBRATION rows for the last step. Every row is scored.

Null text counts as empty and scores by the calibration alone. A null id is never held out nor
labelled. Several labels of one id count as toxic if one does. Repeated rows repeat. Extra columns are
not read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.llm.common import Written, materialise, text_of

#: Letters of a subsequence, its widest span, and the weight of each further place.
LETTERS, SPAN, DECAY = 4, 6, 0.7
#: Gain of a witness that is worth a margin of 1.
SURE = 50.0
#: Longest piece of a word that is scored at once; longer words are scored in overlapping pieces.
PIECE = 24
#: Labelled rows fitted on: a sample of bounded size, so it can be broadcast and no text moves to meet it.
FIT_ROWS = 30_000
#: Words fitted on: witnesses, other words, hard words added per round; rounds; landmarks; SVM cost.
WITNESSES, OTHERS, HARD, ROUNDS, LANDMARKS, COST = 3000, 20_000, 4000, 2, 160, 10.0
#: Scores are kept within LIMIT; words below FLOOR are no evidence; labelled rows that calibration is fitted on.
LIMIT, FLOOR, CALIBRATION = 3.0, -0.5, 20_000
#: Words whose scores a worker keeps.
CACHED_WORDS = 1_000_000

SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
APART = re.compile(r"(?<!\S)(?:\w\s){2,}\w(?!\S)")
OFFSETS = np.array([(0, b, c, d) for b in range(1, SPAN) for c in range(b + 1, SPAN) for d in range(c + 1, SPAN)])
WEIGHTS = DECAY ** (OFFSETS[:, 3] - 3).astype(float)


_table: list[np.ndarray] = []
#: Classes of letters: a to z, other letters by their code, and the end mark.
BASE, MARK = 64, 63


def _letters() -> np.ndarray:
    """The class of each character: 1 to 26 for a to z, 27 to 58 for other letters, 0 for all else."""
    if not _table:
        wide = np.full(0x110000, 0, np.int64)
        for code in range(0x3000):
            if chr(code).isalpha():
                wide[code] = code - 96 if 97 <= code <= 122 else 27 + code % 32
        wide[0x3000:] = 27 + np.arange(0x3000, 0x110000) % 32
        _table.append(wide)
    return _table[0]


def units(text: str) -> list[str]:
    """Words of a text, in lower case; single letters in a row count as one word."""
    text = text.lower()
    found = text.split()
    return found + ["".join(m.split()) for m in APART.findall(text)]


def _flat(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all words between end marks, and the word each belongs to."""
    codes = np.frombuffer("\x00".join(["", *words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    mark = codes == 0
    letters = _letters()[codes]
    letters[mark] = MARK
    word = np.cumsum(mark) - 1
    keep = letters > 0
    return letters[keep], word[keep]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Subsequences of each word: word, code and weight; weights of a word have length one."""
    letters, word = _flat(words)
    # every mark ends one word and starts the next one
    first, code, weight = [], [], []
    where = np.arange(len(letters))
    is_mark = letters == MARK
    ends = np.cumsum(is_mark) - is_mark  # marks before a place
    for (_, b, c, d), w in zip(OFFSETS, WEIGHTS, strict=True):
        at = where[: max(0, len(letters) - d)]
        ok = ends[at + d] - ends[at] <= is_mark[at]
        at = at[ok]
        code.append(((letters[at] * BASE + letters[at + b]) * BASE + letters[at + c]) * BASE + letters[at + d])
        first.append(word[at])
        weight.append(np.full(len(at), w))
    first, code, weight = np.concatenate(first), np.concatenate(code), np.concatenate(weight)
    norm = np.sqrt(np.maximum(np.bincount(first, weight * weight, minlength=len(words)), 1e-9))
    return first, code, weight / norm[first]


def dense(words: list[str], codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Words by the subsequences in codes (default: all that occur)."""
    first, code, weight = features(words)
    codes = np.unique(code) if codes is None else codes
    at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
    ok = codes[at] == code
    out = np.zeros((len(words), len(codes)), np.float32)
    np.add.at(out, (first[ok], at[ok]), weight[ok])
    return out, codes


def pieces(word: str) -> list[str]:
    return [word] if len(word) <= PIECE else [word[i : i + PIECE] for i in range(0, len(word) - PIECE // 2, PIECE // 2)]


class Machine:
    """Weights of the subsequences that landmarks hold, and a bias."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray, bias: float):
        self.codes, self.weights, self.bias = codes, weights, bias
        self.held = np.zeros(1 << 20, bool)  # most subsequences have no weight; this tells quickly
        self.held[self._slot(codes)] = True

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return (codes ^ (codes >> 11)) & ((1 << 20) - 1)

    def words(self, words: list[str]) -> np.ndarray:
        """Scores of words."""
        parts = [(i, p) for i, w in enumerate(words) for p in pieces(w)]
        first, code, weight = features([p for _, p in parts])
        hit = np.flatnonzero(self.held[self._slot(code)])
        at = np.minimum(np.searchsorted(self.codes, code[hit]), len(self.codes) - 1)
        value = np.where(self.codes[at] == code[hit], self.weights[at], 0.0)
        score = np.bincount(first[hit], weight[hit] * value, minlength=len(parts)) + self.bias
        out = np.full(len(words), -LIMIT)
        np.maximum.at(out, [i for i, _ in parts], score)
        return np.clip(out, -LIMIT, LIMIT)


def landmarks(x: np.ndarray, count: int) -> list[int]:
    """Rows picked by pivoted Cholesky of the kernel: each next one is the worst explained so far."""
    left = (x * x).sum(1).astype(float)
    basis = np.zeros((0, len(x)))
    picked: list[int] = []
    for _ in range(min(count, len(x))):
        k = int(left.argmax())
        if left[k] < 1e-3:
            break
        picked.append(k)
        row = (x @ x[k] - basis.T @ basis[:, k]) / np.sqrt(left[k])
        basis = np.vstack([basis, row])
        left = np.maximum(left - row * row, 0)
    return picked


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, margin: np.ndarray, cost: float = COST, steps: int = 30) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss and a margin per row, by Newton steps on the active rows."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        active = y * (x @ w) < margin
        c = cost * weight[active]
        a = x[active]
        new = np.linalg.solve(ridge + (a * c[:, None]).T @ a, a.T @ (c * (y * margin)[active]))
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


def fit(toxic: list[tuple[str, float, float]], clean: list[tuple[str, float]]) -> Machine:
    """The machine from weighted words of both classes; toxic ones have a margin too."""
    names = [w[:PIECE] for w, _, _ in toxic] + [w[:PIECE] for w, _ in clean]
    y = np.r_[np.ones(len(toxic)), -np.ones(len(clean))]
    weight = np.array([k for _, k, _ in toxic] + [k for _, k in clean], float)
    margin = np.array([m for _, _, m in toxic] + [1.0] * len(clean))
    weight[y > 0] *= 0.5 * len(y) / weight[y > 0].sum()
    weight[y < 0] *= 0.5 * len(y) / weight[y < 0].sum()
    good, codes = dense(names[: len(toxic)])
    chosen = landmarks(good, LANDMARKS * 3 // 4)
    marks = [names[i] for i in chosen]
    other = names[len(toxic) : len(toxic) + 2000]
    if other:
        bad, _ = dense(other)
        marks += [other[i] for i in landmarks(bad, LANDMARKS // 4)]
    base, codes = dense(marks)
    gram = base @ base.T
    value, vector = np.linalg.eigh(gram.astype(float) + 1e-6 * np.eye(len(marks)))
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-4))) @ vector.T
    mapped = np.vstack([dense(names[i : i + 2000], codes)[0] @ base.T for i in range(0, len(names), 2000)]) @ root
    w, bias = svm(mapped, y, weight / weight.mean(), margin)
    return Machine(codes, base.T @ (root @ w), bias)


def labelled_sentences(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(sentence, toxic) of the fitted rows of the training fold, each different sentence once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).where(~held_out())
    sample = _marked(labels).where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    rows = rows.join(F.broadcast(sample), "doc_id").select("text", "toxic")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            split = [(s, y) for t, y in zip(batch["text"], batch["toxic"], strict=True) for s in SENTENCE.split(t) if s]
            yield pd.DataFrame(split, columns=["sentence", "toxic"])

    return rows.mapInPandas(run, "sentence string, toxic int").groupBy("sentence").agg(F.min("toxic").alias("toxic"))


def word_counts(sentences: DataFrame) -> DataFrame:
    """(word, toxic, clean): in how many sentences of either class a word stands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count: dict[str, list[int]] = {}

        def flush() -> pd.DataFrame:
            return pd.DataFrame([(w, *c) for w, c in count.items()], columns=["word", "toxic", "clean"])

        for batch in batches:
            for s, y in zip(batch["sentence"], batch["toxic"], strict=True):
                for w in {w.strip(".,;:!?\"'()") for w in units(s)}:
                    count.setdefault(w, [0, 0])[0 if y else 1] += 1
            if len(count) > CACHED_WORDS:
                yield flush()
                count.clear()
        yield flush()

    counted = sentences.mapInPandas(run, "word string, toxic long, clean long")
    return counted.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("length(word) between 3 and 64")


def train(docs: DataFrame, labels: DataFrame) -> Machine | None:
    """The machine of the training fold; none if no word is a witness."""
    written = Written(labelled_sentences(docs, labels), "toxic-sentences")
    counts = materialise(word_counts(written.rows), "toxic-words")
    total = written.rows.agg(F.sum("toxic"), F.count("*")).first()
    written.clear()
    n_words = max(counts.count(), 1)
    rate = min(max((total[0] or 0) / max(total[1], 1), 1e-3), 0.5)
    gain = F.col("toxic") * float(np.log(0.98 / rate)) + F.col("clean") * float(np.log(0.02 / (1 - rate)))
    found = counts.withColumn("gain", gain)
    witness = found.where(F.col("gain") > float(np.log(n_words))).orderBy(F.desc("gain"), "word").limit(WITNESSES).collect()
    if not witness:
        witness = found.where(F.col("gain") > 4.0).orderBy(F.desc("gain"), "word").limit(20).collect()
    if not witness:
        return None
    toxic = [(r["word"], float(np.log1p(r["toxic"])), min(max(r["gain"] / SURE, 0.5), 2.0)) for r in witness]
    both = [(r["word"], float(r["clean"])) for r in witness if r["clean"]]
    clean_rows = counts.where("clean > toxic")
    others = {r["word"]: 1.0 for r in clean_rows.orderBy(F.desc("clean"), "word").limit(OTHERS // 2).collect()}
    others |= {r["word"]: 1.0 for r in clean_rows.orderBy(F.xxhash64("word"), "word").limit(OTHERS // 2).collect()}
    machine = fit(toxic, [*both, *others.items()])
    for _ in range(ROUNDS):
        hard = _scored_words(clean_rows, machine).orderBy(F.desc("score"), "word").limit(HARD).collect()
        others |= {r["word"]: 1.0 for r in hard if r["score"] > -1}
        machine = fit(toxic, [*both, *others.items()])
    return machine


def _scored_words(counts: DataFrame, machine: Machine) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"word": batch["word"], "score": machine.words(batch["word"].tolist())})

    return counts.select("word").mapInPandas(run, "word string, score double")


def held_out() -> Column:
    """The fold that never trains."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def text_scores(machine: Machine, texts: list[str], cache: dict[str, float]) -> list[tuple[float, float, float]]:
    """Of each text: scores of its best and second best different words, and the sum of all above 0."""
    split = [set(units(t)) for t in texts]
    new = list(set().union(*split) - cache.keys())
    if len(cache) > CACHED_WORDS:
        cache.clear()
        new = list(set().union(*split))
    for i in range(0, len(new), 50_000):
        part = new[i : i + 50_000]
        cache.update(zip(part, machine.words(part).tolist(), strict=True))
    out = []
    for ws in split:
        found = [x for w in ws if (x := cache[w]) > FLOOR]
        best = heapq.nlargest(2, found)
        out.append((*best, *[FLOOR] * (2 - len(best)), float(np.log1p(sum(x for x in found if x > 0)))))
    return out


def evidence(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, best, second, total) of every row."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, float] = {}
        for batch in batches:
            texts, out, group, size = batch["_text"].tolist(), [], [], 0
            for t in texts:
                group.append(t)
                size += len(t)
                if size > 4 << 20:
                    out += text_scores(machine, group, cache)
                    group, size = [], 0
            out += text_scores(machine, group, cache)
            frame = pd.DataFrame(out, columns=["best", "second", "total"])
            frame.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield frame

    return docs.select("doc_id", text_of().alias("_text")).mapInPandas(run, f"doc_id {kind}, best double, second double, total double")


def calibrated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the offset."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1.0] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1) and predicted."""
    machine = train(docs, labels) or Machine(np.zeros(1, np.int64), np.zeros(1), FLOOR)
    found = materialise(evidence(docs, machine), "toxic-evidence")
    seen = found.where(~held_out()).join(_marked(labels), "doc_id").select("best", "second", "total", "toxic", F.xxhash64("doc_id").alias("h"))
    rows = seen.orderBy("h", "best", "second", "total").limit(CALIBRATION).collect()
    w = calibrated(np.array([r[:3] for r in rows]), np.array([float(r["toxic"]) for r in rows])) if rows else np.zeros(4)
    margin = F.col("best") * float(w[0]) + F.col("second") * float(w[1]) + F.col("total") * float(w[2]) + float(w[3])
    score = 1 / (1 + F.exp(-margin))
    return found.select("doc_id", held_out().alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def _marked(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
