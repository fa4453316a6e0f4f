"""Operator 8: SentencePiece BPE by vectorised merge rounds.

The distinct words of a batch lie in flat symbol arrays. A round looks up every neighbouring pair,
takes the minimum rank of each word by a segmented minimum, merges the leftmost non-overlapping
pairs of that rank at once and compacts the arrays; words without a pair leave. A merge whose result
is part of a piece of the same or a better rank could change what comes next, so of those only the
leftmost of a word is done in a round. That makes the rounds equal to the library's one-by-one order.

Null text counts as empty; an empty text has the end id only and decodes to "". Repeated rows give
repeated results; other columns are not read.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passbook.llm.common import text_of

SPACE = "▁"
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
NONE = np.iinfo(np.int64).max
#: Words kept in a worker's cache and the longest of them: memory only, results are the same.
CACHED_WORDS, CACHED_LENGTH = 400_000, 64

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class PieceModel:
    """Vocabulary, ranks and valid pairs of a SentencePiece BPE model."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        byte = [sp.is_byte(i) for i in range(size)]
        plain = [i for i in range(size) if not (byte[i] or sp.is_control(i) or sp.is_unknown(i))]
        self.size, self.end, self.unknown = size, sp.eos_id(), sp.unk_id()
        self.byte_ids = np.zeros(256, np.int64)
        self.as_bytes = [b""] * size
        for i in range(size):
            if byte[i]:
                self.byte_ids[int(names[i][3:5], 16)] = i
                self.as_bytes[i] = bytes([int(names[i][3:5], 16)])
        for i in plain:
            self.as_bytes[i] = names[i].replace(SPACE, " ").encode()
        symbol = {names[i]: i for i in plain}
        for char in sorted({c for i in plain for c in names[i]} - symbol.keys()):
            symbol[char] = len(symbol) + size
        self.wide = size + len(symbol) + 1
        self.of_char = np.full(0x110000, -1, np.int64)
        for text, i in symbol.items():
            if len(text) == 1:
                self.of_char[ord(text)] = i
        scores = np.array([sp.get_score(i) for i in range(size)])
        order = np.unique(-scores, return_inverse=True)[1]
        self.rank = order.astype(np.int64)
        keys, results = [], []
        self.alone = np.zeros(size, bool)
        for i in plain:
            text, r = names[i], order[i]
            for cut in range(1, len(text)):
                left, right = symbol.get(text[:cut]), symbol.get(text[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.wide + right)
                    results.append(i)
            for a in range(len(text)):
                for b in range(a + 2, len(text) + 1):
                    part = symbol.get(text[a:b])
                    if part is not None and part != i and part < size and order[part] >= r:
                        self.alone[part] = True
        by = np.argsort(np.array(keys, np.int64))
        self.keys, self.results = np.array(keys, np.int64)[by], np.array(results, np.int64)[by]

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1."""
        key = np.where((left < 0) | (right < 0), -1, left * self.wide + right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.results[at], -1)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, by merge rounds over all of them together."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lengths = np.array([len(w) for w in words], np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        ids, place = self.of_char[chars], np.arange(len(chars))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        made = None
        while len(ids):
            new = np.r_[True, word[1:] != word[:-1]]
            if made is None:
                made = np.full(len(ids), -1, np.int64)
                near = np.flatnonzero(~new[1:])
                made[near] = self._merged(ids[near], ids[near + 1])
            rank = np.where(made >= 0, self.rank[made], NONE)
            starts = np.flatnonzero(new)
            least = np.minimum.reduceat(rank, starts)
            segment = np.cumsum(new) - 1
            open_ = (least < NONE)[segment]
            if not open_.all():
                done.append((word[~open_], ids[~open_], place[~open_]))
                word, ids, place, made, rank = (x[open_] for x in (word, ids, place, made, rank))
                if not len(ids):
                    break
                least = least[least < NONE]
                segment = np.cumsum(np.r_[False, word[1:] != word[:-1]])
            hit = rank == least[segment]
            at = np.flatnonzero(hit)
            run = np.r_[True, np.diff(at) > 1]  # candidates side by side overlap: every second one merges
            offset = at - at[np.flatnonzero(run)[np.cumsum(run) - 1]]
            first = np.r_[True, segment[at[1:]] != segment[at[:-1]]]
            at = at[(offset % 2 == 0) & (first | ~self.alone[made[at]])]
            ids[at] = made[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            changed = np.zeros(len(ids), bool)
            changed[at] = True
            word, ids, place, made, changed = (x[keep] for x in (word, ids, place, made, changed))
            changed[:-1] |= changed[1:]  # only pairs beside a merge are looked up anew
            at = np.flatnonzero(changed)
            made[at] = -1
            at = at[at + 1 < len(ids)]
            at = at[word[at] == word[at + 1]]
            made[at] = self._merged(ids[at], ids[at + 1])
        if not done:
            return [[] for _ in words]
        word, ids, place = (np.concatenate(x) for x in zip(*done, strict=True))
        by = np.argsort(place)
        word, ids, place = word[by], ids[by], place[by]
        odd = (ids < 0) | (ids >= self.size)
        if odd.any():  # characters outside the vocabulary fall back to their bytes
            spelled = {c: [int(self.byte_ids[b]) for b in chr(c).encode("utf-8", "replace")] for c in set(chars[place[odd]].tolist())}
            count = np.ones(len(ids), np.int64)
            count[odd] = [len(spelled[c]) for c in chars[place[odd]].tolist()]
            into = np.repeat(odd, count)
            word, ids = np.repeat(word, count), np.repeat(ids, count)
            ids[into] = [b for c in chars[place[odd]].tolist() for b in spelled[c]]
        flat = ids.tolist()
        ends = np.cumsum(np.bincount(word, minlength=len(words))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; control ids are nothing and the leading blank goes."""
        text = b"".join(map(self.as_bytes.__getitem__, ids)).decode("utf-8", "each_byte")
        return text[1:] if text.startswith(" ") else text


def words_of(text: str) -> list[str]:
    """Pieces never hold a blank after another character, so the text falls apart there."""
    return WORD.findall(SPACE + text.replace(" ", SPACE)) if text else []


_models: dict[str, PieceModel] = {}
_cache: dict[str, dict[str, list[int]]] = {}


def model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_texts(m: PieceModel, texts: list[str], cache: dict[str, list[int]], room: int = 4_000_000) -> Iterator[list[int]]:
    """Ids of each text with the end id; texts are taken together up to so many characters."""
    group: list[list[str]] = []
    held = 0

    def flush() -> Iterator[list[int]]:
        new = list({w for ws in group for w in ws if w not in cache})
        here = dict(zip(new, m.encode_words(new), strict=True)) if new else {}
        for ws in group:
            yield [*chain.from_iterable([here[w] if w in here else cache[w] for w in ws]), m.end]
        if len(cache) > CACHED_WORDS:
            cache.clear()
        cache.update((w, i) for w, i in here.items() if len(w) <= CACHED_LENGTH)

    for text in texts:
        group.append(words_of(text))
        held += len(text)
        if held >= room:
            yield from flush()
            group, held = [], 0
    yield from flush()


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row: id, n_tokens, ids (array) and the decoded text, or only digests of both if not with_ids."""
    kind = dict(docs.dtypes)[id_col]
    outs = "ids array<int>, decoded string" if with_ids else "ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, cache = model(model_path), _cache.setdefault(model_path, {})
        for batch in batches:
            n, a, b = [], [], []
            for ids in encode_texts(m, batch["_text"].tolist(), cache):
                text = m.decode(ids)
                n.append(len(ids))
                if with_ids:
                    a.append(ids)
                    b.append(text)
                else:
                    a.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                    b.append(hashlib.sha256(text.encode("utf-8", "replace")).hexdigest())
            names = ("ids", "decoded") if with_ids else ("ids_sha256", "decoded_sha256")
            yield pd.DataFrame({id_col: batch[id_col], "n_tokens": n, names[0]: a, names[1]: b})

    source = docs.select(F.col(id_col), text_of(text_col).alias("_text"))
    return source.mapInPandas(run, f"`{id_col}` {kind}, n_tokens long, {outs}")
