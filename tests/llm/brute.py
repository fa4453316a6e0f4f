"""Plain versions of the operators, for small fixtures."""

from __future__ import annotations

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def documents(spark, texts, first: int = 0):
    """Documents with running ids, over a few partitions."""
    rows = [(first + i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENT).repartition(4)


def awkward(spark):
    """Null, empty and long texts, null ids, repeated rows, and extra columns whose names clash."""
    rows = [
        (1, "one two three four five six", "en", "a", 27, "x", 1),
        (1, "one two three four five six", "en", "a", 27, "x", 1),
        (2, None, None, None, None, None, None),
        (3, "", "en", "b", 0, "", 0),
        (None, "one two three four five six", "en", "a", 27, "y", 2),
        (None, None, None, None, None, None, None),
        (4, "word " * 30_000, "de", "a", 150_000, "z", 3),
        (5, " \t\n ", "de", "c", 4, "z", 3),
        (6, "One  two\tthree four five six", "en", "a", 28, "x", 1),
    ]
    return spark.createDataFrame(rows, DOCUMENT + ", key string, part int")


def copies(seed: int, count: int, vocabulary: int = 300) -> list[str | None]:
    """Texts with exact and near copies, shared passages and short ones."""
    random.seed(seed)
    names = [f"w{i}" for i in range(vocabulary)]
    base = [[random.choice(names) for _ in range(random.randint(5, 120))] for _ in range(12)]
    out: list[str | None] = []
    for _ in range(count):
        words = list(random.choice(base))
        for _ in range(random.randint(0, 6)):
            words[random.randrange(len(words))] = random.choice(names)
        if random.random() < 0.2:
            words = words[: random.randint(0, 6)]
        out.append(" ".join(words))
    return [*out, None, "", "A b", "a B"]


def passages(seed: int, count: int) -> list[str | None]:
    """Texts that share passages of about fifty words, at their edges too."""
    random.seed(seed)
    names = [f"w{i}" for i in range(40)]
    some = lambda n: " ".join(random.choice(names) for _ in range(n))
    shared = [some(n) for n in (49, 50, 51, 80, 120)]
    out = [" ".join(random.choice([some(random.randint(0, 30)), random.choice(shared)]) for _ in range(random.randint(0, 5))) for _ in range(count)]
    return [*out, None, ""]


def without_repeats(rows, size: int = 50):
    """(doc_id, n_words, n_removed, kept_sha256) by comparing every run of words."""
    first: dict[tuple, int] = {}
    words = {i: WORD.findall(t or "") for i, t in rows}
    for i, w in words.items():
        for a in range(len(w) - size + 1):
            run = tuple(w[a : a + size])
            first[run] = min(first.get(run, i), i)
    out = []
    for i, w in words.items():
        gone = [False] * len(w)
        for a in range(len(w) - size + 1):
            if first[tuple(w[a : a + size])] < i:
                gone[a : a + size] = [True] * size
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return sorted(out)


def shingle_set(text) -> frozenset:
    w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))) if w else frozenset()


def components(rows):
    """(doc_id, n_shingles, component_id, n_links) by comparing all pairs."""
    sets = {i: shingle_set(t) for i, t in rows}
    low, links = {i: i for i in sets}, dict.fromkeys(sets, 0)

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                low[max(a, b)] = min(a, b)
    return sorted((i, len(s), root(i), links[i]) for i, s in sets.items())


def cluster_of(text) -> str | None:
    body = re.sub(r"[\x20\x09-\x0D]+", " ", text or "").lower().strip(" ")
    return body or None


def best_fit(items, capacity: int):
    """Bins of (id, length, source, cluster) by trying every bin for every item."""
    bins, where = [], {}
    for i, length, source, cluster in sorted(items, key=lambda x: (-(x[1] % capacity), x[0])):
        rest = length % capacity
        if not rest:
            continue
        fits = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= rest and (source is None or source not in b["sources"]) and (cluster is None or cluster not in b["clusters"])]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append({"left": capacity, "sources": set(), "clusters": set()})
        bins[k]["left"] -= rest
        bins[k]["sources"].add(source)
        bins[k]["clusters"].add(cluster)
        where[i] = k
    return where
