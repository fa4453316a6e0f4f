"""Operator 10: n-gram Jaccard join by prefixes under several global token orders.

1. Equal shingle sets fold into classes; one document stands for each.
2. Order by hash: a set's prefix is so long that linked sets share at least EXTRA of their tokens in
   their prefixes. A document whose prefix holds fewer tokens that occur elsewhere has no link.
3. The others count their tokens. Each further order puts rare tokens first and breaks ties by a hash
   of its own. Linked sets share a prefix token under every order, so they are in one component of
   every order's token lists: the components are intersected one order after the other.
4. Inside what is left all pairs are compared exactly, in tiles of bounded size.

Tokens travel packed by hash range; tasks fold tokens that they see in several documents, so a token
of a hot group leaves a task once. Token lists link each member to their smallest one, never all
pairs. Only the tiles of step 4 compare pairs, and those stay in a task; their number is the square of
a near-copy group's size over the tile size.

Null text has no words; an empty set links with nothing. Rows equal in id are one document, whatever
their texts: all that links with one of them is in one component, which each of its rows with words
names; one without words names its own id. A null id is compared with nothing and has no component.
Texts may have any length; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.llm import words
from passbook.llm.common import Written, materialise, text_of, width
from passbook.llm.components import components

#: Shingle length in words; similarity in percent; share of a set (1 in EXTRA) that prefixes are longer by.
SHINGLE, PERCENT, EXTRA = 5, 75, 10
#: Hashes that break ties in the orders of step 3.
SALTS = (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A99, 0xD1342543DE82EF95)
#: Characters of text folded at once, documents of a chunk, bytes of text per range, tokens of a tile.
CHUNK_CHARS, CHUNK_DOCS, RANGE_BYTES, TILE = 8 << 20, 60_000, 16 << 20, 1 << 16
MANY = 0xFFFF
PACKED = "part int, chunk long, kind int, docs binary, data binary"
FACT = np.dtype([("id", "i8"), ("none", "u1"), ("k1", "i8"), ("k2", "i8"), ("n", "i4"), ("shared", "i4")])
COUNT = np.dtype([("doc", "u2"), ("shared", "i4")])
FREQUENCY = np.dtype([("doc", "u2"), ("token", "u8"), ("df", "i4")])


def least_overlap(n: int) -> int:
    """Tokens that a set of n shares at least with any set it links with."""
    return -(-n * PERCENT // 100)


def extra(n: int) -> int:
    return max(1, n // EXTRA)


def set_keys(tokens: np.ndarray) -> tuple[int, int]:
    """Two hashes of a sorted set."""
    ends = np.array([len(tokens)])
    a, b = (words.runs(words.sums(tokens, base), ends * 0, ends, base)[0] for base in (words.RUN_BASE, words.RUN_BASE_2))
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _narrow(tokens: np.ndarray) -> bytes:
    """The upper six bytes of each token."""
    return (tokens >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _wide(cell: bytes) -> np.ndarray:
    raw = np.frombuffer(cell, np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (0, 2))).view(np.uint64).reshape(-1)


def _range_of(tokens: np.ndarray, parts: int) -> np.ndarray:
    return ((words.mix(tokens >> np.uint64(16)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _new(values: np.ndarray) -> np.ndarray:
    return np.r_[np.ones(min(1, len(values)), bool), values[1:] != values[:-1]]


class _Chunks:
    """Numbers chunks of a task."""

    def __init__(self) -> None:
        self.base, self.count = TaskContext.get().partitionId() << 32, 0

    def next(self) -> int:
        self.count += 1
        return self.base | self.count


def _deal(chunk: int, tokens: np.ndarray, docs: np.ndarray, parts: int, pack) -> list[tuple]:
    """Tokens of a chunk by hash range, with their documents beside them."""
    part = _range_of(tokens, parts)
    by = np.argsort(part, kind="stable")
    tokens, docs, part = tokens[by], docs[by].astype(np.uint16), part[by]
    cuts = np.flatnonzero(_new(part))
    return [(int(part[a]), chunk, 0, docs[a:b].tobytes(), pack(tokens[a:b])) for a, b in zip(cuts, np.r_[cuts[1:], len(part)][: len(cuts)], strict=True)]


def _prefixes(parts: int):
    """Step 1 and the map side of step 2: facts of each document and packed prefix tokens."""

    def flush(chunk: int, facts: list[tuple], held: list[tuple[int, np.ndarray]]) -> pd.DataFrame:
        fact = np.array(facts, FACT)
        out: list[tuple] = []
        if held:
            tokens = np.concatenate([t for _, t in held])
            docs = np.repeat([d for d, _ in held], [len(t) for _, t in held])
            by = np.argsort(tokens, kind="stable")
            tokens, docs = tokens[by], docs[by]
            new = _new(tokens)
            group = np.cumsum(new) - 1
            many = np.bincount(group)[group] > 1
            fact["shared"] += np.bincount(docs[many], minlength=len(fact)).astype(np.int32)
            docs = np.where(many, MANY, docs)
            keep = ~many | new
            out = _deal(chunk, tokens[keep], docs[keep], parts, _narrow)
        out.append((chunk % parts, chunk, 1, b"", fact.tobytes()))
        return pd.DataFrame(out, columns=["part", "chunk", "kind", "docs", "data"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunks = _Chunks()
        facts: list[tuple] = []
        held: list[tuple[int, np.ndarray]] = []
        seen: set[tuple[int, int]] = set()
        chars = 0
        for batch in batches:
            for id_, none, text in zip(batch["id"].tolist(), batch["none"].tolist(), batch["text"].tolist(), strict=True):
                tokens = words.shingles(text.encode("utf-8", "replace"), SHINGLE)
                n = len(tokens)
                keys = set_keys(tokens) if n else (0, 0)
                if n and not none and keys not in seen:  # of equal sets one stands for all
                    seen.add(keys)
                    held.append((len(facts), tokens[: n - least_overlap(n) + extra(n)]))
                facts.append((id_, none, *keys, n, 0))
                chars += len(text)
                if chars >= CHUNK_CHARS or len(facts) >= CHUNK_DOCS:
                    yield flush(chunks.next(), facts, held)
                    facts, held, seen, chars = [], [], set(), 0
        if facts:
            yield flush(chunks.next(), facts, held)

    return run


def _shared(group: pd.DataFrame) -> pd.DataFrame:
    """One hash range: how many tokens of each document occur elsewhere. Facts pass."""
    own = group[group["kind"] == 0]
    out = [(c, 1, bytes(d)) for c, k, d in group[["chunk", "kind", "data"]].itertuples(index=False) if k == 1]
    if len(own):
        cells = [(c, np.frombuffer(bytes(d), np.uint16), _wide(bytes(t))) for c, d, t in own[["chunk", "docs", "data"]].itertuples(index=False)]
        tokens, docs = np.concatenate([t for _, _, t in cells]), np.concatenate([d for _, d, _ in cells])
        cell = np.repeat(np.arange(len(cells)), [len(t) for _, _, t in cells])
        by = np.argsort(tokens, kind="stable")
        new = _new(tokens[by])
        ids = np.cumsum(new) - 1
        elsewhere = np.bincount(ids, weights=1 + (docs[by] == MANY)) > 1
        hit = by[elsewhere[ids] & (docs[by] != MANY)]
        key, count = np.unique(cell[hit] * 65536 + docs[hit], return_counts=True)
        rows = np.empty(len(key), COUNT)
        rows["doc"], rows["shared"] = key % 65536, count
        out += [(cells[c][0], 0, data) for c, data in words.dealt(rows, key // 65536)]
    return pd.DataFrame(out, columns=["chunk", "kind", "data"])


FACTS = "id long, none boolean, k1 long, k2 long, n int, shared int"


def _facts(group: pd.DataFrame) -> pd.DataFrame:
    """Facts of a chunk with the counts of all ranges."""
    fact = words.unpacked(group["data"][group["kind"] == 1], FACT)
    count = words.unpacked(group["data"][group["kind"] == 0], COUNT)
    more = np.bincount(count["doc"], weights=count["shared"], minlength=len(fact))
    return pd.DataFrame({"id": fact["id"], "none": fact["none"].astype(bool), "k1": fact["k1"], "k2": fact["k2"], "n": fact["n"], "shared": fact["shared"] + more.astype(np.int32)})


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Token sets of the documents that stand for classes."""
    for batch in batches:
        rows = []
        for id_, size, k1, k2, text in batch[["id", "size", "k1", "k2", "text"]].itertuples(index=False):
            tokens = words.shingles(text.encode("utf-8", "replace"), SHINGLE)
            if len(tokens) and set_keys(tokens) == (k1, k2):
                rows.append((id_, size, len(tokens), tokens.tobytes()))
        yield pd.DataFrame(rows, columns=["id", "size", "n", "tokens"])


def _all_tokens(parts: int):
    """Map side of the token counts: whole sets, packed by hash range."""

    def flush(chunk: int, ids: list[int], held: list[np.ndarray]) -> pd.DataFrame:
        docs = np.repeat(np.arange(len(ids)), [len(t) for t in held])
        out = _deal(chunk, np.concatenate(held), docs, parts, np.ndarray.tobytes)
        names = np.array([(i, len(t)) for i, t in zip(ids, held, strict=True)], np.int64).tobytes()
        out.append((chunk % parts, chunk, 1, b"", names))
        return pd.DataFrame(out, columns=["part", "chunk", "kind", "docs", "data"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunks, ids, held, count = _Chunks(), [], [], 0
        for batch in batches:
            for id_, tokens in zip(batch["id"].tolist(), batch["tokens"].tolist(), strict=True):
                ids.append(id_)
                held.append(np.frombuffer(bytes(tokens), np.uint64))
                count += len(held[-1])
                if count >= 1 << 20 or len(ids) >= CHUNK_DOCS:
                    yield flush(chunks.next(), ids, held)
                    ids, held, count = [], [], 0
        if ids:
            yield flush(chunks.next(), ids, held)

    return run


def _frequencies(group: pd.DataFrame) -> pd.DataFrame:
    """One hash range: document frequency of each token that several documents hold. Names pass."""
    own = group[group["kind"] == 0]
    out = [(c, 1, bytes(d)) for c, k, d in group[["chunk", "kind", "data"]].itertuples(index=False) if k == 1]
    if len(own):
        tokens, docs = words.unpacked(own["data"], np.dtype("u8")), words.unpacked(own["docs"], np.dtype("u2"))
        cell = np.repeat(np.arange(len(own)), [len(d) // 8 for d in own["data"]])
        by = np.argsort(tokens, kind="stable")
        ids = np.cumsum(_new(tokens[by])) - 1
        df = np.bincount(ids)[ids]
        by, df = by[df > 1], df[df > 1]
        rows = np.empty(len(by), FREQUENCY)
        rows["doc"], rows["token"], rows["df"] = docs[by], tokens[by], df
        chunk = own["chunk"].tolist()
        out += [(chunk[c], 0, data) for c, data in words.dealt(rows, cell[by])]
    return pd.DataFrame(out, columns=["chunk", "kind", "data"])


def _orders(group: pd.DataFrame) -> pd.DataFrame:
    """Shared prefix tokens of each document of a chunk under each order."""
    names = words.unpacked(group["data"][group["kind"] == 1], np.dtype("i8")).reshape(-1, 2)
    rows = words.unpacked(group["data"][group["kind"] == 0], FREQUENCY)
    n = names[:, 1]
    prefix = n - -(-n * PERCENT // 100) + 1
    room = prefix - (n - np.bincount(rows["doc"], minlength=len(n)))  # tokens of one document come first
    out = []
    for order, salt in enumerate(SALTS):
        by = np.lexsort((words.mix(rows["token"] ^ np.uint64(salt)), rows["df"], rows["doc"]))
        doc = rows["doc"][by].astype(np.int64)
        new = _new(doc)
        place = np.arange(len(doc)) - (np.flatnonzero(new)[np.cumsum(new) - 1] if len(doc) else 0)
        take = place < room[doc]
        out.append(pd.DataFrame({"order": order, "token": rows["token"][by][take].view(np.int64), "id": names[:, 0][doc[take]]}))
    return pd.concat(out, ignore_index=True).astype({"order": "int32"})


def _blocks(prefixes: DataFrame) -> DataFrame:
    """(id, block): components of the token lists of all orders, intersected."""
    blocks = None
    for order in range(len(SALTS)):
        rows = prefixes.where(F.col("order") == order).select("token", "id")
        rows = rows.withColumn("block", F.lit(0).cast("long")) if blocks is None else rows.join(blocks, "id")
        lists = rows.groupBy("block", "token").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
        edges = rows.join(lists, ["block", "token"]).select(F.col("id").alias("a"), F.col("low").alias("b"))
        blocks = components(edges, f"order-{order}").select("id", F.col("low").alias("block"))
    return blocks


def linked(na: int, nb: np.ndarray, common: np.ndarray) -> np.ndarray:
    return 100 * common >= PERCENT * (na + nb - common)


def _compare(group: pd.DataFrame) -> pd.DataFrame:
    """All pairs of each block, or between two tiles of one: links per document and a spanning forest."""
    out: list[tuple] = []
    for _, rows in group.groupby("block", sort=False):
        rows = rows.sort_values("id")
        ids, sizes, side = rows["id"].to_numpy(), rows["size"].to_numpy(), rows["tile"].to_numpy()
        sets = [np.frombuffer(bytes(t), np.uint64) for t in rows["tokens"]]
        n = np.array([len(s) for s in sets])
        tokens, docs = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
        by = np.argsort(tokens, kind="stable")
        tokens, docs = tokens[by], docs[by]
        apart = rows["lo"].iat[0] != rows["hi"].iat[0]
        links, parent = np.zeros(len(sets), np.int64), list(range(len(sets)))

        def root(x: int, parent: list[int] = parent) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for x, mine in enumerate(sets):
            low, high = np.searchsorted(tokens, mine), np.searchsorted(tokens, mine, "right")
            length = high - low
            at = np.arange(int(length.sum())) + np.repeat(low - np.cumsum(length) + length, length)
            common = np.bincount(docs[at], minlength=len(sets))
            yes = linked(n[x], n, common) & (ids != ids[x])
            yes = yes & (side != side[x]) if apart else yes
            links[x] += sizes[yes].sum()
            for y in np.flatnonzero(yes[:x]).tolist():
                a, b = root(x), root(y)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((ids[x], ids[y], 0))
        out += [(i, i, k) for i, k in zip(ids.tolist(), links.tolist(), strict=True) if k]
    return pd.DataFrame(out, columns=["id", "other", "links"])


def _tiles(blocks: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """Sets with the groups that compare them: small blocks together, large ones by pairs of tiles."""
    rows = blocks.join(sets, "id")
    tiles = rows.groupBy("block").agg(F.ceil(F.sum("n") / TILE).cast("long").alias("tiles"), F.count("*").alias("docs")).where("docs > 1").drop("docs")
    rows = rows.join(tiles, "block").withColumn("tile", F.pmod(F.xxhash64("id"), "tiles"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    rows = rows.withColumn("lo", F.least("tile", "with")).withColumn("hi", F.greatest("tile", "with"))
    key: Column = F.when(F.col("tiles") == 1, F.struct(F.pmod(F.xxhash64("block"), F.lit(parts)).alias("block"), F.lit(-1).cast("long").alias("lo"), F.lit(-1).cast("long").alias("hi")))
    return rows.withColumn("group", key.otherwise(F.struct("block", "lo", "hi"))).select("group", "block", "lo", "hi", "tile", "id", "size", "tokens")


def _repeated(usable: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of an id that stands for several texts."""
    key = F.struct("k1", "k2")
    ids = usable.groupBy("id").agg(F.min(key).alias("a"), F.max(key).alias("b")).where("a <> b").select("id")
    theirs = usable.join(ids, "id", "left_semi").select("id", "k1", "k2").distinct()
    return theirs.join(classes.select("k1", "k2", "rep"), ["k1", "k2"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id and n_links, the number of other documents it links with."""
    id_ = F.col(id_col).cast("long")
    source = docs.select(id_.isNull().alias("none"), F.coalesce(id_, F.lit(0)).alias("id"), text_of(text_col).alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(width(docs), -(-size // RANGE_BYTES))
    ranged = source.mapInPandas(_prefixes(parts), PACKED).groupBy("part").applyInPandas(_shared, "chunk long, kind int, data binary")
    facts = materialise(ranged.groupBy("chunk").applyInPandas(_facts, FACTS), "jaccard-facts")

    usable = facts.where("not none and n > 0")
    classes = usable.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.max("n").alias("n"), F.max("shared").alias("shared"))
    classes = materialise(classes, "jaccard-classes")
    least = F.ceil(F.col("n") * F.lit(PERCENT) / F.lit(100)).cast("int")
    wanted = classes.where(F.col("shared") >= F.greatest(F.lit(1), F.floor(least / EXTRA).cast("int"))).select(F.col("rep").alias("id"), "k1", "k2", "size")
    chosen = source.where("not none").join(wanted, "id").select("id", "size", "k1", "k2", "text").dropDuplicates(["id", "k1", "k2", "text"])
    written = Written(chosen.mapInPandas(_sets, "id long, size long, n int, tokens binary"), "jaccard-sets")
    sets = written.rows

    counted = sets.select("id", "tokens").mapInPandas(_all_tokens(parts), PACKED).groupBy("part").applyInPandas(_frequencies, "chunk long, kind int, data binary")
    prefixes = Written(counted.groupBy("chunk").applyInPandas(_orders, "order int, token long, id long"), "jaccard-prefixes")
    compared = materialise(_tiles(_blocks(prefixes.rows), sets, parts).groupBy("group").applyInPandas(_compare, "id long, other long, links long"), "jaccard-links")
    written.clear()
    prefixes.clear()
    edges = compared.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b"))
    low = components(edges.unionByName(_repeated(usable, classes)), "jaccard")
    links = compared.groupBy("id").agg(F.sum("links").alias("links"))

    found = classes.join(low, classes.rep == low.id, "left").drop("id").join(links, classes.rep == links.id, "left")
    found = found.select("k1", "k2", F.coalesce("low", "rep").alias("low"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"))
    out = facts.join(found, ["k1", "k2"], "left")
    named = F.when(~F.col("none"), F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("id")))
    return out.select(
        F.when(~F.col("none"), F.col("id")).alias("doc_id"),
        F.col("n").cast("long").alias("n_shingles"),
        named.alias("component_id"),
        F.when(~F.col("none") & (F.col("n") > 0), F.col("links")).otherwise(0).alias("n_links"),
    )
