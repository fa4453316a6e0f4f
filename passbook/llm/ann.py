"""Operator 2: nearest neighbours by a robust-pruned directed graph per shard.

Different vectors are dealt into shards of bounded size by a hash. Each shard builds a graph: points
are inserted in batches, a greedy beam search on the graph so far proposes neighbours, and relaxed
distance pruning keeps an edge only if no kept neighbour is ALPHA times closer to its end; reverse
edges are pruned alike. Queries visit every shard in blocks by beam search and the best of all shards
win. All distances are in double precision, as single precision cannot order near copies; the whole
beam of a shard is scored by cosines of the original vectors.

Equal vectors are one point that carries its smallest ids, so copies cost nothing and ties go to the
smallest ids. An id with several vectors is found by each of them and named once, with the nearest; as a
query it asks with all of them and has one list. An empty table gives no rows. Vectors that are null, empty, zero or hold null or non-finite components take no part;
neither do null ids. Vectors of different lengths are never compared. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.llm.common import materialise

#: Points of a shard, queries of a block, neighbours of a point, beam of building and of searching.
SHARD, BLOCK, DEGREE, BUILD_BEAM, BEAM = 4096, 2048, 32, 64, 96
#: How much closer a kept neighbour must be to stand in for another one; points inserted at once.
ALPHA, INSERT = 1.2, 256
#: Vectors are shorter than this: shards of different lengths have different numbers.
WIDEST = 1 << 20


def beam_search(unit: np.ndarray, graph: np.ndarray, queries: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The beam of each query, nearest first (id -1: empty), and its squared distances; all queries in step."""
    rows = np.arange(len(queries))[:, None]
    start = start[: min(beam, len(start))]
    ids = np.full((len(queries), beam), -1)
    far = np.full((len(queries), beam), np.inf)
    ids[:, : len(start)] = start
    far[:, : len(start)] = 2 - 2 * queries @ unit[start].T
    order = np.argsort(far, axis=1, kind="stable")
    ids, far = ids[rows, order], far[rows, order]
    done = ids < 0
    while True:
        todo = ~done
        live = np.flatnonzero(todo.any(axis=1))
        if not len(live):
            return ids, far
        at = todo[live].argmax(axis=1)
        done[live, at] = True
        near = graph[ids[live, at]]
        known = (near[:, :, None] == ids[live][:, None, :]).any(axis=2) | (near < 0)
        d = 2 - 2 * np.matmul(unit[near], queries[live][:, :, None])[:, :, 0]
        d[known] = np.inf
        all_ids, all_far = np.concatenate([ids[live], near], axis=1), np.concatenate([far[live], d], axis=1)
        all_done = np.concatenate([done[live], known], axis=1)
        order = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
        pick = np.arange(len(live))[:, None]
        ids[live], far[live], done[live] = all_ids[pick, order], all_far[pick, order], all_done[pick, order]
        done[live] |= ~np.isfinite(far[live])


def robust_prune(unit: np.ndarray, points: np.ndarray, near: np.ndarray, degree: int, alpha: float = ALPHA) -> np.ndarray:
    """Diverse neighbours of each point out of its candidates (-1: none)."""
    near = np.where(near == points[:, None], -1, near)
    near = np.sort(near, axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    ends = unit[near]
    own = np.sqrt(np.maximum(2 - 2 * np.matmul(ends, unit[points][:, :, None])[:, :, 0], 0))
    own[near < 0] = np.inf
    order = np.argsort(own, axis=1, kind="stable")
    rows = np.arange(len(points))[:, None]
    near, own, ends = near[rows, order], own[rows, order], ends[rows, order]
    between = np.sqrt(np.maximum(2 - 2 * np.matmul(ends, ends.transpose(0, 2, 1)), 0))
    left = np.isfinite(own)
    out = np.full((len(points), degree), -1)
    for k in range(degree):
        some = left.any(axis=1)
        if not some.any():
            break
        at = left.argmax(axis=1)
        out[some, k] = near[some, at[some]]
        left &= alpha * between[np.arange(len(points)), at] > own
        left[np.arange(len(points)), at] = False
    return out


def build_graph(unit: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Adjacency (-1: none) and entry points of a shard of unit vectors."""
    count = len(unit)
    rng = np.random.default_rng(count)
    graph = np.full((count, degree), -1)
    order = rng.permutation(count)
    start = np.unique(np.r_[np.argmax(unit @ unit.mean(axis=0)), order[: min(count, 8)]])
    for sweep in range(2):
        for a in range(0, count, INSERT):
            points = order[a : a + INSERT]
            found, _ = beam_search(unit, graph, unit[points], start, beam)
            # points of the same batch do not see each other in the graph yet
            beside = np.argsort(-(unit[points] @ unit[points].T), axis=1)[:, : degree // 2 + 1]
            cand = np.concatenate([found, graph[points], points[beside]], axis=1)
            graph[points] = robust_prune(unit, points, cand, degree)
            source = np.repeat(points, degree)
            target = graph[points].reshape(-1)
            source, target = source[target >= 0], target[target >= 0]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            ends, first, n = np.unique(target, return_index=True, return_counts=True)
            for b in range(0, len(ends), 512):
                e, f, m = ends[b : b + 512], first[b : b + 512], n[b : b + 512]
                back = np.full((len(e), int(m.max())), -1)
                place = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
                back[np.repeat(np.arange(len(e)), m), place] = source[f[0] : f[0] + int(m.sum())]
                graph[e] = robust_prune(unit, e, np.concatenate([graph[e], back], axis=1), degree)
    return graph, start


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision, whatever the size of the components."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / _norms(x)[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows of a with rows of b, in double precision."""
    return (a * b).sum(axis=1) / (_norms(a) * _norms(b))


INDEX = "shard long, dim int, vectors binary, graph binary, start binary, ids array<array<long>>"


def _index(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["low", "key"])
    vectors = np.stack([np.asarray(v, np.float64) for v in group["vector"]])
    graph, start = build_graph(_scaled(vectors))
    row = (group["shard"].iat[0], vectors.shape[1], vectors.tobytes(), graph.astype(np.int32).tobytes(), start.astype(np.int32).tobytes(), [list(x) for x in group["ids"]])
    return pd.DataFrame([row], columns=["shard", "dim", "vectors", "graph", "start", "ids"])


def _search(beam: int, top: int):
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, dim, vectors, graph, start, ids in index[["shard", "dim", "vectors", "graph", "start", "ids"]].itertuples(index=False):
            base = np.frombuffer(bytes(vectors)).reshape(-1, dim)
            own = queries[queries["dim"] == dim]
            if not len(own):
                continue
            ask = np.stack([np.asarray(v, np.float64) for v in own["vector"]])
            unit = _scaled(base)
            edges = np.frombuffer(bytes(graph), np.int32).reshape(len(base), -1)
            for a in range(0, len(ask), 256):
                found, _ = beam_search(unit, edges, _scaled(ask[a : a + 256]), np.frombuffer(bytes(start), np.int32), beam)
                for q, row, vector in zip(own["qid"].iloc[a : a + 256].tolist(), found, ask[a : a + 256], strict=True):
                    row = row[row >= 0]
                    score = cosines(base[row], vector[None, :])
                    best: dict[int, float] = {}
                    for s, k in zip(score.tolist(), row.tolist(), strict=True):
                        for i in ids[k]:
                            best[i] = max(s, best.get(i, s))
                    out += [(q, i, s) for i, s in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:top]]
        return pd.DataFrame(out, columns=["qid", "vec_id", "score"])

    return run


def _lows(top: int):
    """Folds equal vectors of a task to their smallest ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            part = batch.sort_values("vec_id").groupby("key", sort=False)["vec_id"].agg(lambda x: x.tolist()[:top])
            yield pd.DataFrame({"key": part.index, "ids": part.to_numpy()})

    return run


def usable(col: str) -> Column:
    """Whether a vector takes part."""
    x = F.col(col)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(x, lambda v: v != 0)


def nearest(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, beam: int = BEAM) -> DataFrame:
    """Per query (rows where the condition holds) its k nearest others: query_id, rank, vec_id, score."""
    rows = vectors.where(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), queries.alias("asks"))
    # adding zero makes -0.0 and 0.0 one value
    rows = rows.withColumn("vector", F.transform("vector", lambda v: v + 0.0)).withColumn("key", F.sha2(F.to_json("vector"), 256))
    rows = materialise(rows, "ann-vectors")
    top = k + 1  # a query may find itself
    folded = rows.select("key", "vec_id").mapInPandas(_lows(top), "key string, ids array<long>")
    lows = folded.groupBy("key").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, top).alias("ids"))
    lows = lows.withColumn("low", F.col("ids")[0])
    points = rows.join(lows.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & (F.col("vec_id") == F.col("low"))).dropDuplicates(["key"]).select("low", "ids", "vector", "key")
    points = materialise(points, "ann-points")
    count = points.count()
    shards = max(1, -(-count // SHARD))
    sharded = points.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)) * WIDEST + F.size("vector"))
    index = materialise(sharded.groupBy("shard").applyInPandas(_index, INDEX), "ann-index")

    asked = rows.where("asks").groupBy("key").agg(F.first("vector").alias("vector")).withColumn("dim", F.size("vector")).withColumn("qid", F.col("key"))
    asked = materialise(asked, "ann-queries")
    blocks = max(1, -(-asked.count() // BLOCK))
    block = F.pmod(F.xxhash64("key"), F.lit(blocks))
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    # a block of queries goes to each shard of its length of vectors
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    dealt = asked.withColumn("block", block).withColumn("number", every).withColumn("shard", F.col("number") * WIDEST + F.col("dim"))
    found = left.groupBy("shard", "block").cogroup(dealt.groupBy("shard", "block")).applyInPandas(_search(beam, top), "qid string, vec_id long, score double")

    def best(grouped, col: Column) -> DataFrame:
        ordered = F.array_sort(F.collect_list(col))
        return grouped.agg(F.slice(ordered, 1, top).alias("best"))

    one = F.struct((-F.col("score")).alias("far"), "vec_id", "score")
    found = found.groupBy("qid", "vec_id").agg(F.max("score").alias("score"))
    part = best(found.groupBy("qid", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")), one)
    per_key = best(part.select("qid", F.explode("best").alias("one")).groupBy("qid"), F.col("one")).withColumnRenamed("qid", "key")
    mine = rows.where("asks").select(F.col("vec_id").alias("query_id"), "key").distinct().join(per_key, "key")
    # an id with several vectors asks with all of them; of each other id its nearest vector counts
    several = F.col("vectors") > 1
    mine = mine.join(rows.where("asks").groupBy(F.col("vec_id").alias("query_id")).agg(F.count_distinct("key").alias("vectors")), "query_id")
    merged = mine.where(several).select("query_id", F.explode("best").alias("b")).groupBy("query_id", F.col("b.vec_id").alias("vec_id")).agg(F.max("b.score").alias("score"))
    result = mine.where(~several).select("query_id", "best").unionByName(best(merged.groupBy("query_id"), one))
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    flat = result.select("query_id", F.posexplode(others).alias("pos", "b"))
    return flat.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
