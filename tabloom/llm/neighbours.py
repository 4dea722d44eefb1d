"""Operator 2, approximate nearest neighbours by learned partitions.

On a bounded sample (SAMPLE to SAMPLE_MOST vectors, distinct, in the order of a hash of vec_id) a graph links each vector
with its nearest; the graph is cut into parts of almost equal size with few links between them. A softmax classifier
learns in which parts a vector's neighbours lie. It places every vector of the table in its most probable part, and
routes a query to as many parts, by falling probability, as the aimed recall needs; candidates there are scored exactly.
How far that goes is measured on vectors of the sample that the classifier didn't learn from (one in HELD). A query whose
parts hold too few candidates goes on to further ones until there are enough. Vectors without structure have their
neighbours everywhere: most parts are searched then. The column searched tells how many vectors a query's parts hold.

There is a part for each 4 sqrt(vectors), between PARTS and PARTS_MOST (which is reached at 17 million vectors; beyond it
parts grow). Parts are dealt out in chunks of CHUNK candidates and the queries that come to a part in blocks of BLOCK (fewer of long
vectors), so
no task holds a whole part, however many vectors are alike, and a candidate goes only to blocks of its own part. Each
(chunk, block) gives its best k per query; the best k of these are the result.

Nearness is the largest inner product in double precision of the vectors as given; ties go to the smaller vec_id.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
without a vec_id or with another length than most of the table (of lengths as frequent the greatest counts); rows with equal vec_ids are one vector (the least of
them); a query has fewer rows only if there are fewer candidates; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Vectors of the sample: the least bound, for each part, and the greatest bound.
SAMPLE, SAMPLE_PART, SAMPLE_MOST, LINKS = 4096, 32, 1 << 15, 12
PARTS, PARTS_MOST = 16, 1024
CHUNK, BLOCK = 1 << 16, 1 << 14
#: Bytes of a chunk's vectors, and of a block's, as doubles: long vectors make smaller ones.
CHUNK_BYTES, BLOCK_BYTES = 1 << 26, 1 << 24
#: The recall that the reach is set for, and one in how many vectors of the sample it is measured on.
AIM, HELD = 0.95, 6


class Router:
    """What places vectors: weights (dimensions + 1, parts), and the share of probability that a query's parts reach."""

    def __init__(self, weights: np.ndarray, reach: float):
        self.weights, self.reach = weights, reach

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        z = x @ self.weights[:-1] + self.weights[-1]
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def route(self, p: np.ndarray, sizes: np.ndarray, least: int) -> list[np.ndarray]:
        """Parts of each query: up to the reach, then on until they hold at least least vectors."""
        order = np.argsort(-p, axis=1, kind="stable")
        total = np.cumsum(np.take_along_axis(p, order, 1), axis=1)
        held = np.cumsum(sizes[order], axis=1)
        enough = (total - np.take_along_axis(p, order, 1) < self.reach) | (held - sizes[order] < least)
        return [o[e] for o, e in zip(order, enough, strict=True)]


def graph(x: np.ndarray, links: int = LINKS) -> np.ndarray:
    """The nearest others of each row."""
    return nearest_of(x, np.arange(len(x)), min(links, len(x) - 1))


def nearest_of(x: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of some rows of x, in no order."""
    out = np.empty((len(rows), k), np.int64)
    for at in range(0, len(rows), 512):
        some = rows[at : at + 512]
        scores = x[some] @ x.T
        scores[np.arange(len(some)), some] = -np.inf
        out[at : at + 512] = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Cut the graph: parts grow from spread seeds, then vertices move to the part of most neighbours while it has room."""
    n = len(x)
    room = int(np.ceil(1.05 * n / parts))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    centres = unit[rng.choice(n, parts, replace=False)]
    for _ in range(8):
        part = (unit @ centres.T).argmax(1)
        centres = np.stack([unit[part == p].mean(0) if (part == p).any() else unit[rng.integers(n)] for p in range(parts)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    like = (unit @ centres.T).astype(np.float32)
    part, held = np.full(n, -1), np.zeros(parts, int)
    for i in np.argsort(-like.max(1)):
        for p in np.argsort(-like[i]):
            if held[p] < room:
                part[i], held[p] = p, held[p] + 1
                break
    both = [set(r) for r in near.tolist()]
    for i, row in enumerate(near.tolist()):
        for j in row:
            both[j].add(i)
    around = [np.array(sorted(s)) for s in both]
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(part[around[i]], minlength=parts)
            votes[held >= room] = -1
            votes[part[i]] = (part[around[i]] == part[i]).sum()
            best = int(votes.argmax())
            if votes[best] > votes[part[i]]:
                held[part[i]] -= 1
                held[best] += 1
                part[i] = best
                moved += 1
        if not moved:
            break
    return part


def fit(x: np.ndarray, parts: int, k: int, aim: float = AIM, seed: int = 3, epochs: int = 40) -> Router:
    """Graph, parts, classifier and reach, from a sample of vectors."""
    rng = np.random.default_rng(seed)
    x = np.unique(x.astype(np.float64), axis=0)
    x = x[rng.permutation(len(x))]
    parts = max(1, min(parts, len(x) // 8))
    if parts == 1:
        return Router(np.zeros((x.shape[1] + 1, 1)), 1.0)
    held = np.arange(len(x) // HELD)
    learnt = np.arange(len(held), len(x))
    near = graph(x[learnt])
    part = balanced_parts(x[learnt], near, parts, rng)
    # Soft labels: where a vector and its neighbours lie.
    target = np.eye(parts, dtype=np.float32)[part] + np.stack([np.bincount(part[r], minlength=parts) for r in near]).astype(np.float32)
    target /= target.sum(1, keepdims=True)
    unit = np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.ones((len(x), 1))])[learnt]
    w, past = np.zeros((unit.shape[1], parts)), np.full((unit.shape[1], parts), 1e-8)
    for _ in range(epochs):
        order = rng.permutation(len(learnt))
        for at in range(0, len(order), 128):
            some = order[at : at + 128]
            z = unit[some] @ w
            e = np.exp(z - z.max(1, keepdims=True))
            g = unit[some].T @ (e / e.sum(1, keepdims=True) - target[some]) / len(some)
            past += g * g
            w -= 0.3 * g / np.sqrt(past)
    router = Router(w, 1.0)
    # The least reach with the aimed recall, of vectors left out above against the sample, as placed by the classifier.
    q = held[:1024]
    placed = np.concatenate([router.probabilities(x[at : at + 1024]).argmax(1) for at in range(0, len(x), 1024)])
    best = nearest_of(x, q, min(k, len(x) - 1))
    p = router.probabilities(x[q])
    order = np.argsort(-p, axis=1, kind="stable")
    falling = np.take_along_axis(p, order, 1)
    before = np.take_along_axis(np.cumsum(falling, axis=1) - falling, np.argsort(order, axis=1), 1)
    needed = np.sort(np.take_along_axis(before, placed[best], 1).ravel())
    router.reach = float(min(1.0, needed[min(len(needed) - 1, int(np.ceil(aim * len(needed))))] + 1e-9))
    return router


def top(x: np.ndarray, ids: np.ndarray, y: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of y, id, score) of the k vectors of x (their ids ascend) with the largest inner product with each row of y.

    A few more than k are picked by the matrix product and scored again one by one, as equal vectors must have equal
    scores for ties to go to the smaller id; rows with more near-ties than that are gone through apart.
    """
    scores = y @ x.T
    at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
    mine = ids[at] == own
    scores[np.flatnonzero(mine), at[mine]] = -np.inf
    n, m = min(k, len(ids)), min(k + 12, len(ids))
    near = np.argpartition(-scores, m - 1, axis=1)[:, :m]
    best = np.sort(np.take_along_axis(scores, near, 1), axis=1)[:, ::-1]
    cutoff = best[:, n - 1]
    low = cutoff - 1e-12 * np.maximum(1.0, np.abs(np.where(np.isfinite(cutoff), cutoff, 0)))
    tied = np.flatnonzero((best[:, -1] >= low) & np.isfinite(cutoff)) if m < len(ids) else np.zeros(0, np.int64)
    exact = (x[near] * y[:, None, :]).sum(2)
    exact[~np.isfinite(np.take_along_axis(scores, near, 1))] = -np.inf
    order = np.lexsort((ids[near], -exact), axis=1)[:, :n]
    found, value = np.take_along_axis(ids[near], order, 1), np.take_along_axis(exact, order, 1)
    for i in tied:
        all_near = np.flatnonzero(scores[i] >= low[i])
        again = (x[all_near] * y[i]).sum(1)
        first = np.lexsort((ids[all_near], -again))[:n]
        found[i], value[i] = ids[all_near][first], again[first]
    rows = np.repeat(np.arange(len(y)), n)
    keep = np.isfinite(value.ravel())
    return rows[keep], found.ravel()[keep], value.ravel()[keep]


def usable(rows: DataFrame, query: Column) -> DataFrame:
    """vec_id, is_query, v (little-endian bytes) of the vectors that take part, one row per vec_id."""
    kind = rows.schema["embedding"].dataType.elementType.simpleString()
    dtype = "<f4" if kind == "float" else "<f8"
    e = F.col("embedding") if kind == "float" else F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(e, lambda c: c != 0)
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding")).filter(good).select("vec_id", query.alias("is_query"), e.alias("e"))

    def run(batches):
        for batch in batches:
            v = batch.column("e")
            flat, ends = v.flatten().to_numpy(zero_copy_only=False).astype(dtype), np.asarray(v.offsets) - v.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("is_query"), pa.array([flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["vec_id", "is_query", "v"])

    return rows.mapInArrow(run, "vec_id bigint, is_query boolean, v binary").groupBy("vec_id", "is_query").agg(F.min("v").alias("v"))


def nearest(rows: DataFrame, query: Column | None = None, k: int = 20, parts: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score, searched: the k nearest found of each query, of all rows but itself."""
    spark = rows.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double, searched bigint"
    query = F.col("vec_id") % 20 == 0 if query is None else query
    dtype = "<f4" if rows.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    vectors = cut(usable(rows, query), "vectors")
    usual = vectors.groupBy(F.octet_length("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()  # of a row for each length
    if usual is None:
        return spark.createDataFrame([], schema)
    count, dims = usual["count"], usual["n"] // np.dtype(dtype).itemsize
    vectors = vectors.filter(F.octet_length("v") == usual["n"])
    chunk_rows, block_rows = max(1, min(CHUNK, CHUNK_BYTES // (8 * dims))), max(1, min(BLOCK, BLOCK_BYTES // (8 * dims)))
    parts = parts or max(PARTS, min(PARTS_MOST, math.isqrt(count) // 4))
    sample = min(SAMPLE_MOST, max(SAMPLE, SAMPLE_PART * parts))
    chosen = [np.frombuffer(r["v"], dtype) for r in vectors.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()]
    router = fit(np.stack(chosen), parts, k)

    def place(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("v").to_pylist()), dtype).reshape(-1, dims).astype(np.float64)
            part = router.probabilities(x).argmax(1) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], names=["vec_id", "is_query", "v", "part"])

    placed = cut(vectors.mapInArrow(place, "vec_id bigint, is_query boolean, v binary, part int"), "placed")
    sizes = np.zeros(router.weights.shape[1], np.int64)
    for r in placed.groupBy("part").count().collect():  # a row per part
        sizes[r["part"]] = r["count"]
    chunks = [int(-(-n // chunk_rows)) for n in sizes]

    def route(batches):
        for batch in batches:
            vs = batch.column("v").to_pylist()
            x = np.frombuffer(b"".join(vs), dtype).reshape(-1, dims).astype(np.float64)
            to = router.route(router.probabilities(x), sizes, k + 1) if len(x) else []
            ids = batch.column("vec_id").to_pylist()
            out = [(q, v, int(p), c, int(sizes[ps].sum())) for q, v, ps in zip(ids, vs, to, strict=True) for p in ps for c in range(chunks[p])]
            q, v, p, c, n = zip(*out, strict=True) if out else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.binary()), pa.array(p, pa.int32()), pa.array(c, pa.int32()), pa.array(n, pa.int64())], names=["query_id", "qv", "part", "chunk", "searched"])

    routed = cut(placed.filter("is_query").select("vec_id", "v").mapInArrow(route, "query_id bigint, qv binary, part int, chunk int, searched bigint"), "routed")
    blocks = np.zeros(len(sizes), np.int64)
    for r in routed.filter("chunk = 0").groupBy("part").count().collect():  # a row per part
        blocks[r["part"]] = -(-r["count"] // block_rows)
    of_part = lambda numbers: F.get(F.array(*[F.lit(int(n)) for n in numbers]), F.col("part"))
    queries = routed.withColumn("block", F.pmod(F.xxhash64("query_id"), of_part(np.maximum(blocks, 1))).cast("int"))
    chunk = F.pmod(F.xxhash64("vec_id"), of_part([max(1, c) for c in chunks])).cast("int")
    # A candidate goes to the blocks of the queries that come to its part, if there are any.
    to_blocks = F.explode(F.slice(F.sequence(F.lit(0), F.greatest(of_part(blocks), F.lit(1)).cast("int") - 1), 1, of_part(blocks).cast("int")))
    candidates = placed.select("vec_id", "v", "part", chunk.alias("chunk"), to_blocks.alias("block"))

    def best(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64"), "searched": pd.Series(dtype="int64")})
        if not len(qs) or not len(cs):
            return empty
        cs = cs.sort_values("vec_id")
        x = np.frombuffer(b"".join(cs["v"]), dtype).reshape(-1, dims).astype(np.float64)
        ids, out = cs["vec_id"].to_numpy(), []
        for at in range(0, len(qs), 64):
            some = qs.iloc[at : at + 64]
            y = np.frombuffer(b"".join(some["qv"]), dtype).reshape(-1, dims).astype(np.float64)
            own = some["query_id"].to_numpy()
            rows, found, exact = top(x, ids, y, own, k)
            out.append(pd.DataFrame({"query_id": own[rows], "vec_id": found, "score": exact, "searched": some["searched"].to_numpy()[rows]}))
        return pd.concat(out)

    key = ["part", "chunk", "block"]
    found = queries.groupBy(*key).cogroup(candidates.groupBy(*key)).applyInPandas(best, "query_id bigint, vec_id bigint, score double, searched bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "searched")
