"""Exact top-k inner products by no-random-access aggregation (NRA) over sorted lists.

Each block of candidates keeps one sorted list per dimension. A query reads every list from the end where its own
component makes the scores large, so after each step the values still unread are bounded by the last one read. That
gives each candidate a lower and an upper bound; candidates whose upper bound lies under the k-th lower bound are out,
and once few are left their scores are resolved. Bounds of all queries of a block come from matrix products.

On dense vectors that point everywhere no bound tells before most of the lists are read: of 64 dimensions about 0.85. So
at each step some queries go first, and if none of them has few candidates left the others read on without bounds. Where
lists end all scores are known.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Queries that try a step's bounds first.
FIRST = 32


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exact: in doubles where every sum stays under 2**53, else in 64-bit integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)))
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    return a.astype(float) @ b.T.astype(float) if most < 2**53 else a @ b.T


def nra(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, steps=(0.5, 0.85, 0.9, 1.0)):
    """(query number, row number, score) of at least each query's k best rows, its own id left out, and the share of its lists that each query read."""
    n = len(rows)
    order = np.sort(rows, axis=0)
    rank = np.empty_like(rows)
    np.put_along_axis(rank, np.argsort(rows, axis=0, kind="stable"), np.broadcast_to(np.arange(n)[:, None], rows.shape), axis=0)
    read = np.ones(len(queries))
    found = []

    def resolved(q: int, at_rows: np.ndarray, scores: np.ndarray) -> None:
        best = np.lexsort((ids[at_rows], -scores))[:k]
        found.append((np.full(len(best), q), at_rows[best], scores[best].astype(np.int64)))

    def stopped(asking: np.ndarray, depth: int) -> np.ndarray:
        """Which of these queries have few candidates left once so many rows of each list are read; those are resolved."""
        up, down = np.maximum(queries[asking], 0), np.minimum(queries[asking], 0)
        top, bottom = rank >= n - depth, rank < depth  # what has been read from either end
        low = _product(up, np.where(top, rows, order[0])) + _product(down, np.where(bottom, rows, order[-1]))
        high = _product(up, np.where(top, rows, order[n - depth])) + _product(down, np.where(bottom, rows, order[depth - 1]))
        own = ids[None, :] == query_ids[asking][:, None]
        low = np.where(own, -np.inf if low.dtype == float else np.iinfo(np.int64).min, low)
        kth = -np.partition(-low, k, axis=1)[:, k - 1]
        left = (high >= kth[:, None]) & ~own
        few = left.sum(axis=1) <= max(8 * k, n // 32)
        for at in np.flatnonzero(few):
            at_rows, q = np.flatnonzero(left[at]), asking[at]
            resolved(q, at_rows, _product(queries[q : q + 1], rows[at_rows])[0])
            read[q] = depth / n
        return few

    open_ = np.arange(len(queries))
    for step in steps:
        depth = max(k + 1, int(np.ceil(n * step)))
        if depth >= n or not len(open_):
            break
        few = stopped(open_[:FIRST], depth)
        if few.any():
            few = np.concatenate([few, stopped(open_[FIRST:], depth)]) if len(open_) > FIRST else few
            open_ = open_[~few]
    if len(open_):  # their lists are read to the end
        scores = _product(queries[open_], rows)
        for at, q in enumerate(open_):
            other = np.flatnonzero(ids != query_ids[q])
            if len(other) > k:
                known = scores[at, other]
                other = other[known >= -np.partition(-known, k - 1)[k - 1]]
            resolved(q, other, scores[at, other])
    if not found:
        return (*((np.zeros(0, np.int64),) * 3), read)
    return (*(np.concatenate(x) for x in zip(*found, strict=True)), read)


def _matrix(vectors) -> np.ndarray:
    size = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), size), dtype=np.int64)
    for at, v in enumerate(vectors):
        out[at, : len(v)] = v
    return out


def _packs(frames, rows: int):
    """Blocks of so many vectors, as bytes, from one partition's stream."""
    ids, vectors = [], []

    def block():
        m = _matrix(vectors)
        return pd.DataFrame({"ids": [np.array(ids, dtype=np.int64).tobytes()], "dims": [m.shape[1]], "vectors": [m.tobytes()]})

    for frame in frames:
        for i, v in zip(frame["id"], frame["v"], strict=True):
            ids.append(i)
            vectors.append(v)
            if len(ids) == rows:
                yield block()
                ids, vectors = [], []
    if ids:
        yield block()


def _unpack(ids: bytes, dims: int, vectors: bytes, wide: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, dtype=np.int64)
    m = np.frombuffer(vectors, dtype=np.int64).reshape(len(i), dims)
    return i, np.pad(m, ((0, 0), (0, wide - dims)))


def _search(frames, k: int):
    """Each pack of queries against the blocks of its slot, which come before it in the stream."""
    slot, blocks = None, []
    for frame in frames:
        for r in frame.itertuples(index=False):
            if r.slot != slot:
                slot, blocks = r.slot, []
            if r.kind == 0:
                blocks.append((r.ids, r.dims, r.vectors))
                continue
            for block in blocks:
                wide = max(r.dims, block[1])
                q_ids, q = _unpack(r.ids, r.dims, r.vectors, wide)
                ids, rows = _unpack(*block, wide)
                at, to, scores, _ = nra(q, q_ids, rows, ids, k)
                yield pd.DataFrame({"query_id": q_ids[at], "vec_id": ids[to], "score": scores})


def quantised(rows: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """id and v, the vector with every component x as floor(scale * x); rows with a null id or vector, or with null or non-finite components, are gone."""
    x = F.transform(F.col(embedding), lambda x: x.cast("double"))
    return (
        rows.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull())
        .select(F.col(vec_id).cast("long").alias("id"), x.alias("x"))
        .where(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
        .select("id", F.transform("x", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v"))
    )


def top_k(
    rows: DataFrame,
    is_query,
    *,
    k: int = 10,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    scale: int = 1024,
    block_rows: int = 8192,
    pack_rows: int = 1024,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each query, ties to the smaller vec_id.

    Queries are the rows where ``is_query`` (a condition on the table) holds; candidates all rows but those of the
    query's own id. Vectors that are null, or hold null or non-finite components, take no part; a shorter vector counts
    as zero beyond its end. Repeated rows of a candidate each count; of a query's repeated rows the first by value asks.
    Scores must fit 64-bit integers. An empty table, or one without queries, gives no row. Candidates go in blocks of
    ``block_rows``, each sent to one slot; every pack of ``pack_rows`` queries goes to every slot. So candidates are
    shuffled once, queries once per block, memory holds a slot's blocks and one pack, and only k rows a query and block
    leave the search. A slot has one block, or a few by the chance of hashing.
    """
    keep = Scratch(rows.sparkSession, "topk")
    all_rows = quantised(rows, vec_id, embedding, scale)
    asked = quantised(rows.where(is_query), vec_id, embedding, scale).groupBy("id").agg(F.min("v").alias("v"))
    pack_type = "ids binary, dims int, vectors binary"
    blocks = keep.write(all_rows.mapInPandas(lambda it: _packs(it, block_rows), pack_type).withColumn("number", F.monotonically_increasing_id()))
    slots = max(1, blocks.count())
    blocks = blocks.select(F.pmod(F.xxhash64("number"), F.lit(slots)).alias("slot"), F.lit(0).alias("kind"), "ids", "dims", "vectors")
    packs = asked.mapInPandas(lambda it: _packs(it, pack_rows), pack_type)
    packs = packs.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))).alias("slot"), F.lit(1).alias("kind"), "ids", "dims", "vectors")
    dealt = blocks.unionByName(packs).repartition("slot").sortWithinPartitions("slot", "kind")
    found = dealt.mapInPandas(lambda it: _search(it, k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
