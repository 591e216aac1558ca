"""Exact top-k by inner product: blocks in order of their bounds, until none can matter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procura.operators.joins import checkpointed

# Rows of a block, blocks that one task holds, queries that one task holds.
BLOCK, UNIT, CHUNK = 512, 16, 2048
_LONG = np.iinfo(np.int64)


def _exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as doubles where all sums of products are exact in them, else as ints."""
    most = max([1, *(int(np.abs(a.astype(object)).max()) for a in arrays if a.size)])
    kind = np.float64 if most * most * arrays[0].shape[1] < 2**53 else object
    return [a.astype(kind) for a in arrays]


def _long(scores: np.ndarray) -> np.ndarray:
    """Scores set to the range of longs; doubles that are exact lie within it."""
    return np.clip(scores, _LONG.min, _LONG.max) if scores.dtype == object else scores


def _sorted(at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Order by query, falling score, id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(at)), key=lambda t: (at[t], -scores[t], ids[t])), np.int64)
    return np.lexsort((ids, -scores, at))


def search(queries: np.ndarray, own: np.ndarray, least: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int):
    """The best ``k`` rows of ``blocks`` for every query, as (query, id, score) arrays.

    ``blocks``: ids and rows. The bound of a block for a query sums, per component, the
    larger product with the block's extremes. Every query takes its blocks by falling
    bound and stops below ``least`` (a score that its k-th best reaches) or below the
    k-th best found. ``own``: ids that are no candidates.
    """
    if not len(queries) or not blocks:
        return (np.empty(0, np.int64),) * 3
    q, *rows = _exact(queries, *(r for _, r in blocks))
    high, low = np.array([r.max(axis=0) for r in rows]), np.array([r.min(axis=0) for r in rows])
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    bound = _long(bound)
    order = np.argsort(-bound, axis=1, kind="stable")
    kth = least.astype(q.dtype)
    at, ids, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, q.dtype)
    for turn in range(len(rows)):
        mine = order[:, turn]
        active = np.flatnonzero(bound[np.arange(len(q)), mine] >= kth)
        if not len(active):
            break
        for b in np.unique(mine[active]):
            asks = active[mine[active] == b]
            found = _long(q[asks] @ rows[b].T)
            i, j = np.nonzero((found >= kth[asks][:, None]) & (blocks[b][0][None, :] != own[asks][:, None]))
            at, ids, scores = np.append(at, asks[i]), np.append(ids, blocks[b][0][j]), np.append(scores, found[i, j])
        best = _sorted(at, scores, ids)
        at, ids, scores = at[best], ids[best], scores[best]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        at, ids, scores, rank = at[rank < k], ids[rank < k], scores[rank < k], rank[rank < k]
        full = rank == k - 1
        kth[at[full]] = np.maximum(kth[at[full]], scores[full])
    return at, ids, scores.astype(np.int64)


def top_k(
    vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", k: int = 10, every: int = 100, scale: int = 1024
) -> DataFrame:
    """``query_id, rank, id_column, score``: the ``k`` best rows for each query.

    Components become ``floor(scale * x)`` and a score is their integer inner product.
    Queries are the rows whose id is divisible by ``every``; candidates are all rows with
    another id, ties go to the smaller id. Candidates are cut to blocks of ``BLOCK`` rows
    in the order they are stored, queries to chunks of about ``CHUNK``; every task meets
    one chunk and ``UNIT`` blocks. A first pass over one unit gives each query a score
    that its k-th best reaches at least; the second pass prunes by it and returns only
    rows that reach it.

    Vectors that are null or hold null or non-finite components, and null ids, take no
    part. Vectors of different lengths do not meet. Rows that repeat an id are separate
    candidates; a query that repeats id and vector is asked once, and one that repeats
    the id only gets a ranking for each vector. Components and
    scores beyond the range of longs are set to its end, before they are ranked.
    """
    fine = F.col(id_column).isNotNull() & F.forall(column, lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False)))
    whole = F.transform(column, lambda e: F.floor(e.cast("double") * scale))
    rows = vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_column).cast("long").alias("_id"), whole.alias("_v"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for batch in batches:
            for i, v in zip(batch["_id"], batch["_v"], strict=True):
                some = held.setdefault(len(v), [])
                some.append((i, v))
                if len(some) == BLOCK:
                    yield block(len(v), held.pop(len(v)))
        for size, some in held.items():
            yield block(size, some)

    def block(size: int, some: list) -> pd.DataFrame:
        ids, data = np.array([i for i, _ in some], np.int64), np.array([v for _, v in some], np.int64)
        return pd.DataFrame({"_size": [size], "_ids": [ids.tobytes()], "_rows": [data.tobytes()]})

    blocks = rows.mapInPandas(cut, "_size int, _ids binary, _rows binary")
    blocks = checkpointed(blocks.withColumn("_key", F.xxhash64("_ids", "_rows")))
    queries = rows.where(F.col("_id") % every == 0).dropDuplicates()
    queries = checkpointed(queries.select("_id", "_v", F.size("_v").alias("_size"), F.md5(F.to_json(F.struct("_id", "_v"))).alias("_ask")))
    units = blocks.groupBy("_size").agg(F.ceil(F.count("*") / UNIT).cast("int").alias("_units"))
    chunks = queries.groupBy("_size").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("_chunks"))
    shape = units.join(chunks, "_size")
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = queries.join(shape, "_size").withColumn("_chunk", deal("_ask", "_chunks")).drop("_chunks")
    stored = blocks.join(shape, "_size").withColumn("_unit", deal("_key", "_units")).withColumn("_chunk", each("_chunks"))
    stored = stored.drop("_units", "_chunks")

    def meet(asks: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        parts: dict[str, list] = {"_ask": [], "query_id": [], "_id": [], "score": []}
        for (size,), group in some.groupby(["_size"]):
            mine = asks[asks["_size"] == size]
            least = mine["_least"].to_numpy() if "_least" in mine else np.full(len(mine), _LONG.min)
            held = [(np.frombuffer(i, np.int64), np.frombuffer(r, np.int64).reshape(len(i) // 8, size)) for i, r in zip(group["_ids"], group["_rows"], strict=True)]
            own, names = mine["_id"].to_numpy(), mine["_ask"].tolist()
            vectors = np.array(mine["_v"].tolist(), np.int64).reshape(len(mine), size)
            at, ids, scores = search(vectors, own, least, held, k)
            parts["_ask"] += [names[i] for i in at]
            parts["query_id"] += own[at].tolist()
            parts["_id"] += ids.tolist()
            parts["score"] += scores.tolist()
        return pd.DataFrame({name: pd.Series(part, dtype=object if name == "_ask" else np.int64) for name, part in parts.items()})

    def passed(asks: DataFrame) -> DataFrame:
        keys = ["_size", "_chunk", "_unit"]
        return asks.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInPandas(meet, "_ask string, query_id long, _id long, score long")

    def best(found: DataFrame) -> DataFrame:
        """The k best of each query; lists stay as short as k, before the shuffle too."""
        order = "row_number() OVER (PARTITION BY _ask ORDER BY score DESC, _id)"
        return found.withColumn("rank", F.expr(order)).where(F.col("rank") <= k)

    probe = passed(asked.withColumn("_unit", deal("_ask", "_units")))
    reach = probe.groupBy("_ask").agg(F.when(F.count("*") >= k, F.min("score")).alias("_least"))
    bounded = asked.join(reach, "_ask", "left").withColumn("_least", F.coalesce("_least", F.lit(int(_LONG.min)).cast("long")))
    bounded = checkpointed(bounded)
    found = best(passed(bounded.withColumn("_unit", each("_units"))))
    return found.select("query_id", "rank", F.col("_id").alias(id_column), "score")
