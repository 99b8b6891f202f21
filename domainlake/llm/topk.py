"""Exact top-k search by inner product, reading sorted component lists without random access."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LONG_MAX = (1 << 63) - 1


def sorted_lists(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every component a list: row numbers by ascending value, and the values in that order."""
    columns = np.ascontiguousarray(vectors.T)
    order = np.argsort(columns, axis=1, kind="stable")
    return order.astype(np.int32), np.take_along_axis(columns, order, axis=1).astype(np.float64)


def top_k(
    query: np.ndarray, vectors: np.ndarray, lists: tuple[np.ndarray, np.ndarray], k: int, skip: np.ndarray
) -> np.ndarray:
    """Rows that hold the k largest inner products with `query`, and all that tie with the last of them.

    Each list is read in sequence from the end that the query's sign prefers, all lists to the same depth.
    A row that was read in some lists has a lower bound (the worst value of each other list) and an upper
    bound (the value last read there); rows never read have the sum of those values as upper bound. When
    at most the rows in reach of the k-th best lower bound are left, reading stops, and the final scores
    of these are resolved. Rows in `skip` don't count. All scores are exact integers below 2**53.
    """
    order, values = lists
    n = len(vectors)
    active = np.flatnonzero(query)
    if not len(active) or n <= k + len(skip):
        return np.setdiff1d(np.arange(n), skip)
    q = query[active].astype(np.float64)
    up = q > 0
    worst = np.where(up, values[active, 0], values[active, -1]) * q
    base = worst.sum()
    partial = np.zeros(n)  # sum of the terms read, less the worst term of the same list
    unread = np.ones((len(active), n), dtype=np.float32)
    out = np.zeros(n, dtype=bool)
    out[skip] = True
    gap = np.zeros(len(active))  # of a list's last value read over its worst
    depth, step = 0, max(16, n // 4)
    while depth < n:
        end = min(n, depth + step)
        for j, (component, rising) in enumerate(zip(active, up)):
            part = slice(n - end, n - depth) if rising else slice(depth, end)
            rows = order[component, part]
            terms = values[component, part] * q[j] - worst[j]
            partial[rows] += terms
            unread[j, rows] = 0
            gap[j] = terms[0 if rising else -1]
        depth, step = end, max(16, n // 8)
        lower = np.where(out, -np.inf, base + partial)
        bar = np.partition(lower, n - k)[n - k]
        # Single precision is widened by more than its error; too many rows resolved do no harm.
        slack = np.abs(gap).sum() * len(active) * 2.0**-22 + 1
        upper = lower + (gap.astype(np.float32) @ unread) + slack  # a row never read: the values last read
        left = np.flatnonzero(upper >= bar)
        if len(left) <= max(8 * k, n // 8):
            return left
    return left


def _as_matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of integers as rows; shorter ones are filled with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if len(flat) == len(lengths) * dims:
        return flat.reshape(-1, dims)
    out = np.zeros((len(lengths), dims), dtype=np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(x) for x in lengths])] = flat
    return out


def _search_block(k: int):
    def work(queries: pa.Table, rows: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        empty = pa.table([pa.array([], pa.int64())] * 3, names=names)
        if not queries.num_rows or not rows.num_rows:
            return empty
        columns = [t.column(c).combine_chunks() for t in (queries, rows) for c in ("vec_id", "codes")]
        dims = max(len(c.flatten()) and int(np.diff(c.offsets.to_numpy()).max()) for c in columns[1::2])
        q_ids, ids = columns[0].to_numpy(), columns[2].to_numpy()
        q, v = (_as_matrix(c, dims) for c in columns[1::2])
        # Terms and sums must be exact in doubles; larger numbers take Python's integers.
        largest = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(v.astype(float)).max(initial=0))
        exact = largest * max(dims, 1) < 2**52
        by_id = np.argsort(ids, kind="stable")
        lists = sorted_lists(v) if exact else None
        out = []
        for qid, query in zip(q_ids.tolist(), q):
            own = by_id[np.searchsorted(ids, qid, "left", sorter=by_id) : np.searchsorted(ids, qid, "right", sorter=by_id)]
            if exact:
                left = top_k(query, v, lists, k, own)
                scores = v[left] @ query
            else:
                left = np.setdiff1d(np.arange(len(v)), own)
                scores = np.array([sum(map(int.__mul__, query.tolist(), r)) for r in v[left].tolist()], dtype=object)
                scores = np.clip(scores, -LONG_MAX - 1, LONG_MAX).astype(np.int64)
            best = np.lexsort((ids[left], -scores.astype(object) if not exact else -scores))[:k]
            out.append((np.full(len(best), qid), ids[left][best], scores[best]))
        return pa.table([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], names=names)

    return work


def exact_top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, block: int = 16384, query_block: int = 4096
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of `vectors` with the largest inner product, per query.

    Both tables have vec_id (long) and embedding; a component x counts as floor(scale * x), so scores are
    integers. Ties go to the smaller vec_id, then any. Rows with the query's own vec_id are no candidates.
    Vectors that are null or hold a null or non-finite component take no part, nor do null vec_ids;
    missing components of a shorter vector count as zero, and scores beyond a long end at its limits. Rows
    with equal vec_id are ranked one by one, but a query id that occurs repeatedly is asked once (with its
    smallest vector). Empty tables give no rows; other columns are ignored.

    Rows are dealt into blocks of about `block`, queries into blocks of about `query_block`; each pair of
    blocks is one task's search, and the k best of every block are merged.
    """
    spark = vectors.sparkSession

    def coded(df):
        usable = F.expr("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
        codes = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
        rows = df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & usable)
        return rows.select(F.col("vec_id").cast("long").alias("vec_id"), codes.alias("codes"))

    rows = coded(vectors)
    asked = coded(queries).groupBy("vec_id").agg(F.min("codes").alias("codes"))
    n_blocks = max(1, math.ceil(rows.count() / block))
    n_asked = max(1, math.ceil(asked.count() / query_block))
    # Equal rows are spread too, by their place in the scan.
    place = F.xxhash64("vec_id", F.monotonically_increasing_id())
    rows = rows.withColumn("b", F.pmod(place, F.lit(n_blocks)).cast("int")).withColumn(
        "a", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1)))
    )
    asked = asked.withColumn("a", F.pmod(F.xxhash64("vec_id"), F.lit(n_asked)).cast("int")).withColumn(
        "b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    )
    found = (
        asked.groupBy("a", "b")
        .cogroup(rows.groupBy("a", "b"))
        .applyInArrow(_search_block(k), "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
