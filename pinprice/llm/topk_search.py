"""Exact top-k search by inner product over blocks of document ranges.

The corpus is cut into blocks of consecutive ids. A block holds a forward
index (its integer matrix) and, per term (vector component), the extremes over
its rows. For a query the summed term maxima bound every score in a block;
blocks are scored in falling order of that bound until it drops below the
k-th score found, so the answer is exact.

Work is split into cells of (query group, block group): each query group goes
to every block group, which is the stated query set against all rows, in
blocks. A cell's memory is bounded by ``query_group`` and ``block_group *
block_rows`` rows; its answer is k rows per query, merged by a top-k window.

Defined results: vectors that are null or hold a null or non-finite component
take no part, as query or candidate; shorter vectors count as padded with
zeros; rows with the query's own id are no candidates of it; rows of equal id
are separate candidates, but a repeated query id asks once, with its least
vector; ties go to the smaller id; a null id takes no part; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pinprice.llm.common import ship_package, store

BLOCK = "block long, n int, dim int, ids binary, mat binary, hi binary, lo binary"


def scaled(vec: str, scale: int = 256) -> Column:
    """floor(scale * x) per component; null unless every component is finite."""
    x = F.transform(F.col(vec), lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def pack(rows: int):
    """mapInArrow: (id, q) rows in id order to blocks of ``rows`` rows."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, list]] = []

        def cut(last: bool):
            nonlocal held, n
            ids = np.concatenate([h[0] for h in held]) if held else np.empty(0, np.int64)
            vecs = [v for h in held for v in h[1]]
            at = 0
            while len(ids) - at >= rows or (last and at < len(ids)):
                i, v = ids[at:at + rows], vecs[at:at + rows]
                dim = max(map(len, v))
                m = np.zeros((len(v), dim), np.int64)
                for r, x in enumerate(v):
                    m[r, :len(x)] = x
                yield pa.RecordBatch.from_pylist([{
                    "block": (part << 32) + n, "n": len(i), "dim": dim, "ids": i.tobytes(), "mat": m.tobytes(),
                    "hi": m.max(0).tobytes(), "lo": m.min(0).tobytes()}], schema=_SCHEMA)
                n, at = n + 1, at + rows
            held = [(ids[at:], vecs[at:])] if at < len(ids) else []

        size = 0
        for b in batches:
            held.append((b.column(0).to_numpy(zero_copy_only=False).astype(np.int64),
                         list(b.column(1).to_numpy(zero_copy_only=False))))
            size += b.num_rows
            if size >= rows:
                yield from cut(False)
                size = sum(len(h[0]) for h in held)
        yield from cut(True)

    return blocks


_SCHEMA = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()),
                     ("mat", pa.binary()), ("hi", pa.binary()), ("lo", pa.binary())])


def _matrix(row, name: str, n: int, dim: int, dtype) -> np.ndarray:
    """A packed matrix as ``dtype``, padded with zeros to ``dim`` columns."""
    m = np.frombuffer(row[name], np.int64).reshape(n, -1) if n else np.empty((0, dim), np.int64)
    if m.shape[1] < dim:
        m = np.pad(m, ((0, 0), (0, dim - m.shape[1])))
    return m.astype(dtype)


def exact_dtype(dim: int, a: int, b: int):
    """A type in which sums of ``dim`` products of values up to a and b are exact."""
    top = dim * a * b
    return np.float32 if top < 2**24 else np.float64 if top < 2**53 else object


def search_cell(queries: list[tuple[int, np.ndarray]], blocks: list[dict], k: int) -> Iterator[tuple]:
    """(query id, vec id, score) of the k best rows of these blocks for each query."""
    dim = max([b["dim"] for b in blocks] + [len(q) for _, q in queries])
    top = lambda arrays: max((int(np.abs(x).max()) for x in arrays if x.size), default=0)
    hi64 = np.vstack([_matrix(b, "hi", 1, dim, np.int64) for b in blocks])
    lo64 = np.vstack([_matrix(b, "lo", 1, dim, np.int64) for b in blocks])
    dtype = exact_dtype(dim, top([q for _, q in queries]), top([hi64, lo64]))
    mats = [_matrix(b, "mat", b["n"], dim, dtype) for b in blocks]
    # rows padded to the common width hold zeros there, and so may the bounds
    hi, lo = hi64.astype(dtype), lo64.astype(dtype)
    ids = [np.frombuffer(b["ids"], np.int64) for b in blocks]
    for qid, q in queries:
        v = np.zeros(dim, np.int64)
        v[:len(q)] = q
        v = v.astype(dtype)
        bound = hi @ np.maximum(v, 0) + lo @ np.minimum(v, 0)
        best_s, best_i, kth = np.empty(0, dtype), np.empty(0, np.int64), None
        for j in np.argsort(-bound, kind="stable"):
            if kth is not None and bound[j] < kth:
                break
            s = mats[j] @ v
            keep = ids[j] != qid
            if kth is not None:
                keep &= s >= kth
            if not keep.any():
                continue
            s, i = np.concatenate([best_s, s[keep]]), np.concatenate([best_i, ids[j][keep]])
            order = (np.lexsort((i, -s)) if dtype is not object
                     else np.array(sorted(range(len(s)), key=lambda x: (-s[x], i[x]))))[:k]
            best_s, best_i = s[order], i[order]
            if len(best_s) == k:
                kth = best_s[-1]
        for i, s in zip(best_i, best_s, strict=True):
            yield qid, int(i), int(s)


def top_k(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5,
          scale: int = 256, block_rows: int = 256, block_group: int = 128, query_group: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every row that ``queries`` (over id_col) selects."""
    spark = vectors.sparkSession
    ship_package(spark)
    ok = (vectors.select(F.col(id_col).cast("long").alias("id"), scaled(vec_col, scale).alias("q"))
          .where("id is not null and q is not null"))
    blocks = store(ok.repartitionByRange("id").sortWithinPartitions("id").mapInArrow(pack(block_rows), BLOCK),
                   "search-blocks")
    asked = store(ok.where(F.expr(queries) if isinstance(queries, str) else queries).groupBy("id")
                  .agg(F.min("q").alias("q")), "search-queries")
    n_groups = max(1, math.ceil(blocks.count() / block_group))
    q_groups = max(1, math.ceil(asked.count() / query_group))
    # a block group takes blocks from all ranges, so that every cell has near and far ones
    left = asked.select(F.pmod(F.xxhash64("id"), F.lit(q_groups)).alias("h"), "id", "q").withColumn(
        "g", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))).select(F.struct("h", "g").alias("cell"), "id", "q")
    right = blocks.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(n_groups)).cast("int")).withColumn(
        "h", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_groups - 1).cast("long")))).select(
        F.struct("h", "g").alias("cell"), "n", "dim", "ids", "mat", "hi", "lo")

    def cell(lt: pa.Table, rt: pa.Table) -> pa.Table:
        qs = list(zip(lt["id"].to_pylist(), [np.asarray(x, np.int64) for x in lt["q"].to_pylist()], strict=True))
        bs = rt.drop_columns(["cell"]).to_pylist()
        out = list(search_cell(qs, bs, k)) if qs and bs else []
        return pa.table({"query_id": pa.array([o[0] for o in out], pa.int64()),
                         "vec_id": pa.array([o[1] for o in out], pa.int64()),
                         "score": pa.array([o[2] for o in out], pa.int64())})

    found = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(
        cell, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


__all__ = ["exact_dtype", "pack", "scaled", "search_cell", "top_k"]
