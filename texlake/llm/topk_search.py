"""Exact top-k inner-product search by block-at-a-time pruning.

Every component is a term. Vectors are dealt to segments by their nearest pivot, so that the ranges of documents that
make up the blocks of a segment are alike. A segment holds its blocks as forward indexes (the rows themselves) and, for
each block, the greatest and least weight of each term; so has the segment as a whole. A query's bound for a block or
segment is the sum over terms of what it can add at most. Queries first meet the segments' maxima alone; only the blocks
of queries that a segment can serve are sent to it. Blocks are visited in descending order of their bounds until the next bound falls below the
query's k-th score; equal bounds are visited, since ties go to smaller ids. The first k-th score comes, once for a query, from a
bounded sample of real candidates, so most blocks fall at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written


def quantised(column: str, scale: int) -> Column:
    """floor(scale * component) of each component; null if the vector or a component is null or not finite."""
    x = F.transform(F.col(column), lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    bad = F.exists(F.col(column), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(F.col(column).isNotNull() & ~bad, x)


def _matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column as a matrix; shorter vectors are filled up with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _wide(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] >= width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def _pack(rows: int):
    """Rows (id, vector) to packed, numbered rows of at most ``rows`` vectors: block, ids, width, data, and the greatest and
    least weight of each term."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                part = batch.slice(a, rows)
                m = _matrix(part.column("vector"))
                number += 1
                binary = [part.column("vec_id").to_numpy(zero_copy_only=False), m, m.max(axis=0, initial=-(2**63)), m.min(axis=0, initial=2**63 - 1)]
                ids, data, top, low = (pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in binary)
                yield pa.RecordBatch.from_arrays([pa.array([number]), ids, pa.array([m.shape[1]], pa.int32()), data, top, low], names=["block", "ids", "width", "data", "top", "low"])

    return pack


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], "<i8")
    return ids, np.frombuffer(row["data"], "<i8").reshape(len(ids), row["width"])


def search_segment(ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int, block: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its number, and ids and scores of its best ``k`` rows of a segment that can be among its best at all."""
    width = max(rows.shape[1], queries.shape[1])
    rows, queries = _wide(rows, width), _wide(queries, width)
    size = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, width)
    kind = np.float64 if size < 2**53 else object if size >= 2**63 else np.int64  # exact in each case
    r, q = rows.astype(kind), queries.astype(kind)
    edges = np.arange(0, len(ids), block)
    top, low = np.maximum.reduceat(rows, edges, axis=0).astype(kind), np.minimum.reduceat(rows, edges, axis=0).astype(kind)
    bounds = np.maximum(q, 0) @ top.T + np.minimum(q, 0) @ low.T
    for j in range(len(q)):
        best_id, best, kth = np.zeros(0, np.int64), np.zeros(0, kind), floor[j]
        order = np.argsort(-bounds[j], kind="stable")
        a = 0
        while a < len(order) and bounds[j, order[a]] >= kth:
            some = order[a : a + 4]
            some = some[bounds[j, some] >= kth]
            at = (some[:, None] * block + np.arange(block)).reshape(-1)
            at = at[at < len(ids)]
            at = at[ids[at] != own[j]]
            score = r[at] @ q[j]
            keep = score >= kth
            best_id, best = np.concatenate([best_id, ids[at[keep]]]), np.concatenate([best, score[keep]])
            rank = np.lexsort((best_id, -best))[:k]
            best_id, best = best_id[rank], best[rank]
            if len(best) == k:
                kth = max(kth, best[-1])
            a += 4
        if len(best):
            yield j, best_id, np.array([min(max(int(x), -(2**63)), 2**63 - 1) for x in best], np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, sample: int = 512, segment: int = 4096, block: int = 64, query_block: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` best rows of ``vectors`` for every row of ``queries``.

    Both have vec_id (integer) and embedding; scores are inner products of floor(scale * component). A row is no
    candidate for a query of the same vec_id. Ties go to the smaller vec_id. Rows whose vec_id or vector is null, or
    with null or non-finite components, take no part; shorter vectors are filled up with zeros; repeated rows are
    candidates each; repeated queries give repeated results; extra columns are ignored; empty tables give empty results.
    Components and scores beyond 64 bits count as the greatest or least number of 64 bits.
    """
    spark = vectors.sparkSession
    n = partitions(spark)
    clean = lambda frame: frame.select(F.col("vec_id").cast("long").alias("vec_id"), quantised("embedding", scale).alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    schema = "query_id long, rank int, vec_id long, score long"
    rows = clean(vectors)
    known = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    if not known:
        return spark.createDataFrame([], schema)
    width = max(len(r["vector"]) for r in known)
    pivots = np.array([r["vector"] + [0] * (width - len(r["vector"])) for r in known], np.int64).reshape(len(known), width)
    pivot_ids = np.array([r["vec_id"] for r in known], np.int64)
    held = spark.sparkContext.broadcast((pivots, pivot_ids))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value[0][:64].astype(np.float64)
        p = p / np.maximum(np.sqrt((p**2).sum(axis=1, keepdims=True)), 1e-9)
        for batch in batches:
            m = _matrix(batch.column("vector")).astype(np.float64)
            w = max(m.shape[1], p.shape[1])
            cluster = (_wide(m, w) @ _wide(p, w).T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), pa.array(cluster.astype(np.int32))], names=["vec_id", "vector", "cluster"])

    def dealt(frame: DataFrame, per_row: int) -> DataFrame:
        # a cluster of very many rows is dealt over partitions by id; a partition sorts its clusters together
        near_rows = frame.mapInArrow(near, "vec_id long, vector array<long>, cluster int")
        apart = near_rows.repartition(n, "cluster", F.pmod(F.xxhash64("vec_id"), F.lit(max(16, n // 16)))).sortWithinPartitions("cluster", "vec_id")
        return apart.mapInArrow(_pack(per_row), "block long, ids binary, width int, data binary, top binary, low binary")

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of queries with each one's k-th score among the sample, a bound for those with k candidates there."""
        p, p_ids = held.value
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own, q = _unpack(row)
                w = max(q.shape[1], p.shape[1])
                seen = np.where(p_ids[None, :] != own[:, None], (_wide(q, w).astype(np.float64) @ _wide(p, w).T.astype(np.float64)), -np.inf)
                floor = np.sort(seen, axis=1)[:, -k] if seen.shape[1] >= k else np.full(len(q), -np.inf)
                out.append(np.where(np.isfinite(floor), np.floor(floor * (1 - 1e-12 * np.sign(floor))) - 1, -np.inf).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("block", "ids", "width", "data")), pa.array(out, pa.binary())], names=["block", "ids", "width", "data", "floor"])

    segments = written(dealt(rows, segment).withColumnRenamed("block", "segment"), "segments")
    asked = written(dealt(clean(queries), query_block).mapInArrow(floors, "block long, ids binary, width int, data binary, floor binary"), "query-blocks")
    packs = max(1, -(-segments.count() // 128))
    summary = segments.select(F.pmod(F.xxhash64("segment"), F.lit(packs)).alias("pack"), F.struct("segment", "top", "low").alias("s")).groupBy("pack").agg(F.collect_list("s").alias("s"))
    all_packs = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(packs - 1).cast("long")))

    def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of queries against the maxima of some segments: which segments can hold a result."""
        for batch in batches:
            for row in batch.to_pylist():
                _, q = _unpack(row)
                floor, width = np.frombuffer(row["floor"], "<f8"), max([q.shape[1], *(len(x["top"]) // 8 for x in row["s"])])
                # a shorter vector's further terms are zeros
                top, low = (np.array([np.pad(np.frombuffer(x[c], "<i8"), (0, width - len(x[c]) // 8)) for x in row["s"]]).astype(np.float64) for c in ("top", "low"))
                q = _wide(q, width).astype(np.float64)
                bounds = np.maximum(q, 0) @ top.T + np.minimum(q, 0) @ low.T
                slack = 1e-9 * (np.abs(q) @ np.maximum(np.abs(top), np.abs(low)).T) + 1
                needed = (bounds + slack >= floor[:, None]).any(axis=0)
                found = [x["segment"] for x, yes in zip(row["s"], needed) if yes]
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(found), pa.int64()), pa.array(found, pa.int64())], names=["block", "segment"])

    pairs = written(asked.withColumn("pack", all_packs).join(summary, "pack").select("block", "ids", "width", "data", "floor", "s").mapInArrow(serve, "block long, segment long"), "pairs")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                own, q = _unpack(row["q"])
                ids, r = _unpack(row["s"])
                out = list(search_segment(ids, r, q, own, np.frombuffer(row["q"]["floor"], "<f8"), k, block))
                count = [len(x) for _, x, _ in out]
                number = np.repeat(np.array([j for j, _, _ in out], np.int64), count)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(number), row["block"])), pa.array(number), pa.array(own[number]), pa.array(np.concatenate([x for _, x, _ in out]) if out else np.zeros(0, np.int64)), pa.array(np.concatenate([x for _, _, x in out]) if out else np.zeros(0, np.int64))], names=["block", "number", "query_id", "vec_id", "score"])

    # queries travel to the segments, which are by far the larger side
    sent = pairs.join(asked.select("block", F.struct("ids", "width", "data", "floor").alias("q")), "block")
    held_rows = segments.select("segment", F.struct("ids", "width", "data").alias("s"))
    found = sent.join(held_rows, "segment").select("block", "s", "q").mapInArrow(score, "block long, number long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("block", "number").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
