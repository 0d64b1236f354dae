"""Packing documents into training sequences: best fit, then swap-based local search, in bounded groups."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import MOST, encoder
from .common import fresh_worker, partitions, written


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each item into the fullest bin that still holds it. Bins are lists of item numbers."""
    bins: list[list[int]] = []
    free: dict[int, list[int]] = {}
    open_sizes: list[int] = []  # the different free sizes, ascending
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        k = bisect.bisect_left(open_sizes, sizes[i])
        if k < len(open_sizes):
            room = open_sizes[k]
            b = free[room].pop()
            if not free[room]:
                del free[room], open_sizes[k]
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        room -= sizes[i]
        if room:
            if room not in free:
                bisect.insort(open_sizes, room)
                free[room] = []
            free[room].append(b)
    return bins


def local_search(bins: list[list[int]], sizes: list[int], capacity: int, most_rounds: int = 8) -> list[list[int]]:
    """Exchange one for one, two for one, or move items between underfull bins while the squared fill grows.

    The sum of squared fills rises with every step, so it ends; emptied bins go. It stops at the lower bound
    (total size over capacity), after a round without a step, or after ``most_rounds``. Only the emptiest bins give.
    """
    total = sum(sizes[i] for b in bins for i in b)
    bound = -(-total // capacity)
    for _ in range(most_rounds):
        if len(bins) <= bound:
            break
        fill = [sum(sizes[i] for i in b) for b in bins]
        under = sorted((k for k in range(len(bins)) if fill[k] < capacity), key=lambda k: fill[k])
        stepped = False
        for source in under[: len(bins) - bound + 2]:  # the emptiest bins, a few more than must go
            if not bins[source]:
                continue
            # moves: every item of an emptying bin goes to the fullest other bin with room
            for i in sorted(bins[source], key=lambda i: -sizes[i]):
                room = [k for k in under if k != source and bins[k] and fill[k] + sizes[i] <= capacity and fill[k] + sizes[i] > fill[source]]
                if room:
                    k = max(room, key=lambda k: fill[k])
                    bins[source].remove(i)
                    bins[k].append(i)
                    fill[source] -= sizes[i]
                    fill[k] += sizes[i]
                    stepped = True
            # exchanges: a fuller bin gives its smaller item (or two) for a larger one and gets fuller
            for k in reversed(under):
                if k == source or not bins[k] or not bins[source] or fill[k] < fill[source] or fill[k] == capacity:
                    continue
                gap, best = capacity - fill[k], (0, None, None)
                have = {}
                for j in bins[k]:
                    have.setdefault(sizes[j], (j,))
                for x in range(len(bins[k])):
                    for y in range(x):
                        have.setdefault(sizes[bins[k][x]] + sizes[bins[k][y]], (bins[k][x], bins[k][y]))
                of_k = sorted(have)
                for i in bins[source]:
                    p = bisect.bisect_left(of_k, sizes[i] - gap)
                    if p < len(of_k) and 0 < sizes[i] - of_k[p] and sizes[i] - of_k[p] > best[0]:
                        best = (sizes[i] - of_k[p], (i,), have[of_k[p]])
                for x in range(len(bins[source])):
                    for y in range(x):
                        two = sizes[bins[source][x]] + sizes[bins[source][y]]
                        for j in bins[k]:
                            if 0 < two - sizes[j] <= gap and two - sizes[j] > best[0]:
                                best = (two - sizes[j], (bins[source][x], bins[source][y]), (j,))
                if best[0]:
                    gain, give, take = best
                    bins[source] = [i for i in bins[source] if i not in give] + list(take)
                    bins[k] = [i for i in bins[k] if i not in take] + list(give)
                    fill[source] -= gain
                    fill[k] += gain
                    stepped = True
        bins = [b for b in bins if b]
        if not stepped:
            break
    return bins


def _pieces(vocabulary: str, end_id: int, capacity: int, most: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, most).encode
        end, task, at = np.array([end_id], "<u4"), TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = []
            for name, text in zip(batch.column("doc_id"), batch.column("text")):
                ids = np.concatenate([encode(text.as_py() or "").astype("<u4"), end])
                n = len(ids)
                first = n % capacity or min(n, capacity)
                for piece, start in enumerate([0, *range(first, n, capacity)]):
                    part = ids[start : first if not piece else start + capacity]
                    rows.append((name.as_py(), piece, start, len(part), zlib.crc32(part.tobytes()), task << 40 | at))
                    at += 1
            kinds = (batch.column("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "item"])

    return cut


def _pack_group(capacity: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        fresh_worker()
        rows = rows.sort_values("item", ignore_index=True)
        sizes = rows["length"].tolist()
        bins = local_search(best_fit(sizes, capacity), sizes, capacity)
        sequence, offset, fill = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for b in bins:
            at = 0
            for i in b:
                sequence[i], offset[i] = rows["item"][b[0]], at  # a bin is named after its first item: no number is used twice
                at += sizes[i]
            fill[b] = at
        return rows.assign(sequence_id=sequence, offset=offset, fill=fill)

    return pack


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024, group: int = 2048, rounds: int = 3, known: int = MOST) -> DataFrame:
    """Pack every row of ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A document is its ids and
    ``end_id``; only longer ones are cut, their first piece being the shorter one. Full pieces are sequences at once.
    The rest go into groups of about ``group`` pieces: best fit and local search work inside a group, so no task grows
    with the input; the pieces of bins that stay underfull meet again, in new groups, in the next of ``rounds``.
    ``known`` bounds the memory of the tasks that encode (``PieceEncoder``), the ids are the same.
    Null and empty texts are documents of one token; rows that repeat are packed each; extra columns are ignored; an empty
    table has no pieces.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    names = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = written(rows.mapInArrow(_pieces(vocabulary, end_id, capacity, known), f"{names}, item long"), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    done = [pieces.where(F.col("length") == capacity).select(*columns[:5], F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left = pieces.where(F.col("length") < capacity)
    for turn in range(rounds):
        n = left.count()
        groups = -(-n // group)
        dealt = left.withColumn("deal", F.pmod(F.xxhash64("item", F.lit(turn)), F.lit(max(1, groups)))) if n else left.withColumn("deal", F.lit(0).cast("long"))
        if groups > 1:
            dealt = dealt.repartition(min(groups, partitions(docs.sparkSession)), "deal")
        packed = written(dealt.groupBy("deal").applyInPandas(_pack_group(capacity), f"{names}, item long, deal long, sequence_id long, offset long, fill long"), "packed")
        last = turn == rounds - 1 or groups <= 1
        done.append((packed if last else packed.where(F.col("fill") == capacity)).select(*columns))
        if last:
            break
        left = packed.where(F.col("fill") < capacity).select(*columns[:5], "item")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
