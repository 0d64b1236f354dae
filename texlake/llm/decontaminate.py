"""Benchmark decontamination: which documents contain a test item, by size-partitioned MinHash containment search.

An item Q is contained in a document X when at least ``num / den`` of Q's word shingles are among X's. MinHash sketches
of a long document say little about a short item, so the sketch is the item's: its k least shingle hashes, with
k = |Q| - needed + 1, where ``needed`` is the number of shingles that must be shared. A document that shares ``needed``
shingles shares one of any k, so the search misses nothing. Items are partitioned by size; each partition has its own
bound: the greatest hash in its sketches. A document offers a partition only its hashes up to that bound, and only if
it has enough shingles for the partition's smallest item. Candidates are verified on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import hashing
from .common import batches_of, free_name, fresh_worker

#: Bytes of benchmark text that go to the tasks at once, about.
BLOCK_BYTES = 32_000_000

_SPACE = " \t\n\x0b\x0c\r"


def words_of(text: str) -> list[str]:
    """Words between ASCII white space, A-Z in lower case."""
    return [w.decode() for w in text.encode().lower().split()]


def shingle_set(words: list[str], width: int) -> set[tuple[str, ...]]:
    """``width``-word shingles; of fewer words, the whole sequence; of none, nothing."""
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


class Index:
    """Sketches of some items, by size partition."""

    def __init__(self, items: list[tuple[int, str]], width: int, num: int, den: int):
        self.width, self.num, self.den = width, num, den
        self.ids = [i for i, _ in items]
        self.sets = [shingle_set(words_of(t), width) for _, t in items]
        self.needed = [-(-num * len(s) // den) for s in self.sets]
        #: (words to a shingle, least number of shingles, bound, sorted sketch hashes, item of each)
        self.partitions = []
        short = [min(width, len(next(iter(s)))) if s else 0 for s in self.sets]
        classes: dict[tuple[int, int], list[int]] = {}
        for k, s in enumerate(self.sets):
            if s:
                classes.setdefault((short[k], len(s).bit_length()), []).append(k)
        for (n, _), of in sorted(classes.items()):
            hashes, items_of = [], []
            for k in of:
                own = np.sort(self._hashes(self.sets[k]))[: len(self.sets[k]) - self.needed[k] + 1]
                hashes.append(own)
                items_of.append(np.full(len(own), k))
            hashes, items_of = np.concatenate(hashes), np.concatenate(items_of)
            order = np.argsort(hashes, kind="stable")
            self.partitions.append((n, min(self.needed[k] for k in of), hashes.max(), hashes[order], items_of[order]))

    def _hashes(self, shingles: set[tuple[str, ...]]) -> np.ndarray:
        lines = [" ".join(s).encode() for s in shingles]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int64)
        words, owner = hashing.word_hashes(np.frombuffer(b"".join(lines), np.uint8), offsets)
        return hashing.shingles(words, owner, len(next(iter(shingles))))[0]

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (document, item) of which a sketch hash is among the document's shingles."""
        words, owner = hashing.word_hashes(data, offsets)
        counts = np.bincount(owner, minlength=len(offsets) - 1)
        docs, items = [], []
        by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n, least, bound, sketch, of in self.partitions:
            if n not in by_width:
                by_width[n] = hashing.shingles(words, owner, n)
            h, who = by_width[n]
            offered = (h <= bound) & (counts[who] - n + 1 >= least)
            h, who = h[offered], who[offered]
            low, high = np.searchsorted(sketch, h, "left"), np.searchsorted(sketch, h, "right")
            hit = np.flatnonzero(high > low)
            n_hits = (high - low)[hit]
            docs.append(np.repeat(who[hit], n_hits))
            items.append(of[np.arange(n_hits.sum()) - np.repeat(np.cumsum(n_hits) - n_hits, n_hits) + np.repeat(low[hit], n_hits)])
        if not docs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return hashing.distinct_pairs(np.concatenate(items), np.concatenate(docs))[::-1]


def _found(index: Index, batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Verified (document, item, shared shingles) of a batch."""
    before, sets, words = None, {}, []
    for d, k in zip(*(x.tolist() for x in index.candidates(data, offsets))):
        if d != before:
            before, sets = d, {}
            words = words_of(data[offsets[d] : offsets[d + 1]].tobytes().decode())
        n = len(next(iter(index.sets[k])))
        if n not in sets:
            sets[n] = {tuple(words[j : j + n]) for j in range(len(words) - n + 1)}
        shared = len(index.sets[k] & sets[n])
        if shared >= index.needed[k]:
            yield d, k, shared


def _blocks(benchmark: DataFrame, block: int) -> Iterator[list[tuple[int, str]]]:
    """The items, in bounded blocks."""
    items = benchmark.where("text IS NOT NULL").select("item_id", F.col("text").cast("string").alias("text"))
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // block), -(-(size["bytes"] or 0) // BLOCK_BYTES))
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for b in range(blocks):
        rows = items.where(number == b).collect()
        if rows:
            yield [(r["item_id"], r["text"]) for r in rows]


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 5, num: int = 80, den: int = 100, block: int = 50_000) -> DataFrame:
    """Pairs (doc_id, item_id, n_shared, n_shingles, containment) of documents and the benchmark items they contain.

    Takes docs (doc_id, text) and benchmark (item_id, text). Words stand between ASCII white space, A-Z lower-cased; an
    item of fewer than ``width`` words is one shingle, its whole sequence. Null and empty texts contain nothing and are
    contained in nothing; repeated rows of either side give repeated pairs; extra columns are ignored; an empty table
    gives an empty result. Documents aren't shuffled. The benchmark goes to the tasks in blocks of ``block`` items, as
    many passes over the documents as blocks, or more blocks if they would pass BLOCK_BYTES, so its size is never assumed.
    """
    spark = docs.sparkSession
    kinds = [frame.schema[c].dataType.simpleString() for frame, c in ((docs, "doc_id"), (benchmark, "item_id"))]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, n_shared long, n_shingles long"
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    found = None
    for rows in _blocks(benchmark, block):
        held = spark.sparkContext.broadcast(rows)

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            fresh_worker()
            index = Index(held.value, width, num, den)
            for whole in batches:
                for batch, data, offsets in batches_of(whole, "body"):
                    out = [(batch.column("doc_id")[d].as_py(), index.ids[k], shared, len(index.sets[k])) for d, k, shared in _found(index, batch, data, offsets)]
                    types = (batch.column("doc_id").type, item_type, pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate(types)], names=["doc_id", "item_id", "n_shared", "n_shingles"])

        part = _bodies(docs, "doc_id").mapInArrow(search, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    return found.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def _bodies(docs: DataFrame, *columns: str, name: str = "body") -> DataFrame:
    return docs.select(*columns, F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias(name))


def without_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = 5, num: int = 80, den: int = 100, block: int = 50_000) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that contain no item of ``benchmark``, as ``contaminated`` finds them.

    Null and empty texts stay; repeated rows stay or go together; empty tables give an empty or the whole result.
    """
    out, name = docs, free_name(docs.columns, "body")
    for rows in _blocks(benchmark, block):
        held = docs.sparkSession.sparkContext.broadcast(rows)

        def keep(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            fresh_worker()
            index = Index(held.value, width, num, den)
            for whole in batches:
                for batch, data, offsets in batches_of(whole, name):
                    good = np.ones(batch.num_rows, bool)
                    good[[d for d, _, _ in _found(index, batch, data, offsets)]] = False
                    yield batch.filter(pa.array(good)).drop_columns([name])

        out = _bodies(out, *docs.columns, name=name).mapInArrow(keep, docs.schema)
    return out
