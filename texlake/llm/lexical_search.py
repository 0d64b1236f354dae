"""Exact ranked lexical search over a length-stratified index.

A document's score for a term depends on nothing but the term, its count in the document and the document's length
normaliser m. So documents of equal m make a stratum. A stratum is cut into blocks of documents; a block holds, for each term,
its postings in groups of equal count, the highest count first. The impact of a term is computed once for each such
group, not for each posting, and the first group of a term is its bound in the block. A query's bound for a block is the sum of its
terms' bounds. The blocks with the highest bounds of all are scored first, for each query, which gives each query a
floor; then every task visits its blocks by descending bounds until they fall below the floor or below the k-th
score found so far. Equal bounds are visited, since ties go to smaller ids.

Only terms that are asked for have postings: the others are counted (lengths, documents) and read by nobody.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import batches_of, drop, flat_bytes, fresh_worker, list_column, partitions, written
from .hashing import LOWER, Prefix, word_spans

#: Bytes that separate terms: ASCII but for digits and letters.
SEPARATES = np.zeros(256, bool)
SEPARATES[:128] = True
for _low, _high in (("0", "9"), ("A", "Z"), ("a", "z")):
    SEPARATES[ord(_low) : ord(_high) + 1] = False

#: Documents and postings of a block at most, and its share of a stratum that goes to one task.
BLOCK_DOCS, BLOCK_POSTINGS, PIECE = 4096, 500_000, 4096
#: Bytes of the asked terms and items that go to the tasks at once; further items take further passes.
TERM_BYTES, ITEMS = 32_000_000, 20_000


def _parts(data: np.ndarray, offsets: np.ndarray, most: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Texts laid end to end with their offsets and the number of the first; one of over ``most`` bytes in parts that end at separators."""
    if len(data) <= most or len(offsets) != 2:
        yield data, offsets, 0
        return
    edges = np.flatnonzero(SEPARATES[data])
    at = 0
    while at < len(data):
        k = int(np.searchsorted(edges, at + most, "right")) - 1
        k = k if k >= 0 and edges[k] > at else int(np.searchsorted(edges, at + most))  # a term longer than a part stays whole
        end = int(edges[k]) if 0 <= k < len(edges) and len(data) - at > most else len(data)
        yield data[at:end], np.array([0, end - at], np.int64), 0
        at = end


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and starts, ends and text numbers of the terms in them."""
    starts, ends, owner = word_spans(data, offsets, SEPARATES)
    return LOWER[data], starts, ends, owner


class Dictionary:
    """Finds terms by hash and compares them byte by byte."""

    def __init__(self, terms: list[bytes]):
        flat = np.frombuffer(b"".join(terms), np.uint8)
        ends = np.cumsum([len(t) for t in terms]).astype(np.int64)
        starts = ends - np.array([len(t) for t in terms], np.int64)
        hashes = Prefix(flat).of(starts, ends) if len(terms) else np.zeros(0, np.uint64)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes, self.flat, self.starts, self.ends = hashes[self.order], flat, starts, ends

    def find(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each term, -1 for unknown ones."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.hashes) or not len(starts):
            return out
        h = Prefix(low).of(starts, ends)
        at = np.searchsorted(self.hashes, h)
        left = np.flatnonzero((at < len(self.hashes)) & (self.hashes[np.minimum(at, len(self.hashes) - 1)] == h))
        while len(left):  # as many turns as terms share a hash: one, but for made-up input
            k = self.order[at[left]]
            same = (ends - starts)[left] == (self.ends - self.starts)[k]
            size = (ends - starts)[left]
            for n in np.unique(size[same]):
                some = np.flatnonzero(same & (size == n))
                for a in range(0, len(some), max(1, 4_000_000 // int(n))):
                    part = some[a : a + max(1, 4_000_000 // int(n))]
                    span = np.arange(n)
                    same[part] = (low[starts[left[part]][:, None] + span] == self.flat[self.starts[k[part]][:, None] + span]).all(axis=1)
            out[left[same]] = k[same]
            left = left[~same]
            at[left] += 1
            left = left[(at[left] < len(self.hashes)) & (self.hashes[np.minimum(at[left], len(self.hashes) - 1)] == h[left])]
        return out


def _bodies(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.select(*columns, F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("body"))


def _asked(items: DataFrame) -> DataFrame:
    """q (a number for each row of ``items``), item_id, term: the different terms of each item."""
    kind = items.schema["item_id"].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch, data, offsets in batches_of(whole, "body"):
                low, starts, ends, owner = terms_of(data, offsets)
                for d in range(batch.num_rows):
                    a, b = np.searchsorted(owner, [d, d + 1])
                    found = sorted({low[starts[j] : ends[j]].tobytes() for j in range(a, b)})
                    number += 1
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array([number] * len(found), pa.int64()), batch.column("item_id").take(pa.array([d] * len(found), pa.int32())), pa.array(found, pa.binary())], names=["q", "item_id", "term"])

    return written(_bodies(items, "item_id").mapInArrow(cut, f"q long, item_id {kind.simpleString()}, term binary"), "asked")


def _counted(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """doc_id, n (terms with repeats), terms (numbers of the asked ones), counts, for every document with a term."""
    held = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        known = Dictionary(held.value)
        for whole in batches:
            for batch, data, offsets in batches_of(whole, "body"):
                n, keys = np.zeros(batch.num_rows, np.int64), []
                for part, at, first in _parts(data, offsets):
                    low, starts, ends, owner = terms_of(part, at)
                    n += np.bincount(owner + first, minlength=batch.num_rows)
                    k = known.find(low, starts, ends)
                    keys.append((owner[k >= 0] + first) * len(held.value) + k[k >= 0])
                key, tf = np.unique(np.concatenate(keys), return_counts=True)
                has = np.flatnonzero(n > 0)
                owner = key // max(1, len(held.value))
                sizes = np.bincount(owner, minlength=batch.num_rows)[has]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(has)), pa.array(n[has]), list_column((key % max(1, len(held.value))).astype(np.int32), sizes, pa.int32()), list_column(tf.astype(np.int64), sizes, pa.int64())],
                    names=["doc_id", "n", "terms", "counts"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return written(_bodies(docs, "doc_id").mapInArrow(count, f"doc_id {kind}, n long, terms array<int>, counts array<long>"), "counted")


_BLOCK = "block long, m long, ids array<long>, terms binary, counts binary, sizes binary, places binary"


def _block(number: int, m: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """A block: ids, and the postings as groups (term, count, size) by term and descending count with their documents' places."""
    ids = pa.chunked_array([p.column("doc_id") for p in parts]).combine_chunks()
    sizes = np.concatenate([p.column("terms").value_lengths().to_numpy(zero_copy_only=False) for p in parts])
    term = np.concatenate([p.column("terms").flatten().to_numpy(zero_copy_only=False) for p in parts])
    tf = np.concatenate([p.column("counts").flatten().to_numpy(zero_copy_only=False) for p in parts])
    place = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((place, -tf, term))
    term, tf, place = term[order], tf[order], place[order]
    first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])]))
    packed = (term[first].astype("<i4"), tf[first].astype("<i8"), np.diff(np.append(first, len(term))).astype("<i4"), place.astype("<u2"))
    lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.cast(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([m]), lists, *(pa.array([x.tobytes()], pa.binary()) for x in packed)], names=["block", "m", "ids", "terms", "counts", "sizes", "places"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, m, terms, counts) by m to blocks of one stratum each."""
    fresh_worker()
    number, held, docs, postings, m = TaskContext.get().partitionId() << 33, [], 0, 0, None
    for whole in batches:
        ms, at = whole.column("m").to_numpy(), 0
        sums = np.concatenate([[0], np.cumsum(whole.column("terms").value_lengths().to_numpy(zero_copy_only=False))])
        while at < whole.num_rows:
            if held and (ms[at] != m or docs >= BLOCK_DOCS or postings >= BLOCK_POSTINGS):
                number += 1
                yield _block(number, m, held)
                held, docs, postings = [], 0, 0
            m = int(ms[at])
            end = min(int(np.searchsorted(ms, m, "right")), at + BLOCK_DOCS - docs, max(at + 1, int(np.searchsorted(sums, sums[at] + BLOCK_POSTINGS - postings, "right")) - 1))
            held.append(whole.slice(at, end - at))
            docs, postings, at = docs + end - at, postings + int(sums[end] - sums[at]), end
    if held:
        yield _block(number + 1, m, held)


def build_index(counted: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The blocks of all strata. A stratum of many documents, however many share one length, is dealt out in pieces."""
    spark = counted.sparkSession
    placed = counted.where("size(terms) > 0").withColumn("m", F.expr(f"50 + (50L * n * {n_docs}L) div {n_terms}L"))
    strata = placed.groupBy("m").agg(F.ceil(F.count(F.lit(1)) / PIECE).alias("pieces"))
    dealt = placed.join(strata, "m").withColumn("piece", F.pmod(F.xxhash64("doc_id", "terms", "counts"), F.col("pieces")))
    rows = dealt.repartition(partitions(spark), "m", "piece").sortWithinPartitions("m", "piece").select("doc_id", "m", "terms", "counts")
    return written(rows.mapInArrow(_pack, _BLOCK), "strata")


class Block:
    """A block of the index, met by the queries: ``weights`` of all asked terms."""

    def __init__(self, row: dict, weights: np.ndarray):
        self.number, self.ids = row["block"], row["ids"]
        self.terms, counts = np.frombuffer(row["terms"], "<i4"), np.frombuffer(row["counts"], "<i8")
        self.impact = weights[self.terms] * ((1_000_000_000 * counts) // (1000 * counts + 20 * row["m"]))
        self.first = np.flatnonzero(np.concatenate([[True], self.terms[1:] != self.terms[:-1]]))
        self.row = row

    def bounds(self, query_terms: np.ndarray, starts: np.ndarray, n_terms: int) -> np.ndarray:
        """The most that any document here can score, for each query (terms laid end to end from ``starts``)."""
        most = np.zeros(n_terms, np.int64)
        most[self.terms[self.first]] = self.impact[self.first]
        return np.add.reduceat(most[query_terms], starts)

    def open(self) -> None:
        sizes = np.frombuffer(self.row["sizes"], "<i4")
        ends = np.cumsum(sizes)
        self.places, self.each = np.frombuffer(self.row["places"], "<u2"), np.repeat(self.impact, sizes)
        self.spans = dict(zip(self.terms[self.first].tolist(), zip((ends - sizes)[self.first].tolist(), ends[np.append(self.first[1:], len(ends)) - 1].tolist())))
        self.ids = np.array([2**63 - 1 if x is None else x for x in self.row["ids"]], np.int64)
        self.null = np.array([x is None for x in self.row["ids"]])

    def scores(self, terms: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.ids), np.int64)
        for t in terms.tolist():
            span = self.spans.get(t)
            if span:
                out[self.places[span[0] : span[1]]] += self.each[span[0] : span[1]]
        return out


class Best:
    """The k best documents of each query so far: descending scores, then ascending ids, null ids last."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.floor = k, np.maximum(floors, 1)
        none = np.zeros(0, np.int64)
        self.held = [(none, none, np.zeros(0, bool)) for _ in floors]

    def add(self, q: int, scores: np.ndarray, block: Block) -> None:
        at = np.flatnonzero(scores >= self.floor[q])
        if len(at):
            s, d, n = (np.concatenate(x) for x in zip(self.held[q], (scores[at], block.ids[at], block.null[at])))
            order = np.lexsort((d, n, -s))[: self.k]
            self.held[q] = s[order], d[order], n[order]
            if len(order) == self.k:
                self.floor[q] = max(self.floor[q], s[order[-1]])

    def rows(self) -> pa.RecordBatch:
        q = np.repeat(np.arange(len(self.held)), [len(s) for s, _, _ in self.held])
        s, d, n = (np.concatenate([h[j] for h in self.held]) for j in range(3)) if self.held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(d, pa.int64(), mask=n), pa.array(s, pa.int64())], names=["q", "doc_id", "score"])


def _search(index: DataFrame, terms: np.ndarray, starts: np.ndarray, weights: np.ndarray, k: int, first: int = 4) -> DataFrame:
    """q (place of the query), doc_id, score, rank: the ``k`` best documents of each query, exactly."""
    context = index.sparkSession.sparkContext
    held = context.broadcast((terms, starts, np.append(starts[1:], len(terms)), weights))
    n_queries = len(starts)
    by = Window.partitionBy("q")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each query the blocks with the highest bounds in this task."""
        fresh_worker()
        terms, starts, _, weights = held.value
        top, name = np.zeros((n_queries, first), np.int64), np.zeros((n_queries, first), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row, weights)
                bounds = b.bounds(terms, starts, len(weights))
                least = top.argmin(axis=1)
                better = np.flatnonzero(bounds > top[np.arange(n_queries), least])
                top[better, least[better]], name[better, least[better]] = bounds[better], b.number
        q, j = np.nonzero(top)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(name[q, j]), pa.array(top[q, j])], names=["q", "block", "bound"])

    narrow = index.select("block", "m", F.expr("cast(null as array<long>)").alias("ids"), "terms", "counts")
    ranked = narrow.mapInArrow(bound, "q int, block long, bound long").withColumn("r", F.row_number().over(by.orderBy(F.desc("bound"), "block"))).where(F.col("r") <= first)
    picked = ranked.groupBy("block").agg(F.collect_list("q").alias("asks"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        terms, starts, ends, weights = held.value
        best = Best(np.zeros(n_queries, np.int64), k)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                b = Block(row, weights)
                b.open()
                for q in row["asks"]:
                    best.add(q, b.scores(terms[starts[q] : ends[q]]), b)
        yield best.rows()

    rank = F.row_number().over(by.orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    probed = index.join(picked, "block").mapInArrow(probe, "q int, doc_id long, score long").withColumn("rank", rank).where(F.col("rank") <= k)
    floors = np.ones(n_queries, np.int64)
    for r in probed.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).where(F.col("n") == k).collect():
        floors[r["q"]] = r["low"]
    low = context.broadcast(floors)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        terms, starts, ends, weights = held.value
        best = Best(low.value.copy(), k)
        for whole in batches:
            for a in range(0, whole.num_rows, 16):
                blocks = [Block(row, weights) for row in whole.slice(a, 16).to_pylist()]
                bounds = np.array([b.bounds(terms, starts, len(weights)) for b in blocks])
                opened = set()
                for q in np.flatnonzero((bounds >= best.floor).any(axis=0)).tolist():
                    for j in np.argsort(-bounds[:, q], kind="stable").tolist():
                        if bounds[j, q] < best.floor[q]:
                            break
                        if j not in opened:
                            blocks[j].open()
                            opened.add(j)
                        best.add(q, blocks[j].scores(terms[starts[q] : ends[q]]), blocks[j])
        yield best.rows()

    return index.mapInArrow(visit, "q int, doc_id long, score long").withColumn("rank", rank).where(F.col("rank") <= k)


def _blocks_of_items(asked: DataFrame) -> Iterator[DataFrame]:
    """The asked terms in blocks of at most some TERM_BYTES and ITEMS (one item is never split)."""
    total = asked.agg(F.sum(F.octet_length("term") + 24).alias("bytes"), F.count_distinct("q").alias("items")).first()
    n = max(1, -(-(total["bytes"] or 0) // TERM_BYTES), -(-total["items"] // ITEMS))
    for b in range(n):
        yield asked.where(F.pmod(F.xxhash64("q"), F.lit(n)) == b)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: for each row of ``items`` its ``k`` documents of the highest scores above 0.

    Takes docs (doc_id integer, text) and items (item_id, text). Terms are runs of digits, letters and characters beyond
    ASCII, A-Z lower-cased. With N documents that have a term, L terms in all, n in a document, df documents of a term:
    w = floor(1000 * ln((2N+2) / (2df+1))), m = 50 + (50 * n * N) div L, and a document's score is the sum of
    w * ((10^9 * tf) div (1000 * tf + 20 * m)) over an item's different terms. Equal scores go by ascending doc_id, null
    ids last. Null and empty texts have no term: they match nothing and are not counted. Repeated rows are documents and
    items each; texts of any length are whole; extra columns are ignored; empty tables give an empty result.
    Items are asked in blocks of at most some 20,000 whose terms have at most some 32 MB; each block is a pass over the documents.
    """
    spark: SparkSession = docs.sparkSession
    asked = _asked(items)
    kind = items.schema["item_id"].dataType
    out = None
    for rows in _blocks_of_items(asked):
        listed = rows.orderBy("q", "term").toArrow()
        if not listed.num_rows:
            continue
        qs, starts = np.unique(listed.column("q").to_numpy(), return_index=True)
        words = listed.column("term").to_pylist()
        terms = sorted(set(words))
        number = {t: j for j, t in enumerate(terms)}
        query_terms = np.array([number[t] for t in words], np.int64)
        counted = _counted(docs, terms)
        total = counted.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
        if not total["docs"]:
            drop(counted)
            continue
        df = dict(counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weights = np.array([math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * df.get(j, 0) + 1))) for j in range(len(terms))], np.int64)
        index = build_index(counted, total["docs"], total["terms"])
        names = pa.table([pa.array(np.arange(len(qs), dtype=np.int32)), listed.column("item_id").combine_chunks().take(pa.array(starts)).cast(to_arrow_type(kind))], names=["q", "item_id"])
        found = _search(index, query_terms, starts, weights, k).join(spark.createDataFrame(names), "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        part = written(found, "ranked")
        drop(counted, index)
        out = part if out is None else out.unionByName(part)
    drop(asked)
    return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long") if out is None else out
