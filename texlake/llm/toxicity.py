"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

The terms are words and the STEM-letter beginnings of words. A text is the vector of (1 + ln tf) * idf of its terms, idf
over all documents. Terms that tell the labels apart (signed either way; chi-square over the training rows, as many as
there are) are weighed by 1 - least / chi-square, so a neighbour is near because it shares what matters. The others match
nothing: all they do is to lengthen the vector, by REST for each, so that a long text is not near for one word of it.

Examples lie in blocks. Each term has posting lists of the examples of a block that hold it, and their greatest weight. A
query visits blocks in the order of their bounds until none exceeds its k-th best cosine. The nearest examples vote by
cosine squared; the examples' own votes, each without itself, calibrate the score (a logistic curve), and they are
returned as evidence on request.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import batches_of, drop, free_name, fresh_worker, list_column, partitions, written

STEM = 5
#: Length that each term without a label's favour adds to a vector.
REST = 0.05
#: Bytes of text that are worked on at once.
SLICE = 1_000_000
#: Everything but ASCII letters, digits and non-ASCII bytes separates words here.
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and word beginnings of documents laid end to end, and their documents."""
    starts, ends, owner = hashing.word_spans(data, offsets, _SEPARATOR)
    long = ends - starts > STEM
    hashes, i = [np.zeros(0, np.uint64)], 0
    while i < len(starts):  # some megabytes at once, which end with a word
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + 4 * SLICE, "right")))
        low, part = starts[i], long[i:j]
        prefix = hashing.Prefix(hashing.LOWER[data[low : ends[j - 1]]])
        hashes += [prefix.of(starts[i:j] - low, ends[i:j] - low) & ~np.uint64(1), prefix.of(starts[i:j][part] - low, starts[i:j][part] - low + STEM) | np.uint64(1)]
        i = j
    return np.concatenate(hashes[1::2] + hashes[2::2] + hashes[:1]), np.concatenate([owner, owner[long]])


def _bodies(docs: DataFrame, *more, name: str = "body") -> DataFrame:
    return docs.select(*more, F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias(name))


def _rows(make, source: DataFrame, schema, name: str = "body") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for whole in batches:
            for batch, data, offsets in batches_of(whole, name, SLICE):
                yield make(batch, *_terms(data, offsets))

    return source.mapInArrow(run, schema)


def _counted(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different terms of each document, their document and how often each stands there."""
    order = np.lexsort((hashes, owner))
    h, who = hashes[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (who[1:] != who[:-1])])) if len(h) else np.zeros(0, np.int64)
    return h[first], who[first], np.diff(np.concatenate([first, [len(h)]]))


def _term_counts(batch: pa.RecordBatch, hashes: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
    """Of a batch of labelled documents: in how many of each label a term stands."""
    h, who, _ = _counted(hashes, owner)
    toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)[who]
    term, place = np.unique(h, return_inverse=True)
    return pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(np.bincount(place, toxic, len(term)).astype(np.int64)), pa.array(np.bincount(place, 1 - toxic, len(term)).astype(np.int64))], names=["term", "pos", "neg"])


class Terms:
    """The terms that count, and their weights."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray):
        self.hashes, self.weights = hashes, weights

    def vectors(self, hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, term and weight of the entries of ``n`` documents' vectors, which are of unit length with what isn't listed."""
        h, who, tf = _counted(hashes, owner)
        place = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
        hit = self.hashes[place] == h if len(self.hashes) else np.zeros(len(h), bool)
        much = 1 + np.log(tf)
        rest = REST**2 * np.bincount(who[~hit], much[~hit] ** 2, n)
        who, place = who[hit], place[hit]
        weight = much[hit] * self.weights[place]
        size = np.sqrt(np.bincount(who, weight**2, n) + rest)
        return who, place, weight / size[who]


class NearestExamples:
    """The index of the labelled examples, their votes and the calibration of these."""

    def __init__(self, terms: Terms, ids: np.ndarray, labels: np.ndarray, who: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, block: int):
        self.terms, self.k = terms, k
        n = len(ids)
        # examples that share their weightiest term stand together, so blocks have low bounds elsewhere
        heavy, most = np.full(n, len(terms.hashes)), np.zeros(n)
        by = np.lexsort((weight, who))
        heavy[who[by]], most[who[by]] = term[by], weight[by]
        order = np.lexsort((ids, -most, heavy))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        self.ids, self.labels = ids[order], labels[order]
        entry = rank[who]
        by = np.lexsort((entry, term))
        self.entry, self.weight, term = entry[by], weight[by], term[by]
        # a posting list for each term and block
        part = self.entry // block
        heads = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (part[1:] != part[:-1])])) if len(term) else np.zeros(0, np.int64)
        self.start, self.end = heads, np.concatenate([heads[1:], [len(term)]]).astype(np.int64)
        self.part = part[heads]
        self.most = np.maximum.reduceat(self.weight, heads) if len(heads) else np.zeros(0)
        self.lists = np.searchsorted(term[heads], np.arange(len(terms.hashes) + 1))
        self.n_blocks = -(-n // block)
        self.prior = (labels.sum() + 0.5) / (n + 1)
        self.slope, self.shift, self.none = 1.0, 0.0, self.prior

    @staticmethod
    def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All numbers of the ranges, and the range of each."""
        size = end - start
        of = np.repeat(np.arange(len(size)), size)
        return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + start[of], of

    def nearest(self, term: np.ndarray, weight: np.ndarray, own: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples (places in the index) of greatest positive cosine and their cosines, but for ``own``; ties go
        to the smaller doc_id."""
        lists, of = self._ranges(self.lists[term], self.lists[term + 1])
        parts = self.part[lists]
        bounds = np.bincount(parts, weight[of] * self.most[lists], self.n_blocks)
        order = np.argsort(-bounds, kind="stable")[: np.count_nonzero(bounds)]
        near, cosine, kth, a, step = np.zeros(0, np.int64), np.zeros(0), 0.0, 0, 4
        while a < len(order) and bounds[order[a]] >= kth - 1e-12:
            chosen = np.zeros(self.n_blocks, bool)
            chosen[order[a : a + step]] = True
            mine = chosen[parts]
            at, which = self._ranges(self.start[lists[mine]], self.end[lists[mine]])
            found, place = np.unique(self.entry[at], return_inverse=True)
            value = np.bincount(place, self.weight[at] * weight[of[mine]][which], len(found))
            good = found != own
            near, cosine = np.concatenate([near, found[good]]), np.concatenate([cosine, value[good]])
            best = np.lexsort((self.ids[near], -np.round(cosine, 12)))[: self.k]
            near, cosine = near[best], cosine[best]
            kth = cosine[-1] if len(cosine) == self.k else 0.0
            a, step = a + step, step * 4
        return near, cosine

    def votes(self, who: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, own: np.ndarray | None = None) -> tuple[np.ndarray, list]:
        """The share of the votes that is toxic, of each of ``n`` documents (nan without a neighbour), and the neighbours."""
        share, found = np.full(n, np.nan), []
        cuts = np.searchsorted(who, np.arange(n + 1))
        for q in range(n):
            mine = slice(cuts[q], cuts[q + 1])
            near, cosine = self.nearest(term[mine], weight[mine], -1 if own is None else own[q])
            found.append((near, cosine))
            if len(near):
                vote = cosine**2
                share[q] = ((vote * self.labels[near]).sum() + 0.02 * self.prior) / (vote.sum() + 0.02)
        return share, found

    def calibrate(self, share: np.ndarray, labels: np.ndarray) -> None:
        """Fit the score of a share of votes to labels, by Newton steps of a logistic regression with smoothed targets."""
        voted = ~np.isnan(share)
        self.none = (labels[~voted].sum() + self.prior) / ((~voted).sum() + 1)
        x, y = share[voted], labels[voted]
        if not y.sum() or y.sum() == len(y):
            return
        x = np.log(x / (1 - x))
        target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        fit = np.array([1.0, 0.0])
        design = np.stack([x, np.ones(len(x))], axis=1)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(design @ fit, -30, 30)))
            gradient = design.T @ (target - p) - 1e-3 * (fit - [1.0, 0.0])
            step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2), gradient)
            fit = fit + np.clip(step, -2, 2)
        if fit[0] > 0:
            self.slope, self.shift = fit

    def scores(self, share: np.ndarray) -> np.ndarray:
        """The calibrated score of each share of votes."""
        x = np.where(np.isnan(share), 0.5, np.clip(share, 1e-9, 1 - 1e-9))
        score = 1 / (1 + np.exp(-np.clip(self.slope * np.log(x / (1 - x)) + self.shift, -30, 30)))
        return np.where(np.isnan(share), self.none, score)


def fit(docs: DataFrame, labels: DataFrame, examples: int = 20_000, k: int = 15, block: int = 64, least: float = 20.0) -> NearestExamples:
    """Learn from rows of ``labels`` (doc_id, toxic 0/1) and their texts.

    At most ``examples`` labels are used, those with the least hash of their doc_id (a fixed sample of any larger table);
    of one doc_id with several labels the greatest counts, with several texts the first in byte order. Terms count if
    their chi-square is over ``least`` (20: by chance, one term in some 100,000), without a limit to their number; document
    frequencies come from all of ``docs``.
    """
    spark = docs.sparkSession
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)  # two numbers a row
    bodies = _bodies(docs, F.col("doc_id").cast("long").alias("doc_id"))
    rows = written(bodies.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("body").alias("body")), "examples")
    sizes = rows.agg(F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("n")).first()
    n, p = sizes["n"], sizes["pos"] or 0
    share = p / n if n else 0.0
    counted = _rows(_term_counts, rows, "term long, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    df = F.col("pos") + F.col("neg")
    chi = F.pow(F.col("pos") - df * share, 2) / (df * share * (1 - share) + 0.5)
    # what the terms of the bounded sample can be at most
    telling = counted.select("term", chi.alias("chi")).where(F.col("chi") > least).orderBy("term").collect()
    found = np.array([r["term"] for r in telling], np.int64).view(np.uint64)
    order = np.argsort(found)
    kept, gain = found[order], 1 - least / np.array([r["chi"] for r in telling], float)[order]
    held = spark.sparkContext.broadcast(kept)

    def frequency(batch: pa.RecordBatch, hashes: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
        terms = held.value
        place = np.minimum(np.searchsorted(terms, hashes), max(0, len(terms) - 1))
        hit = terms[place] == hashes if len(terms) else np.zeros(len(hashes), bool)
        pairs = np.unique(owner[hit] * np.int64(len(terms) + 1) + place[hit])
        here, count = np.unique(pairs % (len(terms) + 1), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([here, [len(terms)]]).astype(np.int64)), pa.array(np.concatenate([count, [batch.num_rows]]).astype(np.int64))], names=["k", "n"])

    totals = {r["k"]: r["n"] for r in _rows(frequency, _bodies(docs), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    idf = np.array([np.log((totals[len(kept)] + 1) / (totals.get(j, 0) + 1)) + 1 for j in range(len(kept))])
    terms = Terms(kept, idf * gain)

    def vectors(batch: pa.RecordBatch, hashes: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
        who, term, weight = terms.vectors(hashes, owner, batch.num_rows)
        size = np.bincount(who, minlength=batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), list_column(term.astype(np.int64), size, pa.int64()), list_column(weight, size, pa.float64())], names=["doc_id", "toxic", "terms", "weights"])

    # at most ``examples`` rows of the terms that count
    got = _rows(vectors, rows, "doc_id long, toxic int, terms array<long>, weights array<double>").orderBy("doc_id").collect()
    size = [len(r["terms"]) for r in got]
    flat = lambda name, kind: np.array([x for r in got for x in r[name]], kind)
    ids, toxic = np.array([r["doc_id"] for r in got], np.int64), np.array([r["toxic"] for r in got], np.int64)
    model = NearestExamples(terms, ids, toxic, np.repeat(np.arange(len(got)), size), flat("terms", np.int64), flat("weights", float), k, block)
    if n:
        index = spark.sparkContext.broadcast(model)

        def without_itself(batch: pa.RecordBatch, hashes: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
            m = index.value
            sorter = np.argsort(m.ids)
            own = sorter[np.searchsorted(m.ids, batch.column("doc_id").to_numpy(zero_copy_only=False), sorter=sorter)]
            share, _ = m.votes(*m.terms.vectors(hashes, owner, batch.num_rows), batch.num_rows, own)
            return pa.RecordBatch.from_arrays([pa.array(share), batch.column("toxic")], names=["share", "toxic"])

        votes = _rows(without_itself, rows.repartition(partitions(spark)), "share double, toxic int").collect()  # two numbers an example
        share, toxic = np.array([r["share"] for r in votes], float), np.array([r["toxic"] for r in votes], np.int64)
        order = np.lexsort((toxic, share))  # the same sums whatever came first
        model.calibrate(share[order], toxic[order])
        drop(rows)
    return model


def _fold(doc_id):
    """Whether a document is held out: crc32 of its id as text, modulo 5, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def toxicity(docs: DataFrame, labels: DataFrame, with_evidence: bool = False, **parameters) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text), learnt from ``labels`` (doc_id, toxic).

    With ``with_evidence`` an array (doc_id, toxic, cosine) of the examples that voted follows, the nearest first. Labels
    of held-out documents (crc32 of the doc_id as text, modulo 5, is 0) are never read; null labels and labels without a
    document don't count. A text that shares no term that counts with any example, empty or null, scores as such examples
    do. Rows that repeat score alike; null doc_ids are scored, too (held_out null); extra columns are ignored; without any
    label all scores are 0.5; an empty table gives an empty result.
    """
    model = fit(docs, labels.where(~_fold(F.col("doc_id"))), **parameters)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batch: pa.RecordBatch, hashes: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
        m = held.value
        share, found = m.votes(*m.terms.vectors(hashes, owner, batch.num_rows), batch.num_rows)
        columns = {"doc_id": batch.column("doc_id"), "score": pa.array(m.scores(share))}
        if with_evidence:
            columns["evidence"] = pa.array([[{"doc_id": int(m.ids[e]), "toxic": int(m.labels[e]), "cosine": float(c)} for e, c in zip(near, cosine)] for near, cosine in found], pa.list_(pa.struct({"doc_id": pa.int64(), "toxic": pa.int32(), "cosine": pa.float64()})))
        return pa.RecordBatch.from_pydict(columns)

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ["evidence"] if with_evidence else []
    scored = _rows(score, _bodies(docs, "doc_id"), f"doc_id {kind}, score double" + ", evidence array<struct<doc_id: long, toxic: int, cosine: double>>" * with_evidence)
    return scored.select("doc_id", _fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *more)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **parameters) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score below ``threshold``; learning, nulls, empty tables and
    repeated rows as in ``toxicity`` (rows that repeat stay or go together). Without any label all rows stay."""
    model = fit(docs, labels.where(~_fold(F.col("doc_id"))), **parameters)
    if not len(model.ids):
        return docs
    held, name = docs.sparkSession.sparkContext.broadcast(model), free_name(docs.columns, "body")

    def keep(batch: pa.RecordBatch, hashes: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
        m = held.value
        share, _ = m.votes(*m.terms.vectors(hashes, owner, batch.num_rows), batch.num_rows)
        return batch.filter(pa.array(m.scores(share) < threshold)).drop_columns([name])

    return _rows(keep, _bodies(docs, *docs.columns, name=name), docs.schema, name)
