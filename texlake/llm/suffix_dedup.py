"""Removal of long repeated substrings by a sparse suffix array, built bucket by bucket with a difference cover.

1. Winnowing: of every ``length``-byte window, the 128-byte substring with the least hash is the window's anchor. Equal
   windows have equal anchors at equal places, so a window whose anchor substring occurs once cannot repeat. All others
   are suffixes to sort: they fall into buckets, one for each anchor substring.
2. A bucket's rows are laid under each other, anchor over anchor, on a stride of the cover's modulus. Ranks of the suffixes
   at the positions of a difference cover are computed first, by doubling (of bytes, modulo 16, from 16 to 256).
3. Windows are then sorted by their bytes up to the next cover position and, for the long ties, by the ranks of two cover
   suffixes that span the rest, and the bytes after them. Neighbours that tie in all of this are repeats, byte for byte.

Memory is bounded by one block of buckets. A bucket of more than HOT rows is split into its windows, each of which is a
key of its own, counted within batches and then with map-side combines. Equal texts are one text.

Passages can be judged by words, too: the same search then runs over the 64-bit hashes of the words, in the same passes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import batches_of, distinct_texts, drop, free_name, fresh_worker, list_column, partitions, slices, text_key, written

HOT, BLOCK_ROWS = 4096, 2048
#: Elements that are worked on at once, and bytes of text.
_CHUNK, SLICE = 4_000_000, 1_000_000


class Scheme(NamedTuple):
    """How sequences of one kind of element are searched."""

    #: Elements of an anchor.
    gram: int
    #: Every difference modulo cover_size is one of two elements of the cover.
    cover_size: int
    cover: tuple[int, ...]
    #: Two ranks of suffixes of so many elements span a window.
    reach: int
    #: Elements that fit into a key of 64 bits; twice as many are the first span of the ranks, a multiple of cover_size.
    pack: int


#: Of bytes and of words; the lowest bit of an anchor's hash tells which.
BYTES, WORDS = SCHEMES = (Scheme(128, 16, (0, 1, 2, 5, 8), 256, 8), Scheme(17, 4, (0, 1, 2), 32, 2))


def _word_elements(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of texts laid end to end, and the offsets of the texts in them."""
    words, owner = hashing.word_hashes(data, offsets, lower=False)
    return words, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(offsets) - 1))]).astype(np.int64)


def _anchors_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, place, first and last window start of each anchor, for texts laid end to end (places in ``data``)."""
    parts = []
    for begin in range(0, max(1, len(data) - length + 1), _CHUNK):
        piece = data[begin : begin + _CHUNK + length - 1]
        hashes = hashing.Prefix(piece).all_of(gram)
        w = length - gram + 1
        n = len(piece) - length + 1
        if n <= 0:
            continue
        # the high part of the hash, then the place: of equal hashes the first counts
        keyed = (hashes[: n + w - 1] & ~np.uint64((1 << 24) - 1)) | np.arange(n + w - 1, dtype=np.uint64)
        pad = -len(keyed) % w
        rows = np.concatenate([keyed, np.full(pad, ~np.uint64(0))]).reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        least = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & np.uint64((1 << 24) - 1)).astype(np.int64)
        starts = np.arange(n) + begin
        valid = starts + length <= offsets[np.searchsorted(offsets, starts, "right")] if len(offsets) > 2 else np.ones(n, bool)
        least, starts = least[valid], starts[valid]
        if len(least):
            cut = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)]))
            last = np.concatenate([cut[1:], [len(least)]]) - 1
            parts.append((hashes[least[cut]], least[cut] + begin, starts[cut], starts[last]))
    if not parts:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _anchors(lengths: tuple[int, ...]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for whole in batches:
            for batch, data, offsets in batches_of(whole, "body", SLICE):
                for kind, length in enumerate(lengths):
                    if kind:
                        data, offsets = _word_elements(data, offsets)
                    gram, at, low, high = _anchors_of(data, offsets, length, SCHEMES[kind].gram)
                    owner = np.searchsorted(offsets, low, "right") - 1
                    counts = np.bincount(owner, minlength=batch.num_rows)
                    base = offsets[owner]
                    named = (gram & ~np.uint64(1) | np.uint64(kind)).view(np.int64)
                    lists = [list_column(x, counts, pa.int64()) for x in (named, at - base, low - base, high - base)]
                    yield pa.RecordBatch.from_arrays([batch.column("key"), *lists], names=["key", "gram", "at", "low", "high"])

    return read


def _contexts(lengths: tuple[int, ...]):
    """Rows (key, body, places): the elements around each anchor, as bytes. Hot anchors' windows are counted within the
    batch first: those that repeat in it are spans at once (at -1, low and high the span) and, without a key, one row for
    the others; the rest are rows of window hashes."""
    names = ["key", "gram", "at", "low", "high", "bytes", "windows"]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]

    def laid(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    def hot_rows(hot: list[tuple]) -> Iterator[tuple]:
        size = [len(h) for *_, h in hot]
        which = np.repeat(np.arange(len(hot)), size)
        start = np.concatenate([low + np.arange(n) for (_, _, low, _), n in zip(hot, size)])
        grams = np.array([g for _, g, _, _ in hot], np.int64)[which]
        hashes = np.concatenate([h for *_, h in hot])
        order = np.lexsort((start, which, hashes, grams))
        g, h = grams[order], hashes[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (h[1:] != h[:-1])])
        group = np.cumsum(new) - 1
        often = (np.bincount(group) > 1)[group]
        heads = order[new & often]
        for gram in np.unique(grams[heads]):
            yield (None, int(gram), None, None, None, None, hashes[heads[grams[heads] == gram]])
        repeated = np.zeros(len(order), bool)
        repeated[order] = often
        cut = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (repeated[1:] != repeated[:-1]), [True]]))
        for a, z in zip(cut[:-1], cut[1:]):
            key, gram = hot[which[a]][:2]
            if repeated[a]:
                yield (key, gram, -1, int(start[a]), int(start[z - 1]) + lengths[gram & 1], None, None)
            else:
                yield (key, gram, None, int(start[a]), None, None, hashes[a:z])

    def calm_rows(batch: pa.RecordBatch, of: np.ndarray, columns: list[np.ndarray], text: bytes, begin: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i, j in slices(np.concatenate([[0], np.cumsum(end - begin)]), 2_000_000):
            around = pa.array([text[a:z] for a, z in zip(begin[i:j].tolist(), end[i:j].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(of[i:j])), *(pa.array(x[i:j]) for x in columns), around, pa.nulls(j - i, kinds[-1])], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for whole in batches:
            hot, hot_held = [], 0
            for batch, data, offsets in batches_of(whole, "body", SLICE):
                places = batch.column("places")
                of = np.repeat(np.arange(batch.num_rows), pc.list_value_length(places).to_numpy(zero_copy_only=False))
                gram, at, low, high, often = (pc.list_flatten(places).field(c).to_numpy(zero_copy_only=False) for c in ("gram", "at", "low", "high", "hot"))
                for kind, length in enumerate(lengths):
                    mine = gram & 1 == kind
                    if not mine.any():
                        continue
                    elements, base = _word_elements(data, offsets) if kind else (data, offsets)
                    k = np.flatnonzero(mine & ~often)
                    begin, wide = base[of[k]] + low[k], elements.itemsize
                    yield from calm_rows(batch, of[k], [x[k] for x in (gram, at, low, high)], elements.tobytes(), begin * wide, (begin + high[k] - low[k] + length) * wide)
                    k = np.flatnonzero(mine & often)
                    if len(k):
                        hashes = hashing.Prefix(elements).all_of(length).view(np.int64)
                        begin = base[of[k]] + low[k]
                        size = high[k] - low[k] + 1
                        for key, g, first, b, n in zip(batch.column("key").take(pa.array(of[k])).to_pylist(), gram[k].tolist(), low[k].tolist(), begin.tolist(), size.tolist()):
                            hot.append((key, g, first, hashes[b : b + n]))
                            hot_held += n
                            if hot_held > 1_000_000:
                                yield laid(list(hot_rows(hot)))
                                hot, hot_held = [], 0
            if hot:
                yield laid(list(hot_rows(hot)))

    return read


def _rank(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of rows of keys, the first key counting most."""
    out = None
    for key in keys:
        _, r = np.unique(key.reshape(-1), return_inverse=True)
        if out is not None:
            _, r = np.unique(out.astype(np.uint64) << np.uint64(32) | r.astype(np.uint64), return_inverse=True)
        out = r
    return out.reshape(keys[0].shape)


def repeated_windows(rows: list[np.ndarray], at: np.ndarray, length: int, maybe: np.ndarray, scheme: Scheme) -> np.ndarray:
    """For rows of elements around anchors (anchor ``at`` elements into each): whether the window that starts at a column repeats.

    Columns are places before the anchor, the last one being the anchor's own; rows hold the windows from their first
    element to ``length`` elements before their end. ``maybe`` (windows of all rows, in order) leaves out those that surely
    don't.
    """
    step, pack, bits = scheme.cover_size, scheme.pack, np.uint64(64 // scheme.pack)
    left = length - scheme.gram
    left += -left % step
    width = left + length + 2 * step
    width += -width % step
    m = len(rows)
    sizes = np.array([len(r) for r in rows], np.int64)
    flat = np.concatenate(rows)
    if flat.itemsize > 1:
        flat = np.unique(flat, return_inverse=True)[1].astype(np.uint32) + np.uint32(1)
    row = np.repeat(np.arange(m), sizes)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + (left - at)[row]
    text = np.zeros((m, width), flat.dtype)
    text[row, column] = flat
    keys = np.zeros((m, width - pack + 1), np.uint64)
    for k in range(pack):
        keys = keys << bits | text[:, k : k + width - pack + 1].astype(np.uint64)
    # ranks of the cover suffixes by doubling: first the elements that two suffixes differ in early, then ranks of ranks
    cover = np.array([c for c in range(width) if c % step in scheme.cover])
    place = np.full(width, -1)
    here = cover[cover + pack < keys.shape[1]]
    place[here] = np.arange(len(here))
    ranks, span = _rank(keys[:, here], keys[:, here + pack]), 2 * pack
    while span < scheme.reach:
        further = here[(here + span < width) & (place[np.minimum(here + span, width - 1)] >= 0)]
        ranks = _rank(ranks[:, place[further]], ranks[:, place[further + span]])
        place = np.full(width, -1)
        place[further] = np.arange(len(further))
        here, span = further, span * 2
    # windows, by the elements before a cover position, the ranks, and the elements after them
    first = left - at
    last = first + sizes - length
    who = np.repeat(np.arange(m), last - first + 1)
    start = np.arange(len(who)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[who]
    who, start = who[maybe], start[maybe]
    up = np.array([min((c - r) % step for c in scheme.cover) for r in range(step)])
    down = np.array([min((r - c) % step for c in scheme.cover) for r in range(step)])
    ahead = up[start % step]
    tail_end = start + length
    behind = down[(tail_end - span) % step]
    part = lambda places, n: np.where(n > 0, keys[who, places] >> (bits * (pack - np.maximum(n, 1)).astype(np.uint64)), np.uint64(0))
    order = [ranks[who, place[start + ahead]].astype(np.uint64) << np.uint64(4) | (start % step).astype(np.uint64)]
    order += [ranks[who, place[tail_end - behind - span]].astype(np.uint64), part(start, ahead), part(tail_end - behind, behind)]
    group = _rank(*order)
    out = np.zeros((m, left + 1), bool)
    out[who, start] = np.bincount(group)[group] > 1
    return out


def _candidates(rows: list[np.ndarray], length: int) -> np.ndarray:
    """Which windows of the rows have a hash that another one has, too: all repeats and, rarely, others."""
    sizes = np.array([len(r) for r in rows], np.int64)
    count = sizes - length + 1
    base = np.cumsum(sizes) - sizes
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(base, count)
    hashes = hashing.Prefix(np.concatenate(rows)).all_of(length)[at]
    order = np.argsort(hashes)
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = hashes[order[1:]] == hashes[order[:-1]]
    out = np.zeros(len(order), bool)
    out[order] = same[1:] | same[:-1]
    return out


def block_repeats(grams: np.ndarray, at: np.ndarray, rows: list[bytes], length: int, scheme: Scheme) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of repeated windows of the rows of some whole buckets: row, first and last window start within it.

    Equal rows of a bucket are one row whose windows all repeat; a bucket with one row then needs no sort. Of the others,
    only rows with windows whose hash occurs twice are sorted.
    """
    known: dict[tuple, int] = {}
    of = np.array([known.setdefault(k, len(known)) for k in zip(grams.tolist(), at.tolist(), rows)], np.int64)
    first = np.full(len(known), -1)
    first[of[::-1]] = np.arange(len(rows))[::-1]
    often = np.bincount(of) > 1
    bucket = np.unique(grams[first], return_inverse=True)[1]
    alone = np.bincount(bucket)[bucket] == 1
    kind = np.dtype(np.uint8 if scheme == BYTES else np.uint64)
    sizes = np.array([len(rows[k]) for k in first], np.int64) // kind.itemsize - length + 1
    base = np.cumsum(sizes) - sizes  # the windows of all rows lie end to end
    found = np.repeat(often, sizes)
    tried = np.flatnonzero(~alone)
    if len(tried):
        laid = [np.frombuffer(rows[k], kind) for k in first[tried]]
        maybe = _candidates(laid, length)
        some = np.logical_or.reduceat(maybe, np.cumsum(sizes[tried]) - sizes[tried])
        if some.any():
            picked = tried[some]
            left = length - scheme.gram
            left += -left % scheme.cover_size
            exact = repeated_windows([laid[j] for j in np.flatnonzero(some)], at[first[picked]], length, maybe[np.repeat(some, sizes[tried])], scheme)
            for k, row in zip(picked, exact):
                begin = left - at[first[k]]
                found[base[k] : base[k] + sizes[k]] |= row[begin : begin + sizes[k]]
    edge = np.zeros(len(found) + 1, bool)
    edge[base] = edge[-1] = True
    starts = np.flatnonzero(found & (edge[:-1] | ~np.concatenate([[False], found[:-1]])))
    ends = np.flatnonzero(found & (edge[1:] | ~np.concatenate([found[1:], [False]])))
    row = np.searchsorted(base, starts, "right") - 1
    runs = np.bincount(row, minlength=len(known))
    each = runs[of]
    who = np.repeat(np.arange(len(of)), each)
    run = np.arange(len(who)) - np.repeat(np.cumsum(each) - each, each) + (np.cumsum(runs) - runs)[of[who]]
    return who, starts[run] - base[row[run]], ends[run] - base[row[run]]


def _bucket_repeats(lengths: tuple[int, ...]):
    """Rows sorted by gram (key, gram, at, low, bytes): intervals of elements that repeated windows cover."""

    def repeats(keys, grams, at, low, rows) -> Iterator[pa.RecordBatch]:
        for kind, length in enumerate(lengths):
            mine = np.flatnonzero((grams & 1) == kind)
            if len(mine):
                r, a, z = block_repeats(grams[mine], (at - low)[mine], [rows[k] for k in mine], length, SCHEMES[kind])
                r = mine[r]
                yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in r], pa.binary()), pa.array(np.full(len(r), kind, np.int32)), pa.array(low[r] + a, pa.int64()), pa.array(low[r] + z + length, pa.int64())], names=["key", "kind", "start", "end"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        keys, grams, at, low, rows = [], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), []
        for batch in batches:
            keys += batch.column("key").to_pylist()
            rows += batch.column("bytes").to_pylist()
            grams, at, low = (np.concatenate([x, batch.column(c).to_numpy(zero_copy_only=False)]) for x, c in ((grams, "gram"), (at, "at"), (low, "low")))
            ends = np.flatnonzero(grams[1:] != grams[:-1]) + 1  # buckets that are complete
            while len(ends) and len(rows) >= BLOCK_ROWS:
                fit = ends[ends <= BLOCK_ROWS]
                z = int(fit[-1] if len(fit) else ends[0])
                yield from repeats(keys[:z], grams[:z], at[:z], low[:z], rows[:z])
                keys, rows, grams, at, low = keys[z:], rows[z:], grams[z:], at[z:], low[z:]
                ends = ends[ends > z] - z
        while rows:
            ends = np.concatenate([np.flatnonzero(grams[1:] != grams[:-1]) + 1, [len(rows)]])
            fit = ends[ends <= BLOCK_ROWS]
            z = int(fit[-1] if len(fit) else ends[0])
            yield from repeats(keys[:z], grams[:z], at[:z], low[:z], rows[:z])
            keys, rows, grams, at, low = keys[z:], rows[z:], grams[z:], at[z:], low[z:]

    return read


def _merged(found: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, z in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return out


def _cut(length: int, words: int | None, cut_words: bool):
    """Rows (key, body, copies, spans, word_spans): the digest of each text, and what is left of it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        names = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_words", "kept", "whole"]
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        for batch in batches:
            rows = []
            for key, body, copies, spans, word_spans in zip(*(batch.column(c) for c in ("key", "body", "copies", "spans", "word_spans"))):
                body = body.as_py()
                n, copied = len(body), copies.as_py() > 1
                found = [(s["start"], s["end"]) for s in spans.as_py() or ()]
                passages = _merged([(s["start"], s["end"]) for s in word_spans.as_py() or ()])
                long = n >= length
                if words and (passages or copied):
                    starts, ends, _ = hashing.word_spans(np.frombuffer(body, np.uint8), np.array([0, n]))
                    if copied and len(starts) >= words:
                        passages = [[0, len(starts)]]
                    if cut_words:
                        long = long or len(starts) >= words
                        found += [(int(starts[a]), int(ends[z - 1])) for a, z in passages]
                merged = [[0, n]] if copied and long else _merged(found)
                at, pieces = 0, []
                for a, z in merged:
                    pieces.append(body[at:a])
                    at = z
                pieces.append(body[at:])
                kept = b"".join(pieces)
                whole = b"".join(part.decode("utf-8", "ignore").encode() for part in pieces)
                rows.append((key.as_py(), n, n - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), len(passages), sum(z - a for a, z in passages), kept, whole.decode()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return read


def dedup_texts(docs: DataFrame, length: int = 400, words: int | None = None, cut_words: bool = True, early: bool = False) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256, n_passages, n_passage_words, kept (bytes) and whole (its whole characters) of each different text of ``docs``.

    A byte goes if a ``length``-byte string that covers it starts at another place, too, in any text or its own; strings
    are judged on the input. ``length`` is at least 288 and at most 512. With ``words`` (40 to 64), passages of so many
    words (between ASCII white space, compared by 64-bit hashes) that stand at another place as well, however short they
    are, are counted (maximal runs and the words in them; else 0) and, with ``cut_words``, go from their first word to
    their last. With ``early`` the spans are written, so that the search's tables are off the disk before the texts move.
    """
    lengths = (length, words) if words else (length,)
    for size, scheme in zip(lengths, SCHEMES):
        if not scheme.reach + 2 * scheme.cover_size <= size <= 2 * scheme.reach:
            raise ValueError("length must lie between 288 and 512 bytes, words between 40 and 64")
    texts = distinct_texts(docs, "suffix_texts")
    span = F.struct("start", "end")
    found, contexts = _spans(texts, lengths)
    spans = found.groupBy("key").agg(F.collect_list(F.when(F.col("kind") == 0, span)).alias("spans"), F.collect_list(F.when(F.col("kind") == 1, span)).alias("word_spans"))
    if early:
        spans = written(spans, "spans")
        drop(contexts)  # several times the texts: gone before those move again
    schema = "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_words long, kept binary, whole string"
    return texts.join(spans, "key", "left").mapInArrow(_cut(length, words, cut_words), schema)


def _spans(texts: DataFrame, lengths: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """key, kind, start, end: what windows that repeat in ``texts`` cover, of bytes (kind 0) and of words (kind 1); and the
    written table that this reads."""
    n = partitions(texts.sparkSession)
    found = written(texts.select("key", "body").mapInArrow(_anchors(lengths), "key binary, gram array<long>, at array<long>, low array<long>, high array<long>"), "anchors")
    places = found.select("key", F.explode(F.arrays_zip("gram", "at", "low", "high")).alias("p")).select("key", "p.*")
    # written, so that Spark can split the partitions of frequent anchors in the join
    again = written(places.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "again")
    kept = places.join(again, "gram").groupBy("key").agg(F.collect_list(F.struct("gram", "at", "low", "high", (F.col("n") > HOT).alias("hot"))).alias("places"))
    around = texts.select("key", "body").join(kept, "key").mapInArrow(_contexts(lengths), "key binary, gram long, at long, low long, high long, bytes binary, windows array<long>")
    around = written(around, "contexts")
    drop(found, again)
    calm = around.where("bytes IS NOT NULL").repartition(n, "gram").sortWithinPartitions("gram")
    spans = calm.mapInArrow(_bucket_repeats(lengths), "key binary, kind int, start long, end long")
    counted = around.where("windows IS NOT NULL").select("key", "gram", "low", F.posexplode("windows").alias("k", "window"))
    # a row without a key stands for at least two places of its batch
    twice = counted.groupBy("gram", "window").agg(F.sum(F.when(F.col("key").isNull(), 2).otherwise(1)).alias("n")).where("n > 1").select("gram", "window")
    windows = counted.where("key IS NOT NULL")
    kind = F.col("gram").bitwiseAND(F.lit(1)).cast("int").alias("kind")
    known = around.where("at = -1").select("key", kind, F.col("low").alias("start"), F.col("high").alias("end"))
    hot = windows.join(twice, ["gram", "window"], "left_semi").groupBy("key", "gram", "low").agg(F.collect_list("k").alias("ks"))
    # a row per anchor and step between window starts that do not follow each other
    hot = hot.select("key", kind, "low", F.array_sort("ks").alias("ks")).select("key", "kind", "low", "ks", F.filter(F.transform("ks", lambda k, i: F.when((i == 0) | (F.get("ks", i - 1) != k - 1), i)), lambda i: i.isNotNull()).alias("heads"))
    size = F.get(F.array(*map(F.lit, lengths)), F.col("kind"))
    hot = hot.select("key", "kind", "low", "ks", "heads", F.posexplode("heads").alias("j", "head")).select("key", "kind", (F.col("low") + F.get("ks", F.col("head"))).alias("start"), (F.col("low") + F.get("ks", F.coalesce(F.get("heads", F.col("j") + 1), F.size("ks")) - 1) + size).alias("end"))
    return spans.unionByName(hot).unionByName(known), around


def suffix_dedup(docs: DataFrame, length: int = 400, with_text: bool = False, words: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes, and whole, their whole characters) of every row of ``docs`` (doc_id, text).

    With ``words``, n_passages and n_passage_words follow: repeated passages of so many words or more, which are only
    counted. Null and empty texts have 0 bytes and nothing to remove; rows with equal texts of at least ``length`` bytes
    lose everything; repeated rows and null doc_ids keep their rows; extra columns are ignored; an empty table gives an
    empty result.
    """
    digest = dedup_texts(docs, length, words, cut_words=False)
    if not words:
        digest = digest.drop("n_passages", "n_passage_words")
    if not with_text:
        digest = written(digest.drop("kept", "whole"), "suffix-digest")
    return docs.select("doc_id", text_key().alias("key")).join(digest, "key").drop("key")


def without_repeats(docs: DataFrame, length: int = 400, words: int | None = None) -> DataFrame:
    """The rows of ``docs`` with the columns they have, ``text`` without repeated passages and n_chars, if any, to match.

    Passages are those of ``dedup_texts``. Characters that a passage's border cuts go, too. Null texts stay null.
    Repeated rows repeat each other's passages, so they lose all that is long enough; an empty table stays empty.
    """
    key, null, kept = (free_name(docs.columns, name) for name in ("_key", "_null", "_kept"))
    digest = dedup_texts(docs, length, words, early=True).select(F.col("key").alias(key), F.col("whole").alias(kept))
    rows = docs.withColumns({key: text_key(), null: F.col("text").isNull()}).drop("text").join(digest, key)
    rows = rows.withColumn("text", F.when(~F.col(null), F.col(kept)))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(docs.columns)
