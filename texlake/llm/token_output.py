"""Token ids of a corpus in a binary file format of patched frame-of-reference blocks, and its reader.

A shard file holds some documents of ascending id:

* magic ``TXPF0001``, then four little-endian unsigned 64-bit counts: documents, tokens, blocks, bytes of the
  packed blocks;
* document index: ids (signed 64-bit, with a byte for null before them), first token of each in the shard, tokens of each;
* block index: the byte at which each block starts in the packed part (64-bit), so any block is read alone;
* the packed blocks, each of BLOCK ids (the last one filled up with its minimum): minimum (32-bit), width in bits
  (8-bit), number of exceptions (16-bit), the low ``width`` bits of ``id - minimum`` in LANES interleaved lanes,
  exception positions (16-bit) and their high parts (32-bit).

The width is the least that holds the PERCENTILE share of a block's ids; the rest are the exceptions.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import new_path, written

MAGIC, BLOCK, LANES, PERCENTILE = b"TXPF0001", 512, 16, 0.95
_STEPS = BLOCK // LANES


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Blocks (rows of BLOCK values under 2**width) as rows of width * LANES 32-bit words."""
    rows = values.reshape(-1, _STEPS, LANES).astype(np.uint32)
    words = np.zeros((len(rows), width, LANES), np.uint32)
    for k in range(_STEPS if width else 0):
        at, shift = divmod(k * width, 32)
        words[:, at] |= rows[:, k] << np.uint32(shift)
        if shift + width > 32:
            words[:, at + 1] |= rows[:, k] >> np.uint32(32 - shift)
    return words.reshape(len(rows), -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of _pack."""
    if not width:
        return np.zeros((len(words), BLOCK), np.uint32)
    words = words.reshape(-1, width, LANES)
    rows = np.zeros((len(words), _STEPS, LANES), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for k in range(_STEPS if width else 0):
        at, shift = divmod(k * width, 32)
        x = words[:, at] >> np.uint32(shift)
        if shift + width > 32:
            x = x | words[:, at + 1] << np.uint32(32 - shift)
        rows[:, k] = x & mask
    return rows.reshape(len(words), BLOCK)


def encode_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The packed blocks of ``ids``, and the byte at which each starts."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return b"", np.zeros(0, np.int64)
    full = np.empty(n * BLOCK, np.uint32)
    full[: len(ids)] = ids
    full[len(ids) :] = ids[(n - 1) * BLOCK :].min()
    rows = full.reshape(n, BLOCK)
    least = rows.min(axis=1)
    rest = rows - least[:, None]
    holds = np.partition(rest, int(PERCENTILE * (BLOCK - 1)), axis=1)[:, int(PERCENTILE * (BLOCK - 1))]
    width = np.ceil(np.log2(holds.astype(np.float64) + 1)).astype(np.uint8)
    over = rest >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    over_row, over_at = np.nonzero(over)
    count = over.sum(axis=1)
    high = (rest[over_row, over_at] >> width[over_row].astype(np.uint32)).astype("<u4")
    first = np.concatenate([[0], np.cumsum(count)])
    packed: dict[int, bytes] = {}
    for w in np.unique(width):
        rows_of = np.flatnonzero(width == w)
        low = rest[rows_of] & np.uint32((1 << int(w)) - 1)
        for r, words in zip(rows_of, _pack(low, int(w))):
            packed[r] = words.astype("<u4").tobytes()
    out, starts, at = [], np.zeros(n, np.int64), 0
    for b in range(n):
        a, z = first[b], first[b + 1]
        block = least[b].astype("<u4").tobytes() + width[b].tobytes() + count[b].astype("<u2").tobytes() + packed[b] + over_at[a:z].astype("<u2").tobytes() + high[a:z].tobytes()
        starts[b] = at
        at += len(block)
        out.append(block)
    return b"".join(out), starts


def decode_blocks(data: bytes, starts: np.ndarray, n: int) -> np.ndarray:
    """``n`` ids from packed blocks."""
    flat = np.frombuffer(data, np.uint8)
    m = len(starts)
    if not m:
        return np.zeros(0, np.uint32)
    head = flat[starts[:, None] + np.arange(7)]
    least = head[:, :4].copy().view("<u4")[:, 0]
    width, count = head[:, 4], head[:, 5:7].copy().view("<u2")[:, 0]
    out = np.empty((m, BLOCK), np.uint32)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        size = int(w) * LANES * 4
        for part in np.array_split(rows, -(-len(rows) // 4096)):
            words = flat[(starts[part] + 7)[:, None] + np.arange(size)].view("<u4")
            out[part] = _unpack(words, int(w)) + least[part, None]
    for b in np.flatnonzero(count):
        at = int(starts[b]) + 7 + int(width[b]) * LANES * 4
        c = int(count[b])
        where = np.frombuffer(data, "<u2", c, at)
        out[b, where] += np.frombuffer(data, "<u4", c, at + 2 * c) << np.uint32(width[b])
    return out.reshape(-1)[:n]


def shard_bytes(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    """A whole shard file."""
    packed, starts = encode_blocks(ids)
    n = np.array(lengths, "<i8")
    names = np.array([0 if d is None else d for d in doc_ids], "<i8")
    null = np.array([d is None for d in doc_ids], np.uint8)
    counts = np.array([len(n), len(ids), len(starts), len(packed)], "<u8")
    return b"".join([MAGIC, counts.tobytes(), null.tobytes(), names.tobytes(), (np.cumsum(n) - n).astype("<i8").tobytes(), n.tobytes(), starts.astype("<i8").tobytes(), packed])


def read_shard(data: bytes) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, first tokens, token counts and all ids of a shard file."""
    if data[:8] != MAGIC:
        raise ValueError("not a token shard")
    docs, tokens, blocks, size = (int(x) for x in np.frombuffer(data, "<u8", 4, 8))
    at = 40
    null = np.frombuffer(data, np.uint8, docs, at)
    names, starts, lengths = (np.frombuffer(data, "<i8", docs, at + docs + k * 8 * docs) for k in range(3))
    at += docs + 24 * docs
    index = np.frombuffer(data, "<i8", blocks, at)
    ids = decode_blocks(data[at + 8 * blocks : at + 8 * blocks + size], index, tokens)
    return [None if z else int(x) for z, x in zip(null, names)], starts, lengths, ids


def _writer(path: str, vocabulary: str, end_id: int, most: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        store, root = fs.FileSystem.from_uri(path)
        end = np.array([end_id], np.uint32)
        names, lengths, ids, held, rows = [], [], [], 0, []

        def flush():
            nonlocal names, lengths, ids, held
            shard = uuid.uuid4().hex  # a task that runs twice leaves a file that no manifest row names
            with store.open_output_stream(f"{root}/{shard}.tok") as out:
                out.write(shard_bytes(names, lengths, np.concatenate(ids)))
            rows.append((f"{shard}.tok", names[0], len(rows), len(names), held))
            names, lengths, ids, held = [], [], [], 0

        store.create_dir(root, recursive=True)
        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                x = np.concatenate([encode(text.as_py() or "").astype(np.uint32), end])
                names.append(name)
                lengths.append(len(x))
                ids.append(x)
                held += len(x)
                if held >= most:
                    flush()
        if names:
            flush()
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["file", "first_doc", "part", "n_docs", "n_tokens"])

    return write


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int = 0, path: str | None = None, shard_tokens: int = 4_000_000) -> tuple[str, DataFrame]:
    """Write the ids of ``docs`` (doc_id long, text string) in ascending doc_id order; returns the folder and its manifest.

    Texts are range-partitioned by doc_id, sorted, encoded and written by the same tasks: one shuffle of text, no
    second pass. A shard closes at ``shard_tokens`` ids (a longer document stays whole), so memory is bounded. The
    manifest (file, base, first_doc, part, n_docs, n_tokens) is a table of one row per shard, written by Spark: its
    commit decides which files count, so repeated tasks and lost executors leave only unnamed files. Null texts are
    empty; rows of null doc_id come first; rows of equal doc_id stay together, in the order of their texts. Extra
    columns are ignored. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.coalesce("text", F.lit("")))
    shards = ordered.mapInArrow(_writer(path, vocabulary, end_id, shard_tokens), "file string, first_doc long, part long, n_docs long, n_tokens long")
    shards = written(shards, "token-shards")
    # one row per shard of millions of ids, not per document: small enough for one ordered running sum
    before = "coalesce(sum(n_tokens) OVER (ORDER BY first_doc ASC NULLS FIRST, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    return path, written(shards.select("*", F.expr(before).alias("base")), "token-manifest")


def read_tokens(spark, path: str, manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Documents from the shard files that the manifest names: doc_id, start (over the whole corpus), n_tokens, ids_crc32, ids."""
    found = manifest.count()
    if not found:
        kinds = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
        return spark.createDataFrame([], kinds)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data in zip(batch.column("base").to_pylist(), batch.column("content")):
                names, starts, lengths, ids = read_shard(data.as_py())
                parts = np.split(ids.astype("<u4"), np.cumsum(lengths)[:-1])
                out = [pa.array(names, pa.int64()), pa.array(starts + base, pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())]
                titles = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    out.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
                    titles.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=titles)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    named = manifest.select("file", "base")
    named = F.broadcast(named) if found <= 100_000 else named  # a row of a hundred bytes each
    return files.join(named, "file").select("base", "content").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
