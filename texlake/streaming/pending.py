"""The translation queue as streams: new files in, each paragraph without a translation out once.

Two streams follow each other. The first cuts arriving files into prose paragraphs (a file needs no other file for that, but
windows over its lines, so it is done batch by batch). The second keeps, for every paper, the digests that are
translated or queued, in the state store: a batch looks up the papers that it has, however long the queue is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scan import scan_spans
from ..functions.shared import cut, drop
from ..operators.translate import chunk_digest, pending_chunks, prose_chunks

_QUEUE = "paper_id string, path string, chunk_id int, digest string, text string"


def _prose(sources: DataFrame, spans: DataFrame) -> DataFrame:
    rows = prose_chunks(sources, spans).withColumn("digest", chunk_digest(F.col("text")))
    return rows.select("paper_id", "path", "chunk_id", "digest", "text")


def queue_of(sources: DataFrame, memory: DataFrame) -> DataFrame:
    """paper_id, path, chunk_id, digest, text of the prose of ``sources`` that ``memory`` (paper_id, digest) lacks."""
    return pending_chunks(_prose(sources, cut(scan_spans(sources), "spans")), memory).select("paper_id", "path", "chunk_id", "digest", "text")


def stream_chunks(spark: SparkSession, in_dir: str, chunk_dir: str, checkpoint: str) -> StreamingQuery:
    """Prose paragraphs of the Parquet ``sources`` that arrive in ``in_dir``; a batch that runs again replaces its own folder."""

    def add(batch: DataFrame, number: int) -> None:
        files = cut(batch, "arrived")
        spans = cut(scan_spans(files), "spans")
        _prose(files, spans).write.mode("overwrite").parquet(f"{chunk_dir}/batch={number}")
        drop(files, spans)

    stream = spark.readStream.schema("paper_id string, path string, content string").parquet(in_dir)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _first(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The first paragraph of each digest of a paper, unless it is known from an earlier batch or from memory."""
    known = set(state.get[0]) if state.exists else set()
    best: dict[str, tuple[str, int, str]] = {}
    for part in parts:
        for path, chunk, digest, text, told in zip(*(part[c] for c in ("path", "chunk_id", "digest", "text", "known"))):
            if told:
                known.add(digest)
            elif digest not in known and (digest not in best or (path, chunk) < best[digest][:2]):
                best[digest] = (path, chunk, text)  # one row of a digest is held, whatever repeats arrive
    rows = [(key[0], path, chunk, digest, text) for digest, (path, chunk, text) in best.items() if digest not in known]
    state.update((list(known | best.keys()),))
    if rows:
        yield pd.DataFrame(rows, columns=["paper_id", "path", "chunk_id", "digest", "text"]).astype({"chunk_id": "int32"})


def stream_queue(spark: SparkSession, chunk_dir: str, memory_dir: str, out_dir: str, checkpoint: str) -> StreamingQuery:
    """Each paragraph of ``chunk_dir`` once: keyed state tells which ones an earlier batch, or ``memory_dir``, has had."""
    for path in (chunk_dir, memory_dir):
        _make(spark, path)
    chunks = spark.readStream.schema(_QUEUE).option("recursiveFileLookup", True).parquet(chunk_dir).withColumn("known", F.lit(False))
    memory = spark.readStream.schema("paper_id string, digest string").parquet(memory_dir)
    events = chunks.unionByName(memory.withColumn("known", F.lit(True)), allowMissingColumns=True).where("paper_id IS NOT NULL AND digest IS NOT NULL")
    rows = events.groupBy("paper_id").applyInPandasWithState(_first, _QUEUE, "known array<string>", "append", GroupStateTimeout.NoTimeout)
    return rows.writeStream.format("parquet").outputMode("append").option("path", out_dir).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_pending(spark: SparkSession, in_dir: str, memory_dir: str, out_dir: str, checkpoint: str) -> StreamingQuery:
    """Queue the prose of the Parquet ``sources`` that have arrived in ``in_dir`` since the last call; what memory or the queue has is left out.

    The first stream runs to its end, the second one is returned. Files that arrive again, and batches that run again, add nothing.
    """
    stream_chunks(spark, in_dir, f"{out_dir}-chunks", f"{checkpoint}/chunks").awaitTermination()
    return stream_queue(spark, f"{out_dir}-chunks", memory_dir, out_dir, f"{checkpoint}/queue")


def _make(spark: SparkSession, path: str) -> None:
    """The folder, where it is not there yet."""
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(name)
