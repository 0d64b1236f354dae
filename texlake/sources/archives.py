"""Archives of papers (``.tar.gz``, one a paper) as a Spark data source, to read and to write.

``spark.read.format("tex_archives").load(root)`` once ``register`` was called, or ``read_archives`` and ``write_archives``.
Paths are those that pyarrow's file systems know (local, file:, s3:, gs:, hdfs:).
"""

from __future__ import annotations

import io
import tarfile
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SOURCES = "paper_id string, path string, content string"
ENDINGS = (".tar.gz", ".tgz")
#: Compressed bytes of the archives of one task (a larger archive has its own), and text bytes of a batch.
TASK_BYTES, BATCH_BYTES = 32_000_000, 4_000_000


def opened(root: str) -> tuple[pafs.FileSystem, str]:
    """A file system and the path in it."""
    return pafs.FileSystem.from_uri(root) if ":" in root.split("/")[0] else (pafs.LocalFileSystem(), root)


@dataclass
class Archives(InputPartition):
    paths: list[str]


class ArchiveReader(DataSourceReader):
    """Members are streamed out of the archive as it is read: a task holds one member and a batch of small ones."""

    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[Archives]:
        files, base = opened(self.root)
        found = files.get_file_info(pafs.FileSelector(base, recursive=True)) if files.get_file_info(base).type == pafs.FileType.Directory else [files.get_file_info(base)]
        out: list[Archives] = []
        held = TASK_BYTES
        for info in sorted((f for f in found if f.is_file and f.path.endswith(ENDINGS)), key=lambda f: f.path):
            if held + info.size > TASK_BYTES:
                out.append(Archives([]))
                held = 0
            out[-1].paths.append(info.path)
            held += info.size
        return out or [Archives([])]

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        files, _ = opened(self.root)
        rows: list[tuple[str, str, str]] = []
        held = 0
        for path in partition.paths:
            paper = urllib.parse.unquote(path.rsplit("/", 1)[-1].removesuffix(".tgz").removesuffix(".tar.gz"))
            with files.open_input_stream(path, compression=None) as stream:
                try:
                    with tarfile.open(fileobj=stream, mode="r|*") as archive:
                        for member in archive:
                            if member.isfile() and member.name.endswith(".tex"):
                                rows.append((paper, member.name.removeprefix("./"), archive.extractfile(member).read().decode("utf-8", "replace")))
                                held += member.size
                                if held > BATCH_BYTES:
                                    yield laid(rows)
                                    rows, held = [], 0
                except (tarfile.TarError, EOFError, zlib.error) as error:
                    raise ValueError(f"{path} is no whole archive: {error}") from error
        yield laid(rows)


def laid(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["paper_id", "path", "content"])


class ArchiveWriter(DataSourceWriter):
    """One archive for each run of rows of a paper, under another name until it is whole: a task that runs again writes the same."""

    def __init__(self, root: str):
        self.root = root

    def write(self, iterator) -> WriterCommitMessage:
        files, base = opened(self.root)
        files.create_dir(base, recursive=True)
        paper = archive = stream = temporary = None
        done = set()

        def close() -> None:
            if archive is not None:
                archive.close()
                stream.close()
                files.move(temporary, f"{base}/{urllib.parse.quote(paper, safe='')}.tar.gz")
                done.add(paper)

        for row in iterator:
            if row["paper_id"] is None or row["path"] is None:
                raise ValueError("a row without paper_id or path has no place in an archive")
            if row["paper_id"] != paper:
                close()
                paper = row["paper_id"]
                if paper in done:
                    raise ValueError(f"the rows of {paper} are not together")
                temporary = f"{base}/.{uuid.uuid4().hex}"
                stream = files.open_output_stream(temporary, compression=None)
                archive = tarfile.open(fileobj=stream, mode="w|gz")
            data = (row["content"] or "").encode()
            info = tarfile.TarInfo(row["path"])
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))
        close()
        return WriterCommitMessage()


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tex_archives"

    def schema(self) -> str:
        return SOURCES

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to the session, which must be the active one where a thread of its own reads or writes."""
    spark._get_j_spark_session_class(spark._jvm).setActiveSession(spark._jsparkSession)
    spark.dataSource.register(ArchiveSource)


def read_archives(spark: SparkSession, root: str) -> DataFrame:
    """paper_id, path, content of all ``.tex`` members of the archives below ``root``; bytes that are no UTF-8 become U+FFFD.

    A broken archive is an error that names it. A store that only Spark can list is read whole, archive by archive.
    """
    try:
        opened(root)
    except (pa.ArrowInvalid, NotImplementedError, OSError):
        return _through_spark(spark, root)
    register(spark)
    return spark.read.format("tex_archives").load(root)


def _through_spark(spark: SparkSession, root: str) -> DataFrame:
    """The same with the archives' bytes from Spark's own reader: an archive, of at most 2 GB, is in memory at once."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("name"), batch.column("content")):
                with tarfile.open(fileobj=io.BytesIO(data.as_py()), mode="r|*") as archive:
                    for member in archive:
                        if member.isfile() and member.name.endswith(".tex"):
                            yield laid([(urllib.parse.unquote(name.as_py()), member.name.removeprefix("./"), archive.extractfile(member).read().decode("utf-8", "replace"))])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{tar.gz,tgz}").option("recursiveFileLookup", True).load(root)
    return files.select(F.regexp_extract("path", r"([^/]+)\.(?:tar\.gz|tgz)$", 1).alias("name"), "content").mapInArrow(unpack, SOURCES)


def write_archives(sources: DataFrame, root: str) -> None:
    """One ``.tar.gz`` for each paper of ``sources`` below ``root``; an archive of the same paper is replaced. Null contents are empty."""
    register(sources.sparkSession)
    rows = sources.select(F.col("paper_id").cast("string").alias("paper_id"), "path", "content")
    rows.repartition("paper_id").sortWithinPartitions("paper_id", "path").write.format("tex_archives").mode("append").save(root)
