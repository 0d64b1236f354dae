"""Sources and sinks: TeX trees, archives, the derived test corpus, changed files, diagnostics, paper keys."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import spread
from .archives import SOURCES, opened, read_archives, write_archives  # noqa: F401


def read_sources(spark: SparkSession, root: str, pattern: str = "*.tex") -> DataFrame:
    """All files of a ``pattern`` below per-paper directories of ``root``; bytes that are no UTF-8 become U+FFFD, line ends stay."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    below = F.regexp_extract("path", rf"{base}/(.*)$", 1)
    return files.select(
        F.regexp_extract(below, r"^([^/]+)/", 1).alias("paper_id"),
        F.regexp_extract(below, r"^[^/]+/(.*)$", 1).alias("path"),
        F.expr("make_valid_utf8(CAST(content AS STRING))").alias("content"),
    )


def write_sources(sources: DataFrame, root: str) -> None:
    """Every file of ``sources`` at ``root``/paper_id/path, null contents as empty files; paths are those of pyarrow's file systems.

    A task writes its files itself, each under another name first, so that a file is whole or absent and a task that runs
    again replaces what it has written. Nothing is left for the driver to move.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = opened(root)
        for batch in batches:
            for paper, path, content in zip(*(batch.column(c).to_pylist() for c in ("paper_id", "path", "content"))):
                if paper in ("", ".", "..") or "/" in paper or ".." in path.split("/"):
                    raise ValueError(f"{paper}/{path} is no place below {root}")
                place = f"{base}/{paper}/{path}"
                files.create_dir(place.rsplit("/", 1)[0], recursive=True)
                temporary = f"{place}.{uuid.uuid4().hex}"
                with files.open_output_stream(temporary, compression=None) as f:
                    f.write((content or "").encode())
                files.move(temporary, place)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    rows = sources.select(F.col("paper_id").cast("string").alias("paper_id"), "path", "content")
    rows.mapInArrow(put, "n long").write.format("noop").mode("overwrite").save()


#: One line of a document as TeX. x: the line, @i: its number from 0, D: the document.
_LINE = r"""CASE @i % 16
 WHEN 0 THEN '\section{' || left(x, 30) || '}\label{sec:' || D || '-' || @i || '}'
 WHEN 1 THEN x
 WHEN 2 THEN '\begin{equation}\label{eq:' || D || '-' || @i || '}x=' || @i || '\end{equation}'
 WHEN 3 THEN x || ' with $y=' || @i || '$ \citep[see]{k' || (D % 7) || ',k' || (@i % 5) || '} and \ref{sec:' || D || '-' || (@i - 3) || '}'
 WHEN 4 THEN '\begin{figure*}\centering\includegraphics[width=1cm]{fig/p' || (@i % 3) || '.pdf}\caption{' || left(x, 20) || '}\label{fig:' || D || '-' || @i || '}\end{figure*}'
 WHEN 5 THEN x || ' See \autoref{fig:' || D || '-' || (@i - 1) || '} and \eqref{eq:' || D || '-' || (@i - 3) || '}.'
 WHEN 6 THEN '\subsection{' || left(x, 25) || '}'
 WHEN 7 THEN '\begin{' || E || '}\label{thm:' || D || '-' || @i || '}' || x || '\end{' || E || '}'
 WHEN 8 THEN '\begin{table}\caption{' || left(x, 15) || '}\label{tab:' || D || '-' || @i || '}\begin{tabularx}{5cm}{l@{}S[x]r}a\end{tabularx}\end{table}'
 WHEN 9 THEN '% note ' || left(x, 20) || N || x
 WHEN 10 THEN '\paragraph{' || left(x, 20) || '} ' || x
 WHEN 11 THEN x || ' \ref{sec:missing-' || D || '}'
 WHEN 12 THEN '\begin{align}a\label{eq:' || D || '-' || @i || 'a}b\label{eq:' || D || '-' || @i || 'b}\end{align}'
 WHEN 13 THEN '\vspace{1em}\noindent ' || x || ' \textsc{' || left(x, 10) || '}'
 WHEN 14 THEN '\begin{itemize}\item ' || x || ' \item ' || x || '\end{itemize}'
 ELSE '\begin{algorithm}\caption{' || left(x, 15) || '}\begin{algorithmic}\For{i}\State ' || left(x, 10) || '\If{b}\State y\EndIf\EndFor\end{algorithmic}\end{algorithm}' END"""

_BEFORE = r"""CASE m WHEN 0 THEN '\documentclass[11pt]{article}' || N || '\usepackage{amsmath, graphicx,pkg' || (P % 9) || '}' || N || '\RequirePackage[final]{xcolor}' || N
 || '\newcommand{\R}{real}' || N || '\newcommand{\thing}[1]{<#1>}' || N || '\newtheorem{claim}{Claim}' || N || '\graphicspath{{fig/}{img/}}' || N
 || '\title{Paper \R ' || P || ' \thanks{x}}' || N || '\author{Ann A' || P || '$^{1}$, Bob B' || (P % 11) || '\\ Some Lab}' || N || '\begin{document}' || N
 || '\begin{abstract}' || left(clean, 80) || '\end{abstract}' || N || CASE WHEN P % 3 = 0 THEN '\chapter{Start}' || N ELSE '' END
 WHEN 1 THEN '\newcommand{\R}{other}' || N WHEN 3 THEN '\appendix' || N ELSE '' END"""

_AFTER = r"""CASE m WHEN 0 THEN N || '\input{sections/intro}' || CASE WHEN P % 2 = 1 THEN N || '\input{sections/body.tex}' ELSE '' END
 || CASE WHEN P % 5 <> 0 THEN N || '\include{appendix}' ELSE '' END || N || '\end{document}'
 WHEN 1 THEN CASE WHEN P % 2 = 0 THEN N || '\input{body}' ELSE '' END
 WHEN 2 THEN CASE WHEN P % 7 = 0 THEN N || '\input{../main}' ELSE '' END ELSE '' END"""

_PATH = "CASE m WHEN 0 THEN 'main.tex' WHEN 1 THEN 'sections/intro.tex' WHEN 2 THEN 'sections/body.tex' ELSE 'appendix.tex' END"
_KIND = "CASE D % 3 WHEN 0 THEN 'theorem' WHEN 1 THEN 'lemma' ELSE 'claim' END"


def derive_sql(spark: bool, documents: str = "documents") -> str:
    """The derived corpus as SQL over ``documents``, for Spark or for DuckDB."""
    if spark:
        lines = "array_join(transform(split(clean, N), (x, i) -> " + _LINE.replace("@i", "i") + "), N || N)"
        clean = "translate(coalesce(text, ''), '$%&#\\{}_^~', '')"
    else:
        lines = "array_to_string(list_transform(string_split(clean, N), lambda x, j: " + _LINE.replace("@i", "(j - 1)") + "), chr(10) || chr(10))"
        clean = "regexp_replace(coalesce(text, ''), '[$%&#\\\\{}_^~]', '', 'g')"
    sql = f"""SELECT P AS paper_id, {_PATH} AS path, {_BEFORE} || {lines} || {_AFTER} AS content FROM (
 SELECT *, {_KIND} AS E FROM (SELECT doc_id AS D, CAST(floor(doc_id / 4) AS BIGINT) AS P, doc_id % 4 AS m, chr(10) AS N, {clean} AS clean FROM {documents}) AS a) AS b"""
    return sql.replace("\\", "\\\\") if spark else sql


def derive_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived corpus: every document of the ``documents`` table as a TeX file of one of the four paths of a paper."""
    view = "documents_" + uuid.uuid4().hex
    spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id").createOrReplaceTempView(view)
    return spark.sql(derive_sql(True, view))


def paper_key(df: DataFrame, column: str) -> DataFrame:
    """``paper_id`` from an identifier or an abs/pdf URL, without version: ``2402.08954v2`` gives ``2402.08954``; else null."""
    found = F.regexp_extract(F.trim(F.col(column)), r"([a-z\-]+(?:\.[A-Z]{2})?/\d{7}|\d{4}\.\d{4,5})(?:v\d+)?(?:\.pdf)?/?$", 1)
    return df.withColumn("paper_id", F.nullif(found, F.lit("")))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files of ``after`` whose content differs from ``before``."""
    old = before.select("paper_id", "path", F.col("content").alias("_old"))
    return after.join(old, ["paper_id", "path"]).where("content <> _old").drop("_old")


def write_changed(before: DataFrame, after: DataFrame, out: str, buckets: int = 64) -> None:
    """Write the changed files as Parquet, by a hash bucket of the paper."""
    rows = changed(before, after).withColumn("bucket", F.pmod(F.xxhash64("paper_id"), F.lit(buckets)).cast("int"))
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(out)


def report_diagnostics(*frames: DataFrame) -> DataFrame:
    """All diagnostics, by path, pass, start, end (null as -1), code and message."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out.orderBy("paper_id", "path", "pass_name", F.coalesce("start", F.lit(-1)), F.coalesce("end", F.lit(-1)), "code", "message")
