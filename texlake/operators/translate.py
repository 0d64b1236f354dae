"""Paragraphs, batches and responses of a translation corpus, and the bilingual documents."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import AnswerLog
from ..functions.macros import expand
from ..functions.scan import argument, math_in
from ..functions.tex import balanced_braces
from .discover import TRUSTED, first_by
from .intervals import FILE, adjacent_label, cut_points_to_ranges, merge_ranges, not_contained_in, not_overlapping, outermost, sliced

HEADINGS = ("chapter", "section", "subsection", "subsubsection", "paragraph")
#: Environments that hold no prose of their own.
SKIPPED = (
    "figure", "figure*", "table", "table*", "equation", "equation*", "align", "align*", "gather", "gather*", "multline", "multline*",
    "eqnarray", "eqnarray*", "algorithmdisplay", "algorithm", "algorithm*", "algorithmic", "lstlisting", "verbatim", "minted", "listing",
    "thebibliography", "tabular", "tabular*", "tabularx", "longtable", "wrapfigure", "subfigure", "tabu", "tabulary", "tblr", "xltabular",
    "ltablex", "NiceTabular", "NiceTabular*", "adjustbox", "tikzpicture",
)
#: Commands whose arguments are no prose.
STRUCTURAL = (
    *HEADINGS, "label", "caption", "includegraphics", "input", "include", "bibliography", "bibliographystyle", "documentclass", "usepackage", "RequirePackage",
    "title", "author", "date", "keywords", "newcommand", "renewcommand", "providecommand", "DeclareRobustCommand", "DeclareMathOperator", "setlength", "setcounter",
    "addtocounter", "addtolength", "newcounter", "graphicspath", "definecolor", "captionsetup", "fancyhead", "fancyfoot", "pagestyle", "cite", "parencite", "textcite",
    "autocite", "fullcite", "footcite", "citeauthor", "citetitle", "citep", "citet", "Citet", "Citep", "citealt", "citealp", "citenum", "citeyear",
)
#: Commands that a chunk is shown without.
CUT = (*HEADINGS, "label", "input", "include", "item")
BEGIN, END = "% TEXLAKE_TRANSLATION_BEGIN ", "% TEXLAKE_TRANSLATION_END "
PROSE_LETTERS = 20


def document_body(sources: DataFrame, nodes: DataFrame, papers: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bodies (paper_id, path, start, end): the main file's document environment (or what stands between its only pair of
    tokens), other included files whole; and diagnostics of main files without either."""
    main = papers.select("paper_id", F.col("main_path").alias("path")).join(sources, FILE)
    env = nodes.where("kind = 'environment' AND name = 'document'").groupBy(*FILE).agg(F.min_by(F.struct("body_start", "body_end", F.expr(TRUSTED).alias("ok")), "start").alias("b"))
    rows = main.join(env, FILE, "left")
    begin, finish = F.lit("\\begin{document}"), F.lit("\\end{document}")
    pair = (F.regexp_count("content", F.lit(r"\\begin\{document\}")) == 1) & (F.regexp_count("content", F.lit(r"\\end\{document\}")) == 1)
    lexical = pair & (F.instr("content", "\\begin{document}") < F.instr("content", "\\end{document}"))
    whole = F.coalesce(F.col("b.ok"), F.lit(False))
    rows = rows.withColumn("start", F.when(whole, F.col("b.body_start")).when(lexical, F.instr("content", "\\begin{document}") - 1 + F.length(begin)))
    rows = rows.withColumn("end", F.when(whole, F.col("b.body_end")).when(lexical, F.instr("content", "\\end{document}") - 1))
    bodies = rows.where("start IS NOT NULL").select(*FILE, "start", "end")
    others = files.select(*FILE).join(papers.select("paper_id", F.col("main_path").alias("path")), FILE, "left_anti").join(sources, FILE).select(*FILE, F.lit(0).alias("start"), F.length("content").alias("end"))
    lost = rows.where("start IS NULL OR NOT (b.ok <=> true)").select(
        *FILE, F.lit("body").alias("pass_name"), F.when(F.col("start").isNull(), "missing-document").otherwise("lexical-document-boundary-fallback").alias("code"),
        F.lit("no trusted document environment").alias("message"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"),
    )
    return bodies.unionByName(others), lost


def skip_ranges(spans: DataFrame) -> DataFrame:
    """Merged ranges of skipped environments and of display or incomplete math."""
    envs = outermost(spans.where((F.col("kind") == "environment") & F.col("name").isin(*SKIPPED) & F.expr(TRUSTED)).select(*FILE, "start", "end", "node_id"), FILE, "node_id").select(*FILE, "start", "end")
    return merge_ranges(envs.unionByName(spans.where("kind = 'math' AND (display OR NOT complete)").select(*FILE, "start", "end")))


#: A line without anything to see, but for the line feed at its end; all blanks of Unicode count.
BLANK_LINE = r"(?U)\A[^\S\r\n]*\r?\z"


def paragraph_ranges(sources: DataFrame, with_text: bool = False) -> DataFrame:
    """Paragraphs: what stands between blank lines; with their text, if asked for.

    A file becomes its lines with running offsets, and the runs of lines between blank ones are its paragraphs: islands of a
    window, whatever the number of lines or of blank ones in a row. A first or last line is never a gap.
    """
    lines = sources.select(*FILE, F.split(F.coalesce("content", F.lit("")), "\n").alias("_l")).select(*FILE, F.size("_l").alias("_n"), F.posexplode("_l").alias("k", "line"))
    gap = (F.col("k") > 0) & (F.col("k") < F.col("_n") - 1) & F.col("line").rlike(BLANK_LINE)
    w = Window.partitionBy(*FILE).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.withColumns({"gap": gap, "island": F.sum(gap.cast("int")).over(w), "stop": (F.sum(F.length("line") + 1).over(w) - 1).cast("int")}).where("NOT gap")
    # a carriage return before a gap belongs to it
    carriage = F.when((F.col("k") < F.col("_n") - 1) & F.col("line").endswith("\r"), 1).otherwise(0)
    text = [F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("text")] if with_text else []
    found = placed.groupBy(*FILE, "island").agg(F.min(F.col("stop") - F.length("line")).alias("start"), F.max(F.struct("k", "stop", "_n", carriage.alias("r"))).alias("z"), *text)
    cut = F.when(F.col("z.k") < F.col("z._n") - 1, F.col("z.r")).otherwise(0)
    found = found.withColumn("end", F.col("z.stop") - cut).where("start < end")
    return found.select(*FILE, "start", "end", *([F.left("text", F.col("end") - F.col("start")).alias("text")] if with_text else []))


def chunks(sources: DataFrame, spans: DataFrame) -> DataFrame:
    """Ranges between the borders of paragraphs, environment tokens and items, never inside display math; chunk_id from 0."""
    paragraphs = paragraph_ranges(sources)
    points = [paragraphs.select(*FILE, F.explode(F.array("start", "end")).alias("at")), spans.where("kind = 'env_token'").select(*FILE, F.explode(F.array("start", "end")).alias("at")), spans.where("kind = 'command' AND name = 'item'").select(*FILE, F.col("start").alias("at")), sources.select(*FILE, F.explode(F.array(F.lit(0), F.length("content"))).alias("at"))]
    math = spans.where("kind = 'math' AND (display OR NOT complete)").select(*FILE, "start", "end")
    rows = cut_points_to_ranges(reduce(DataFrame.unionByName, points), math)
    return rows.withColumn("chunk_id", F.row_number().over(Window.partitionBy(*FILE).orderBy("start")) - 1)


def _invisible(spans: DataFrame) -> DataFrame:
    """Ranges in which letters don't count."""
    command = F.col("kind") == "command"
    hidden = F.col("kind").isin("comment", "math", "env_token") | (command & F.col("name").isin(*STRUCTURAL))
    both = F.array(F.when(hidden, F.struct("start", "end")), F.when(command, F.struct("start", F.col("command_token_end").alias("end"))))
    return spans.select(*FILE, F.inline(F.array_compact(both)))  # the spans are read once: they may be the scan itself


def _letters(text: str) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]", ""))


def letters_in(rows: DataFrame, sources: DataFrame, spans: DataFrame) -> DataFrame:
    """``rows`` with ``letters``: letters of their text outside comments, math and the arguments of structural commands."""
    return sliced(rows, sources, seen=_invisible(spans)).withColumn("letters", _letters("seen")).drop("seen")


def prose_chunks(sources: DataFrame, spans: DataFrame, least: int = PROSE_LETTERS) -> DataFrame:
    """Chunks of prose: paper_id, path, start, end, chunk_id, text without comments, tokens, headings, labels, inputs, math."""
    rows = not_contained_in(chunks(sources, spans), skip_ranges(spans))
    hidden = spans.where((F.col("kind").isin("comment", "env_token")) | ((F.col("kind") == "math") & (F.col("display") | ~F.col("complete"))) | ((F.col("kind") == "command") & F.col("name").isin(*CUT)))
    both = sliced(rows, sources, seen=_invisible(spans), text=hidden.select(*FILE, "start", "end"))
    prose = both.where(_letters("seen") >= least).drop("seen")
    return prose.withColumn("text", F.regexp_replace("text", r"\A\s+|\s+\z", "")).where("text <> ''")


def chunk_digest(text: Column) -> Column:
    """SHA-256 of a text without one line end at its end."""
    return F.sha2(F.regexp_replace(text, r"(\r\n|\r|\n)\z", ""), 256)


def existing_blocks(sources: DataFrame) -> DataFrame:
    """Closed, not nested blocks between marker lines: paper_id, path, digest, start, end."""
    lines = sources.select(*FILE, F.posexplode(F.split("content", "\n")).alias("k", "line"))
    ahead = F.coalesce(F.sum(F.length("line") + 1).over(Window.partitionBy(*FILE).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marks = lines.withColumn("start", ahead.cast("int")).where(F.col("line").startswith(BEGIN) | F.col("line").startswith(END))
    marks = marks.select(*FILE, "start", (F.col("start") + F.length(F.regexp_replace("line", r"\r$", ""))).alias("end"), F.col("line").startswith(BEGIN).alias("opens"), F.regexp_extract("line", r"(\S+)\s*$", 1).alias("digest"))
    w = Window.partitionBy(*FILE).orderBy("start")
    closed = marks.withColumn("n", F.lead(F.struct("opens", "digest", "end")).over(w)).where("opens AND NOT n.opens AND n.digest = digest")
    return closed.select(*FILE, "digest", "start", F.col("n.end").alias("end"))


def pending_chunks(rows: DataFrame, memory: DataFrame) -> DataFrame:
    """Chunks (with digest) whose paper has no translation of them yet."""
    return rows.join(memory.select("paper_id", "digest"), ["paper_id", "digest"], "left_anti")


def pack_batches(rows: DataFrame, most: int = 24_000) -> DataFrame:
    """``rows`` (chunk_id, text) with ``batch``: greedy in order per file; a new one when the sum would pass ``most`` characters.

    Lengths alone are sorted by file and run through once, whatever a file's size; a null text has none.
    """
    if most <= 0:
        raise ValueError("the limit must be positive")
    lengths = rows.select(*FILE, "chunk_id", F.coalesce(F.length("text"), F.lit(0)).alias("n"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, batch_of, held = None, 0, 0
        for part in batches:
            out = []
            for paper, path, n in zip(*(part.column(c).to_pylist() for c in ("paper_id", "path", "n"))):
                if (paper, path) != file:
                    file, batch_of, held = (paper, path), 0, 0
                if held and held + n > most:
                    batch_of, held = batch_of + 1, 0
                held += n
                out.append(batch_of)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("paper_id", "path", "chunk_id")), pa.array(out, pa.int32())], names=["paper_id", "path", "chunk_id", "batch"])

    kinds = ", ".join(f"{c} {lengths.schema[c].dataType.simpleString()}" for c in (*FILE, "chunk_id"))
    dealt = lengths.repartition(*FILE).sortWithinPartitions(*FILE, "chunk_id").mapInArrow(deal, f"{kinds}, batch int")
    return rows.join(dealt, [*FILE, "chunk_id"])


def _tokens_for(text: str | None) -> tuple[str | None, list[dict[str, str]]]:
    """A text, scanned once, with tokens at the places of its math; and what they stand for."""
    pieces, replacements, at = [], [], 0
    for k, (start, end, _, closing) in enumerate(math_in(text or "")):
        if closing is not None:
            math = text[start:end]
            token = f"⟦TL_MATH_{k}_{hashlib.sha256(math.encode()).hexdigest()[:12]}⟧"
            pieces += [text[at:start], token]
            replacements.append({"token": token, "math": math})
            at = end
    return text if text is None else "".join(pieces) + text[at:], replacements


def protect_math(rows: DataFrame) -> DataFrame:
    """``rows`` (text) with prompt_text, complete math as marked tokens, and replacements array<struct<token, math>>.

    Math is what the scanner finds in the text: escaped dollars, inline code, comments and raw bodies are none, and what
    begins without an end stays as it is. One pass over each text, whatever its length.
    """

    @F.pandas_udf("prompt_text string, replacements array<struct<token:string,math:string>>")
    def protected(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_tokens_for(t) for t in texts], columns=["prompt_text", "replacements"])

    return rows.withColumn("_p", protected("text")).select("*", "_p.prompt_text", "_p.replacements").drop("_p")


def build_prompts(rows: DataFrame) -> DataFrame:
    """paper_id, path, batch, prompt: ``[id]``, line feed, text, by id, with blank lines between."""
    item = F.struct("chunk_id", F.concat(F.lit("["), F.col("chunk_id").cast("string"), F.lit("]\n"), "prompt_text").alias("t"))
    return rows.groupBy(*FILE, "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), "\n\n").alias("prompt"))


def parse_responses(raw: DataFrame) -> DataFrame:
    """paper_id, path, batch, chunk_id, translation from numbered answers; of a repeated number the last one counts.

    Zeros before a number don't matter; numbers beyond an int name no chunk.
    """
    # answers come from as many tasks as may ask at once; they are taken apart in all, where their numbers meet anyway
    parts = raw.repartition(*FILE, "batch").select(*FILE, "batch", F.posexplode(F.split("raw", r"(?=\[\d+\]\s*\n)")).alias("pos", "part"))
    rows = parts.select(*FILE, "batch", "pos", F.regexp_replace(F.regexp_extract("part", r"(?s)\A\[(\d+)\]\s*\n(.*)\z", 1), r"\A0+(?=\d)", "").alias("id"), F.regexp_replace(F.regexp_extract("part", r"(?s)\A\[(\d+)\]\s*\n(.*)\z", 2), r"\A\s+|\s+\z", "").alias("translation"))
    rows = rows.withColumn("chunk_id", F.col("id").try_cast("int")).where("chunk_id IS NOT NULL AND translation <> ''")
    return first_by(rows, [*FILE, "batch", "chunk_id"], F.desc("pos")).select(*FILE, "batch", "chunk_id", "translation")


def validate_translations(protected: DataFrame, responses: DataFrame) -> DataFrame:
    """``protected`` with translation and ``reason``: null, missing, unbalanced-braces, placeholders or raw-math."""
    rows = protected.join(responses.select(*FILE, "chunk_id", "translation"), [*FILE, "chunk_id"], "left")
    tokens = F.array_sort(F.regexp_extract_all("translation", F.lit(r"(⟦TL_MATH_\d+_[0-9a-f]{12}⟧)"), 1))
    reason = (
        F.when(F.col("translation").isNull(), "missing")
        .when(~balanced_braces(F.col("translation")), "unbalanced-braces")
        .when(tokens != F.array_sort(F.transform("replacements", lambda r: r["token"])), "placeholders")
        .when(F.regexp_replace("translation", r"\\[\\$%]|%[^\r\n]*", "").rlike(r"\$|\\\(|\\\["), "raw-math")
    )
    return rows.withColumn("reason", reason)


def restore_math(rows: DataFrame) -> DataFrame:
    """``translation`` of valid rows with its math back."""
    return rows.where("reason IS NULL").withColumn("translation", F.aggregate("replacements", F.col("translation"), lambda t, r: F.replace(t, r["token"], r["math"])))


def retry_set(requested: DataFrame, valid: DataFrame) -> DataFrame:
    """Requested chunks without a valid translation."""
    return requested.join(valid.select(*FILE, "chunk_id"), [*FILE, "chunk_id"], "left_anti")


def headings(nodes: DataFrame, skip: DataFrame) -> DataFrame:
    """Titles in document order outside skipped ranges: paper_id, path, file_ord, start, end, name, title (``nodes`` with file_ord)."""
    rows = nodes.where((F.col("kind") == "command") & F.col("name").isin(*HEADINGS) & F.expr(TRUSTED))
    rows = rows.select(*FILE, "file_ord", "start", "end", "name", F.trim(F.try_element_at("arguments", F.lit(-1))["text"]).alias("title")).where("title <> ''")
    return not_contained_in(rows, skip)


def unique_headings(rows: DataFrame) -> DataFrame:
    """paper_id, title, heading_id: different titles of a paper in first-seen order, from 0."""
    first = rows.groupBy("paper_id", "title").agg(F.min(F.struct("file_ord", "start")).alias("f"))
    return first.select("paper_id", "title", (F.row_number().over(Window.partitionBy("paper_id").orderBy("f")) - 1).alias("heading_id"))


def interleave(sources: DataFrame, translations: DataFrame, heads: DataFrame, head_translations: DataFrame, labels: DataFrame) -> DataFrame:
    """Edits that put each translation (between markers) behind its paragraph, and each heading's behind it and its label.

    translations: paper_id, path, end, digest, translation; heads as from ``headings``; head_translations: paper_id, title, translation.
    Blocks that a file already has are not added again.
    """
    block = lambda digest, text: F.concat(F.lit("\n\n" + BEGIN), digest, F.lit("\n"), text, F.lit("\n" + END), digest, F.lit("\n"))
    have = existing_blocks(sources).select(*FILE, "digest").distinct()
    below = translations.join(have, [*FILE, "digest"], "left_anti").select(*FILE, F.col("end").alias("at"), block(F.col("digest"), F.col("translation")).alias("replacement"))
    named = adjacent_label(heads, labels, sources).join(head_translations, ["paper_id", "title"]).withColumn("digest", chunk_digest(F.col("title")))
    titles = named.join(have, [*FILE, "digest"], "left_anti").select(*FILE, F.col("attach").alias("at"), block(F.col("digest"), F.col("translation")).alias("replacement"))
    rows = below.unionByName(titles).groupBy(*FILE, "at").agg(F.array_join(F.array_sort(F.collect_list("replacement")), "").alias("replacement"))
    return rows.select(*FILE, F.col("at").cast("int").alias("start"), F.col("at").cast("int").alias("end"), "replacement", F.lit("interleave").alias("pass_name"), F.lit("safe").alias("safety"))


def bilingual_rows(rows: DataFrame, translations: DataFrame, order: DataFrame) -> DataFrame:
    """paper_id, file_ord, chunk_id, source, target in order; target is null where there is none."""
    joined = rows.join(order, FILE).join(translations.select(*FILE, "chunk_id", "translation"), [*FILE, "chunk_id"], "left")
    return joined.select("paper_id", "file_ord", "chunk_id", F.col("text").alias("source"), F.col("translation").alias("target")).orderBy("paper_id", "file_ord", "chunk_id")


def translate_batches(prompts: DataFrame, fn: Callable[[str], str], parallel: int = 5, tries: int = 3, wait: float = 1.0, log: str | None = None) -> DataFrame:
    """paper_id, path, batch, raw, error: ``fn`` of every prompt, up to ``tries`` times with growing waits; at most ``parallel`` at once.

    With ``log``, a folder that all executors share, each answer is written down as soon as it is there. A task that runs
    again, or a later job with the same log, asks only what has no answer yet; equal prompts are asked once. Failures are not
    logged. Without a log, requests may repeat when a task does; results are keyed, so repeats change nothing.
    """
    kind = prompts.schema["paper_id"].dataType.simpleString()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = AnswerLog(log) if log else None
        for batch in batches:
            raw, errors = [], []
            for prompt in batch.column("prompt").to_pylist():
                answer, error = answers.get(prompt) if answers else None, None
                for k in range(tries if answer is None else 0):
                    try:
                        answer, error = fn(prompt), None
                        if answers and answer is not None:
                            answer = answers.put(prompt, answer)
                        break
                    except Exception as e:  # what the user's function raises becomes a row
                        error = f"{type(e).__name__}: {e}"
                        if k + 1 < tries:
                            time.sleep(wait * 2**k)
                raw.append(answer)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("paper_id", "path", "batch")), pa.array(raw, pa.string()), pa.array(errors, pa.string())], names=["paper_id", "path", "batch", "raw", "error"])

    # equal prompts meet in one task, and in the same one whenever it runs
    dealt = prompts.where("prompt IS NOT NULL").select(*FILE, "batch", "prompt").repartition(parallel, F.xxhash64("prompt"))
    return dealt.mapInArrow(ask, f"paper_id {kind}, path string, batch int, raw string, error string")


def expand_macros(df: DataFrame, column: str, macros: DataFrame, depth: int = 5) -> DataFrame:
    """``df`` (paper_id, ...) with the macros of its paper expanded in ``column``; malformed calls stay."""
    listed = macros.groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("body", "parameter_count", "optional_default", "math_operator")))).alias("_m"))

    @F.pandas_udf("string")
    def grow(texts: pd.Series, tables: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or not m else expand(t, {k: (v["body"], v["parameter_count"], v["optional_default"], v["math_operator"]) for k, v in dict(m).items()}, depth) for t, m in zip(texts, tables)])

    joined = df.join(listed, "paper_id", "left")
    return joined.withColumn(column, F.when(F.col("_m").isNull(), F.col(column)).otherwise(grow(F.col(column), F.col("_m")))).drop("_m")


def is_prose(rows: DataFrame, sources: DataFrame, spans: DataFrame, least: int = PROSE_LETTERS) -> DataFrame:
    """``rows`` with ``prose``: whether at least ``least`` letters are visible."""
    return letters_in(rows, sources, spans).withColumn("prose", F.col("letters") >= least)


def untouched(rows: DataFrame, generated: DataFrame) -> DataFrame:
    """Rows that no generated block overlaps."""
    return not_overlapping(rows, generated)


def abstract_prompt(facts: DataFrame, heads: DataFrame) -> DataFrame:
    """paper_id, prompt: title, abstract and headings of a paper, as context for a glossary."""
    listed = unique_headings(heads).groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("heading_id", "title"))), lambda x: x["title"]), ", ").alias("h"))
    return facts.join(listed, "paper_id", "left").select("paper_id", F.concat_ws("\n\n", "title", "abstract", "h").alias("prompt"))


def labels_of(nodes: DataFrame) -> DataFrame:
    return argument(nodes, "label")
