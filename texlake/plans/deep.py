"""Queries over variants of the corpus that meet what the plain one does not have: malformed, starred, nested and rare constructs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tex
from ..operators import discover as D
from ..operators import intervals as V
from ..operators import number as W
from ..operators import rewrite as R
from ..operators import translate as G
from . import oracles as O  # noqa: E741
from .oracles import sql
from .registry import query
from .texts import PARAGRAPHS, digests, edits, expected, paragraphs

#: Environments that never end: all behind the first one of a file is opaque.
BROKEN = ((r"\\begin\{itemize\}", r"\\begin{itemize}\\begin{broken}"),)


@query("n03_unclosed_environments", sql("""SELECT paper_id, path, count(*) AS n FROM (SELECT paper_id, path, start FROM cmd WHERE name NOT IN ('begin', 'end') UNION ALL SELECT paper_id, path, start FROM env WHERE name <> 'broken') x
 WHERE NOT EXISTS (SELECT 1 FROM arg b WHERE b.name = 'begin' AND b.a = 'broken' AND b.paper_id = x.paper_id AND b.path = x.path AND b.start <= x.start) GROUP BY ALL""", variant=BROKEN))
def _(c):
    own = c.variant(*BROKEN).nodes.withColumn("opaque", ~F.col("complete"))
    return V.mark_opaque(own).where(D.TRUSTED).groupBy("paper_id", "path").agg(F.count(F.lit(1)).alias("n"))


@query("n01_opaque_nodes", sql("""SELECT paper_id, path, count(*) AS n FROM (SELECT paper_id, path, start FROM cmd WHERE name NOT IN ('begin', 'end') UNION ALL SELECT paper_id, path, start FROM env WHERE name <> 'broken') x
 WHERE EXISTS (SELECT 1 FROM arg b WHERE b.name = 'begin' AND b.a = 'broken' AND b.paper_id = x.paper_id AND b.path = x.path AND b.start < x.start) GROUP BY ALL""", variant=BROKEN))
def _(c):
    return c.variant(*BROKEN).nodes.where("opaque AND name <> 'broken'").groupBy("paper_id", "path").agg(F.count(F.lit(1)).alias("n"))


#: As many closing braces as opening ones, in the wrong order.
TURNED = ((r"\\noindent ", r"}\\noindent {"),)


@query("n04_braces_in_order", sql("SELECT paper_id, path, length(replace(content, '{', '')) = length(replace(content, '}', '')) AND NOT contains(content, '}\\noindent {') AS ok FROM src", variant=TURNED))
def _(c):
    return c.variant(*TURNED).sources.select("paper_id", "path", tex.balanced_braces(F.col("content")).alias("ok"))


#: Some files with some line ends of the other style.
MIXED = ((r"\n% note", "\r\n% note"), (r"\n\\subsection", "\r" + r"\\subsection"))


@query("n06_mixed_line_ends", sql("SELECT paper_id, path, CASE WHEN contains(content, chr(13) || chr(10)) THEN 'CRLF' ELSE 'LF' END AS style, md5(replace(regexp_replace(content, '\\r\\n|\\r', chr(10), 'g'), chr(10), CASE WHEN contains(content, chr(13) || chr(10)) THEN chr(13) || chr(10) ELSE chr(10) END)) AS digest FROM src", variant=MIXED))
def _(c):
    text = F.col("content")
    style = tex.newline_style(text)
    return c.variant(*MIXED).sources.select("paper_id", "path", F.when(style == "\n", "LF").otherwise("CRLF").alias("style"), F.md5(tex.normalize_newlines(text, style)).alias("digest"))


#: A second path command whose names are the paper's.
PATHS = ((r"\\author\{Ann A([0-9]+)", r"\\graphicspath{{ p$1// }{fig}{figures}}\\author{Ann A$1"),)


@query("d08_two_path_commands", sql("SELECT paper_id, '.|figures|images|fig|img|p' || paper_id AS search FROM src WHERE path = 'main.tex'", variant=PATHS))
def _(c):
    return D.graphics_paths(c.variant(*PATHS).ordered).select("paper_id", F.array_join("search", "|").alias("search"))


#: Titles with sizes, notes, nested braces, line breaks and macro calls.
TITLES = ((r"\\title\{Paper \\R ([0-9]+) \\thanks\{x\}\}", r"\\title[s]{\\large A \\emph{b $1}\\footnote{c {d}}\\\\ \\thing{e}}"),)


@query("d12_titles_of_all_sorts", sql("SELECT paper_id, 'A b ' || paper_id || ' <e>' AS title FROM src WHERE path = 'main.tex'", variant=TITLES))
def _(c):
    v = c.variant(*TITLES)
    return D.paper_title(v.ordered, v.papers, v.macros)


#: Starred chapters, one of which names its own prefix.
STARRED = ((r"\\chapter\{Start\}", r"\\chapter*{B Supplement}\\chapter{One}\\chapter*{Plain}\\chapter{Two}"),)


@query("w02_starred_chapters", sql("SELECT paper_id, start, CASE row_number() OVER (PARTITION BY paper_id ORDER BY start) WHEN 1 THEN 'B' WHEN 4 THEN '2' ELSE '1' END AS prefix FROM cmd WHERE name = 'chapter'", variant=STARRED))
def _(c):
    return W.number_chapters(c.variant(*STARRED).included).select("paper_id", F.col("start").cast("long"), "prefix")


#: Figures of two labelled parts.
PARTS = ((r"(\\caption\{[^{}]*\})\\label\{fig:([0-9]+-[0-9]+)\}", r"\\label{sub:$2-a}\\label{sub:$2-b}$1\\label{fig:$2}"),)


@query("w06_figure_parts", sql("""SELECT f.paper_id, l.a AS label, coalesce(f.prefix || '.', '') || f.n || CASE WHEN l.a LIKE 'sub:%' THEN right(l.a, 1) ELSE '' END AS number
 FROM flt f JOIN acmd l ON l.name = 'label' AND l.paper_id = f.paper_id AND l.path = f.path AND l.start BETWEEN f.start AND f.stop""", O.CHAPTER, O.FLOATS, variant=PARTS))
def _(c):
    return W.number_subfigures(c.variant(*PARTS).included).select("paper_id", "label", "number")


#: Dingbats and circled numbers, known and unknown, with dollars around and without.
SYMBOLS = ((r"\\textsc\{([^{}]*)\}", r"\\ding{51} \$\\textcircled{3}\$ \\textcircled{4}\$x\$ \\ding{9999}\\ding{ 56 }"),)


@query("r08_dingbats", expected((r"\\textsc\{([^{}]*)\}", r"✓ ③ ④$x$ \\ding{9999}✘"), variant=SYMBOLS))
def _(c):
    v = c.variant(*SYMBOLS)
    return digests(v, lambda nodes: R.plan_symbols(nodes, v.sources))


#: Drawings with a label in them instead of images.
DRAWN = ((r"\\centering\\includegraphics\[width=1cm\]\{fig/p[0-9]\.pdf\}", r"\\begin{tikzpicture}draw\\end{tikzpicture}\\label{in}"),)


@query("r17_drawings", sql("""SELECT e.paper_id, e.path, e.begin_end AS start, k.start AS stop, chr(10) || '\\centering' || chr(10) || '\\includegraphics[width=\\linewidth]{page' || e.n || '.png}' || chr(10) || '\\label{in}' || chr(10) AS replacement
 FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY file_ord, start) AS n FROM env JOIN allfo USING (paper_id, path) WHERE name = 'figure*') e
 JOIN arg k ON k.name = 'caption' AND k.paper_id = e.paper_id AND k.path = e.path AND k.start BETWEEN e.start AND e.stop""", variant=DRAWN))
def _(c):
    v = c.variant(*DRAWN).only("figure", "figure*", "table", "table*", "wrapfigure", "caption", "label", "tikzpicture")
    counts = v.sources.groupBy("paper_id").agg(F.sum(F.regexp_count("content", F.lit(r"\\begin\{figure\*\}"))).cast("int").alias("n")).where("n > 0")
    captions = counts.select("paper_id", F.lit(1).alias("page"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("ord")).withColumn("image_ref", F.concat(F.lit("page"), "ord", F.lit(".png")))
    return edits(R.align_tikz(v.ordered, captions)[0])


@query("e01_all_reasons", sql("""SELECT paper_id, path, start, stop, reason FROM (SELECT paper_id, path, unnest([0, 0, length(content) + 5, 5, 5, 7]) AS start, unnest([1, 2, length(content) + 6, 5, 5, 8]) AS stop, unnest([NULL, 'overlap', 'bad-range', NULL, 'same-place', 'unsafe']) AS reason FROM src)
 UNION ALL SELECT paper_id, path || '.none', 0, 0, 'unknown-file' FROM src"""))
def _(c):
    n = F.length("content")
    item = lambda start, end, text, safety="safe", path=F.col("path"): F.struct(path.alias("path"), F.lit(start).cast("int").alias("start"), F.lit(end).cast("int").alias("end"), F.lit(text).alias("replacement"), F.lit(safety).alias("safety"))
    rows = F.array(item(0, 1, "a"), item(0, 2, "b"), item(n + 5, n + 6, "c"), item(5, 5, "d"), item(5, 5, "e"), item(7, 8, "f", "fallback"), item(0, 0, "g", path=F.concat("path", F.lit(".none"))))
    plan = c.sources.select("paper_id", F.explode(rows).alias("e")).select("paper_id", "e.*").withColumn("pass_name", F.lit("test"))
    return R.validate_edits(plan, c.sources).select("paper_id", "path", F.col("start").cast("long"), F.col("end").cast("long").alias("stop"), "reason")


@query("g18_interleaved_texts", sql("""SELECT paper_id, path, md5(string_agg(text || CASE WHEN text = '' THEN '' ELSE chr(10) || chr(10) || '% TEXLAKE_TRANSLATION_BEGIN ' || h || chr(10) || '<' || text || '>' || chr(10) || '% TEXLAKE_TRANSLATION_END ' || h || chr(10) END || gap, '' ORDER BY k)) AS digest
 FROM (SELECT *, sha256(regexp_replace(text, '(\\r\\n|\\r|\\n)$', '')) AS h FROM pg0) GROUP BY paper_id, path""", PARAGRAPHS))
def _(c):
    c = c.only(*G.HEADINGS, *G.SKIPPED, "label", "math")
    rows = paragraphs(c).withColumn("digest", G.chunk_digest(F.col("text"))).withColumn("translation", F.concat(F.lit("<"), "text", F.lit(">")))
    none = c.papers.select("paper_id", F.lit("").alias("title"), F.lit("").alias("translation")).where("false")
    plan = G.interleave(c.sources, rows, G.headings(c.included, G.skip_ranges(c.spans)), none, c.commands("label"))
    return R.apply_edits(c.sources, plan).select("paper_id", "path", F.md5("content").alias("digest"))
