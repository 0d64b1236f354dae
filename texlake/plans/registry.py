"""Registered queries of the corpus operators over the derived corpus, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tex
from ..functions.scan import scan_spans
from ..operators import discover as D
from ..operators import intervals as V
from ..operators import number as W
from ..sources.corpus import derive_sources
from . import oracles as O  # noqa: E741
from .corpus import Corpus
from .oracles import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function of a Corpus under ``name``."""

    def add(make: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: make(Corpus(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return make

    return add


FLAT = "('section', 'subsection', 'label', 'caption', 'ref', 'autoref', 'eqref', 'input', 'include', 'textsc', 'vspace', 'paragraph', 'includegraphics', 'citep')"
KEY = "paper_id, path, start"


@query("s03_derive_sources", sql("SELECT paper_id, path, md5(content) AS digest, length(content) AS n FROM src"))
def _(c):
    return c.plain.select("paper_id", "path", F.md5("content").alias("digest"), F.length("content").cast("long").alias("n"))


@query("n01_scan_commands", sql(f"SELECT {KEY}, name, a AS arg, stop FROM arg WHERE name IN {FLAT}"))
def _(c):
    rows = scan_spans(c.plain).where(f"kind = 'command' AND name IN {FLAT}")
    return rows.select("paper_id", "path", F.col("start").cast("long"), "name", F.try_element_at("arguments", F.lit(-1))["text"].alias("arg"), F.col("end").cast("long").alias("stop"))


@query("n01_scan_environments", sql(f"SELECT {KEY}, name, stop, begin_end FROM env"))
def _(c):
    return c.environments.select("paper_id", "path", F.col("start").cast("long"), "name", F.col("end").cast("long").alias("stop"), F.col("begin_token_end").cast("long").alias("begin_end"))


@query("n01_scan_math", sql("SELECT paper_id, path, count(*) AS n_math FROM (SELECT paper_id, path, unnest(regexp_extract_all(content, '\\$[^$]*\\$')) AS m FROM src) GROUP BY ALL"))
def _(c):
    return c.spans.where("kind = 'math'").groupBy("paper_id", "path").agg(F.count(F.lit(1)).alias("n_math"))


#: Inline code and verbatim text full of what would begin math, comments and groups.
RAW = ((r"\\textsc\{", r"\\verb|%\$ {|\\textsc{"), (r"\\begin\{itemize\}", r"\\begin{verbatim}\$ } 50% \\end{verbatim}\\begin{itemize}"))


@query("n01_scan_raw_bodies", sql("""SELECT p.paper_id, p.path, length(regexp_replace(p.content, '[^$]', '', 'g')) // 2 AS n_math, length(regexp_replace(p.content, '[^%]', '', 'g')) AS n_comments,
 len(regexp_extract_all(p.content, '[\\\\]textsc')) AS n_verb, len(regexp_extract_all(p.content, '[\\\\]begin')) + len(regexp_extract_all(p.content, '[\\\\]begin[{]itemize')) AS n_environments FROM plain p""", variant=RAW))
def _(c):
    of = lambda when: F.count_if(F.expr(when))
    rows = c.variant(*RAW).spans.groupBy("paper_id", "path").agg(of("kind = 'math'").alias("n_math"), of("kind = 'comment'").alias("n_comments"), of("kind = 'command' AND name = 'verb'").alias("n_verb"), of("kind = 'environment' AND complete").alias("n_environments"))
    return c.sources.select("paper_id", "path").join(rows, ["paper_id", "path"], "left").fillna(0)


@query("n02_strip_comments", sql("SELECT paper_id, path, md5(regexp_replace(content, '%[^\\r\\n]*', '', 'g')) AS digest FROM src"))
def _(c):
    return c.plain.select("paper_id", "path", F.md5(tex.strip_comments(F.col("content"))).alias("digest"))


@query("n03_mark_opaque", sql("SELECT paper_id, count(*) AS n FROM (SELECT paper_id FROM cmd WHERE name NOT IN ('begin', 'end') UNION ALL SELECT paper_id FROM env) GROUP BY 1"))
def _(c):
    return V.mark_opaque(c.nodes.withColumn("opaque", ~F.col("complete"))).where(D.TRUSTED).groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"))


@query("n04_balanced_braces", sql("SELECT paper_id, path, length(replace(content, '{', '')) = length(replace(content, '}', '')) AS ok FROM src"))
def _(c):
    return c.plain.select("paper_id", "path", tex.balanced_braces(F.col("content")).alias("ok"))


@query("n06_newline_style", sql("SELECT paper_id, path, CASE WHEN contains(content, chr(13) || chr(10)) THEN 'CRLF' ELSE 'LF' END AS style, md5(replace(content, chr(10), chr(13) || chr(10))) AS crlf FROM src"))
def _(c):
    style = tex.newline_style(F.col("content"))
    return c.plain.select("paper_id", "path", F.when(style == "\n", "LF").otherwise("CRLF").alias("style"), F.md5(tex.normalize_newlines(F.col("content"), F.lit("\r\n"))).alias("crlf"))


LONGEST = "out1 AS (SELECT e.* FROM env e WHERE e.name <> 'document' AND NOT EXISTS (SELECT 1 FROM env o WHERE o.name <> 'document' AND o.paper_id = e.paper_id AND o.path = e.path AND o.start <= e.start AND e.stop <= o.stop AND (o.start, o.stop) <> (e.start, e.stop)))"


@query("v01_outermost", sql(f"SELECT {KEY}, name, stop FROM out1", LONGEST))
def _(c):
    return V.outermost(c.environments.where("name <> 'document'"), V.FILE, "node_id").select("paper_id", "path", F.col("start").cast("long"), "name", F.col("end").cast("long").alias("stop"))


MERGED = """rng AS (SELECT paper_id, path, start, stop FROM arg WHERE stop > start + 1 AND name IN ('section', 'label', 'caption', 'citep', 'ref') UNION ALL SELECT paper_id, path, start, stop FROM env WHERE name IN ('itemize', 'table')),
mrg AS (SELECT paper_id, path, min(start) AS start, max(stop) AS stop FROM (SELECT *, sum(b) OVER (PARTITION BY paper_id, path ORDER BY start, stop) AS i FROM (
 SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY paper_id, path ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS b FROM rng)) GROUP BY paper_id, path, i)"""


def ranges(c: Corpus) -> DataFrame:
    return c.commands("section", "label", "caption", "citep", "ref").unionByName(c.environments.where("name IN ('itemize', 'table')"))


@query("v02_merge_ranges", sql(f"SELECT {KEY}, stop FROM mrg", MERGED))
def _(c):
    return V.merge_ranges(ranges(c)).select("paper_id", "path", F.col("start").cast("long"), F.col("end").cast("long").alias("stop"))


IN = "EXISTS (SELECT 1 FROM env e WHERE e.name IN ('figure*', 'table') AND e.paper_id = l.paper_id AND e.path = l.path AND e.start <= l.start AND l.stop <= e.stop)"


@query("v03_contained_in", sql(f"SELECT {KEY}, a AS label FROM arg l WHERE name = 'label' AND {IN}"))
def _(c):
    return V.contained_in(c.commands("label"), c.environments.where("name IN ('figure*', 'table')")).select("paper_id", "path", F.col("start").cast("long"), F.try_element_at("arguments", F.lit(-1))["text"].alias("label"))


@query("v03_not_contained_in", sql(f"SELECT {KEY}, a AS label FROM arg l WHERE name = 'label' AND NOT {IN}"))
def _(c):
    return V.not_contained_in(c.commands("label"), c.environments.where("name IN ('figure*', 'table')")).select("paper_id", "path", F.col("start").cast("long"), F.try_element_at("arguments", F.lit(-1))["text"].alias("label"))


@query("v04_not_overlapping", sql(f"SELECT {KEY}, name FROM env l WHERE NOT EXISTS (SELECT 1 FROM env e WHERE e.name IN ('table', 'algorithm') AND e.paper_id = l.paper_id AND e.path = l.path AND l.start < e.stop AND l.stop > e.start)"))
def _(c):
    return V.not_overlapping(c.environments, c.environments.where("name IN ('table', 'algorithm')")).select("paper_id", "path", F.col("start").cast("long"), "name")


@query("v05_slice_without", sql(f"""SELECT e.paper_id, e.path, e.start, md5(regexp_replace(substr(s.content, CAST(e.start + 1 AS BIGINT), CAST(e.stop - e.start AS BIGINT)), '\\\\(label|caption)\\{{[^{{}}]*\\}}', '', 'g')) AS digest
 FROM env e JOIN src s USING (paper_id, path) WHERE e.name IN ('figure*', 'table', 'theorem')"""))
def _(c):
    rows = c.environments.where("name IN ('figure*', 'table', 'theorem')").select("paper_id", "path", "start", "end")
    return V.slice_without(rows, c.sources, c.commands("label", "caption")).select("paper_id", "path", F.col("start").cast("long"), F.md5("text").alias("digest"))


PARENT = "(SELECT e.name FROM env e WHERE e.paper_id = l.paper_id AND e.path = l.path AND e.start <= l.start AND l.stop <= e.stop ORDER BY e.stop - e.start LIMIT 1)"


@query("v06_smallest_container", sql(f"SELECT l.paper_id, l.path, l.start, min_by(e.name, e.stop - e.start) AS container FROM arg l LEFT JOIN env e ON e.paper_id = l.paper_id AND e.path = l.path AND e.start <= l.start AND l.stop <= e.stop WHERE l.name IN ('caption', 'label') GROUP BY ALL"))
def _(c):
    return V.smallest_container(c.commands("caption", "label"), c.environments).select("paper_id", "path", F.col("start").cast("long"), F.col("container.name").alias("container"))


@query("v07_parent_environment", sql("SELECT l.paper_id, l.path, l.start, l.name, min_by(e.name, e.stop - e.start) AS parent FROM env l LEFT JOIN env e ON e.paper_id = l.paper_id AND e.path = l.path AND e.start <= l.start AND l.stop <= e.stop AND (e.start, e.stop) <> (l.start, l.stop) GROUP BY ALL"))
def _(c):
    return V.parent_environment(c.environments).select("paper_id", "path", F.col("start").cast("long"), "name", F.col("parent_environment").alias("parent"))


@query("v08_until_next", sql(f"SELECT paper_id, path, start, md5(substr(content, CAST(stop + 1 AS BIGINT), CAST(coalesce(nxt, length(content)) - stop AS BIGINT))) AS digest FROM (SELECT {KEY}, stop, lead(start) OVER (PARTITION BY paper_id, path ORDER BY start) AS nxt FROM arg WHERE name IN ('section', 'subsection', 'paragraph')) JOIN src USING (paper_id, path)"))
def _(c):
    return V.until_next(c.commands("section", "subsection", "paragraph"), c.sources).select("paper_id", "path", F.col("start").cast("long"), F.md5("tail").alias("digest"))


@query("v09_adjacent_label", sql("SELECT h.paper_id, h.path, h.start, coalesce(l.stop, h.stop) AS attach FROM arg h LEFT JOIN arg l ON l.name = 'label' AND l.paper_id = h.paper_id AND l.path = h.path AND l.start = h.stop WHERE h.name IN ('section', 'subsection')"))
def _(c):
    return V.adjacent_label(c.commands("section", "subsection"), c.commands("label"), c.sources).select("paper_id", "path", F.col("start").cast("long"), F.col("attach").cast("long"))


@query("v10_cut_points", sql("""SELECT paper_id, path, spot AS start, lead(spot) OVER (PARTITION BY paper_id, path ORDER BY spot) AS stop FROM (SELECT DISTINCT paper_id, path, spot FROM (
 SELECT p.paper_id, p.path, p.start AS spot FROM arg p WHERE p.name IN ('label', 'section', 'caption') AND NOT EXISTS (SELECT 1 FROM env e WHERE e.name IN ('table', 'figure*') AND e.paper_id = p.paper_id AND e.path = p.path AND e.start < p.start AND p.start < e.stop)
 UNION ALL SELECT paper_id, path, unnest([start, stop]) AS spot FROM env WHERE name IN ('table', 'figure*'))) QUALIFY stop IS NOT NULL"""))
def _(c):
    points = c.commands("label", "section", "caption").select("paper_id", "path", F.col("start").alias("at"))
    return V.cut_points_to_ranges(points, c.environments.where("name IN ('table', 'figure*')")).select("paper_id", "path", F.col("start").cast("long"), F.col("end").cast("long").alias("stop"))


@query("d01_find_main", sql("SELECT paper_id, coalesce(min(CASE WHEN contains(content, '\\documentclass') THEN path END), min(path)) AS main_path FROM src GROUP BY paper_id"))
def _(c):
    return c.papers


@query("d02_include_edges", sql("SELECT paper_id, path, target, start FROM edge"))
def _(c):
    return c.edges.withColumn("start", F.col("start").cast("long"))


@query("d03_include_order", sql("SELECT * FROM fo"))
def _(c):
    return c.files.withColumn("file_ord", F.col("file_ord").cast("long"))


@query("d04_file_order", sql("SELECT * FROM allfo"))
def _(c):
    return c.order.withColumn("file_ord", F.col("file_ord").cast("long"))


@query("d05_detached_files", sql("SELECT s.paper_id, s.path FROM src s ANTI JOIN fo f ON f.paper_id = s.paper_id AND f.path = s.path"))
def _(c):
    return D.detached_files(c.files, c.sources)


@query("d06_macro_definitions", sql("""SELECT paper_id, name, arg_min(body, (file_ord, start)) AS body, arg_min(n, (file_ord, start)) AS parameter_count FROM (
 SELECT a.paper_id, f.file_ord, a.start, '\\' || regexp_extract(b.p, '^[A-Za-z@]+') AS name, regexp_extract(b.p, '\\}(\\[[0-9]\\])?\\{([^{}]*)\\}', 2) AS body,
 coalesce(TRY_CAST(regexp_extract(b.p, '\\}\\[([0-9])\\]', 1) AS INTEGER), 0) AS n FROM cmd a JOIN cmd b ON b.paper_id = a.paper_id AND b.path = a.path AND b.start = a.start + 12
 JOIN allfo f ON f.paper_id = a.paper_id AND f.path = a.path WHERE a.name = 'newcommand') GROUP BY paper_id, name"""))
def _(c):
    return c.macros.select("paper_id", "name", "body", "parameter_count")


@query("d07_packages", sql("""SELECT paper_id, package, row_number() OVER (PARTITION BY paper_id ORDER BY f) AS ord FROM (SELECT paper_id, package, min((file_ord, r, start, pos)) AS f FROM (
 SELECT paper_id, file_ord, start, CASE name WHEN 'usepackage' THEN 0 ELSE 1 END AS r, unnest(list_transform(string_split(a, ','), lambda x: trim(x))) AS package, generate_subscripts(string_split(a, ','), 1) AS pos
 FROM acmd WHERE name IN ('usepackage', 'RequirePackage')) WHERE package <> '' GROUP BY paper_id, package)"""))
def _(c):
    return D.packages(c.ordered).withColumn("ord", F.col("ord").cast("long"))


@query("d08_graphics_paths", sql("SELECT paper_id, '.|figures|images|fig|img' AS search FROM src WHERE contains(content, '\\graphicspath{{fig/}{img/}}')"))
def _(c):
    return D.graphics_paths(c.ordered).select("paper_id", F.array_join("search", "|").alias("search"))


@query("d09_resource_refs", sql("SELECT a.paper_id, a.path, f.file_ord, a.start, a.a AS ref FROM arg a JOIN allfo f USING (paper_id, path) WHERE a.name = 'includegraphics'"))
def _(c):
    return D.resource_refs(c.ordered).select("paper_id", "path", F.col("file_ord").cast("long"), F.col("start").cast("long"), "ref")


@query("d10_label_index", sql("SELECT a.paper_id, a.a AS label, arg_min(a.path, (f.file_ord, a.start)) AS path, arg_min(a.start, (f.file_ord, a.start)) AS start FROM arg a JOIN allfo f USING (paper_id, path) WHERE a.name = 'label' GROUP BY a.paper_id, a.a"))
def _(c):
    return D.label_index(c.ordered).withColumn("start", F.col("start").cast("long"))


@query("d11_theorem_names", sql("SELECT p.paper_id, lower(t) AS environment, t AS label FROM (SELECT DISTINCT paper_id FROM src) p, (SELECT unnest(['Theorem', 'Lemma', 'Proposition', 'Corollary', 'Definition', 'Example', 'Remark', 'Assumption', 'Claim', 'Conjecture', 'Observation', 'Note', 'Fact', 'Property', 'Condition', 'Hypothesis']) AS t)"))
def _(c):
    return D.theorem_names(c.ordered, c.papers)


@query("d12_paper_title", sql("SELECT paper_id, 'Paper real ' || paper_id AS title FROM src WHERE contains(content, '\\title{Paper \\R ')"))
def _(c):
    return D.paper_title(c.ordered, c.papers, c.macros)


@query("d13_paper_authors", sql("SELECT paper_id, unnest([0, 1]) AS ord, unnest(['Ann A' || paper_id, 'Bob B' || (paper_id % 11)]) AS author FROM src WHERE contains(content, '\\author{Ann A')"))
def _(c):
    return D.paper_authors(c.ordered, c.papers)


@query("d14_paper_abstract", sql("SELECT paper_id, trim(regexp_extract(content, '\\\\begin\\{abstract\\}((?s).*?)\\\\end\\{abstract\\}', 1)) AS abstract FROM src WHERE path = 'main.tex'"))
def _(c):
    return D.paper_abstract(c.ordered, c.papers, c.sources)


@query("d15_paper_facts", sql("""SELECT m.paper_id, 'Paper real ' || m.paper_id AS title, (SELECT string_agg(path, '|' ORDER BY file_ord) FROM fo f WHERE f.paper_id = m.paper_id) AS files,
 (SELECT count(DISTINCT a) FROM arg l WHERE l.name = 'label' AND l.paper_id = m.paper_id) AS n_labels, (SELECT count(*) FROM arg g WHERE g.name = 'includegraphics' AND g.paper_id = m.paper_id) AS n_images FROM src m WHERE m.path = 'main.tex'"""))
def _(c):
    facts = D.paper_facts(c.ordered, c.papers, c.sources, c.files)
    size = lambda x: F.coalesce(F.size(x), F.lit(0)).cast("long")
    return facts.select("paper_id", "title", F.array_join("include_order", "|").alias("files"), size("labels").alias("n_labels"), size("resource_refs").alias("n_images"))


@query("d16_resolve_resources", sql("""SELECT a.paper_id, a.path, a.start, a.a AS ref, CASE WHEN (a.paper_id + CAST(substr(a.a, 6, 1) AS INTEGER)) % 3 > 0 THEN 'src/' || a.a END AS resource FROM arg a WHERE a.name = 'includegraphics'"""))
def _(c):
    refs = D.resource_refs(c.ordered)
    # of the three images of a paper two are known, below one more directory
    known = c.papers.select("paper_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).where("(paper_id + k) % 3 > 0").select("paper_id", F.concat(F.lit("src/fig/p"), "k", F.lit(".pdf")).alias("path"))
    return D.resolve_resources(refs, known).select("paper_id", "path", F.col("start").cast("long"), "ref", "resource")


@query("d17_common_root", sql("SELECT paper_id, CASE WHEN bool_and(path LIKE 'sections/%') THEN 'sections' ELSE '' END AS root FROM src WHERE path <> 'main.tex' OR paper_id % 2 = 0 GROUP BY paper_id"))
def _(c):
    return D.common_root(c.sources.where("path <> 'main.tex' OR paper_id % 2 = 0"))


@query("w01_numbering_scope", sql("SELECT paper_id, CASE WHEN bool_or(name = 'chapter') THEN 'chapter' ELSE 'global' END AS scope FROM acmd GROUP BY paper_id"))
def _(c):
    return W.numbering_scope(c.included)


@query("w02_number_chapters", sql("SELECT paper_id, start, prefix FROM chap", O.CHAPTER))
def _(c):
    return W.number_chapters(c.included).select("paper_id", F.col("start").cast("long"), "prefix")


@query("w03_number_objects", sql(f"SELECT {KEY}, float, {O.NUMBER} AS number FROM flt", O.CHAPTER, O.FLOATS))
def _(c):
    return W.number_objects(c.included).select("paper_id", "path", F.col("start").cast("long"), "float", "number")


@query("w04_number_equations", sql(f"SELECT paper_id, start, label, {O.NUMBER} AS number FROM eql", O.CHAPTER, O.EQUATIONS))
def _(c):
    return W.number_equations(c.included).select("paper_id", F.col("start").cast("long"), "label", "number")


#: Pairs of labelled equations under one number.
SUB = ((r"\\begin\{align\}a\\label\{eq:([0-9]+-[0-9]+)a\}", r"\\begin{subequations}\\label{par:$1}\\begin{align}a\\label{eq:$1a}"), (r"b\}\\end\{align\}", r"b}\\end{align}\\end{subequations}"))


@query("w05_subequations", sql(f"""SELECT e.paper_id, l.a AS label, {O.NUMBER} || CASE WHEN l.a LIKE 'par:%' THEN '' WHEN l.a LIKE '%a' THEN 'a' ELSE 'b' END AS number FROM (
 SELECT *, row_number() OVER (PARTITION BY paper_id, prefix ORDER BY file_ord, start) AS n FROM {O.placed('aenv', 't.*')} WHERE name IN ('align', 'equation')) e
 JOIN acmd l ON l.name = 'label' AND l.paper_id = e.paper_id AND l.path = e.path AND (l.start BETWEEN e.start AND e.stop OR l.stop = e.start) WHERE e.name = 'align'""", O.CHAPTER, variant=SUB))
def _(c):
    return W.number_subequations(c.variant(*SUB).only("chapter", "label", "subequations", *W.MATH).included).select("paper_id", "label", "number")


@query("w06_number_float_labels", sql("SELECT f.paper_id, l.a AS label, coalesce(f.prefix || '.', '') || f.n AS number FROM flt f JOIN acmd l ON l.name = 'label' AND l.paper_id = f.paper_id AND l.path = f.path AND l.start BETWEEN f.start AND f.stop", O.CHAPTER, O.FLOATS))
def _(c):
    return W.number_subfigures(c.included).select("paper_id", "label", "number")


@query("w07_number_theorems", sql(f"SELECT {KEY}, name AS environment, heading, n FROM thm", O.THEOREMS.format(t="(SELECT e.*, f.file_ord FROM env e JOIN allfo f USING (paper_id, path))")))
def _(c):
    return W.number_theorems(c.ordered, D.theorem_names(c.ordered, c.papers)).select("paper_id", "path", F.col("start").cast("long"), "environment", "heading", F.col("n").cast("long"))


@query("w08_number_algorithms", sql(f"SELECT {KEY}, n FROM alg", O.ALGORITHMS.format(t="(SELECT e.*, f.file_ord FROM env e JOIN allfo f USING (paper_id, path))")))
def _(c):
    return W.number_algorithms(c.ordered).select("paper_id", "path", F.col("start").cast("long"), F.col("n").cast("long"))


LINE = """ln AS (SELECT c.paper_id, c.path, e.start AS body, c.start, c.name AS command, row_number() OVER (PARTITION BY c.paper_id, c.path, e.start ORDER BY c.start) AS line,
 trim(regexp_replace(regexp_replace(c.p, '^[A-Za-z@]+(\\{[^{}]*\\})?', ''), '\\s+', ' ', 'g')) AS text FROM cmd c JOIN env e ON e.name = 'algorithmic' AND e.paper_id = c.paper_id AND e.path = c.path AND c.start > e.start AND c.start < e.close
 WHERE c.name IN ('For', 'State', 'If', 'EndIf', 'EndFor') AND NOT (c.name = 'State' AND trim(regexp_replace(c.p, '^[A-Za-z@]+', '')) = ''))"""


@query("w09_algorithm_lines", sql("SELECT *, CASE command WHEN 'State' THEN CASE WHEN text = 'y' AND lag(command) OVER w = 'If' THEN 2 ELSE 1 END WHEN 'If' THEN 1 WHEN 'EndIf' THEN 1 ELSE 0 END AS indent FROM ln WINDOW w AS (PARTITION BY paper_id, path, body ORDER BY start)", LINE))
def _(c):
    return W.algorithm_lines(c.ordered, c.sources).select("paper_id", "path", F.col("body").cast("long"), F.col("start").cast("long"), "command", F.col("line").cast("long"), "text", F.col("indent").cast("int"))


@query("w10_number_appendix", sql("SELECT paper_id, path, start, number FROM app", O.APPENDIX))
def _(c):
    return W.number_appendix(c.included).select("paper_id", "path", F.col("start").cast("long"), "number")


@query("w11_explicit_headings", sql("SELECT paper_id, path, start, CAST(NULL AS VARCHAR) AS number FROM arg WHERE name = 'section' AND NOT regexp_matches(a, '^[A-Z]+[.0-9]*\\s') UNION ALL SELECT paper_id, path, start, regexp_extract(a, '^([A-Z]+[.0-9]*)\\s', 1) FROM arg WHERE name = 'section' AND regexp_matches(a, '^[A-Z]+[.0-9]*\\s')"))
def _(c):
    heads = scan_spans(c.plain).where("kind = 'command' AND name = 'section'").select("paper_id", "path", F.col("start").cast("long").alias("start"), F.try_element_at("arguments", F.lit(-1))["text"].alias("text"), F.lit(False).alias("strong"))
    return W.number_headings_explicit(heads).select("paper_id", "path", "start", "number")


def numbers(c: Corpus) -> DataFrame:
    return W.all_numbers(c.included, D.theorem_names(c.ordered, c.papers))


@query("w12_all_numbers", sql("SELECT DISTINCT paper_id, label, number, prefix FROM num", *O.ALL_NUMBERS))
def _(c):
    return numbers(c)


@query("w13_resolve_refs", sql("""SELECT r.paper_id, r.path, r.start, r.type, r.label, CASE type WHEN 'eqref' THEN CASE WHEN n.prefix = 'Equation' THEN '(' || n.number || ')' ELSE '[' || r.label || ']' END
 WHEN 'ref' THEN coalesce(n.number, '[' || r.label || ']') ELSE CASE WHEN r.label LIKE 'fig:%' THEN 'Fig.' || chr(160) ELSE '' END || coalesce(n.number, 'link') END AS text FROM rf r LEFT JOIN (SELECT DISTINCT * FROM num) n ON n.paper_id = r.paper_id AND n.label = r.label""", *O.ALL_NUMBERS, O.REFS))
def _(c):
    return W.resolve_refs(c.included, numbers(c)).withColumn("start", F.col("start").cast("long"))


@query("w14_caption_text", sql("SELECT l.paper_id, l.path, l.start, upper(f.float[1]) || f.float[2:] || ' ' || coalesce(f.prefix || '.', '') || f.n || ': ' || trim(l.a) AS text FROM flt f JOIN acmd l ON l.name = 'caption' AND l.paper_id = f.paper_id AND l.path = f.path AND l.start BETWEEN f.start AND f.stop", O.CHAPTER, O.FLOATS))
def _(c):
    return W.caption_text(c.included).withColumn("start", F.col("start").cast("long"))


@query("w15_dangling_refs", sql("SELECT r.paper_id, r.path, r.start, r.label FROM rf r WHERE NOT EXISTS (SELECT 1 FROM acmd l WHERE l.name = 'label' AND l.paper_id = r.paper_id AND l.a = r.label)", O.REFS))
def _(c):
    return W.dangling_refs(c.included).select("paper_id", "path", F.col("start").cast("long"), "label")


from . import deep, texts  # noqa: E402, F401  add their queries here
