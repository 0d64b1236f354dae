"""Registered queries of the rewrite and translation operators, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scan import scan_spans
from ..functions.shared import cut, new_path
from ..operators import discover as D
from ..operators import intervals as V
from ..operators import number as W
from ..operators import rewrite as R
from ..operators import translate as G
from ..sources import corpus as S
from ..streaming.pending import queue_of, stream_pending
from . import oracles as O  # noqa: E741
from .corpus import Corpus
from .oracles import sql
from .registry import LINE, query

EDIT = "paper_id, path, start, stop, replacement"


def edits(rows: DataFrame) -> DataFrame:
    return rows.select("paper_id", "path", F.col("start").cast("long"), F.col("end").cast("long").alias("stop"), "replacement")


@query("s01_read_sources", sql("SELECT 'paper_id=' || paper_id AS paper_id, md5(string_agg(content, chr(10) ORDER BY path) || chr(10)) AS digest FROM src GROUP BY paper_id"))
def _(c):
    # a directory for each paper, with one file in it
    tree = new_path(c.spark, "tree")
    whole = c.plain.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "content"))), lambda x: x["content"]), "\n").alias("value"))
    S.write_sources(whole.select(F.concat(F.lit("paper_id="), "paper_id").alias("paper_id"), F.lit("all.txt").alias("path"), F.concat("value", F.lit("\n")).alias("content")), tree)
    return S.read_sources(c.spark, tree, "*.txt").select("paper_id", F.md5("content").alias("digest"))


@query("s04_changed_files", sql("SELECT paper_id, path, md5(new) AS digest FROM (SELECT *, regexp_replace(content, '\\\\citep\\[see\\]', '\\\\cite', 'g') AS new FROM src) WHERE new <> content"))
def _(c):
    return S.changed(c.sources, R.apply_edits(c.sources, R.plan_citations(c.nodes))).select("paper_id", "path", F.md5("content").alias("digest"))


@query("s02_archives", sql("SELECT CAST(paper_id AS VARCHAR) AS paper_id, path, md5(content) AS digest FROM src"))
def _(c):
    root = new_path(c.spark, "archives")
    S.write_archives(c.sources, root)
    return S.read_archives(c.spark, root).select("paper_id", "path", F.md5("content").alias("digest"))


@query("s04_write_changed", sql("SELECT paper_id, path, md5(new) AS digest FROM (SELECT *, regexp_replace(content, '\\\\citep\\[see\\]', '\\\\cite', 'g') AS new FROM src) WHERE new <> content"))
def _(c):
    out = new_path(c.spark, "changed")
    S.write_changed(c.sources, R.apply_edits(c.sources, R.plan_citations(c.nodes)), out)
    return c.spark.read.parquet(out).select("paper_id", "path", F.md5("content").alias("digest"))


@query("s05_report_diagnostics", sql("SELECT paper_id, path, 'references' AS pass_name, 'dangling-reference' AS code, label AS message, start FROM rf r WHERE NOT EXISTS (SELECT 1 FROM acmd l WHERE l.name = 'label' AND l.paper_id = r.paper_id AND l.a = r.label)", O.REFS))
def _(c):
    dangling = W.dangling_refs(c.included).select("paper_id", "path", F.lit("references").alias("pass_name"), F.lit("dangling-reference").alias("code"), F.col("label").alias("message"), F.col("start").cast("long"), F.lit(None).cast("int").alias("end"))
    broken = R.untrusted(c.nodes, G.HEADINGS, "headings").withColumn("start", F.col("start").cast("long"))
    return S.report_diagnostics(dangling, broken).drop("end")


@query("s06_paper_key", "SELECT doc_id, '2402.' || lpad(CAST(doc_id AS VARCHAR), 5, '0') AS paper_id FROM documents")
def _(c):
    docs = c.sources.select(F.explode(F.array((F.col("paper_id") * 4 + F.when(F.col("path") == "main.tex", 0).when(F.col("path") == "sections/intro.tex", 1).when(F.col("path") == "sections/body.tex", 2).otherwise(3)))).alias("doc_id"))
    named = docs.withColumn("url", F.concat(F.lit("https://host/abs/2402."), F.lpad(F.col("doc_id").cast("string"), 5, "0"), F.lit("v2")))
    return S.paper_key(named, "url").select("doc_id", "paper_id")


@query("r01_remove", sql("SELECT paper_id, path, start, CASE name WHEN 'vspace' THEN stop ELSE start + 1 + length(name) END AS stop, '' AS replacement FROM arg WHERE name IN ('vspace', 'centering', 'noindent')"))
def _(c):
    return edits(R.plan_remove(c.nodes, c.sources))


@query("r04_rename_environments", sql(f"""SELECT {EDIT} FROM (SELECT paper_id, path, start, begin_end AS stop, '\\begin{{figure}}' AS replacement FROM env WHERE name = 'figure*' UNION ALL SELECT paper_id, path, close, stop, '\\end{{figure}}' FROM env WHERE name = 'figure*'
 UNION ALL SELECT paper_id, path, start, start + length('\\begin{{tabularx}}{{5cm}}{{l@{{}}S[x]r}}'), '\\begin{{tabular}}{{l@{{}}S[x]r}}' FROM env WHERE name = 'tabularx' UNION ALL SELECT paper_id, path, close, stop, '\\end{{tabular}}' FROM env WHERE name = 'tabularx')"""))
def _(c):
    return edits(R.plan_rename_environments(c.nodes))


@query("r05_column_specs", sql("SELECT paper_id, path, start + length('\\begin{tabularx}{5cm}{') AS start, start + length('\\begin{tabularx}{5cm}{l@{}S[x]r') AS stop, 'lrr' AS replacement FROM env WHERE name = 'tabularx'"))
def _(c):
    return edits(R.plan_column_specs(c.nodes))


SPECS = ((r"\{l@\{\}S\[x\]r\}", r"{>{\\Small\\S}l!{x}S [y]@{z}p{\\Sx}}"),)


@query("r05_column_spec_commands", sql("SELECT paper_id, path, '>{\\Small\\S}l!{x}rp{\\Sx}' AS replacement FROM env WHERE name = 'tabularx'"))
def _(c):
    v = c.variant(*SPECS)
    return R.plan_column_specs(v.nodes).select("paper_id", "path", "replacement")


@query("r06_filter_packages", sql("SELECT paper_id, path, start + length('\\usepackage{') AS start, stop - 1 AS stop, 'amsmath,' || split_part(a, ',', 3) AS replacement FROM arg WHERE name = 'usepackage' UNION ALL SELECT paper_id, path, start, stop, '' FROM arg WHERE name = 'RequirePackage'"))
def _(c):
    return edits(R.plan_filter_packages(c.nodes))


@query("r07_citations", sql("SELECT paper_id, path, start, stop, '\\cite{' || a || '}' AS replacement FROM arg WHERE name = 'citep'"))
def _(c):
    return edits(R.plan_citations(c.nodes))


@query("r08_symbols", sql("SELECT paper_id, path, start, start + 7 AS stop, '\\text' AS replacement FROM arg WHERE name = 'textsc'"))
def _(c):
    return edits(R.plan_symbols(c.nodes, c.sources))


@query("r09_headings", sql("""SELECT paper_id, path, start + 10 AS start, start + 10 AS stop, '*' AS replacement FROM arg WHERE name = 'paragraph' UNION ALL SELECT paper_id, path, start, start + 9, '' FROM cmd WHERE name = 'appendix'
 UNION ALL SELECT paper_id, path, start + 1 + length(name), start + 1 + length(name), '*' FROM app UNION ALL SELECT paper_id, path, start + 2 + length(name), start + 2 + length(name), number || ' ' FROM app""", O.APPENDIX))
def _(c):
    return edits(R.plan_headings(c.nodes, c.papers, c.included))


THEOREM_EDITS = """SELECT paper_id, path, start, begin_end AS stop, '\\begin{quote}' || chr(10) || '% TEXLAKE_THEOREM' || chr(10) || '\\textbf{' || heading || ' ' || n || '}\\textbf{.} ' AS replacement FROM thm
 UNION ALL SELECT paper_id, path, close, stop, chr(10) || '\\end{quote}' FROM thm"""


@query("r11_theorems", sql(THEOREM_EDITS, O.THEOREMS.format(t="(SELECT e.*, f.file_ord FROM env e JOIN allfo f USING (paper_id, path))")))
def _(c):
    return edits(R.plan_theorems(c.nodes, c.ordered, D.theorem_names(c.ordered, c.papers), c.sources))


#: Lemmas with titles, claims as proofs.
TITLED = ((r"\\begin\{lemma\}", r"\\begin{lemma}[Of \\emph{x}]"), (r"\\(begin|end)\{claim\}", r"\\$1{proof}"))


@query("r11_titles_and_proofs", sql("""SELECT paper_id, path, start, begin_end + length('[Of \\emph{x}]') AS stop, '\\begin{quote}' || chr(10) || '% TEXLAKE_THEOREM' || chr(10) || '\\textbf{Lemma ' || n || '} \\textit{(Of \\emph{x})}\\textbf{.} ' AS replacement FROM thm WHERE name = 'lemma'
 UNION ALL SELECT paper_id, path, close, stop, chr(10) || '\\end{quote}' FROM thm WHERE name = 'lemma'
 UNION ALL SELECT paper_id, path, start, begin_end, '\\begin{quote}' || chr(10) || '% TEXLAKE_THEOREM' || chr(10) || '\\textit{Proof.} ' FROM env WHERE name = 'proof' UNION ALL SELECT paper_id, path, close, stop, ' \\hfill$\\square$' || chr(10) || '\\end{quote}' FROM env WHERE name = 'proof'""",
 O.THEOREMS.format(t="(SELECT e.*, f.file_ord FROM env e JOIN allfo f USING (paper_id, path))"), variant=TITLED))
def _(c):
    v = c.variant(*TITLED)
    sources = v.sources  # written first, so that the scan reads it
    rows = edits(R.plan_theorems(v.nodes, v.ordered, D.theorem_names(v.ordered, v.papers), sources))
    return rows.where("replacement NOT LIKE '%{Theorem %'").join(v.environments.where("name = 'theorem'").select("paper_id", "path", F.col("end").cast("long").alias("stop")), ["paper_id", "path", "stop"], "left_anti").select("paper_id", "path", "start", "stop", "replacement")


#: Theorems and macros under names of the paper's own: titles with braces, calls with arguments.
OWN = ((r"\\newtheorem\{claim\}\{Claim\}", r"\\newtheorem{lem}{Lem}"), (r"\\begin\{claim\}", r"\\begin{lem}[On \\emph{x}]"), (r"\\end\{claim\}", r"\\end{lem}"), (r"\\textsc\{", r"\\thing{"))


@query("n01_own_forms", sql("""SELECT paper_id, path, start, 'thing' AS name, a AS arg, stop FROM arg WHERE name = 'thing' AND regexp_matches(p, '^thing\\{[^{}]*\\}')
 UNION ALL SELECT paper_id, path, start, 'lem', 'On \\emph{x}', begin_end + length('[On \\emph{x}]') FROM env WHERE name = 'lem'""", variant=OWN))
def _(c):
    calls = c.variant(*OWN).own.nodes.where(f"name IN ('thing', 'lem') AND {D.TRUSTED}")
    return calls.select("paper_id", "path", F.col("start").cast("long"), "name", F.get("arguments", F.lit(0))["text"].alias("arg"), F.coalesce("body_start", "end").cast("long").alias("stop"))


@query("r11_own_theorems", sql("""SELECT paper_id, path, start, begin_end + length('[On \\emph{x}]') AS stop, '\\begin{quote}' || chr(10) || '% TEXLAKE_THEOREM' || chr(10) || '\\textbf{Lem ' || row_number() OVER (PARTITION BY paper_id ORDER BY file_ord, start) || '} \\textit{(On \\emph{x})}\\textbf{.} ' AS replacement
 FROM env JOIN allfo USING (paper_id, path) WHERE name = 'lem'""", variant=OWN))
def _(c):
    v = c.variant(*OWN).own
    return edits(R.plan_theorems(v.nodes, v.ordered, D.theorem_names(v.ordered, v.papers), v.sources)).where("replacement LIKE '%{Lem %'")


@query("x02_macro_calls", sql("SELECT paper_id, path, start, stop, '<' || a || '>' AS replacement FROM arg WHERE name = 'thing' AND regexp_matches(p, '^thing\\{[^{}]*\\}')", variant=OWN))
def _(c):
    v = c.variant(*OWN).own
    return edits(R.plan_macro_calls(v.nodes, v.macros).where("replacement LIKE '<%'"))


ITEMS = r"\\begin\{itemize\}", r"\\end\{itemize\}"
WRAPPED = ((r"\\textsc\{([^{}]*)\}", r"\\texorpdfstring{$1}{z}"),)
PAGES = ((ITEMS[0], r"\\begin{minipage}[t]{5cm}"), (ITEMS[1], r"\\end{minipage}"))
CAPTIONED = ((ITEMS[0], r"\\begin{minipage}{5cm}\\captionof{table}{Cap}"), (ITEMS[1], r"\\end{minipage}"))
CODE = ((ITEMS[0], r"\\begin{lstlisting}[language=C]"), (ITEMS[1], r"\\end{lstlisting}"), (r"\\textsc\{([^{}]*)\}", r"\\mintinline{py}{$1}"))
NOTES = ((r"\\newcommand\{\\thing\}\[1\]\{<#1>\}", r"\\newcommand{\\atran}[1]{<#1>}\\newcounter{annotatec}\\newcommand{\\annotatez}{q}"),)


def expected(*pairs: tuple[str, str], variant) -> str:
    """The digest of each file of the plain corpus after some replacements, which the edits of the variant must give."""
    text = "content"
    for old, new in pairs:
        text = f"regexp_replace({text}, '{old}', '{new}', 'g')"
    return sql(f"SELECT paper_id, path, md5({text}) AS digest FROM plain", variant=variant)


def digests(c: Corpus, plan) -> DataFrame:
    return R.apply_edits(c.sources, plan(c.nodes)).select("paper_id", "path", F.md5("content").alias("digest"))


@query("r02_unwrap_commands", expected((r"\\textsc\{([^{}]*)\}", r"\1"), variant=WRAPPED))
def _(c):
    return digests(c.variant(*WRAPPED), R.plan_unwrap_commands)


@query("r03_unwrap_environments", expected((ITEMS[0], ""), (ITEMS[1], ""), variant=PAGES))
def _(c):
    return digests(c.variant(*PAGES), R.plan_unwrap_environments)


@query("r10_captionof", expected((ITEMS[0], r"\\begin{table}\\caption{Cap}"), (ITEMS[1], r"\\end{table}"), variant=CAPTIONED))
def _(c):
    return digests(c.variant(*CAPTIONED), R.plan_captionof)


@query("r13_listings", expected((ITEMS[0], r"\\begin{lstlisting}"), (ITEMS[1], r"\\end{lstlisting}"), (r"\\textsc\{", r"\\texttt{"), variant=CODE))
def _(c):
    return digests(c.variant(*CODE), R.plan_listings)


@query("r16_annotations", expected((r"\\newcommand\{\\thing\}\[1\]\{<#1>\}", r"\\newcommand{\\atran}[1]{#1}"), variant=NOTES))
def _(c):
    return digests(c.variant(*NOTES), R.plan_annotations)


STEPS = """st AS (SELECT *, CASE command WHEN 'State' THEN CASE WHEN text = 'y' AND lag(command) OVER w = 'If' THEN 2 ELSE 1 END WHEN 'If' THEN 1 WHEN 'EndIf' THEN 1 ELSE 0 END AS indent FROM ln WINDOW w AS (PARTITION BY paper_id, path, body ORDER BY start)),
pseudo AS (SELECT e.paper_id, e.path, e.start, e.stop, string_agg(s.line || ': ' || repeat('~~~~', CAST(s.indent AS INTEGER)) || CASE s.command WHEN 'For' THEN '\\textbf{for} i \\textbf{do}' WHEN 'If' THEN '\\textbf{if} b \\textbf{then}' WHEN 'EndIf' THEN '\\textbf{end if}' WHEN 'EndFor' THEN '\\textbf{end for}' ELSE s.text END, '\\\\' || chr(10) ORDER BY s.line) AS replacement
 FROM env e JOIN st s ON s.paper_id = e.paper_id AND s.path = e.path AND s.body = e.start WHERE e.name = 'algorithmic' GROUP BY ALL)"""
CALLED = ((r"\\State y\\EndIf", r"\\State \\Call{f}{\\Call{g}{x}, 1}\\EndIf"),)


@query("r12_algorithm_calls", sql("SELECT paper_id, path, count(*) AS n FROM env WHERE name = 'algorithmic' GROUP BY ALL", variant=CALLED))
def _(c):
    v = c.variant(*CALLED)
    sources = v.sources  # written first, so that the scan reads it
    rows = edits(R.plan_algorithms(v.nodes, v.ordered, sources))
    return rows.where(F.contains("replacement", F.lit("~~~~~~~~\\operatorname{f}(\\operatorname{g}(x), 1)"))).groupBy("paper_id", "path").agg(F.count(F.lit(1)).alias("n"))


@query("r12_algorithms", sql(f"SELECT {EDIT} FROM pseudo", LINE, STEPS))
def _(c):
    return edits(R.plan_algorithms(c.nodes, c.ordered, c.sources))


@query("r14_inputs", sql("SELECT a.paper_id, a.path, a.stop - 1 AS start, a.stop - 1 AS stop, '.tex' AS replacement FROM arg a JOIN edge e ON e.paper_id = a.paper_id AND e.path = a.path AND e.start = a.start WHERE a.a NOT LIKE '%.tex'"))
def _(c):
    return edits(R.plan_inputs(c.nodes, c.files))


#: Inputs that only the papers' common directory has.
ROOTED = ((r"\\input\{body\}", r"\\input{sections/body}"), (r"\\input\{sections/intro\}", r"\\input{sections/intro}" + "\n" + r"\\input{sections/body.tex}"))


@query("r14_second_root", sql("""SELECT a.paper_id, a.path, a.stop - 1 AS start, a.stop - 1 AS stop, '.tex' AS replacement FROM arg a WHERE a.name IN ('input', 'include') AND a.a NOT LIKE '%.tex'
 AND EXISTS (SELECT 1 FROM fo f WHERE f.paper_id = a.paper_id AND f.path IN (a.a || '.tex', replace(regexp_extract(a.path, '^(.*/)?', 0) || a.a, 'sections/../', '') || '.tex'))""", variant=ROOTED))
def _(c):
    v = c.variant(*ROOTED)
    return edits(R.plan_inputs(v.nodes, v.files))


#: Wrappers four deep.
DEEP = ((r"\\textsc\{([^{}]*)\}", r"\\hyperlink{a}{\\texorpdfstring{\\hyperref[b]{\\hypertarget{c}{$1}}}{z}}"),)


@query("e04_deep_wrappers", sql("SELECT paper_id, path, len(regexp_extract_all(content, '\\\\textsc')) AS n FROM plain WHERE contains(content, '\\textsc')", variant=DEEP))
def _(c):
    whole = c.sources  # first: the variant is made of the written files
    after, _ = R.rewrite_corpus(c.variant(*DEEP).plain, rounds=3)
    text = F.lit(r"\\hyper|\\texorpdfstring")
    whole = whole.select("paper_id", "path", F.regexp_count("content", F.lit(r"\\textsc\{")).cast("long").alias("n")).where("n > 0")
    return whole.join(after.where(F.regexp_count("content", text) == 0).select("paper_id", "path"), ["paper_id", "path"])


@query("r15_image_refs", sql("SELECT paper_id, path, stop - 4 AS start, stop - 1 AS stop, 'png' AS replacement FROM arg WHERE name = 'includegraphics' AND (paper_id + CAST(substr(a, 6, 1) AS INTEGER)) % 3 > 0"))
def _(c):
    known = c.papers.select("paper_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).where("(paper_id + k) % 3 > 0").select("paper_id", F.concat(F.lit("src/fig/p"), "k", F.lit(".pdf")).alias("path"))
    return edits(R.plan_image_refs(D.resolve_resources(D.resource_refs(c.ordered), known), c.nodes))


@query("r17_align_tikz", sql("""SELECT paper_id, 'figure-count-mismatch' AS code, n || ' figures, ' || m || ' captions' AS message FROM (SELECT s.paper_id, count(f.start) AS n, s.paper_id % 3 AS m FROM (SELECT DISTINCT paper_id FROM src) s
 LEFT JOIN (SELECT e.* FROM env e WHERE name = 'figure*') f ON f.paper_id = s.paper_id GROUP BY s.paper_id) WHERE n <> m"""))
def _(c):
    captions = c.papers.where("paper_id % 3 > 0").select("paper_id", F.lit(1).alias("page"), F.explode(F.sequence(F.lit(1), (F.col("paper_id") % 3).cast("int"))).alias("ord"), F.lit("i.png").alias("image_ref"))
    return R.align_tikz(c.ordered, captions)[1].select("paper_id", "code", "message")


@query("e01_validate_edits", sql("""SELECT paper_id, path, start, stop, CASE WHEN o THEN 'overlap' END AS reason FROM (SELECT paper_id, path, start, start + length('\\begin{tabularx}{5cm}{l@{}S[x]r}') AS stop, false AS o FROM env WHERE name = 'tabularx'
 UNION ALL SELECT paper_id, path, close, stop, false FROM env WHERE name = 'tabularx' UNION ALL SELECT paper_id, path, start + length('\\begin{tabularx}{5cm}{'), start + length('\\begin{tabularx}{5cm}{l@{}S[x]r'), true FROM env WHERE name = 'tabularx')"""))
def _(c):
    both = R.plan_rename_environments(c.nodes.where("name = 'tabularx'")).unionByName(R.plan_column_specs(c.nodes))
    return R.validate_edits(both, c.sources).select("paper_id", "path", F.col("start").cast("long"), F.col("end").cast("long").alias("stop"), "reason")


@query("e02_apply_edits", sql("SELECT paper_id, path, md5(regexp_replace(regexp_replace(content, '\\\\citep\\[see\\]', '\\\\cite', 'g'), '\\\\textsc\\{', '\\\\text{', 'g')) AS digest FROM src"))
def _(c):
    plan = R.plan_citations(c.nodes).unionByName(R.plan_symbols(c.nodes, c.sources))
    return R.apply_edits(c.sources, plan).select("paper_id", "path", F.md5("content").alias("digest"))


@query("e03_filter_safety", sql("SELECT paper_id, count(*) AS n FROM arg WHERE name = 'textsc' GROUP BY paper_id"))
def _(c):
    plan = R.plan_symbols(c.nodes, c.sources).unionByName(R.plan_citations(c.nodes).withColumn("safety", F.lit("fallback")))
    return R.filter_safety(plan).groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"))


#: All edits of all rounds, in the places of the first text: none of them touch.
ALL_EDITS = f"""ed AS (SELECT paper_id, path, start, CASE name WHEN 'vspace' THEN stop ELSE start + 1 + length(name) END AS stop, '' AS replacement, ['remove'] AS passes FROM arg WHERE name IN ('vspace', 'centering', 'noindent')
 UNION ALL SELECT paper_id, path, start + length('\\usepackage{{'), stop - 1, 'amsmath,' || split_part(a, ',', 3), ['packages'] FROM arg WHERE name = 'usepackage' UNION ALL SELECT paper_id, path, start, stop, '', ['packages'] FROM arg WHERE name = 'RequirePackage'
 UNION ALL SELECT paper_id, path, start, stop, '\\cite{{' || a || '}}', ['citations'] FROM arg WHERE name = 'citep'
 UNION ALL SELECT paper_id, path, start, begin_end, '\\begin{{figure}}', ['rename'] FROM env WHERE name = 'figure*' UNION ALL SELECT paper_id, path, close, stop, '\\end{{figure}}', ['rename'] FROM env WHERE name = 'figure*'
 UNION ALL SELECT paper_id, path, start, start + length('\\begin{{tabularx}}{{5cm}}{{l@{{}}S[x]r}}'), '\\begin{{tabular}}{{lrr}}', ['rename', 'column-specs'] FROM env WHERE name = 'tabularx' UNION ALL SELECT paper_id, path, close, stop, '\\end{{tabular}}', ['rename'] FROM env WHERE name = 'tabularx'
 UNION ALL SELECT paper_id, path, start, start + 7, '\\text', ['symbols'] FROM arg WHERE name = 'textsc'
 UNION ALL SELECT *, ['theorems'] FROM ({THEOREM_EDITS}) UNION ALL SELECT paper_id, path, start, stop, replacement, ['algorithms'] FROM pseudo
 UNION ALL SELECT paper_id, path, start + 10, start + 10, '*', ['headings'] FROM arg WHERE name = 'paragraph' UNION ALL SELECT paper_id, path, start, start + 9, '', ['headings'] FROM cmd WHERE name = 'appendix'
 UNION ALL SELECT paper_id, path, start + 1 + length(name), start + 1 + length(name), '*', ['headings'] FROM app UNION ALL SELECT paper_id, path, start + 2 + length(name), start + 2 + length(name), number || ' ', ['headings'] FROM app
 UNION ALL SELECT a.paper_id, a.path, a.stop - 1, a.stop - 1, '.tex', ['inputs'] FROM arg a JOIN edge e ON e.paper_id = a.paper_id AND e.path = a.path AND e.start = a.start WHERE a.a NOT LIKE '%.tex'),
pieces AS (SELECT e.*, substr(s.content, CAST(coalesce(lag(e.stop) OVER w, 0) + 1 AS BIGINT), CAST(e.start - coalesce(lag(e.stop) OVER w, 0) AS BIGINT)) || e.replacement AS piece FROM ed e JOIN src s USING (paper_id, path) WINDOW w AS (PARTITION BY e.paper_id, e.path ORDER BY e.start, e.stop)),
joined AS (SELECT paper_id, path, string_agg(piece, '' ORDER BY start, stop) AS head, max(stop) AS last FROM pieces GROUP BY paper_id, path),
turns AS (SELECT paper_id, path, count(DISTINCT p) AS passes FROM (SELECT paper_id, path, unnest(passes) AS p FROM ed) GROUP BY paper_id, path)"""


@query("e04_rewrite_corpus", sql("""SELECT s.paper_id, s.path, md5(coalesce(j.head, '') || substr(s.content, CAST(coalesce(j.last, 0) + 1 AS BIGINT))) AS digest, coalesce(t.passes, 0) AS passes
 FROM src s LEFT JOIN joined j USING (paper_id, path) LEFT JOIN turns t USING (paper_id, path)""", O.THEOREMS.format(t="(SELECT e.*, f.file_ord FROM env e JOIN allfo f USING (paper_id, path))"), O.APPENDIX, LINE, STEPS, ALL_EDITS))
def _(c):
    after, log = R.rewrite_corpus(c.plain)
    counts = log.groupBy("paper_id", "path").agg(F.count(F.lit(1)).alias("passes"))
    digests = after.select("paper_id", "path", F.md5("content").alias("digest"))
    return digests.join(counts, ["paper_id", "path"], "left").select("paper_id", "path", "digest", F.coalesce("passes", F.lit(0)).alias("passes"))


@query("e05_all_or_nothing", sql("SELECT paper_id, path, md5(CASE WHEN paper_id % 4 = 0 THEN content ELSE regexp_replace(content, '\\\\citep\\[see\\]', '\\\\cite', 'g') END) AS digest FROM src"))
def _(c):
    after = R.apply_edits(c.sources, R.plan_citations(c.nodes))
    return R.all_or_nothing(c.sources, after, c.sources.where("paper_id % 4 = 0")).select("paper_id", "path", F.md5("content").alias("digest"))


@query("g01_document_body", sql("SELECT paper_id, path, begin_end AS start, close AS stop FROM env WHERE name = 'document' UNION ALL SELECT f.paper_id, f.path, 0, length(s.content) FROM fo f JOIN src s USING (paper_id, path) WHERE f.path <> 'main.tex'"))
def _(c):
    return G.document_body(c.sources, c.nodes, c.papers, c.files)[0].select("paper_id", "path", F.col("start").cast("long"), F.col("end").cast("long").alias("stop"))


SKIP = "sk AS (SELECT e.paper_id, e.path, e.start, e.stop FROM env e WHERE e.name IN ('figure*', 'table', 'equation', 'align', 'algorithm'))"


@query("g02_skip_ranges", sql("SELECT * FROM sk", SKIP))
def _(c):
    return G.skip_ranges(c.spans).select("paper_id", "path", F.col("start").cast("long"), F.col("end").cast("long").alias("stop"))


#: Paragraphs with their places and texts.
PARAGRAPHS = """pg0 AS (SELECT paper_id, path, unnest(parts) AS text, unnest(list_append(gaps, '')) AS gap, generate_subscripts(parts, 1) AS k FROM (
 SELECT paper_id, path, string_split_regex(content, '\\r?\\n[^\\S\\r\\n]*\\r?\\n(?:[^\\S\\r\\n]*\\r?\\n)*') AS parts, regexp_extract_all(content, '\\r?\\n[^\\S\\r\\n]*\\r?\\n(?:[^\\S\\r\\n]*\\r?\\n)*') AS gaps FROM src)),
pg1 AS (SELECT *, CAST(sum(length(text) + length(gap)) OVER (PARTITION BY paper_id, path ORDER BY k) - length(text) - length(gap) AS BIGINT) AS start FROM pg0),
pg AS (SELECT paper_id, path, text, start, start + length(text) AS stop, CAST(row_number() OVER (PARTITION BY paper_id, path ORDER BY start) - 1 AS INTEGER) AS chunk_id FROM pg1 WHERE length(text) > 0)"""


def paragraphs(c: Corpus) -> DataFrame:
    number = F.row_number().over(Window.partitionBy(*V.FILE).orderBy("start")) - 1
    return G.paragraph_ranges(c.sources, with_text=True).select(*V.FILE, "start", "end", number.alias("chunk_id"), "text")


@query("g03_paragraph_ranges", sql("SELECT paper_id, path, start, stop FROM pg", PARAGRAPHS))
def _(c):
    return G.paragraph_ranges(c.sources).select("paper_id", "path", F.col("start").cast("long"), F.col("end").cast("long").alias("stop"))


#: Thousands of blank lines with either line end, and lines of blanks.
BLANKS = ((r"\\chapter\{Start\}", r"\\chapter{Start}" + " \r\n" + "\r\n" * 3000 + " \t\n" * 3000 + "\n" * 3000 + "Text\r\n\r\n"),)


@query("g03_blank_lines", sql("SELECT paper_id, path, start, stop, md5(text) AS digest FROM pg", PARAGRAPHS, variant=BLANKS))
def _(c):
    return G.paragraph_ranges(c.variant(*BLANKS).sources, with_text=True).select("paper_id", "path", F.col("start").cast("long"), F.col("end").cast("long").alias("stop"), F.md5("text").alias("digest"))


POINTS = """pt AS (SELECT DISTINCT paper_id, path, spot FROM (SELECT paper_id, path, unnest([start, stop]) AS spot FROM pg UNION ALL SELECT paper_id, path, unnest([start, start + 1 + length(name) + 2 + length(a)]) FROM arg WHERE name IN ('begin', 'end')
 UNION ALL SELECT paper_id, path, start FROM cmd WHERE name = 'item' UNION ALL SELECT paper_id, path, unnest([0, length(content)]) FROM src))"""


@query("g04_chunks", sql("SELECT paper_id, path, spot AS start, lead(spot) OVER (PARTITION BY paper_id, path ORDER BY spot) AS stop FROM pt QUALIFY stop IS NOT NULL", PARAGRAPHS, POINTS))
def _(c):
    c = c.only("env_token", "math", "item")
    return G.chunks(c.sources, c.spans).select("paper_id", "path", F.col("start").cast("long"), F.col("end").cast("long").alias("stop"))


def gone(text: str, *patterns: str) -> str:
    for p in patterns:
        text = f"regexp_replace({text}, '{p}', '', 'g')"
    return text


TOKENS = r"\\(begin|end)\{[^{}]*\}"
#: What letters don't count in: comments, math, tokens, structural commands with their arguments, other commands' names.
VISIBLE = (
    r"%[^\n]*", r"\$[^$]*\$", TOKENS, r"\\title\{[^\n]*\}", r"\\author\{[^\n]*\}", r"\\graphicspath\{[^\n]*\}", r"\\newcommand\{[^{}]*\}(\[[0-9]\])?\{[^{}]*\}",
    r"\\(section|subsection|paragraph|chapter|label|caption|includegraphics|input|include|documentclass|usepackage|RequirePackage|citep)(\[[^\]]*\])?\{[^{}]*\}", r"\\[A-Za-z@]+",
)
SHOWN = (r"%[^\n]*", TOKENS, r"\\(section|subsection|paragraph|chapter|label|input|include)\{[^{}]*\}", r"\\item", r"^\s+|\s+$")
PROSE = f"""ck AS (SELECT p.paper_id, p.path, p.start, p.stop, p.chunk_id, substr(s.content, CAST(p.start + 1 AS BIGINT), CAST(p.stop - p.start AS BIGINT)) AS whole FROM (
 SELECT paper_id, path, spot AS start, lead(spot) OVER w AS stop, CAST(row_number() OVER w - 1 AS INTEGER) AS chunk_id FROM pt WINDOW w AS (PARTITION BY paper_id, path ORDER BY spot)) p JOIN src s USING (paper_id, path) WHERE stop IS NOT NULL),
prose AS (SELECT *, {gone("whole", *SHOWN)} AS text FROM ck WHERE length({gone("whole", *VISIBLE, "[^" + chr(92) + "p{L}]")}) >= 20
 AND NOT EXISTS (SELECT 1 FROM sk WHERE sk.paper_id = ck.paper_id AND sk.path = ck.path AND sk.start <= ck.start AND ck.stop <= sk.stop))"""


@query("g05_prose_chunks", sql("SELECT paper_id, path, start, chunk_id, md5(text) AS digest FROM prose WHERE text <> ''", PARAGRAPHS, POINTS, SKIP, PROSE))
def _(c):
    return G.prose_chunks(c.sources, c.spans).select("paper_id", "path", F.col("start").cast("long"), "chunk_id", F.md5("text").alias("digest"))


@query("g06_chunk_digest", sql("SELECT paper_id, path, chunk_id, sha256(regexp_replace(text, '(\\r\\n|\\r|\\n)$', '')) AS digest FROM pg", PARAGRAPHS))
def _(c):
    return paragraphs(c).select("paper_id", "path", "chunk_id", G.chunk_digest(F.col("text")).alias("digest"))


@query("g07_existing_blocks", sql("SELECT paper_id, path, sha256(path) AS digest, length(content) + 1 AS start, length(content) + 1 + 2 * 64 + length('% TEXLAKE_TRANSLATION_BEGIN ') + length('% TEXLAKE_TRANSLATION_END ') + 3 AS stop FROM src"))
def _(c):
    digest = F.sha2("path", 256)
    with_block = c.sources.withColumn("content", F.concat("content", F.lit("\n" + G.BEGIN), digest, F.lit("\nt\n" + G.END), digest, F.lit("\n")))
    return G.existing_blocks(with_block).select("paper_id", "path", "digest", F.col("start").cast("long"), F.col("end").cast("long").alias("stop"))


@query("g08_pending_chunks", sql("SELECT paper_id, path, chunk_id FROM pg p WHERE NOT EXISTS (SELECT 1 FROM pg q WHERE q.paper_id = p.paper_id AND q.chunk_id % 2 = 0 AND q.text = p.text)", PARAGRAPHS))
def _(c):
    rows = cut(paragraphs(c).withColumn("digest", G.chunk_digest(F.col("text"))), "paragraphs")
    return G.pending_chunks(rows, rows.where("chunk_id % 2 = 0")).select("paper_id", "path", "chunk_id")


BATCHES = """bt AS (SELECT paper_id, path, chunk_id, length(text) AS n, 0 AS batch, length(text) AS held FROM pg WHERE chunk_id = 0
 UNION ALL SELECT p.paper_id, p.path, p.chunk_id, length(p.text), CASE WHEN b.held + length(p.text) <= 2000 THEN b.batch ELSE b.batch + 1 END, CASE WHEN b.held + length(p.text) <= 2000 THEN b.held + length(p.text) ELSE length(p.text) END
 FROM bt b JOIN pg p ON p.paper_id = b.paper_id AND p.path = b.path AND p.chunk_id = b.chunk_id + 1)"""


@query("g09_pack_batches", sql("SELECT paper_id, path, chunk_id, batch FROM bt", PARAGRAPHS, BATCHES))
def _(c):
    return G.pack_batches(paragraphs(c), 2000).select("paper_id", "path", "chunk_id", "batch")


PROTECTED = """pr AS (SELECT *, regexp_extract(text, '\\$[^$]+\\$') AS m FROM pg),
pt1 AS (SELECT *, CASE WHEN m = '' THEN text ELSE replace(text, m, chr(10214) || 'TL_MATH_0_' || left(sha256(m), 12) || chr(10215)) END AS prompt_text FROM pr)"""


@query("g10_protect_math", sql("SELECT paper_id, path, chunk_id, prompt_text, CASE WHEN m = '' THEN 0 ELSE 1 END AS n FROM pt1", PARAGRAPHS, PROTECTED))
def _(c):
    return G.protect_math(paragraphs(c)).select("paper_id", "path", "chunk_id", "prompt_text", F.size("replacements").alias("n"))


@query("g11_build_prompts", sql("SELECT paper_id, path, batch, md5(string_agg('[' || chunk_id || ']' || chr(10) || prompt_text, chr(10) || chr(10) ORDER BY chunk_id)) AS digest FROM bt JOIN pt1 USING (paper_id, path, chunk_id) GROUP BY paper_id, path, batch", PARAGRAPHS, BATCHES, PROTECTED))
def _(c):
    prompts = G.build_prompts(G.pack_batches(G.protect_math(paragraphs(c)), 2000))
    return prompts.select("paper_id", "path", "batch", F.md5("prompt").alias("digest"))


def answers(c: Corpus) -> tuple[DataFrame, DataFrame]:
    """Protected chunks, and the answers of a stand-in translator: itself, but each third chunk missing and each fifth broken."""
    rows = cut(G.pack_batches(G.protect_math(paragraphs(c)), 2000), "protected")
    said = rows.where("chunk_id % 3 <> 0").withColumn("prompt_text", F.concat("prompt_text", F.when(F.col("chunk_id") % 5 == 0, "}").otherwise("")))
    return rows, G.parse_responses(G.translate_batches(G.build_prompts(said), lambda prompt: prompt, wait=0.0))


@query("x01_translate_batches", sql("SELECT paper_id, path, batch, md5(string_agg('[' || chunk_id || ']' || chr(10) || prompt_text, chr(10) || chr(10) ORDER BY chunk_id) || ' done') AS digest FROM bt JOIN pt1 USING (paper_id, path, chunk_id) GROUP BY paper_id, path, batch", PARAGRAPHS, BATCHES, PROTECTED))
def _(c):
    prompts = G.build_prompts(G.pack_batches(G.protect_math(paragraphs(c)), 2000))
    said = G.translate_batches(prompts, lambda prompt: prompt + " done", wait=0.0)
    return said.where("error IS NULL").select("paper_id", "path", "batch", F.md5("raw").alias("digest"))


@query("x01_answer_log", sql("SELECT paper_id, path, batch, md5(string_agg('[' || chunk_id || ']' || chr(10) || prompt_text, chr(10) || chr(10) ORDER BY chunk_id) || CASE WHEN batch % 2 = 0 THEN ' first' ELSE ' later' END) AS digest FROM bt JOIN pt1 USING (paper_id, path, chunk_id) GROUP BY paper_id, path, batch", PARAGRAPHS, BATCHES, PROTECTED))
def _(c):
    # what an earlier job has logged is not asked again; prompts carry their paper, so that none is equal to another
    log = new_path(c.spark, "answers")
    prompts = G.build_prompts(G.pack_batches(G.protect_math(paragraphs(c)), 2000))
    keyed = cut(prompts.withColumn("prompt", F.concat_ws("|", "paper_id", "path", "batch", "prompt")), "prompts")
    answer = lambda end: lambda prompt: prompt.split("|", 3)[3] + end
    G.translate_batches(keyed.where("batch % 2 = 0"), answer(" first"), wait=0.0, log=log).write.format("noop").mode("overwrite").save()
    said = G.translate_batches(keyed, answer(" later"), wait=0.0, log=log)
    return said.where("error IS NULL").select("paper_id", "path", "batch", F.md5("raw").alias("digest"))


HIDDEN = ((r"with \$y", r"5\\\$ \\\\\$y"),)


@query("g10_protect_escaped", sql("""SELECT paper_id, path, chunk_id, CASE WHEN m = '' THEN text ELSE replace(text, m, chr(10214) || 'TL_MATH_0_' || left(sha256(m), 12) || chr(10215)) END AS prompt_text, m AS math
 FROM (SELECT *, regexp_extract(text, '\\$y=[0-9]+\\$') AS m FROM pg) WHERE path <> 'main.tex'""", PARAGRAPHS, variant=HIDDEN))
def _(c):
    rows = G.protect_math(paragraphs(c.variant(*HIDDEN))).where("path <> 'main.tex'")
    return rows.select("paper_id", "path", "chunk_id", "prompt_text", F.coalesce(F.get("replacements", F.lit(0))["math"], F.lit("")).alias("math"))


#: A dollar with a hundred thousand characters behind it, and a paragraph of displayed, inline and hidden math.
STRAY = ((r"\\chapter\{Start\}", "\n\n" + r"\$5 " + "lost " * 20_000 + "\n\n" + r"\\verb|\$| \$\$a\$\$ % \$c" + "\n" + r" \$z\$" + "\n\n"),)


@query("g10_protect_long", sql("""SELECT paper_id, path, chunk_id, md5(CASE WHEN contains(text, '\\verb') THEN replace(replace(text, '$$a$$', chr(10214) || 'TL_MATH_0_' || left(sha256('$$a$$'), 12) || chr(10215)), '$z$', chr(10214) || 'TL_MATH_1_' || left(sha256('$z$'), 12) || chr(10215)) ELSE prompt_text END) AS digest FROM pt1""", PARAGRAPHS, PROTECTED, variant=STRAY))
def _(c):
    return G.protect_math(paragraphs(c.variant(*STRAY))).select("paper_id", "path", "chunk_id", F.md5("prompt_text").alias("digest"))


@query("g12_parse_responses", sql("SELECT paper_id, path, chunk_id, md5(regexp_replace(prompt_text || CASE WHEN chunk_id % 5 = 0 THEN '}' ELSE '' END, '^\\s+|\\s+$', '', 'g')) AS digest FROM pt1 WHERE chunk_id % 3 <> 0", PARAGRAPHS, PROTECTED))
def _(c):
    return answers(c)[1].select("paper_id", "path", "chunk_id", F.md5("translation").alias("digest"))


@query("g13_validate_translations", sql("SELECT paper_id, path, chunk_id, CASE WHEN chunk_id % 3 = 0 THEN 'missing' WHEN chunk_id % 5 = 0 THEN 'unbalanced-braces' END AS reason FROM pt1", PARAGRAPHS, PROTECTED))
def _(c):
    return G.validate_translations(*answers(c)).select("paper_id", "path", "chunk_id", "reason")


@query("g14_restore_math", sql("SELECT paper_id, path, chunk_id, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS digest FROM pg WHERE chunk_id % 3 <> 0 AND chunk_id % 5 <> 0", PARAGRAPHS))
def _(c):
    return G.restore_math(G.validate_translations(*answers(c))).select("paper_id", "path", "chunk_id", F.md5("translation").alias("digest"))


@query("g15_retry_set", sql("SELECT paper_id, path, chunk_id FROM pg WHERE chunk_id % 3 = 0 OR chunk_id % 5 = 0", PARAGRAPHS))
def _(c):
    rows, said = answers(c)
    return G.retry_set(rows, G.validate_translations(rows, said).where("reason IS NULL")).select("paper_id", "path", "chunk_id")


HEADS = "hd AS (SELECT c.paper_id, c.path, c.file_ord, c.start, c.name, trim(c.a) AS title FROM acmd c WHERE c.name IN ('chapter', 'section', 'subsection', 'paragraph') AND trim(c.a) <> '')"


@query("g16_headings", sql("SELECT paper_id, path, start, name, title FROM hd", HEADS))
def _(c):
    return G.headings(c.included, G.skip_ranges(c.spans)).select("paper_id", "path", F.col("start").cast("long"), "name", "title")


@query("g17_unique_headings", sql("SELECT paper_id, title, row_number() OVER (PARTITION BY paper_id ORDER BY f) - 1 AS heading_id FROM (SELECT paper_id, title, min((file_ord, start)) AS f FROM hd GROUP BY paper_id, title)", HEADS))
def _(c):
    return G.unique_headings(G.headings(c.included, G.skip_ranges(c.spans))).select("paper_id", "title", F.col("heading_id").cast("long"))


@query("g18_interleave", sql("SELECT paper_id, path, length(content) + CAST((SELECT sum(2 * length(p.text) + 2 * 64 + length('% TEXLAKE_TRANSLATION_BEGIN ') + length('% TEXLAKE_TRANSLATION_END ') + 5 - length(p.text)) FROM pg p WHERE p.paper_id = s.paper_id AND p.path = s.path) AS BIGINT) AS n FROM src s", PARAGRAPHS))
def _(c):
    c = c.only(*G.HEADINGS, *G.SKIPPED, "label", "math")
    rows = paragraphs(c).withColumn("digest", G.chunk_digest(F.col("text"))).withColumn("translation", F.col("text"))
    none = c.papers.select("paper_id", F.lit("").alias("title"), F.lit("").alias("translation")).where("false")
    plan = G.interleave(c.sources, rows, G.headings(c.included, G.skip_ranges(c.spans)), none, c.commands("label"))
    return R.apply_edits(c.sources, plan).select("paper_id", "path", F.length("content").cast("long").alias("n"))


@query("g19_bilingual_rows", sql("SELECT p.paper_id, f.file_ord, p.chunk_id, md5(p.text) AS source, CASE WHEN p.chunk_id % 3 <> 0 AND p.chunk_id % 5 <> 0 THEN md5(regexp_replace(p.text, '^\\s+|\\s+$', '', 'g')) END AS target FROM pg p JOIN fo f USING (paper_id, path)", PARAGRAPHS))
def _(c):
    c = c.only()
    rows, said = answers(c)
    done = G.restore_math(G.validate_translations(rows, said))
    out = G.bilingual_rows(rows, done, c.files)
    return out.select("paper_id", F.col("file_ord").cast("long"), "chunk_id", F.md5("source").alias("source"), F.md5("target").alias("target"))


@query("n05_literal_alpha", sql(f"SELECT paper_id, path, length({gone('content', *VISIBLE, '[^' + chr(92) + 'p{L}]')}) AS letters, length({gone('content', *VISIBLE, '[^' + chr(92) + 'p{L}]')}) >= 20 AS prose FROM src"))
def _(c):
    rows = c.sources.select("paper_id", "path", F.lit(0).alias("start"), F.length("content").alias("end"))
    spans = scan_spans(c.sources, keep=("command", "comment", "math", "env_token"))  # read once, so not written
    return G.is_prose(rows, c.sources, spans).select("paper_id", "path", F.col("letters").cast("long"), "prose")


@query("x02_expand_macros", sql("SELECT paper_id, 'Paper real ' || paper_id || ' \\thanks{x}' AS title FROM src WHERE path = 'main.tex'"))
def _(c):
    titles = c.commands("title").select("paper_id", F.try_element_at("arguments", F.lit(-1))["text"].alias("title"))
    return G.expand_macros(titles, "title", c.macros)


@query("t01_pending_queue", sql("SELECT paper_id, path, chunk_id, sha256(text) AS digest FROM prose WHERE text <> ''", PARAGRAPHS, POINTS, SKIP, PROSE))
def _(c):
    memory = c.sources.select("paper_id", F.lit("").alias("digest"))
    return queue_of(c.sources, memory).select("paper_id", "path", "chunk_id", "digest")


@query("t01_stream", sql("SELECT DISTINCT CAST(paper_id AS VARCHAR) AS paper_id, sha256(text) AS digest FROM prose WHERE text <> '' AND paper_id % 5 > 0", PARAGRAPHS, POINTS, SKIP, PROSE))
def _(c):
    base = new_path(c.spark, "stream")
    files = cut(c.sources.withColumn("paper_id", F.col("paper_id").cast("string")), "files")
    queue_of(files.where("paper_id % 5 = 0"), files.select("paper_id", F.lit("").alias("digest"))).select("paper_id", "digest").write.parquet(f"{base}/memory")
    # two drops, and the first one once more
    for drop in ("paper_id % 2 = 0", "paper_id % 2 = 1", "paper_id % 2 = 0"):
        files.where(drop).write.mode("append").parquet(f"{base}/in")
        stream_pending(c.spark, f"{base}/in", f"{base}/memory", f"{base}/queue", f"{base}/checkpoint").awaitTermination()
    return c.spark.read.parquet(f"{base}/queue").select("paper_id", "digest")
