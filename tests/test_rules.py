"""Single clean-up rules on small sources: the text after the rule's edits."""

import pytest
from pyspark.sql import functions as F

from texlake.functions.scan import nodes_of, scan_spans
from texlake.operators import discover as D
from texlake.operators import intervals as V
from texlake.operators import rewrite as R
from texlake.operators import translate as G


def table(spark, text, path="m.tex"):
    return spark.createDataFrame([("p", path, text)], "paper_id string, path string, content string")


def after(spark, text, plan):
    src = table(spark, text)
    nodes = V.mark_opaque(nodes_of(scan_spans(src)))
    edits = plan(nodes, src)
    assert edits.columns == ["paper_id", "path", "start", "end", "replacement", "pass_name", "safety"]
    return R.apply_edits(src, R.settle(edits)).first()["content"]


def ordered(spark, nodes):
    return D.in_order(nodes, spark.createDataFrame([("p", "m.tex", 1)], "paper_id string, path string, file_ord int"))


@pytest.mark.parametrize(
    "rule, text, out",
    [
        ("remove", "a\n\\hypersetup{x}\nb \\noindent c\\vspace*{1em} \\lstset{y} d", "a\nb  c  d"),
        ("remove", "\\vspace{1em", "\\vspace{1em"),
        ("unwrap", "\\hyperref[l]{see \\emph{x}} \\texorpdfstring{a}{b} \\makecell{a\\\\b}", "see \\emph{x} a a b"),
        ("environments", "\\begin{minipage}[t]{1cm}in\\end{minipage}", "in"),
        ("rename", "\\begin{wrapfigure}{r}{1cm}x\\end{wrapfigure}\\begin{table*}y\\end{table*}", "\\begin{figure}[H]x\\end{figure}\\begin{table}y\\end{table}"),
        ("rename", "\\begin{minted}{py}x\\end{minted}", "\\begin{verbatim}x\\end{verbatim}"),
        ("symbols", "\\ding{51} $\\textcircled{2}$ \\ding{9999} \\textsc{Ab}", "✓ ② \\ding{9999} \\text{Ab}"),
        ("listings", "\\begin{lstlisting}[language=C]x\\end{lstlisting} \\mintinline{py}{a+b}", "\\begin{lstlisting}x\\end{lstlisting} \\texttt{a+b}"),
        ("annotations", "\\newcommand{\\atran}[1]{x#1y}\\newcommand{\\annotatez}{q}\\newcounter{annotatec}\\newcounter{other}", "\\newcommand{\\atran}[1]{#1}\\newcounter{other}"),
        ("captionof", "\\begin{minipage}{1cm}\\captionof{table}{T}\\end{minipage}", "\\begin{table}\\caption{T}\\end{table}"),
        ("captionof", "\\begin{figure}\\begin{minipage}{1cm}\\captionof{figure}{T}\\end{minipage}\\end{figure}", "\\begin{figure}\\caption{T}\\end{figure}"),
    ],
)
def test_rule(spark, rule, text, out):
    plans = {
        "remove": R.plan_remove,
        "unwrap": lambda n, s: R.plan_unwrap_commands(n),
        "environments": lambda n, s: R.plan_unwrap_environments(n),
        "rename": lambda n, s: R.plan_rename_environments(n),
        "symbols": R.plan_symbols,
        "listings": lambda n, s: R.plan_listings(n),
        "annotations": lambda n, s: R.plan_annotations(n),
        "captionof": lambda n, s: R.plan_captionof(n),
    }
    assert after(spark, text, plans[rule]) == out


def test_tikz_needs_equal_counts(spark):
    text = "\\begin{figure}\\begin{tikzpicture}x\\label{in}\\end{tikzpicture}\\caption{c}\\label{out}\\end{figure}"
    nodes = ordered(spark, V.mark_opaque(nodes_of(scan_spans(table(spark, text)))))
    rows = lambda n: spark.createDataFrame([("p", 1, k, f"i{k}.png") for k in range(n)], "paper_id string, page int, ord int, image_ref string")
    edits, off = R.align_tikz(nodes, rows(1))
    assert [r["replacement"] for r in edits.collect()] == ["\n\\centering\n\\includegraphics[width=\\linewidth]{i0.png}\n\\label{in}\n"] and off.count() == 0
    edits, off = R.align_tikz(nodes, rows(2))
    assert edits.count() == 0 and [r["code"] for r in off.collect()] == ["figure-count-mismatch"]


def test_untrusted_nodes_are_reported(spark):
    nodes = V.mark_opaque(nodes_of(scan_spans(table(spark, "\\begin{minipage}{1cm} \\section{a}"))))
    got = {(r["code"], r["message"].split()[-1]) for r in R.untrusted(nodes, ("minipage", "section"), "t").collect()}
    assert got == {("incomplete-environment", "minipage"), ("opaque-structure", "section")}


def test_resources(spark):
    refs = spark.createDataFrame([("p", "sub/a.tex", r) for r in ("x.pdf", "fig/x.pdf", "y.pdf", "none.pdf")], "paper_id string, path string, ref string")
    known = spark.createDataFrame([("p", r) for r in ("sub/x.pdf", "o/fig/x.pdf", "a/y.pdf", "b/y.pdf")], "paper_id string, path string")
    got = {r["ref"]: r["resource"] for r in D.resolve_resources(refs, known).collect()}
    assert got == {"x.pdf": "sub/x.pdf", "fig/x.pdf": "o/fig/x.pdf", "y.pdf": None, "none.pdf": None}


def test_adjacent_label_skips_comments(spark):
    text = "\\section{a} % c\n \\label{x} \\section{b} text \\label{y}"
    spans = scan_spans(table(spark, text))
    name = lambda n: spans.where((F.col("kind") == "command") & (F.col("name") == n))
    got = [r["attach"] for r in V.adjacent_label(name("section"), name("label"), table(spark, text)).orderBy("start").collect()]
    assert got == [text.index("\\label{x}") + len("\\label{x}"), text.index(" text")]


def test_interleave_adds_once(spark):
    src = table(spark, "\\section{One}\\label{s}\n\nA paragraph.\n")
    spans = scan_spans(src)
    heads = G.headings(ordered(spark, nodes_of(spans)), G.skip_ranges(spans))
    rows = spark.createDataFrame([("p", "m.tex", 36, "Ein Absatz.")], "paper_id string, path string, end int, translation string").withColumn("digest", G.chunk_digest(F.lit("A paragraph.")))
    titles = spark.createDataFrame([("p", "One", "Eins")], "paper_id string, title string, translation string")
    labels = spans.where("name = 'label'")
    once = R.apply_edits(src, G.interleave(src, rows, heads, titles, labels))
    text = once.first()["content"]
    assert text.index("One}\\label{s}") < text.index("Eins") < text.index("A paragraph.") < text.index("Ein Absatz.")
    assert G.existing_blocks(once).count() == 2
    assert G.interleave(once, rows, heads, titles, labels).count() == 0


def test_missing_document(spark):
    src = spark.createDataFrame([("a", "m.tex", "no document"), ("b", "m.tex", "\\begin{document}\\begin{quote}x\\end{document}")], "paper_id string, path string, content string")
    nodes = V.mark_opaque(nodes_of(scan_spans(src)))
    papers = D.find_main(src, nodes)
    bodies, lost = G.document_body(src, nodes, papers, src.select("paper_id", "path").withColumn("file_ord", F.lit(1)))
    assert {r["paper_id"]: r["code"] for r in lost.collect()}["a"] == "missing-document"
    assert [(r["paper_id"], r["start"]) for r in bodies.collect()] == [("b", 16)]


@pytest.mark.parametrize(
    "text, out",
    [
        (r"a\\R b \R", r"a\\R b real"),
        ("% \\R here\n\\R", "% \\R here\nreal"),
        (r"\two{x}", r"\two{x}"),
        (r"\one x \one{y{z}} \one", r"<x> <y{z}> \one"),
        (r"\opt{b} \opt[c]{d}", "a-b c-d"),
        (r"\op", r"\operatorname{arg}"),
    ],
)
def test_macros(text, out):
    macros = {"\\R": ("real", 0, None, False), "\\two": ("#1#3", 1, None, False), "\\one": ("<#1>", 1, None, False), "\\opt": ("#1-#2", 2, "a", False), "\\op": ("arg", 0, None, True)}
    assert G.expand(text, macros) == out


def test_theorems_once(spark):
    text = "\\begin{theorem}[Of {a}]x\\end{theorem}\\begin{proof}y\\end{proof}"
    mark = "\\begin{quote}\n% TEXLAKE_THEOREM\n"
    names = spark.createDataFrame([("p", "theorem", "Theorem")], "paper_id string, environment string, label string")
    plan = lambda n, s: R.plan_theorems(n, ordered(spark, n), names, s)
    once = after(spark, text, plan)
    assert once == f"{mark}\\textbf{{Theorem 1}} \\textit{{(Of {{a}})}}\\textbf{{.}} x\n\\end{{quote}}{mark}\\textit{{Proof.}} y \\hfill$\\square$\n\\end{{quote}}"
    nested = once.replace("x\n", "x\\begin{theorem}z\\end{theorem}\n")
    assert after(spark, nested, plan) == nested


def test_calls():
    assert R.calls_replaced(r"a \Call{f}{\Call{g}{x}, {1}} \Call{h} \Calls{i}{j}") == r"a \operatorname{f}(\operatorname{g}(x), {1}) \Call{h} \Calls{i}{j}"


def test_configuration_line_of_many_blanks(spark):
    assert after(spark, "a\n  \\hypersetup{x}" + " " * 500 + "\nb", R.plan_remove) == "a\nb"


def test_responses_of_long_numbers(spark):
    raw = spark.createDataFrame([("p", "m.tex", 0, "[0000000000012]\nzwölf\n[99999999999999]\nx\n[3]\ndrei")], "paper_id string, path string, batch int, raw string")
    assert {(r["chunk_id"], r["translation"]) for r in G.parse_responses(raw).collect()} == {(12, "zwölf"), (3, "drei")}


def test_verbatim_and_inline_code(spark):
    text = "\\verb|$%{| $a$ \\begin{verbatim}50% \\end{verbatim} $b$ \\begin{lstlisting}[a=1]\n$ } \\end{lstlisting}\\section{x}"
    got = [(r["kind"], r["name"]) for r in scan_spans(table(spark, text)).orderBy("start", "node_id").collect() if r["kind"] != "env_token"]
    assert got == [("command", "verb"), ("math", None), ("environment", "verbatim"), ("math", None), ("environment", "lstlisting"), ("command", "section")]


def test_titles():
    from texlake.functions.macros import title_text

    macros = {"\\R": ("real", 0, None, False), "\\N": ("\\thanks{n}", 0, None, False)}
    raw = r"\Large A \emph{b \textbf{c}}\thanks{x {y} \footnote{z}} \\[2pt] \R\N\vspace*{1em} d\blfootnote{q}\smallskip \footnotetext{e} \\R"
    assert title_text(raw, macros) == "A b c real d R"
