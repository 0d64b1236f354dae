"""Turns of a clean-up over files that carry their nodes: the same edits as the plans make, without moving or writing a file again."""

import random
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texlake.functions import scan as S
from texlake.operators import rewrite as R
from texlake.operators import turns as T
from texlake.operators.intervals import FILE

SOURCES = "paper_id string, path string, content string"
PARTS = [
    "  \\hypersetup{a}\n", "\\lstset{x}", "\\vspace*{1em}", "\\vspace{1", "\\todo{\n\\lstset{q}\n}", "\\begin{tikzpicture}[x]a\\end{tikzpicture}", "\\usepackage{amsmath, graphicx,foo}", "\\RequirePackage{xcolor}",
    "\\newcommand{\\atran}[1]{x#1y}", "\\newcommand{\\annotatez}{q}", "\\newcounter{annotatec}", "\\newtheorem{note}{Nota}[", "\\citep[see][p]{a,b}", "\\citet*%c\n{c}", "\\citep", "\\begin{tabularx}{5cm}{l@{}S[x]r}a\\end{tabularx}", "\\begin{tabular}{l@{{}S}b\\end{tabular}",
    "\\begin{minipage}{1cm}\\captionof{table}{T}\\end{minipage}", "\\begin{minipage}[t]{1cm}in\\end{minipage}", "\\begin{figure*}x\\begin{subfigure}{a}y\\end{subfigure}\\end{figure*}", "\\begin{wrapfigure}{r}{1cm}x\\end{wrapfigure}", "\\begin{minted}{py}x$}\\end{minted}", "\\begin{minted}\\foo\\end{minted}",
    "\\hyperlink{a}{\\texorpdfstring{\\hyperref[b]{Q}}{z}}", "\\makecell{a\\\\b}", "\\begin{lemma}[bad\\end{lemma}", "\\textsc\\verb|{|", "\\textsc $x$", "{", "}", "[", "]", "%c {\n", "\\%", "\\", "$", "😀é", " ", "\n\n", "\\section[a{b}]{c}", "\\begin{verbatim} \\citep{x} \\end{verbatim}", "\\begin{verbatim}", "\\begin { minipage }{1cm}u\\end{minipage}",
]


def odd(seed: int) -> str:
    r = random.Random(seed)
    return "".join(r.choice(PARTS) for _ in range(r.randrange(0, 30)))


@pytest.mark.parametrize("names", [{*R.REMOVING, *R.CITES, *R.FLOATING, *R.RENAMED, *R.UNWRAPPING}, {"textsc", "label", "minted", "section", "foo"}])
def test_scan_for_some_names(names):
    found = 0
    for seed in range(2000):
        text = odd(seed)
        whole = [r[:1] + r[2:] for r in S.scan_rows(text) if r[0] in ("command", "environment") and r[2] in names]
        some = S.scan_rows(text, only=frozenset(names))
        assert whole == [r[:1] + r[2:] for r in some] and [r[1] for r in some] == list(range(len(some)))
        assert not some or T.mentions(names).search(text)
        found += len(some)
    assert found > 1000


def test_scan_for_some_names_and_all_that_is_untrusted():
    names = frozenset(R.NUMBERING)
    for seed in range(2000):
        text = odd(seed)
        whole = [r[:1] + r[2:] for r in S.scan_rows(text) if r[0] in ("command", "environment") and (r[16] or r[2] in names)]
        assert whole == [r[:1] + r[2:] for r in S.scan_rows(text, only=names, untrusted=True)]


def test_settled_is_settle(spark):
    r = random.Random(1)
    rows = [("p", f"f{k}", a := r.randrange(12), a + r.randrange(5), r.choice("xy"), r.choice("pq"), "safe") for k in range(60) for _ in range(r.randrange(1, 9))]
    edits = spark.createDataFrame(rows, "paper_id string, path string, start int, end int, replacement string, pass_name string, safety string")
    want = sorted(tuple(e)[1:] for e in R.settle(edits).collect())
    of = {}
    for row in rows:
        of.setdefault(row[1], []).append((*row[2:], None))
    assert sorted((f, *e[:5]) for f, es in of.items() for e in T.settled(es)) == want


@pytest.mark.parametrize("turn", ["remove", "citations", "specs", "rename", "unwrap"])
def test_a_turn_does_what_its_plans_do(spark, turn):
    src = spark.createDataFrame([("p", f"f{k}", odd(k)) for k in range(300)] + [("p", "null", None), ("p", "empty", "")], SOURCES)
    union = lambda *frames: reduce(DataFrame.unionByName, frames)
    names, edits, plan = {
        "remove": (R.REMOVING, R.edits_remove(), lambda n: union(R.plan_filter_packages(n), R.plan_remove(n, src), R.plan_annotations(n))),
        "citations": (R.CITES, R.edits_citations(), R.plan_citations),
        "specs": (R.TABLES, R.edits_column_specs(), R.plan_column_specs),
        "rename": (R.RENAMED, R.edits_rename(), R.plan_rename_environments),
        "unwrap": (R.UNWRAPPING, R.edits_unwrap(), lambda n: union(R.plan_unwrap_commands(n), R.plan_unwrap_environments(n))),
    }[turn]
    files = T.turned(T.turned(src, names), {"section"}, edits, {"line": R._line, "spec": R._simpler})
    settled = R.settle(plan(S.nodes_of(S.scan_spans(src))))
    want = {r["path"]: r["content"] for r in R.apply_edits(src, settled).collect()}
    got = files.collect()
    assert {r["path"]: r["content"] for r in got} == want
    assert {(r["path"], p) for r in got for p in r["passes"] or ()} == {(r["path"], r["pass_name"]) for r in settled.collect()}
    before = {r["path"]: r["content"] for r in src.collect()}
    assert {r["path"] for r in got if r["changed"]} == {k for k, v in want.items() if v != before[k]} != set()


def test_rounds_of_a_files_own_edits_move_no_file(spark, monkeypatch):
    """Nothing is shuffled or joined before the fourth round, and a turn writes the files that the last one changed alone."""
    written, cut = [], R.cut

    def recorded(df, name="cut"):
        written.append((name, df._jdf.queryExecution().executedPlan().toString(), cut(df, name)))
        return written[-1][2]

    monkeypatch.setattr(R, "cut", recorded)
    deep = "\\hyperlink{a}{" * 3 + "x" + "}" * 3
    src = spark.createDataFrame([("p", "a.tex", f"\\noindent {deep}"), ("p", "b.tex", "\\begin{tabularx}{1cm}{S}x\\end{tabularx} \\citep{k}")], SOURCES)
    after, log = R.rewrite_corpus(src, rounds=3)
    assert {r["path"]: r["content"] for r in after.collect()} == {"a.tex": " x", "b.tex": "\\begin{tabular}{r}x\\end{tabular} \\cite{k}"}
    assert {tuple(r) for r in log.collect()} == {("remove", "p", "a.tex"), ("unwrap", "p", "a.tex"), *(("%s" % p, "p", "b.tex") for p in ("citations", "column-specs", "rename"))}
    assert {name for name, _, _ in written} == {"files"} and not any("Exchange" in plan or "Join" in plan for _, plan, _ in written)
    assert [df.count() for _, _, df in written[-2:]] == [1, 1]


def test_captions_outside_floats_in_a_rewrite(spark):
    page = "\\begin{minipage}{1cm}\\captionof{table}{T}\\end{minipage}"
    src = spark.createDataFrame([("p", "a.tex", page + "\\begin{tabular}{S}\\end{tabular}"), ("p", "b.tex", "\\begin{figure}" + page.replace("table", "figure") + "\\end{figure}")], SOURCES)
    after, _ = R.rewrite_corpus(src, rounds=3)
    assert {r["path"]: r["content"] for r in after.collect()} == {"a.tex": "\\begin{table}\\caption{T}\\end{table}\\begin{tabular}{r}\\end{tabular}", "b.tex": "\\begin{figure}\\caption{T}\\end{figure}"}
