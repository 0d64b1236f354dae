"""Scanner, intervals, numbering, edits and translation on small sources."""

import pytest
from pyspark.sql import functions as F

from texlake.functions import tex
from texlake.functions.scan import nodes_of, scan_spans, scan_text
from texlake.operators import discover as D
from texlake.operators import intervals as V
from texlake.operators import number as W
from texlake.operators import rewrite as R
from texlake.operators import translate as G
from texlake.sources import corpus as S


def spans(text):
    return [(s["kind"], s.get("name"), s["start"], s["end"], s["complete"]) for s in scan_text(text)]


def table(spark, rows):
    return spark.createDataFrame([("p", path, text) for path, text in rows], "paper_id string, path string, content string")


def test_scan_nested_and_escaped():
    text = "\\section*{A \\textbf{b}} \\{ % \\ref{no}\n$x\\$y$ \\begin{figure}\\label{l}\\end{figure}"
    assert [s[:2] for s in spans(text)] == [("command", "section"), ("command", "textbf"), ("comment", None), ("math", None), ("environment", "figure"), ("env_token", "figure"), ("command", "label"), ("env_token", "figure")]
    assert scan_text(text)[0]["arguments"][0]["text"] == "*"


def test_scan_incomplete():
    assert spans("\\section{never closed")[0][4] is False
    assert spans("\\begin{figure} x")[0][3:] == (16, False)
    assert spans("\\usepackage[a, b")[0][4] is False
    assert spans("") == []


def test_scan_definition_bodies_open_nothing():
    kinds = spans("\\newcommand{\\x}{\\begin{center}} \\begin{quote}q\\end{quote}")
    assert [k[1] for k in kinds if k[0] == "environment"] == ["quote"]


def test_scan_raw_bodies():
    kinds = spans("\\begin{verbatim}\\ref{x} $ \\end{verbatim} \\ref{y}")
    assert [k[1] for k in kinds if k[0] == "command"] == ["ref"]


def test_scan_null_and_crlf(spark):
    rows = spark.createDataFrame([("p", "a.tex", None), ("p", "b.tex", "a\r\n% c\r\n😀\\label{x}")], "paper_id string, path string, content string")
    got = {(r["kind"], r["start"], r["end"]) for r in scan_spans(rows).collect()}
    assert got == {("comment", 3, 6), ("command", 9, 18)}


def test_expressions(spark):
    rows = spark.createDataFrame([("a{b}c",), ("}{",), ("\\}{\\{}",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(tex.balanced_braces(F.col("t"))).collect()] == [True, False, True, True, None]
    one = spark.createDataFrame([("a \\% b % c\n\\\\% d",)], "t string")
    assert one.select(tex.strip_comments(F.col("t"))).first()[0] == "a \\% b \n\\\\"
    assert [r[0] for r in spark.range(1).select(F.explode(F.array(*[tex.letters(F.lit(n)) for n in (1, 26, 27, 702, 703)]))).collect()] == ["a", "z", "aa", "zz", "aaa"]


def ranges(spark, pairs):
    return spark.createDataFrame([("p", "f", a, z, k) for k, (a, z) in enumerate(pairs)], "paper_id string, path string, start int, end int, node_id int")


def pairs(df):
    return sorted((r["start"], r["end"]) for r in df.collect())


def test_intervals(spark):
    assert pairs(V.merge_ranges(ranges(spark, [(8, 12), (1, 4), (3, 6), (9, 10), (6, 8), (20, 20)]))) == [(1, 12)]
    assert pairs(V.outermost(ranges(spark, [(0, 10), (2, 5), (0, 10), (8, 12)]), V.FILE, "node_id")) == [(0, 10), (8, 12)]
    assert pairs(V.not_overlapping(ranges(spark, [(0, 2), (3, 5), (6, 9)]), ranges(spark, [(4, 6)]))) == [(0, 2), (6, 9)]
    assert pairs(V.merge_ranges(ranges(spark, []))) == []


def nodes(spark, rows):
    return V.mark_opaque(nodes_of(scan_spans(table(spark, rows))))


def ordered(spark, rows):
    n = nodes(spark, rows)
    order = spark.createDataFrame([("p", path, k + 1) for k, (path, _) in enumerate(rows)], "paper_id string, path string, file_ord int")
    return D.in_order(n, order)


def test_include_cycle_and_order(spark):
    rows = [("main.tex", "\\documentclass{a}\\input{b}\\input{c}"), ("b.tex", "\\input{c.tex}"), ("c.tex", "\\input{main}"), ("z.tex", "")]
    n, src = nodes(spark, rows), table(spark, rows)
    papers = D.find_main(src, n)
    files = D.include_order(D.include_edges(n, src), papers)
    assert [(r["path"], r["file_ord"]) for r in files.orderBy("file_ord").collect()] == [("main.tex", 1), ("b.tex", 2), ("c.tex", 3)]
    assert [r["path"] for r in D.detached_files(files, src).collect()] == ["z.tex"]


def test_first_macro_wins(spark):
    o = ordered(spark, [("m.tex", "\\newcommand{\\a}[1]{x#1}\\renewcommand{\\a}{y}\\DeclareMathOperator{\\op}{op}\\newcommand{\\bad}[12]{z}")])
    got = {r["name"]: (r["body"], r["parameter_count"], r["math_operator"]) for r in D.macro_definitions(o).collect()}
    assert got == {"\\a": ("x#1", 1, False), "\\op": ("op", 0, True)}


def test_subequations(spark):
    o = ordered(spark, [("m.tex", "\\begin{equation}\\label{a}\\end{equation}\\begin{subequations}\\label{p}\\begin{align}x\\label{b}y\\label{c}\\end{align}\\end{subequations}\\begin{equation*}\\label{s}\\end{equation*}\\begin{gather}\\label{d}\\end{gather}")])
    got = {r["label"]: r["number"] for r in W.number_equations(o).unionByName(W.number_subequations(o)).collect()}
    assert got == {"a": "1", "p": "2", "b": "2a", "c": "2b", "d": "3"}


def test_subfigures_and_chapters(spark):
    text = "\\begin{figure}\\caption{x}\\label{f0}\\end{figure}\\chapter{One}\\begin{figure}\\label{a}\\label{b}\\caption{x}\\label{f}\\end{figure}\\chapter*{A Appendix}\\begin{figure}\\caption{y}\\label{g}\\end{figure}"
    got = {r["label"]: r["number"] for r in W.number_subfigures(ordered(spark, [("m.tex", text)])).collect()}
    assert got == {"f0": "1", "a": "1.1a", "b": "1.1b", "f": "1.1", "g": "A.1"}


def test_appendix(spark):
    text = "\\section{x}\\appendix\\section{a}\\subsection{b}\\subsection{c}\\section*{no}\\section{d}\\subsection{e}"
    assert [r["number"] for r in W.number_appendix(ordered(spark, [("m.tex", text)])).orderBy("start").collect()] == ["A", "A.1", "A.2", "B", "B.1"]


def test_edits(spark):
    src = table(spark, [("a", "0123456789"), ("b", "xyz"), ("c", "xyz")])
    rows = [("a", 2, 4, "AB", "safe"), ("a", 4, 4, "-", "safe"), ("b", 0, 2, "", "safe"), ("b", 1, 3, "", "safe"), ("d", 0, 1, "", "safe"), ("c", 0, 9, "", "safe")]
    edits = spark.createDataFrame([("p", *r[:4], "t", r[4]) for r in rows], "paper_id string, path string, start int, end int, replacement string, pass_name string, safety string")
    reasons = sorted((r["path"], r["start"], r["reason"]) for r in R.validate_edits(edits, src).collect() if r["reason"])
    assert reasons == [("b", 1, "overlap"), ("c", 0, "bad-range"), ("d", 0, "unknown-file")]
    assert {r["path"]: r["content"] for r in R.apply_edits(src, edits).collect()} == {"a": "01AB-456789", "b": "xyz", "c": "xyz"}


def test_rewrite_is_idempotent(spark):
    text = "\\documentclass{article}\n\\usepackage{amsmath,geometry}\n\\hypersetup{x}\n\\begin{document}\\centering \\citep[see]{a} \\begin{figure*}\\caption{c}\\end{figure*}\\begin{minipage}{1cm}in \\hyperref[l]{text}\\end{minipage}\\paragraph{P} q\\end{document}\n"
    once = R.rewrite_corpus(table(spark, [("m.tex", text)]))[0]
    twice = R.rewrite_corpus(once)[0]
    content = once.first()["content"]
    assert content == twice.first()["content"]
    assert "\\cite{a}" in content and "geometry" not in content and "minipage" not in content and "\\paragraph*{P}" in content and "hypersetup" not in content


@pytest.mark.parametrize("spec, simple", [("l@{}S[x]r", "lrr"), ("{p{1cm}@{x}}c", "{p{1cm}}c"), ("l{", None), ("l}", None), ("", ""), (r">{\Small\S}lS [a]!{x}", r">{\Small\S}lr!{x}")])
def test_column_spec(spec, simple):
    assert R.column_spec(spec) == simple


def test_pack_batches(spark):
    rows = spark.createDataFrame([("p", "f", k, "x" * n) for k, n in enumerate((4, 4, 2, 3, 9, 1))], "paper_id string, path string, chunk_id int, text string")
    assert [r["batch"] for r in G.pack_batches(rows, 6).orderBy("chunk_id").collect()] == [0, 1, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        G.pack_batches(rows, 0)


def test_responses_and_math(spark):
    raw = spark.createDataFrame([("p", "f", 0, "intro\n[0]\n a \n\n[2]\nb\n[2]\nc\n[3]\n \n")], "paper_id string, path string, batch int, raw string")
    assert {(r["chunk_id"], r["translation"]) for r in G.parse_responses(raw).collect()} == {(0, "a"), (2, "c")}
    rows = spark.createDataFrame([("p", "f", 0, "a $x$ b $x$"), ("p", "f", 1, "no math")], "paper_id string, path string, chunk_id int, text string")
    kept = G.protect_math(rows)
    said = kept.select("paper_id", "path", "chunk_id", F.when(F.col("chunk_id") == 0, F.col("prompt_text")).otherwise("$raw$").alias("translation"))
    checked = G.validate_translations(kept, said)
    assert {r["chunk_id"]: r["reason"] for r in checked.collect()} == {0: None, 1: "raw-math"}
    assert G.restore_math(checked).first()["translation"] == "a $x$ b $x$"


def test_translate_retries(spark):
    rows = spark.createDataFrame([("p", "f", 0, "ok"), ("p", "f", 1, "bad")], "paper_id string, path string, batch int, prompt string")

    def fn(prompt):
        if prompt == "bad":
            raise ValueError("no")
        return prompt.upper()

    got = {r["batch"]: (r["raw"], r["error"]) for r in G.translate_batches(rows, fn, parallel=2, wait=0.0).collect()}
    assert got == {0: ("OK", None), 1: (None, "ValueError: no")}


@pytest.mark.parametrize("text, out", [("\\a{1}", "x1"), ("\\a", "\\a"), ("\\b", "d-y"), ("\\b[z]", "z-y"), ("\\ab", "\\ab"), ("\\op", "\\operatorname{op}"), ("\\loop", "\\loop")])
def test_expand(text, out):
    macros = {"\\a": ("x#1", 1, None, False), "\\b": ("#1-\\c", 1, "d", False), "\\c": ("y", 0, None, False), "\\op": ("op", 0, None, True), "\\loop": ("\\loop", 0, None, False)}
    assert G.expand(text, macros) == out


def test_sources_and_keys(spark, tmp_path):
    (tmp_path / "p1/sub").mkdir(parents=True)
    (tmp_path / "p1/main.tex").write_bytes(b"a\r\n\xff")
    (tmp_path / "p1/sub/x.tex").write_text("b")
    (tmp_path / "p1/n.txt").write_text("no")
    got = {(r["paper_id"], r["path"]): r["content"] for r in S.read_sources(spark, str(tmp_path)).collect()}
    assert got == {("p1", "main.tex"): "a\r\n\ufffd", ("p1", "sub/x.tex"): "b"}
    keys = spark.createDataFrame([("2402.08954v2",), ("https://h/abs/2402.08954",), ("https://h/pdf/2402.08954v1.pdf",), ("none",)], "u string")
    assert [r["paper_id"] for r in S.paper_key(keys, "u").collect()] == ["2402.08954", "2402.08954", "2402.08954", None]


def test_archives(spark, tmp_path):
    import io
    import tarfile

    with tarfile.open(tmp_path / "2401.1.tar.gz", "w:gz") as t:
        for name, data in (("./main.tex", b"x"), ("a.txt", b"no")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    assert [tuple(r) for r in S.read_archives(spark, str(tmp_path)).collect()] == [("2401.1", "main.tex", "x")]


def test_archives_large_members(spark, tmp_path):
    import io
    import tarfile

    sizes = {"a.tex": 3, "b.tex": 16_000_001, "c.tex": 5}
    with tarfile.open(tmp_path / "2401.2.tar.gz", "w:gz", compresslevel=1) as t:
        for name, n in sizes.items():
            info = tarfile.TarInfo(name)
            info.size = n
            t.addfile(info, io.BytesIO(b"x" * n))
    got = S.read_archives(spark, str(tmp_path)).select("path", F.length("content").alias("n")).collect()
    assert {r["path"]: r["n"] for r in got} == sizes


def test_stream_queues_once(spark, tmp_path):
    from texlake.streaming.pending import stream_pending

    prose = "These words are long enough to count as prose here.\n\nAnd so are these, in a second paragraph of it.\n"
    inp, memory, out, check = (str(tmp_path / x) for x in ("in", "memory", "out", "check"))
    table(spark, [("a.tex", prose)]).write.parquet(inp)
    stream_pending(spark, inp, memory, out, check).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    table(spark, [("b.tex", prose)]).write.mode("append").parquet(inp)
    stream_pending(spark, inp, memory, out, check).awaitTermination()
    assert spark.read.parquet(out).count() == 2
