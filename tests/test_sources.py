"""Archives, the answer log, the streaming queue, own forms, input roots and versions."""

import os
import tarfile

import pytest
from pyspark.sql import functions as F

from texlake.functions.scan import nodes_of, rescan, scan_spans
from texlake.operators import discover as D
from texlake.operators import intervals as V
from texlake.operators import rewrite as R
from texlake.operators import translate as G
from texlake.sources import archives as A

SOURCES = "paper_id string, path string, content string"


def test_archives_round_trip(spark, tmp_path):
    rows = [("2401.1", "main.tex", "a\r\nü😀"), ("2401.1", "sub/x.tex", ""), ("hep-th/99", "m.tex", "b" * 5_000_000), ("hep-th/99", "n.tex", None)]
    root = f"file://{tmp_path}/out"
    A.write_archives(spark.createDataFrame(rows, SOURCES), root)
    A.write_archives(spark.createDataFrame(rows[:2], SOURCES), root)  # replaces the paper's archive
    assert sorted(os.listdir(tmp_path / "out")) == ["2401.1.tar.gz", "hep-th%2F99.tar.gz"]
    assert sorted(map(tuple, A.read_archives(spark, root).collect())) == sorted((p, f, c or "") for p, f, c in rows)
    assert sorted(map(tuple, A._through_spark(spark, root).collect())) == sorted((p, f, c or "") for p, f, c in rows)
    assert A.read_archives(spark, f"{root}/2401.1.tar.gz").count() == 2


def test_archives_are_tasks(tmp_path, monkeypatch):
    for k in range(5):
        with tarfile.open(tmp_path / f"{k}.tar.gz", "w:gz"):
            pass
    size = (tmp_path / "0.tar.gz").stat().st_size
    monkeypatch.setattr(A, "TASK_BYTES", 2 * size)
    parts = A.ArchiveReader(str(tmp_path)).partitions()
    assert [len(p.paths) for p in parts] == [2, 2, 1]


def test_broken_archives_are_named(spark, tmp_path):
    (tmp_path / "bad.tar.gz").write_bytes(b"\x1f\x8b no archive")
    with pytest.raises(Exception, match="bad.tar.gz is no whole archive"):
        A.read_archives(spark, str(tmp_path)).count()
    with pytest.raises(Exception, match="has no place in an archive"):
        A.write_archives(spark.createDataFrame([(None, "m.tex", "x")], SOURCES), f"{tmp_path}/out")


def test_no_archives(spark, tmp_path):
    assert A.read_archives(spark, str(tmp_path)).count() == 0


def test_a_killed_task_asks_nothing_again(spark, tmp_path):
    rows = spark.createDataFrame([("p", "m", k, f"prompt {k}") for k in range(12)] + [("q", "m", 0, "prompt 0"), ("q", "m", 1, None)], "paper_id string, path string, batch int, prompt string")
    asked, died, log = str(tmp_path / "asked"), str(tmp_path / "died"), f"file://{tmp_path}/log"

    def fn(prompt):
        if prompt == "prompt 7" and not os.path.exists(died):
            open(died, "w").close()
            os._exit(1)
        with open(asked, "a") as f:
            f.write(prompt + "\n")
        return prompt.upper()

    with pytest.raises(Exception):  # local mode gives a task no second attempt; a cluster would run it again
        G.translate_batches(rows, fn, parallel=1, wait=0.0, log=log).collect()
    got = {(r["paper_id"], r["batch"]): r["raw"] for r in G.translate_batches(rows, fn, parallel=3, wait=0.0, log=log).collect()}
    assert got == {("p", k): f"PROMPT {k}" for k in range(12)} | {("q", 0): "PROMPT 0"}
    assert sorted(open(asked).read().split("\n")[:-1]) == sorted(f"prompt {k}" for k in range(12))


def test_failures_are_not_logged(spark, tmp_path):
    rows = spark.createDataFrame([("p", "m", 0, "x")], "paper_id string, path string, batch int, prompt string")

    def bad(prompt):
        raise ValueError("no")

    assert G.translate_batches(rows, bad, tries=2, wait=0.0, log=str(tmp_path)).first()["error"] == "ValueError: no"
    assert G.translate_batches(rows, str.upper, wait=0.0, log=str(tmp_path)).first()["raw"] == "X"


def test_stream_knows_memory_and_replays(spark, tmp_path):
    from texlake.streaming.pending import stream_pending

    text = lambda k: f"Paragraph number {k} has enough letters to be prose."
    inp, memory, out, check = (str(tmp_path / x) for x in ("in", "memory", "out", "check"))
    spark.createDataFrame([("p",)], "paper_id string").select("paper_id", G.chunk_digest(F.lit(text(1))).alias("digest")).write.parquet(memory)

    def drop(*rows):
        spark.createDataFrame(rows, SOURCES).write.mode("append").parquet(inp)
        stream_pending(spark, inp, memory, out, check).awaitTermination()
        return sorted((r["paper_id"], r["text"][17]) for r in spark.read.parquet(out).collect())

    assert drop(("p", "a.tex", f"{text(1)}\n\n{text(2)}\n\n{text(2)}")) == [("p", "2")]
    assert drop(("p", "a.tex", f"{text(1)}\n\n{text(2)}"), ("q", "a.tex", text(1))) == [("p", "2"), ("q", "1")]
    spark.createDataFrame([("p",)], "paper_id string").select("paper_id", G.chunk_digest(F.lit(text(3))).alias("digest")).write.mode("append").parquet(memory)
    assert drop(("p", "b.tex", f"{text(3)}\n\n{text(4)}")) == [("p", "2"), ("p", "4"), ("q", "1")]


def own(spark, *rows):
    src = spark.createDataFrame(rows, SOURCES)
    spans = scan_spans(src)
    files = spark.createDataFrame([(r[0], r[1], k) for k, r in enumerate(rows)], "paper_id string, path string, file_ord int")
    nodes = V.mark_opaque(nodes_of(spans))
    forms = D.own_forms(D.in_order(nodes, files))
    return src, files, forms, V.mark_opaque(nodes_of(rescan(src, spans, forms)))


def test_own_forms(spark):
    rows = [
        ("p", "m.tex", "\\newcommand{\\pair}[2][d]{#1-#2}\\newcommand{\\section}[2]{no}\\newtheorem{lem}{Lemma}\\newtheorem{tabular}{F}\\DeclareMathOperator{\\op}{o}"),
        ("p", "b.tex", "\\pair[a]{b} \\pair{c} \\pair \\begin{lem}[Of {x}]y\\end{lem}\\section{t}\\op{u}"),
        ("q", "m.tex", "\\pair[a]{b}\\begin{lem}[x]\\end{lem}"),
    ]
    src, files, forms, nodes = own(spark, *rows)
    assert {r["paper_id"]: (r["macro_args"], r["env_args"]) for r in forms.collect()} == {"p": ({"pair": "[{"}, {"lem": "["})}
    got = {(r["paper_id"], r["start"]): [a and a["text"] for a in r["arguments"]] for r in nodes.where("path <> 'm.tex' OR paper_id = 'q'").where("name IN ('pair', 'lem', 'op', 'section')").collect()}
    assert got == {("p", 0): ["a", "b"], ("p", 12): [None, "c"], ("p", 21): [None, "\\begin"], ("p", 27): ["Of {x}"], ("p", 56): [None, None, "t"], ("p", 67): [], ("q", 0): [], ("q", 11): []}
    macros = D.macro_definitions(D.in_order(nodes, files))
    edits = {(r["start"], r["replacement"]) for r in R.plan_macro_calls(nodes.where("path = 'b.tex'"), macros).collect()}
    assert {(0, "a-b"), (12, "d-c"), (67, "\\operatorname{o}")} <= edits


def test_input_roots(spark):
    files = spark.createDataFrame([("p", f) for f in ("src/main.tex", "src/ch/a.tex", "src/ch/b.tex", "src/b.tex")], "paper_id string, path string")
    src = spark.createDataFrame([("p", "src/ch/a.tex", "\\input{b}\\input{ch/b}\\include{b.tex}\\input{../b}\\input{none}\\input{../../../b}")], SOURCES)
    nodes = V.mark_opaque(nodes_of(scan_spans(src)))
    got = sorted((r["start"], r["target"], r["root"]) for r in D.resolve_inputs(nodes, files).collect())
    assert got == [(0, "src/ch/b.tex", 0), (9, "src/ch/b.tex", 1), (21, "src/ch/b.tex", 0), (36, "src/b.tex", 0)]
    text = R.apply_edits(src, R.plan_inputs(nodes, files)).first()["content"]
    assert text == "\\input{b.tex}\\input{ch/b.tex}\\include{b.tex}\\input{../b.tex}\\input{none}\\input{../../../b}"


def test_versions_write_what_changes(spark):
    rows = [("p", f"f{k}.tex", f"\\section{{s{k}}} text") for k in range(20)]
    now = R.Versions(spark.createDataFrame(rows, SOURCES))
    before = now.spans
    now.put(spark.createDataFrame([("p", "f3.tex", "\\emph{new}")], SOURCES))
    assert now.stale == 1 and before.count() == 20
    assert sorted(r["name"] for r in now.spans.where("path IN ('f3.tex', 'f4.tex')").collect()) == ["emph", "section"]
    many = spark.createDataFrame([("p", f"f{k}.tex", "plain") for k in range(12)], SOURCES)
    now.put(many)
    assert now.stale == 0 and now.spans.count() == 8 and now.sources.count() == 20
    assert {r["path"]: r["content"] for r in now.sources.collect()} == {r[1]: "plain" if k < 12 else r[2] for k, r in enumerate(rows)}


def test_wrappers_four_deep(spark):
    deep = "\\hyperlink{a}{" * 4 + "x" + "}" * 4
    src = spark.createDataFrame([("p", "main.tex", f"\\documentclass{{article}} {deep}"), ("p", "b.tex", "plain")], SOURCES)
    after, log = R.rewrite_corpus(src, rounds=3)
    assert {r["path"]: r["content"] for r in after.collect()} == {"main.tex": "\\documentclass{article} x", "b.tex": "plain"}
    assert {(r["pass_name"], r["path"]) for r in log.collect()} == {("unwrap", "main.tex")}


def test_own_theorems_of_a_rewrite(spark):
    src = spark.createDataFrame([("p", "main.tex", "\\documentclass{article}\\newtheorem{lem}{Lemma}\\begin{document}\\begin{lem}[Of x]y\\end{lem}\\end{document}")], SOURCES)
    assert "\\textbf{Lemma 1} \\textit{(Of x)}\\textbf{.} y" in R.rewrite_corpus(src, rounds=4)[0].first()["content"]


def test_include_order_betters_paths(spark):
    edges = [("main", "b", 1), ("main", "a", 2), ("b", "c", 1), ("c", "a", 1), ("a", "main", 1), ("a", "d", 2)]
    rows = spark.createDataFrame([("p", s, t, k) for s, t, k in edges], "paper_id string, path string, target string, start int")
    papers = spark.createDataFrame([("p", "main")], "paper_id string, main_path string")
    assert [r["path"] for r in D.include_order(rows, papers).orderBy("file_ord").collect()] == ["main", "b", "c", "a", "d"]
