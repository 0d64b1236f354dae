"""Inputs that are long, deep or repeated: none may cost more than its length, and none may end the job."""

import hashlib

import pytest
from pyspark.sql import functions as F

from texlake.functions import tex
from texlake.functions.scan import math_in, nodes_of, scan_spans
from texlake.operators import discover as D
from texlake.operators import intervals as V
from texlake.operators import rewrite as R
from texlake.operators import translate as G


def sources(spark, *texts):
    return spark.createDataFrame([("p", f"m{k}.tex", t) for k, t in enumerate(texts)], "paper_id string, path string, content string")


def test_a_stray_dollar_and_long_math(spark):
    long = "x" * 1_000_000
    rows = sources(spark, f"$5 {long}", f"$ {long} $ and $$b$$", f"\\({long}\\) \\[c", f"\\verb|$| % $a$ {long}\n$d$", None, "", "\\$1 \\\\$e$")
    got = {r["path"]: (r["prompt_text"], [x["math"] for x in r["replacements"]]) for r in G.protect_math(rows.withColumnRenamed("content", "text")).collect()}
    assert got["m0.tex"] == (f"$5 {long}", [])
    assert got["m1.tex"][1] == [f"$ {long} $", "$$b$$"] and len(got["m1.tex"][0]) < 100
    assert got["m2.tex"][1] == [f"\\({long}\\)"] and got["m2.tex"][0].endswith(" \\[c")
    assert got["m3.tex"][1] == ["$d$"] and got["m6.tex"][1] == ["$e$"]
    assert got["m4.tex"] == (None, []) and got["m5.tex"] == ("", [])


def test_math_numbers_and_tokens():
    assert math_in("a $x$ \\begin{verbatim}$y$\\end{verbatim} $z") == [(2, 5, "$", "$"), (40, 42, "$", None)]
    text, found = G._tokens_for("a $x$ b $x$")
    digest = hashlib.sha256(b"$x$").hexdigest()[:12]
    assert text == f"a ⟦TL_MATH_0_{digest}⟧ b ⟦TL_MATH_1_{digest}⟧" and [f["math"] for f in found] == ["$x$", "$x$"]


def paragraphs(text):
    """Paragraphs one character after the other, as defined: gaps are a line end, blank lines, a line end."""
    import re

    out, at = [], 0
    for m in re.finditer(r"(?:\r\n|\n)(?:[^\S\r\n]*(?:\r\n|\n))+", text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    return out + ([(at, len(text))] if at < len(text) else [])


@pytest.mark.parametrize("text", ["", "\n", "\n\n", "a", "a\n", "a\n\n", "\na", "\n\na\n\n\n b \n\t\n\x0b\nc\r\n\r\nd\r\n \r\n\r\n", " \n\nx\r\r\n\ny\r", "a\n \nb", "a\n  \n\nb\n "])
def test_paragraphs(spark, text):
    got = sorted((r["start"], r["end"], r["text"]) for r in G.paragraph_ranges(sources(spark, text), with_text=True).collect())
    assert got == [(a, b, text[a:b]) for a, b in paragraphs(text)]


def test_a_million_blank_lines(spark):
    src = sources(spark, "One.\n" + "\n" * 500_000 + "\r\n" * 250_000 + " \t\n" * 250_000 + "Two.\n\nThree.")
    got = sorted((r["start"], r["text"]) for r in G.paragraph_ranges(src, with_text=True).collect())
    assert [t for _, t in got] == ["One.", "Two.", "Three."] and got[1][0] == 5 + 500_000 + 500_000 + 750_000
    assert G.chunks(src, scan_spans(src)).count() == 5


@pytest.mark.parametrize("body, out", [("[0,1) is half open " + "y" * 200_000, None), ("[Of [0,1) {]}] x", None), ("[Of {[0,1)}] x", "Of {[0,1)}")])
def test_theorem_options(spark, body, out):
    """An option that never ends is untrusted, so its theorem stays; others are titles up to their own bracket."""
    src = sources(spark, f"\\begin{{theorem}}{body}\\end{{theorem}}")
    nodes = V.mark_opaque(nodes_of(scan_spans(src)))
    names = spark.createDataFrame([("p", "theorem", "Theorem")], "paper_id string, environment string, label string")
    rows = R.plan_theorems(nodes, D.in_order(nodes, spark.createDataFrame([("p", "m0.tex", 1)], "paper_id string, path string, file_ord int")), names, src).collect()
    if out is None:
        assert not [r for r in rows if "textit{(" in r["replacement"] and "y" * 9 in r["replacement"]]
    else:
        assert f"\\textit{{({out})}}" in rows[0]["replacement"] + rows[-1]["replacement"]


def test_patterns_on_long_runs(spark):
    slashes, blanks = "\\" * 100_000, " " * 100_000
    src = sources(spark, f"{slashes}% c", f"a{blanks}b", "{" * 50_000 + "}" * 50_000, blanks + "% TEXLAKE", "[1]" * 50_000)
    text = F.col("content")
    rows = src.select("path", tex.strip_comments(text).alias("s"), tex.balanced_braces(text).alias("b"), tex.normalize_newlines(text, F.lit("\n")).alias("n")).collect()
    assert {r["path"]: r["s"] for r in rows}["m0.tex"] == slashes and {r["path"]: r["b"] for r in rows}["m2.tex"]
    raw = spark.createDataFrame([("p", "m", 0, "[1]\n" + "word " * 100_000 + "\n[2]\n" + "\n" * 100_000 + "x")], "paper_id string, path string, batch int, raw string")
    assert {r["chunk_id"]: len(r["translation"]) for r in G.parse_responses(raw).collect()} == {1: 499_999, 2: 1}


def naive(rows, ranges, kind):
    inside = {"contained": lambda a, b, c, d: c <= a and b <= d, "overlapping": lambda a, b, c, d: a < d and b > c}[kind]
    return sorted((a, b) for a, b in rows if any(inside(a, b, c, d) for c, d in ranges))


def test_sweeps_equal_all_pairs(spark):
    import random

    frame = lambda pairs: spark.createDataFrame([("p", "m", a, b) for a, b in pairs], "paper_id string, path string, start int, end int")
    values = lambda df: sorted((r["start"], r["end"]) for r in df.collect())
    for seed in range(4):
        random.seed(seed)
        some = lambda n, wide: [(a, a + random.randint(0, wide)) for a in (random.randint(0, 60) for _ in range(n))]
        rows, ranges = some(40, 6), some(12, 9)
        full = [(c, d) for c, d in ranges if c < d]
        a, b = frame(rows), frame(ranges)
        assert values(V.contained_in(a, b)) == naive(rows, ranges, "contained")
        assert values(V.not_contained_in(a, b)) == sorted(set_minus(rows, naive(rows, ranges, "contained")))
        assert values(V.not_overlapping(a, b)) == sorted(set_minus(rows, naive(rows, merged(full), "overlapping")))
        held = V.with_container(a, V.merge_ranges(b))
        assert sorted((r["start"], r["end"], r["o_start"]) for r in held.collect()) == sorted((s, e, c) for s, e in rows for c, d in merged(full) if c <= s and e <= d)


def set_minus(rows, gone):
    left = list(rows)
    for g in gone:
        left.remove(g)
    return left


def merged(ranges):
    out = []
    for c, d in sorted(ranges):
        if out and c <= out[-1][1]:
            out[-1] = (out[-1][0], max(d, out[-1][1]))
        else:
            out.append((c, d))
    return out


def test_sweeps_of_a_million_ranges(spark):
    ranges = spark.range(1_000_000).selectExpr("'p' AS paper_id", "'m' AS path", "CAST(10 * id AS INT) AS start", "CAST(10 * id + 5 AS INT) AS end")
    rows = spark.range(1_000_000).selectExpr("'p' AS paper_id", "'m' AS path", "CAST(10 * id + id % 7 AS INT) AS start", "CAST(10 * id + id % 7 + 1 AS INT) AS end")
    inside = sum(k % 7 + 1 <= 5 for k in range(1_000_000))
    found = V.contained_in(rows, ranges)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == inside and V.not_contained_in(rows, ranges).count() == 1_000_000 - inside
    assert V.not_overlapping(rows, ranges).count() == 1_000_000 - inside
    points = rows.select("paper_id", "path", F.col("start").alias("at"))
    assert V.cut_points_to_ranges(points, ranges).count() == 2_000_000 + sum(k % 7 > 5 for k in range(1_000_000)) - 1


def test_configuration_lines(spark):
    text = "\\hypersetup{a}\n x\n\t\\lstset{b} \r\n\\lstset{c} y\n\\lstset{d}\\lstset{e}\n" + "\\lstset{f}z" * 20_000 + "\n  \\lstset{g}"
    src = sources(spark, text)
    nodes = V.mark_opaque(nodes_of(scan_spans(src)))
    found = V.alone_on_line(nodes.where("name IN ('hypersetup', 'lstset')"), src)
    assert sorted((r["line_start"], r["line_end"]) for r in found.collect()) == [(0, 15), (18, 32)]
    assert R.apply_edits(src, R.settle(R.plan_remove(nodes, src))).first()["content"] == " x\n y\n\n" + "z" * 20_000 + "\n  "
