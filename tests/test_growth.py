"""What keeps the cost of a query in proportion to its input: what is computed once, kept once and written once."""

from pyspark.sql import functions as F

from texlake.functions.scan import scan_spans
from texlake.operators import intervals as V
from texlake.operators import translate as G

SOURCES = "paper_id string, path string, content string"


def test_sliced_is_slice_without_for_several_cuts(spark):
    files = [("p", "a", "0123456789"), ("p", "b", None), ("q", "a", "é😀xyz")]
    src = spark.createDataFrame(files, SOURCES)
    rows = spark.createDataFrame([("p", "a", 0, 10, "u"), ("p", "a", 2, 5, "v"), ("p", "a", 2, 5, "w"), ("p", "a", 4, 40, "x"), ("p", "b", 0, 3, "y"), ("q", "a", 1, 4, None), ("q", "none", 0, 1, "z")], "paper_id string, path string, start int, end int, tag string")
    one = spark.createDataFrame([("p", "a", 3, 4), ("p", "a", 4, 6), ("q", "a", 2, 3)], "paper_id string, path string, start int, end int")
    two = spark.createDataFrame([("p", "a", 0, 3)], one.schema)
    got = {tuple(r) for r in V.sliced(rows, src, one=one, two=two).select("path", "start", "end", "tag", "one", "two").collect()}
    want = set()
    for r in V.slice_without(rows, src, one).withColumnRenamed("text", "one").join(V.slice_without(rows, src, two).withColumnRenamed("text", "two").select(*V.FILE, "start", "end", F.col("tag").alias("t"), "two"), [*V.FILE, "start", "end"]).where("tag <=> t").collect():
        want.add((r["path"], r["start"], r["end"], r["tag"], r["one"], r["two"]))
    assert got == want and len(got) == 6
    assert ("a", 0, 10, "u", "0126789", "3456789") in got and ("a", 1, 4, None, "😀y", "😀xy") in got


def test_prose_cuts_a_file_into_lines_once(spark):
    src = spark.createDataFrame([("p", "a", "A paragraph of enough letters.\n\nAnother one of enough letters.")], SOURCES)
    found = G.prose_chunks(src, scan_spans(src))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1
    assert found.count() == 2


def test_stream_state_is_a_row_a_paper(spark, tmp_path):
    from texlake.streaming.pending import stream_pending

    text = "\n\n".join(f"Paragraph number {chr(97 + k)} has enough letters to be prose." for k in range(20))
    inp, memory, out, check = (str(tmp_path / x) for x in ("in", "memory", "out", "check"))
    spark.createDataFrame([("p", "a.tex", text), ("q", "a.tex", text)], SOURCES).write.parquet(inp)
    query = stream_pending(spark, inp, memory, out, check)
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 2
    assert spark.read.parquet(out).count() == 40


def test_written_trees_are_read_again(spark, tmp_path):
    import pytest

    from texlake.sources import corpus as S

    rows = [("p", "main.tex", "a\r\nü😀"), ("p", "sub/x.tex", "c"), ("q", "main.tex", "b" * 3_000_000)]
    for root in (str(tmp_path / "one"), f"file://{tmp_path}/two"):
        for _ in range(2):  # a second run replaces the first one's files
            S.write_sources(spark.createDataFrame(rows, SOURCES), root)
        assert sorted(map(tuple, S.read_sources(spark, root).collect())) == sorted((p, f, c or "") for p, f, c in rows)
    assert sorted(x.name for x in (tmp_path / "one").rglob("*") if x.is_file()) == ["main.tex", "main.tex", "x.tex"]
    with pytest.raises(Exception, match="no place below"):
        S.write_sources(spark.createDataFrame([("p", "../x.tex", "a")], SOURCES), str(tmp_path / "one"))


def test_answers_are_asked_of_written_prompts(spark):
    """Both jobs of x01_answer_log read the same prompts: neither finds the paragraphs and their math again."""
    from texlake.plans.registry import QUERIES

    found = QUERIES["x01_answer_log"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("MapInArrow") == 1
    assert found.count() > 0


def test_own_forms_write_definitions_of_the_first_scan_alone(spark, monkeypatch):
    from collections import Counter

    from texlake.functions.scan import scan_spans
    from texlake.plans import registry  # noqa: F401
    from texlake.plans import corpus as C

    written, real = [], C.cut
    monkeypatch.setattr(C, "cut", lambda df, name="cut": written.append((name, real(df, name))) or written[-1][1])
    c = C.Corpus(spark, "/root/testdata/sf0.001")
    own = c.own.spans
    first, again = [df for name, df in written if name == "spans"]
    names = {r["name"] for r in first.select("name").distinct().collect()}
    assert names and names <= {*C.STRUCTURE, *C.DEFINITIONS}
    # as they are in the whole table, and scanned again as ``rescan`` does it
    keep = {"math", "label", "figure*"}
    rows = lambda df: Counter(tuple(map(str, r)) for r in df.collect())
    assert rows(scan_spans(c.sources, keep=keep)) == rows(scan_spans(c.sources).where("kind = 'math' OR (kind IN ('command', 'environment') AND name IN ('math', 'label', 'figure*'))"))
    whole = C.Corpus(spark, "/root/testdata/sf0.001", c.sources)
    assert whole.spans and rows(whole.own.spans) == rows(own) == rows(again)


def test_answers_are_taken_apart_in_more_tasks_than_ask(spark):
    from texlake.operators import translate as G

    raw = spark.createDataFrame([(1, "m.tex", k, f"[{k}]\na {k}", None) for k in range(40)], "paper_id long, path string, batch int, raw string, error string").coalesce(1)
    found = G.parse_responses(raw)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.rindex("RepartitionByExpression") and found.count() == 40


def test_subequations_write_the_spans_they_read_alone(spark, monkeypatch):
    from texlake.plans import corpus, registry

    written = {}
    cut = corpus.cut

    def recorded(df, name="cut"):
        written[name] = cut(df, name)
        return written[name]

    monkeypatch.setattr(corpus, "cut", recorded)
    registry.QUERIES["w05_subequations"](spark, "/root/testdata/sf0.001")
    names = {(r["kind"], r["name"]) for r in written["spans"].select("kind", "name").distinct().collect()}
    assert ("environment", "subequations") in names and ("command", "label") in names
    assert not {"ref", "section", "figure*", None} & {n for _, n in names}


def test_letters_read_the_spans_once(spark):
    src = spark.createDataFrame([("p", "a", r"Some \emph{words} and \label{x}$m$ here % no")], SOURCES)
    spans = scan_spans(src, keep=("command", "comment", "math", "env_token"))
    rows = src.select("paper_id", "path", F.lit(0).alias("start"), F.length("content").alias("end"))
    found = G.letters_in(rows, src, spans)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow scan") == 1
    assert [r["letters"] for r in found.collect()] == [len("Somewordsandhere")] == [r["letters"] for r in G.letters_in(rows, src, scan_spans(src)).collect()]
