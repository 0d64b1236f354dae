"""The driver contract: names, oracles, and the library without its training-data operators."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SF = Path("/root/testdata/sf0.001")

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.mark.parametrize("name", ["n01_scan_commands", "v02_merge_ranges", "d07_packages", "w03_number_objects", "e01_validate_edits", "g13_validate_translations", "n01_own_forms", "g03_blank_lines", "g10_protect_long", "r14_second_root", "s02_archives", "e01_all_reasons"])
def test_oracle(spark, name):
    import __spark_entry__ as entry

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = entry.queries()[name](spark, str(SF))
    want = con.execute(entry.oracle_sql()[name])
    columns = sorted(c[0] for c in want.description)
    assert columns == sorted(got.columns)
    place = [[c[0] for c in want.description].index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(tuple(r[k] for k in place) for r in want.fetchall())


def test_every_oracle_has_its_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_training_operators():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('texlake.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "names = set(e.queries())\n"
        "assert 'w13_resolve_refs' in names and 'pipeline' not in names and not any(n.startswith('op') for n in names)\n"
        "assert not any(m.startswith('texlake.llm') for m in sys.modules)\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    # a missing dependency is not taken for a missing subpackage
    broken = code.split("import __spark_entry__")[0].replace("name == 'corpus_pipeline' or name.startswith('texlake.llm')", "name == 'pyarrow'") + "import __spark_entry__\n"
    assert subprocess.run([sys.executable, "-c", broken], cwd=ROOT, capture_output=True).returncode


def test_long_files_stay_linear(spark):
    from texlake.functions.scan import scan_spans
    from texlake.operators import intervals as V
    from texlake.operators import translate as G

    text = "\n\n".join(f"\\section{{s{k}}}\\label{{l{k}}} Paragraph {k} has some words." for k in range(50_000))
    sources = spark.createDataFrame([("p", "m.tex", text), ("p", "null.tex", None)], "paper_id string, path string, content string")
    rows = G.paragraph_ranges(sources, with_text=True)
    assert rows.count() == 50_000
    numbered = rows.selectExpr("paper_id", "path", "start", "end", "text", "CAST(row_number() OVER (PARTITION BY paper_id, path ORDER BY start) - 1 AS INT) AS chunk_id")
    batches = G.pack_batches(numbered, 2000).groupBy("batch").agg({"*": "count"}).collect()
    assert sum(r["count(1)"] for r in batches) == 50_000 and len(batches) > 1000
    spans = scan_spans(sources)
    labels, heads = spans.where("name = 'label'"), spans.where("name = 'section'")
    assert V.slice_without(rows.drop("text"), sources, labels.select("paper_id", "path", "start", "end")).where("text LIKE '%label%'").isEmpty()
    assert V.adjacent_label(heads, labels, sources).where("attach > end").count() == 50_000
    assert V.smallest_container(labels.select("paper_id", "path", "start", "end"), rows.selectExpr("paper_id", "path", "start", "end", "'p' AS name")).where("container IS NOT NULL").count() == 50_000
