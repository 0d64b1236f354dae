"""DuckDB SQL for the queries over the derived corpus, from the text of the files alone.

The corpus has flat arguments, so a file split at its backslashes shows every command: the places are the lengths of the
pieces before it. Environments end at the next end of their name.
"""

from __future__ import annotations

import re

from ..sources.corpus import derive_sql

_TABLES = f"""pc AS (SELECT paper_id, path, k, p, CAST(sum(length(p) + 1) OVER (PARTITION BY paper_id, path ORDER BY k) - length(p) - 2 AS BIGINT) AS spot
 FROM (SELECT paper_id, path, unnest(string_split(content, '\\')) AS p, generate_subscripts(string_split(content, '\\'), 1) AS k FROM src)),
cmd AS (SELECT paper_id, path, spot AS start, p, regexp_extract(p, '^[A-Za-z@]+') AS name FROM pc WHERE k > 1 AND regexp_extract(p, '^[A-Za-z@]+') <> ''),
arg AS (SELECT *, regexp_extract(p, '^[A-Za-z@]+(\\[[^\\]]*\\])?\\{{([^{{}}]*)\\}}', 2) AS a,
 start + 1 + length(regexp_extract(p, '^[A-Za-z@]+(\\[[^\\]]*\\])?\\{{[^{{}}]*\\}}')) AS stop FROM cmd),
env AS (SELECT paper_id, path, a AS name, start, close + 6 + length(a) AS stop, start + 8 + length(a) AS begin_end, close FROM (
 SELECT *, lead(start) OVER (PARTITION BY paper_id, path, a ORDER BY start) AS close FROM arg WHERE name IN ('begin', 'end')) WHERE name = 'begin'),
edge AS (SELECT e.paper_id, e.path, s.path AS target, e.start FROM (
 SELECT paper_id, path, start, replace(regexp_extract(path, '^(.*/)?', 0) || a, 'sections/../', '') AS t FROM arg WHERE name IN ('input', 'include')) e
 JOIN src s ON s.paper_id = e.paper_id AND (s.path = e.t OR s.path = e.t || '.tex')),
walk AS (SELECT paper_id, path, [CAST(0 AS BIGINT)] AS o, [path] AS seen FROM src WHERE path = 'main.tex'
 UNION ALL SELECT w.paper_id, e.target, list_append(w.o, e.start), list_append(w.seen, e.target) FROM walk w JOIN edge e ON e.paper_id = w.paper_id AND e.path = w.path WHERE NOT list_contains(w.seen, e.target)),
fo AS (SELECT paper_id, path, row_number() OVER (PARTITION BY paper_id ORDER BY min(o)) AS file_ord FROM walk GROUP BY paper_id, path),
allfo AS (SELECT * FROM fo UNION ALL SELECT s.paper_id, s.path, coalesce((SELECT max(f.file_ord) FROM fo f WHERE f.paper_id = s.paper_id), 0)
 + row_number() OVER (PARTITION BY s.paper_id ORDER BY s.path) FROM src s WHERE NOT EXISTS (SELECT 1 FROM fo f WHERE f.paper_id = s.paper_id AND f.path = s.path)),
acmd AS (SELECT a.*, f.file_ord FROM arg a JOIN fo f USING (paper_id, path)),
aenv AS (SELECT e.*, f.file_ord FROM env e JOIN fo f USING (paper_id, path))"""


def _rewrite(new: str) -> str:
    """Spark's replacement text (``$1``, escaped dollars and backslashes) as DuckDB's."""
    return re.sub(r"\\\\|\\\$|\$(\d)", lambda m: "$" if m[0] == "\\$" else "\\" + m[1] if m[1] else m[0], new)


def sql(body: str, *more: str, variant: tuple[tuple[str, str], ...] = ()) -> str:
    """A query over the base tables, with further ones (``name AS (...)``) before it.

    With ``variant`` (as in ``Corpus.variant``), ``src`` is the changed corpus and ``plain`` the one before.
    """
    text = "content"
    for old, new in variant:
        text = f"regexp_replace({text}, '{old}', '{_rewrite(new)}', 'g')"
    source = f"plain AS ({derive_sql(False)}),\nsrc AS (SELECT paper_id, path, {text} AS content FROM plain)"
    return "WITH RECURSIVE " + ",\n".join([source, _TABLES, *more]) + "\n" + body


#: Chapters of each paper: the prefix is their number; all papers of chapter scope have one.
CHAPTER = "chap AS (SELECT paper_id, file_ord, start, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY file_ord, start) AS VARCHAR) AS prefix FROM acmd WHERE name = 'chapter')"


def placed(table: str, columns: str) -> str:
    """Rows of ``table`` with the chapter number that they stand in."""
    return f"(SELECT {columns}, (SELECT max(c.prefix) FROM chap c WHERE c.paper_id = t.paper_id AND (c.file_ord, c.start) <= (t.file_ord, t.start)) AS prefix FROM {table} t)"


FLOATS = f"flt AS (SELECT *, row_number() OVER (PARTITION BY paper_id, prefix, float ORDER BY file_ord, start) AS n FROM {placed('aenv', chr(116) + '.*, CASE WHEN name LIKE ' + chr(39) + 'table%' + chr(39) + ' THEN ' + chr(39) + 'table' + chr(39) + ' ELSE ' + chr(39) + 'figure' + chr(39) + ' END AS float')} WHERE name IN ('figure', 'figure*', 'table', 'table*'))"
NUMBER = "coalesce(prefix || '.', '') || n"
EQUATIONS = f"""eqn AS (SELECT *, greatest(1, (SELECT count(*) FROM acmd l WHERE l.name = 'label' AND l.paper_id = e.paper_id AND l.path = e.path AND l.start BETWEEN e.start AND e.stop)) AS taken
 FROM {placed('aenv', 't.*')} e WHERE name IN ('align', 'equation')),
eqb AS (SELECT *, CAST(sum(taken) OVER (PARTITION BY paper_id, prefix ORDER BY file_ord, start) - taken AS BIGINT) AS before FROM eqn),
eql AS (SELECT l.paper_id, l.file_ord, l.start, l.a AS label, e.prefix, e.before + row_number() OVER (PARTITION BY e.paper_id, e.path, e.start ORDER BY l.start) AS n
 FROM eqb e JOIN acmd l ON l.name = 'label' AND l.paper_id = e.paper_id AND l.path = e.path AND l.start BETWEEN e.start AND e.stop)"""
THEOREMS = """thm AS (SELECT *, row_number() OVER (PARTITION BY paper_id, name ORDER BY file_ord, start) AS n, upper(name[1]) || name[2:] AS heading FROM {t} WHERE name IN ('theorem', 'lemma', 'claim'))"""
ALGORITHMS = "alg AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY file_ord, start) AS n FROM {t} WHERE name = 'algorithm')"
APPENDIX = """app0 AS (SELECT c.*, CASE name WHEN 'chapter' THEN 0 WHEN 'section' THEN 1 ELSE 2 END AS level FROM acmd c WHERE name IN ('chapter', 'section', 'subsection')
 AND EXISTS (SELECT 1 FROM acmd x WHERE x.name = 'appendix' AND x.paper_id = c.paper_id AND (x.file_ord, x.start) < (c.file_ord, c.start))),
app1 AS (SELECT *, min(level) OVER (PARTITION BY paper_id) AS top, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id ORDER BY file_ord, start) AS c1 FROM app0),
app2 AS (SELECT *, sum(CASE WHEN level = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id, c1 ORDER BY file_ord, start) AS c2 FROM app1),
app AS (SELECT *, CASE WHEN top = 1 THEN chr(CAST(64 + c1 AS INTEGER)) || CASE WHEN level = 2 THEN '.' || c2 ELSE '' END ELSE chr(CAST(64 + c2 AS INTEGER)) END AS number FROM app2)"""
NUMBERS = f"""lab AS (SELECT * FROM acmd WHERE name = 'label'),
num AS (SELECT paper_id, label, {NUMBER} AS number, 'Equation' AS prefix FROM eql
 UNION ALL SELECT f.paper_id, l.a, coalesce(f.prefix || '.', '') || f.n, upper(f.float[1]) || f.float[2:] FROM flt f JOIN lab l ON l.paper_id = f.paper_id AND l.path = f.path AND l.start BETWEEN f.start AND f.stop
 UNION ALL SELECT t.paper_id, l.a, CAST(t.n AS VARCHAR), t.heading FROM thm t JOIN lab l ON l.paper_id = t.paper_id AND l.path = t.path AND l.start BETWEEN t.start AND t.stop
 UNION ALL SELECT h.paper_id, l.a, h.number, 'Section' FROM app h JOIN lab l ON l.paper_id = h.paper_id AND l.path = h.path AND l.start = h.stop)"""
ALL_NUMBERS = (CHAPTER, FLOATS, EQUATIONS, THEOREMS.format(t="aenv"), APPENDIX, NUMBERS)
REFS = "rf AS (SELECT paper_id, path, file_ord, start, CASE name WHEN 'ref' THEN 'ref' WHEN 'eqref' THEN 'eqref' ELSE 'lower' END AS type, a AS label FROM acmd WHERE name IN ('ref', 'eqref', 'autoref'))"
