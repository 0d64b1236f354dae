"""Numbers of chapters, floats, equations, theorems, algorithms and appendices, and references to them.

``nodes`` have file_ord (see discover.in_order); document order is (file_ord, start) within a paper.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scan import argument
from ..functions.shared import cut
from ..functions.tex import letters
from .discover import TRUSTED, first_by
from .intervals import FILE, contained_in, outermost, texts_of, with_container

MATH = ("align", "equation", "eqnarray", "gather", "multline")
#: What stands before a number, by the kind of its label.
LOWER = {"fig": "Fig. ", "tab": "Table ", "sec": "§", "eq": "Eq. "}
UPPER = {"fig": "Figure ", "tab": "Table ", "sec": "Section ", "eq": "Equation "}
#: Pseudo-code commands that open and close an indentation.
OPENS = ("For", "ForAll", "If", "While", "Loop", "Repeat", "Else", "ElsIf")
CLOSES = ("EndFor", "EndIf", "EndWhile", "EndLoop", "Else", "ElsIf", "Until")
LINES = ("State", "Require", "Ensure", "Return", "Print", *OPENS[:6], *CLOSES)


def _upto(*keys: str):
    return Window.partitionBy(*keys).orderBy("file_ord", "start").rowsBetween(Window.unboundedPreceding, 0)


def _order(*keys: str):
    return Window.partitionBy(*keys).orderBy("file_ord", "start")


def numbering_scope(nodes: DataFrame) -> DataFrame:
    """paper_id, scope: ``chapter`` if a file has a trusted unstarred chapter, else ``global``."""
    chapter = (F.col("kind") == "command") & (F.col("name") == "chapter") & F.expr(TRUSTED) & F.get("arguments", F.lit(0)).isNull()
    return nodes.groupBy("paper_id").agg(F.when(F.bool_or(chapter), F.lit("chapter")).otherwise(F.lit("global")).alias("scope"))


def number_chapters(nodes: DataFrame) -> DataFrame:
    """paper_id, path, file_ord, start, prefix, chapter_group of chapters, in papers of chapter scope.

    Unstarred ones count 1, 2, ...; a starred one whose title begins with capitals and a blank takes those as prefix; other
    starred ones change nothing. Each change begins a group.
    """
    rows = nodes.where(f"kind = 'command' AND name = 'chapter' AND {TRUSTED}").join(numbering_scope(nodes).where("scope = 'chapter'"), "paper_id", "left_semi")
    starred, explicit = F.get("arguments", F.lit(0)).isNotNull(), F.regexp_extract(F.try_element_at("arguments", F.lit(-1))["text"], r"^([A-Z]+)\s+", 1)
    rows = rows.select(*FILE, "file_ord", "start", (~starred).cast("int").alias("counted"), F.when(starred & (explicit != ""), explicit).alias("explicit"))
    rows = rows.withColumn("count", F.sum("counted").over(_upto("paper_id"))).withColumn("changed", F.when((F.col("counted") == 1) | F.col("explicit").isNotNull(), 1).otherwise(0))
    own = F.when(F.col("counted") == 1, F.col("count").cast("string")).otherwise(F.col("explicit"))
    return rows.select(*FILE, "file_ord", "start", F.last(own, ignorenulls=True).over(_upto("paper_id")).alias("prefix"), F.sum("changed").over(_upto("paper_id")).alias("chapter_group"))


def with_chapter(rows: DataFrame, nodes: DataFrame, chapters: DataFrame | None = None) -> DataFrame:
    """``rows`` (paper_id, file_ord, start) with the prefix and group of the chapter that they stand in (null, 0 before any).

    ``chapters``, here and below: number_chapters of the nodes, where several passes need it.
    """
    marks = (number_chapters(nodes) if chapters is None else chapters).select("paper_id", "file_ord", "start", "prefix", "chapter_group")
    both = rows.withColumn("_row", F.lit(True)).unionByName(marks.withColumnsRenamed({"prefix": "_p", "chapter_group": "_g"}), allowMissingColumns=True)
    order = Window.partitionBy("paper_id").orderBy("file_ord", "start", F.coalesce("_row", F.lit(False))).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("prefix", F.last("_p", True).over(order)).withColumn("chapter_group", F.coalesce(F.last("_g", True).over(order), F.lit(0)))
    return both.where("_row").drop("_row", "_p", "_g")


def dotted(prefix: str, number: str) -> Column:
    """prefix.n, or n without a prefix."""
    return F.concat(F.coalesce(F.concat(F.col(prefix), F.lit(".")), F.lit("")), F.col(number).cast("string"))


def floats(nodes: DataFrame) -> DataFrame:
    """Trusted figures and tables that stand in no other: kind_name figure or table."""
    kinds = nodes.where(f"kind = 'environment' AND {TRUSTED} AND name IN ('figure', 'figure*', 'table', 'table*', 'wrapfigure')")
    kinds = kinds.withColumn("float", F.when(F.col("name").startswith("table"), F.lit("table")).otherwise(F.lit("figure")))
    return outermost(kinds, [*FILE, "float"], "node_id")


def number_objects(nodes: DataFrame, chapters: DataFrame | None = None) -> DataFrame:
    """paper_id, path, file_ord, start, end, float, number of figures and tables: a counter per chapter and kind."""
    rows = with_chapter(floats(nodes).select(*FILE, "file_ord", "start", "end", "float"), nodes, chapters)
    rows = rows.withColumn("n", F.row_number().over(_order("paper_id", "chapter_group", "float")))
    return rows.withColumn("number", dotted("prefix", "n")).drop("n", "prefix", "chapter_group")


def in_floats(rows: DataFrame, objects: DataFrame, *columns: str) -> DataFrame:
    """``rows`` in floats, with o_start, o_end, float and ``columns``; one in a figure that is in a table is in both."""
    each = rows.withColumn("float", F.explode(F.array(F.lit("figure"), F.lit("table"))))
    return with_container(each, objects, *columns, keys=[*FILE, "float"])


def float_labels(nodes: DataFrame, chapters: DataFrame | None = None) -> DataFrame:
    """Labels in floats: paper_id, path, file_ord, start, label, float, number, o_start, sub (whether it is a part's).

    The float's own label is the last one; others before the last caption are parts.
    """
    objects = number_objects(nodes, chapters)
    labels = in_floats(argument(nodes, "label").select(*FILE, "file_ord", "start", "end", F.col("arg").alias("label")), objects, "number")
    captions = in_floats(argument(nodes, "caption").select(*FILE, "start", "end"), objects).groupBy(*FILE, "o_start").agg(F.max("start").alias("caption"))
    rows = labels.join(captions, [*FILE, "o_start"], "left")
    last = F.row_number().over(Window.partitionBy(*FILE, "o_start").orderBy(F.desc("start"))) == 1
    return rows.withColumn("sub", ~last & (F.col("start") < F.coalesce("caption", F.lit(0)))).withColumn("own", last).where("own OR sub").drop("caption", "end", "o_end")


def number_subfigures(nodes: DataFrame, chapters: DataFrame | None = None) -> DataFrame:
    """Labels of floats with their numbers, parts with a, b, ...: paper_id, file_ord, start, label, number, prefix."""
    rows = float_labels(nodes, chapters)
    rank = F.row_number().over(Window.partitionBy(*FILE, "o_start", "sub").orderBy("start"))
    rows = rows.withColumn("number", F.when(F.col("sub"), F.concat("number", letters(rank))).otherwise(F.col("number")))
    return rows.select("paper_id", "file_ord", "start", "label", "number", F.initcap("float").alias("prefix"))


def equations(nodes: DataFrame, chapters: DataFrame | None = None) -> DataFrame:
    """Numbered math environments outside subequations with their labels as an array, and the first number of each."""
    envs = nodes.where((F.col("kind") == "environment") & F.col("name").isin(*MATH) & F.expr(TRUSTED))
    labels = with_container(argument(nodes, "label").select(*FILE, "start", "end", F.col("arg").alias("label")), outermost(envs.select(*FILE, "start", "end")))
    listed = labels.groupBy(*FILE, "o_start").agg(F.array_sort(F.collect_list(F.struct("start", "label"))).alias("labels")).withColumnRenamed("o_start", "start")
    rows = envs.select(*FILE, "file_ord", "start", "end").join(listed, [*FILE, "start"], "left")
    groups = outermost(nodes.where(f"kind = 'environment' AND name = 'subequations' AND {TRUSTED}").select(*FILE, "start", "end"))
    sub = contained_in(rows.select(*FILE, "start", "end"), groups).withColumn("sub", F.lit(True))
    rows = rows.join(sub, [*FILE, "start", "end"], "left").withColumn("sub", F.coalesce("sub", F.lit(False)))
    taken = F.when(F.col("sub"), F.lit(1)).otherwise(F.greatest(F.lit(1), F.coalesce(F.size("labels"), F.lit(0))))
    rows = with_chapter(rows.withColumn("taken", taken), nodes, chapters)
    return rows.withColumn("before", F.sum("taken").over(_upto("paper_id", "chapter_group")) - F.col("taken"))


def number_equations(nodes: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Labels of unstarred math environments: the i-th label of one that takes max(1, labels) numbers has the i-th.

    ``found``, here and below: ``equations`` of the nodes, where both passes need it.
    """
    rows = (equations(nodes) if found is None else found).where("NOT sub AND labels IS NOT NULL").select("paper_id", "file_ord", "prefix", "before", F.posexplode("labels").alias("pos", "l"))
    rows = rows.withColumn("n", F.col("before") + F.col("pos") + 1)
    return rows.select("paper_id", "file_ord", F.col("l.start").alias("start"), F.col("l.label").alias("label"), dotted("prefix", "n").alias("number"), F.lit("Equation").alias("prefix"))


def number_subequations(nodes: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Labels in subequations: the parent has its environment's one number, the children that and a, b, ..."""
    groups = outermost(nodes.where(f"kind = 'environment' AND name = 'subequations' AND {TRUSTED}").select(*FILE, "start", "end"))
    math = with_container((equations(nodes) if found is None else found).where("sub"), groups).withColumn("n", F.col("before") + 1).withColumn("number", dotted("prefix", "n"))
    first = math.groupBy(*FILE, "o_start").agg(F.min(F.struct("start", "number")).alias("m"))
    heads = with_container(argument(nodes, "label").select(*FILE, "file_ord", "start", "end", F.col("arg").alias("label")), groups).join(first, [*FILE, "o_start"]).where("start < m.start")
    parent = first_by(heads, [*FILE, "o_start"], "start").select("paper_id", "file_ord", "start", "label", F.col("m.number").alias("number"))
    kids = math.where("labels IS NOT NULL").select("paper_id", "file_ord", "number", F.posexplode("labels").alias("pos", "l"))
    kids = kids.select("paper_id", "file_ord", F.col("l.start").alias("start"), F.col("l.label").alias("label"), F.concat("number", letters(F.col("pos") + 1)).alias("number"))
    return parent.unionByName(kids).withColumn("prefix", F.lit("Equation"))


def number_theorems(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """paper_id, path, file_ord, start, end, environment, heading, n, label: outermost trusted theorems; a counter for each name."""
    named = nodes.where(f"kind = 'environment' AND {TRUSTED}").join(names.select("paper_id", F.col("environment").alias("name"), F.col("label").alias("heading")), ["paper_id", "name"])
    proofs = nodes.where(f"kind = 'environment' AND name = 'proof' AND {TRUSTED}").withColumn("heading", F.lit("Proof"))
    rows = outermost(named.unionByName(proofs, allowMissingColumns=True), FILE, "node_id").where("name <> 'proof'")
    rows = rows.withColumn("n", F.row_number().over(_order("paper_id", "name")))
    label = with_container(argument(nodes, "label").select(*FILE, "start", "end", F.col("arg").alias("label")), rows.select(*FILE, "start", "end")).groupBy(*FILE, "o_start").agg(F.min_by("label", "start").alias("label"))
    out = rows.select(*FILE, "file_ord", "start", "end", F.col("name").alias("environment"), "heading", "n")
    return out.join(label.withColumnRenamed("o_start", "start"), [*FILE, "start"], "left")


def number_algorithms(nodes: DataFrame) -> DataFrame:
    """paper_id, path, file_ord, start, end, n, label: outermost algorithms that hold a trusted algorithmic and nothing untrusted."""
    outer = outermost(nodes.where(f"kind = 'environment' AND name IN ('algorithm', 'algorithm*') AND {TRUSTED}"), FILE, "node_id").select(*FILE, "file_ord", "start", "end")
    parts = with_container(nodes.where("(kind = 'environment' AND name = 'algorithmic') OR kind = 'command'").select(*FILE, "start", "end", "kind", "name", "complete", "opaque", "arguments"), outer)
    good = parts.groupBy(*FILE, "o_start").agg(
        F.bool_and(F.expr(TRUSTED)).alias("ok"), F.bool_or(F.expr(f"kind = 'environment' AND {TRUSTED}")).alias("has"),
        F.min_by(F.when(F.col("name") == "label", F.try_element_at("arguments", F.lit(-1))["text"]), F.when(F.col("name") == "label", F.col("start"))).alias("label"),
    )
    rows = outer.join(good.withColumnRenamed("o_start", "start").where("ok AND has"), [*FILE, "start"])
    return rows.select(*FILE, "file_ord", "start", "end", F.row_number().over(_order("paper_id")).alias("n"), F.trim("label").alias("label"))


def algorithm_lines(nodes: DataFrame, contents: DataFrame) -> DataFrame:
    """Pseudo-code lines: paper_id, path, body (where the algorithmic starts), line, command, text, indent."""
    bodies = outermost(nodes.where(f"kind = 'environment' AND name = 'algorithmic' AND {TRUSTED}").withColumn("end", F.col("body_end")), FILE, "node_id").select(*FILE, "start", "end")
    rows = with_container(nodes.where((F.col("kind") == "command") & F.col("name").isin(*LINES)).select(*FILE, "start", "end", "name", "arguments"), bodies)
    body = Window.partitionBy(*FILE, "o_start").orderBy("start")
    rows = rows.withColumn("until", F.coalesce(F.lead("start").over(body), F.col("o_end")))
    tails = texts_of(rows.select(*FILE, F.col("end").alias("start"), F.col("until").alias("end")), contents)
    tails = tails.select(*FILE, F.col("start").alias("end"), F.col("end").alias("until"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))
    rows = rows.join(tails, [*FILE, "end", "until"])
    opens, closes = F.col("name").isin(*OPENS).cast("int"), F.col("name").isin(*CLOSES).cast("int")
    so_far = body.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("level", F.sum(opens - closes).over(so_far) - opens)
    # the clamp at 0 as a running minimum of the unclamped level
    rows = rows.withColumn("indent", F.col("level") - F.least(F.lit(0), F.min("level").over(so_far)))
    kept = rows.where("NOT (name = 'State' AND text = '')").withColumn("line", F.row_number().over(body))
    return kept.select(*FILE, F.col("o_start").alias("body"), "line", "start", F.col("name").alias("command"), F.get("arguments", F.lit(0))["text"].alias("arg"), "text", "indent")


def number_appendix(nodes: DataFrame) -> DataFrame:
    """paper_id, path, file_ord, start, level, number: headings after the first appendix, A, A.1, ... below its shallowest level."""
    levels = F.create_map(*[x for k, name in enumerate(("chapter", "section", "subsection", "subsubsection")) for x in (F.lit(name), F.lit(k))])
    begin = nodes.where("kind = 'command' AND name = 'appendix'").groupBy("paper_id").agg(F.min(F.struct("file_ord", "start")).alias("a"))
    rows = nodes.where(f"kind = 'command' AND name IN ('chapter', 'section', 'subsection', 'subsubsection') AND {TRUSTED}").where(F.get("arguments", F.lit(0)).isNull())
    rows = rows.join(begin, "paper_id").where(F.struct("file_ord", "start") > F.col("a")).select(*FILE, "file_ord", "start", "end", F.element_at(levels, F.col("name")).alias("level"))
    rows = rows.withColumn("top", F.min("level").over(Window.partitionBy("paper_id")))
    counters = []
    for k in range(4):
        group = f"g{k}"
        rows = rows.withColumn(group, F.sum(F.when(F.col("level") < k, 1).otherwise(0)).over(_upto("paper_id")))
        rows = rows.withColumn(f"c{k}", F.sum(F.when(F.col("level") == k, 1).otherwise(0)).over(_upto("paper_id", group)))
        counters.append(F.when((F.col("top") <= k) & (F.col("level") >= k), F.when(F.col("top") == k, F.upper(letters(F.greatest(F.col(f"c{k}"), F.lit(1))))).otherwise(F.col(f"c{k}").cast("string"))))
    return rows.select(*FILE, "file_ord", "start", "end", "level", F.array_join(F.array(*counters), ".").alias("number"))


def number_headings_explicit(headings: DataFrame) -> DataFrame:
    """``headings`` (text, strong) with prefix and number as the text states them: ``Theorem 3.`` or ``A.1 Title``."""
    strong, plain = r"(?s)^(.*?)\s+(\d+)[\p{Punct}\s]*$", r"^([A-Z]+[.\d]*)\s+"
    number = F.when(F.col("strong"), F.regexp_extract("text", strong, 2)).otherwise(F.regexp_extract("text", plain, 1))
    prefix = F.when(F.col("strong"), F.regexp_extract("text", strong, 1)).otherwise(F.lit("Section"))
    return headings.withColumn("number", F.nullif(number, F.lit(""))).withColumn("prefix", F.when(F.col("number").isNotNull(), prefix))


def heading_labels(headings: DataFrame, labels: DataFrame) -> DataFrame:
    """The label right after each numbered heading, with its number."""
    l = labels.select(*FILE, F.col("start").alias("end"), F.col("start").alias("at"), F.trim(F.try_element_at("arguments", F.lit(-1))["text"]).alias("label"))  # noqa: E741
    return headings.join(l, [*FILE, "end"]).select("paper_id", "file_ord", F.col("at").alias("start"), "label", "number", F.lit("Section").alias("prefix"))


def all_numbers(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """paper_id, label, number, prefix: of repeated labels the last assignment counts (by pass, then document order)."""
    theorems = number_theorems(nodes, names).where("label IS NOT NULL").select("paper_id", "file_ord", "start", "label", F.col("n").cast("string").alias("number"), F.col("heading").alias("prefix"))
    algorithms = number_algorithms(nodes).where("label IS NOT NULL").select("paper_id", "file_ord", "start", "label", F.col("n").cast("string").alias("number"), F.lit("Algorithm").alias("prefix"))
    appendix = heading_labels(number_appendix(nodes), nodes.where("kind = 'command' AND name = 'label'"))
    chapters = cut(number_chapters(nodes), "chapters")
    found = cut(equations(nodes, chapters), "equations")
    passes = [number_equations(nodes, found), number_subequations(nodes, found), number_subfigures(nodes, chapters), theorems, algorithms, appendix]
    ranked = [p.select("paper_id", "label", "number", "prefix", F.lit(k).alias("pass_rank"), "file_ord", "start") for k, p in enumerate(passes)]
    rows = reduce(DataFrame.unionByName, ranked)
    return first_by(rows, ["paper_id", "label"], F.desc("pass_rank"), F.desc("file_ord"), F.desc("start")).select("paper_id", "label", "number", "prefix")


def references(nodes: DataFrame) -> DataFrame:
    """Trusted references: paper_id, path, file_ord, start, type, label."""
    kinds = F.create_map(*map(F.lit, ("ref", "ref", "eqref", "eqref", "autoref", "lower", "cref", "lower", "Autoref", "upper", "Cref", "upper")))
    rows = nodes.where(f"kind = 'command' AND name IN ('ref', 'eqref', 'autoref', 'cref', 'Autoref', 'Cref') AND {TRUSTED}")
    return rows.select(*FILE, "file_ord", "start", F.element_at(kinds, F.col("name")).alias("type"), F.trim(F.try_element_at("arguments", F.lit(-1))["text"]).alias("label"))


def resolve_refs(nodes: DataFrame, numbers: DataFrame) -> DataFrame:
    """``references`` with text: numbers, with prefixes for automatic ones; unresolved ones as [label] or ``link``."""
    rows = references(nodes).join(numbers.select("paper_id", "label", "number", "prefix"), ["paper_id", "label"], "left")
    kind = F.regexp_extract("label", "^(fig|tab|sec|eq):", 1)
    table = lambda m: F.create_map(*[F.lit(x) for pair in m.items() for x in pair])
    own = F.when(F.col("type") == "upper", F.try_element_at(table(UPPER), kind)).otherwise(F.try_element_at(table(LOWER), kind))
    before = F.coalesce(own, F.when(F.col("prefix").isNotNull(), F.concat("prefix", F.lit(" "))), F.lit(""))
    bracket = F.concat(F.lit("["), F.col("label"), F.lit("]"))
    equation = F.col("prefix").eqNullSafe(F.lit("Equation"))
    text = (
        F.when(F.col("type") == "eqref", F.when(equation, F.concat(F.lit("("), F.col("number"), F.lit(")"))).otherwise(bracket))
        .when(F.col("type") == "ref", F.coalesce("number", bracket))
        .when(F.col("number").isNotNull(), F.concat(before, "number"))
        .otherwise(F.concat(F.coalesce(own, F.lit("")), F.lit("link")))
    )
    return rows.select(*FILE, "start", "type", "label", text.alias("text"))


def caption_text(nodes: DataFrame) -> DataFrame:
    """paper_id, path, start, text: the last caption of each float behind its name and number."""
    rows = in_floats(argument(nodes, "caption").select(*FILE, "start", "end", "arg"), number_objects(nodes), "number")
    last = first_by(rows, [*FILE, "o_start"], F.desc("start"))
    return last.select(*FILE, "start", F.concat(F.initcap("float"), F.lit(" "), "number", F.lit(": "), "arg").alias("text"))


def dangling_refs(nodes: DataFrame) -> DataFrame:
    """References whose label stands nowhere in the paper."""
    labels = argument(nodes, "label").select("paper_id", F.col("arg").alias("label")).distinct()
    return references(nodes).join(labels, ["paper_id", "label"], "left_anti")
