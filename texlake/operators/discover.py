"""Facts about papers: main files, includes, macros, packages, labels, titles, resources."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.macros import title_text
from ..functions.scan import ENV_ARGS, MACRO_ARGS, argument
from ..functions.shared import cut
from .intervals import FILE

#: Names of the environments that count as theorems.
THEOREMS = {
    "theorem": "Theorem", "lemma": "Lemma", "proposition": "Proposition", "corollary": "Corollary", "definition": "Definition",
    "example": "Example", "remark": "Remark", "assumption": "Assumption", "claim": "Claim", "conjecture": "Conjecture",
    "observation": "Observation", "note": "Note", "fact": "Fact", "property": "Property", "condition": "Condition", "hypothesis": "Hypothesis",
}
TRUSTED = "complete AND NOT opaque"


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def find_main(sources: DataFrame, nodes: DataFrame) -> DataFrame:
    """paper_id, main_path: the first path with a trusted document class or document environment, else the first path."""
    documents = nodes.where(f"{TRUSTED} AND ((kind = 'command' AND name = 'documentclass') OR (kind = 'environment' AND name = 'document'))")
    marked = sources.select(*FILE).join(documents.select(*FILE).distinct().withColumn("has", F.lit(True)), FILE, "left")
    return marked.groupBy("paper_id").agg(F.coalesce(F.min(F.when(F.col("has"), F.col("path"))), F.min("path")).alias("main_path"))


def normal_path(path: Column) -> Column:
    """A relative path without ``.`` and with ``..`` taken back; null if it leaves the root."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    step = lambda a, p: F.when(a.isNull(), a).when(p != "..", F.concat(a, F.array(p))).when(F.size(a) > 0, F.slice(a, F.lit(1), F.size(a) - 1))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*/)[^/]*$", 1)


def include_edges(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """paper_id, path, target, start of inputs whose target exists, as it is named or with ``.tex``, beside its file."""
    wanted = argument(nodes, "input").unionByName(argument(nodes, "include")).where("arg <> ''")
    tried = wanted.select(*FILE, "start", F.posexplode(F.array(F.col("arg"), F.concat("arg", F.lit(".tex")))).alias("try", "named"))
    tried = tried.withColumn("target", normal_path(F.concat(directory(F.col("path")), "named")))
    there = tried.join(sources.select("paper_id", F.col("path").alias("target")), ["paper_id", "target"])
    return first_by(there, [*FILE, "start"], "try").select(*FILE, "target", "start")


def resolve_inputs(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """paper_id, path, start, target, root: trusted inputs (with ``.tex`` or without) that name one of the included ``files``.

    Two roots are tried, and the first that has the file counts: 0, the input's own directory, and 1, the longest common
    directory of the paper's files. All candidates meet the files in one equi-join.
    """
    wanted = argument(nodes, "input").unionByName(argument(nodes, "include")).where("arg <> ''").select(*FILE, "start", F.when(F.endswith("arg", F.lit(".tex")), F.col("arg")).otherwise(F.concat("arg", F.lit(".tex"))).alias("named"))
    roots = F.array(directory(F.col("path")), F.when(F.col("common") == "", F.lit("")).otherwise(F.concat("common", F.lit("/"))))
    tried = wanted.join(common_root(files).withColumnRenamed("root", "common"), "paper_id").select(*FILE, "start", "named", F.posexplode(roots).alias("root", "base"))
    tried = tried.select(*FILE, "start", "root", normal_path(F.concat("base", "named")).alias("target"))
    there = tried.join(files.select("paper_id", F.col("path").alias("target")), ["paper_id", "target"])
    return first_by(there, [*FILE, "start"], "root").select(*FILE, "start", "target", "root")


def include_order(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """paper_id, path, file_ord: depth-first from the main file, each file once; cycles end.

    The least simple path of inputs that leads to a file orders files as a depth-first walk does. The frontier, files
    whose path the last round has found or bettered, is all that a round extends by an edge and writes; what is settled is
    only compared. Ends when the frontier is empty.
    """
    hop = edges.withColumn("n", F.row_number().over(Window.partitionBy(*FILE).orderBy("start")))
    hop = cut(hop.select("paper_id", F.col("path").alias("source"), "target", "n"), "hops")
    empty = F.array().cast("array<int>")
    frontier = cut(papers.select("paper_id", F.col("main_path").alias("path"), empty.alias("order_path"), F.array("main_path").alias("seen")), "frontier")
    known = frontier.select(*FILE, "order_path")
    while True:  # ends: paths are simple, so there is a best one for each file
        grown = frontier.withColumnRenamed("path", "source").join(hop, ["paper_id", "source"]).where(~F.array_contains("seen", F.col("target")))
        grown = grown.select("paper_id", F.col("target").alias("path"), F.concat("order_path", F.array("n")).alias("order_path"), F.concat("seen", F.array("target")).alias("seen"))
        best = known.groupBy(*FILE).agg(F.min("order_path").alias("_best"))
        better = first_by(grown, FILE, "order_path").join(best, FILE, "left").where("_best IS NULL OR order_path < _best").drop("_best")
        frontier = cut(better, "frontier")
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier.select(*FILE, "order_path"))
    settled = known.groupBy(*FILE).agg(F.min("order_path").alias("order_path"))
    return settled.select(*FILE, F.row_number().over(Window.partitionBy("paper_id").orderBy("order_path")).alias("file_ord"))


def file_order(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Included files first, then the others by path."""
    rest = detached_files(files, sources)
    count = files.groupBy("paper_id").agg(F.max("file_ord").alias("_n"))
    later = rest.join(count, "paper_id", "left").select(*FILE, (F.coalesce("_n", F.lit(0)) + F.row_number().over(Window.partitionBy("paper_id").orderBy("path"))).alias("file_ord"))
    return files.select(*FILE, "file_ord").unionByName(later)


def detached_files(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Files that the main file doesn't reach."""
    return sources.select(*FILE).join(files.select(*FILE), FILE, "left_anti")


def in_order(nodes: DataFrame, order: DataFrame) -> DataFrame:
    """``nodes`` of the ordered files, with ``file_ord``."""
    return nodes.join(order.select(*FILE, "file_ord"), FILE)


def macro_definitions(nodes: DataFrame) -> DataFrame:
    """paper_id, name, body, parameter_count, optional_default, math_operator (``nodes`` with file_ord); the first counts."""
    kinds = ["newcommand", "renewcommand", "providecommand", "DeclareRobustCommand", "DeclareMathOperator"]
    a = lambda k: F.get("arguments", F.lit(k))["text"]
    operator = F.col("name") == "DeclareMathOperator"
    rows = nodes.where((F.col("kind") == "command") & F.col("name").isin(kinds) & F.expr(TRUSTED)).select(
        "paper_id", "file_ord", "start", operator.alias("math_operator"), F.trim(a(1)).alias("name"),
        F.when(operator, a(2)).otherwise(a(4)).alias("body"), F.when(~operator, F.trim(a(2))).alias("count"), F.when(~operator, a(3)).alias("optional_default"),
    )
    rows = rows.where(F.col("name").rlike(r"^\\[A-Za-z@]+$") & (F.col("count").isNull() | F.col("count").rlike("^[0-9]$")))
    rows = rows.withColumn("parameter_count", F.coalesce(F.col("count").cast("int"), F.lit(0))).where("optional_default IS NULL OR parameter_count > 0")
    body = F.replace("body", F.lit("\\xspace"), F.lit(""))
    return first_by(rows, ["paper_id", "name"], "file_ord", "start").select("paper_id", "name", body.alias("body"), "parameter_count", "optional_default", "math_operator")


def own_forms(nodes: DataFrame) -> DataFrame:
    """paper_id, macro_args, env_args: the argument forms of a paper's own macros and theorems, for ``scan_spans``.

    A macro has as many arguments as its first definition says, the first one optional if it has a default; an environment
    of a newtheorem takes an optional title. Names that the scan knows anyway are left out. ``nodes`` have file_ord.
    """
    form = F.concat(F.when(F.col("optional_default").isNotNull(), "[").otherwise(""), F.repeat(F.lit("{"), F.col("parameter_count") - F.col("optional_default").isNotNull().cast("int")))
    macros = macro_definitions(nodes).where("parameter_count > 0").where(~F.substr("name", F.lit(2)).isin(*MACRO_ARGS)).groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct(F.substr("name", F.lit(2)), form))).alias("macro_args"))
    own = nodes.where(f"kind = 'command' AND name = 'newtheorem' AND {TRUSTED}").select("paper_id", F.trim(F.get("arguments", F.lit(1))["text"]).alias("name")).where("name <> ''").where(~F.col("name").isin(*ENV_ARGS)).distinct()
    environments = own.groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("name", F.lit("[")))).alias("env_args"))
    return macros.join(environments, "paper_id", "full")


def packages(nodes: DataFrame) -> DataFrame:
    """paper_id, package, ord: distinct names of package lists in first-seen order (of a file, usepackage comes first)."""
    rank = F.when(F.col("name") == "usepackage", 0).otherwise(1)
    rows = nodes.where(f"kind = 'command' AND name IN ('usepackage', 'RequirePackage') AND {TRUSTED}")
    items = rows.select("paper_id", "file_ord", rank.alias("rank"), "start", F.posexplode(F.split(F.try_element_at("arguments", F.lit(-1))["text"], ",")).alias("pos", "package"))
    items = items.withColumn("package", F.trim("package")).where("package <> ''")
    first = items.groupBy("paper_id", "package").agg(F.min(F.struct("file_ord", "rank", "start", "pos")).alias("f"))
    return first.select("paper_id", "package", F.row_number().over(Window.partitionBy("paper_id").orderBy("f")).alias("ord"))


def graphics_paths(nodes: DataFrame) -> DataFrame:
    """paper_id, search: ``.``, ``figures``, ``images`` and the distinct graphics paths in first-seen order."""
    groups = argument(nodes, "graphicspath").select("paper_id", "file_ord", "start", F.posexplode(F.regexp_extract_all("arg", F.lit(r"\{([^{}]*)\}"), 1)).alias("pos", "dir"))
    first = groups.withColumn("dir", F.regexp_replace(F.trim("dir"), "/+$", "")).where("dir <> ''").groupBy("paper_id", "dir").agg(F.min(F.struct("file_ord", "start", "pos")).alias("f"))
    own = first.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "dir"))), lambda x: x["dir"]).alias("dirs"))
    return own.select("paper_id", F.array_union(F.array(F.lit("."), F.lit("figures"), F.lit("images")), "dirs").alias("search"))


def resource_refs(nodes: DataFrame) -> DataFrame:
    """Every image reference in document order: paper_id, path, file_ord, start, ref."""
    return argument(nodes, "includegraphics").select(*FILE, "file_ord", "start", F.col("arg").alias("ref"))


def label_index(nodes: DataFrame) -> DataFrame:
    """paper_id, label, path, start: the first place of each label."""
    rows = argument(nodes, "label").where("arg <> ''").select(*FILE, "file_ord", "start", F.col("arg").alias("label"))
    return first_by(rows, ["paper_id", "label"], "file_ord", "start").select("paper_id", "label", "path", "start")


def theorem_names(nodes: DataFrame, papers: DataFrame) -> DataFrame:
    """paper_id, environment, label: built-in names under the first newtheorem of each."""
    spark = nodes.sparkSession
    builtin = spark.createDataFrame(list(THEOREMS.items()), "environment string, label string")
    base = papers.select("paper_id").join(F.broadcast(builtin))  # sixteen rows
    own = nodes.where(f"kind = 'command' AND name = 'newtheorem' AND {TRUSTED}").select("paper_id", "file_ord", "start", F.trim(F.get("arguments", F.lit(1))["text"]).alias("environment"), F.trim(F.get("arguments", F.lit(3))["text"]).alias("_own"))
    own = first_by(own.where("environment <> ''"), ["paper_id", "environment"], "file_ord", "start").select("paper_id", "environment", "_own")
    return base.join(own, ["paper_id", "environment"], "full").select("paper_id", "environment", F.coalesce("_own", "label").alias("label"))


def paper_title(nodes: DataFrame, papers: DataFrame, macros: DataFrame) -> DataFrame:
    """paper_id, title: the first complete title of the main file, cleaned (``macros.title_text``), with macros expanded."""
    main = papers.select("paper_id", F.col("main_path").alias("path"))
    first = argument(nodes, "title").join(main, FILE).groupBy("paper_id").agg(F.min_by(F.try_element_at("arguments", F.lit(-1))["text"], "start").alias("title"))
    known = macros.groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("body", "parameter_count", "optional_default", "math_operator")))).alias("macros"))

    @F.pandas_udf("string")
    def shown(titles: pd.Series, tables: pd.Series) -> pd.Series:
        return pd.Series([t if t is None else title_text(t, {k: (v["body"], v["parameter_count"], v["optional_default"], v["math_operator"]) for k, v in dict(m or {}).items()}) for t, m in zip(titles, tables)])

    return first.join(known, "paper_id", "left").select("paper_id", shown("title", "macros").alias("title"))


def paper_authors(nodes: DataFrame, papers: DataFrame) -> DataFrame:
    """paper_id, ord, author: names of the first author command of the main file."""
    main = papers.select("paper_id", F.col("main_path").alias("path"))
    first = argument(nodes, "author").join(main, FILE).groupBy("paper_id").agg(F.min_by(F.try_element_at("arguments", F.lit(-1))["text"], "start").alias("a"))
    line = F.regexp_replace(F.split("a", r"\\\\", 2)[0], r"\$?\^\{[^{}]*\}\$?|\\[A-Za-z@]+\*?(?:\{[^{}]*\})?|[{}$]", "")
    names = F.filter(F.transform(F.split(line, ","), lambda n: F.trim(n)), lambda n: n.rlike(r"\p{L}"))
    return first.select("paper_id", F.posexplode(names).alias("ord", "author"))


def paper_abstract(nodes: DataFrame, papers: DataFrame, sources: DataFrame) -> DataFrame:
    """paper_id, abstract: the body of the first trusted abstract of the main file."""
    main = papers.select("paper_id", F.col("main_path").alias("path"))
    found = nodes.where(f"kind = 'environment' AND name = 'abstract' AND {TRUSTED}").join(main, FILE)
    first = found.groupBy(*FILE).agg(F.min_by(F.struct("body_start", "body_end"), "start").alias("b"))
    return first.join(sources, FILE).select("paper_id", F.trim(F.substring(F.col("content"), F.col("b.body_start") + 1, F.col("b.body_end") - F.col("b.body_start"))).alias("abstract"))


def resolve_resources(refs: DataFrame, resources: DataFrame) -> DataFrame:
    """``refs`` (paper_id, path, ref, ...) with ``resource``: the path beside the file; else, for a ref with a directory, the
    only path that ends in it; else, for a bare name, the only path of that name."""
    base = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    wanted = refs.select("paper_id", "path", "ref").distinct().withColumn("base", base(F.col("ref")))
    wanted = wanted.withColumn("beside", normal_path(F.concat(directory(F.col("path")), "ref")))
    known = resources.select("paper_id", F.col("path").alias("resource")).distinct().withColumn("base", base(F.col("resource")))
    nested = F.col("ref").contains("/")
    fits = F.when(nested, F.endswith(F.col("resource"), F.col("ref"))).otherwise(True)
    tiers = wanted.join(known, ["paper_id", "base"]).groupBy("paper_id", "path", "ref").agg(
        F.max(F.when(F.col("resource") == F.col("beside"), F.col("resource"))).alias("exact"),
        F.sum(F.when(fits, 1).otherwise(0)).alias("n"),
        F.max(F.when(fits, F.col("resource"))).alias("only"),
    )
    found = tiers.select("paper_id", "path", "ref", F.coalesce("exact", F.when(F.col("n") == 1, F.col("only"))).alias("resource"))
    return refs.join(found, ["paper_id", "path", "ref"], "left")


def common_root(files: DataFrame) -> DataFrame:
    """paper_id, root: the longest common directory of a paper's files ('' for the top)."""
    dirs = F.filter(F.split(F.regexp_replace(directory(F.col("path")), "/$", ""), "/"), lambda d: d != "")
    ends = files.select("paper_id", dirs.alias("d")).groupBy("paper_id").agg(F.min("d").alias("a"), F.max("d").alias("b"))
    step = lambda s, p: F.when(s["on"] & p["a"].eqNullSafe(p["b"]) & p["a"].isNotNull(), F.struct(F.lit(True).alias("on"), F.concat(s["d"], F.array(p["a"])).alias("d"))).otherwise(F.struct(F.lit(False).alias("on"), s["d"].alias("d")))
    start = F.struct(F.lit(True).alias("on"), F.array().cast("array<string>").alias("d"))
    return ends.select("paper_id", F.aggregate(F.arrays_zip("a", "b"), start, step, lambda s: F.array_join(s["d"], "/")).alias("root"))


def paper_facts(nodes: DataFrame, papers: DataFrame, sources: DataFrame, order: DataFrame) -> DataFrame:
    """One row per paper with all of the above as arrays and maps (``nodes`` with file_ord)."""
    listed = lambda df, key, value: df.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v")))), lambda x: x["v"]))
    macros = macro_definitions(nodes)
    labels = label_index(nodes).groupBy("paper_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", F.struct("path", "start"))))).alias("labels"))
    theorems = theorem_names(nodes, papers).groupBy("paper_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("environment", "label")))).alias("theorem_labels"))
    refs = resource_refs(nodes).groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("file_ord", "start", "path", "ref"))), lambda r: F.struct(r["path"].alias("path"), r["ref"].alias("ref"))).alias("resource_refs"))
    parts = [
        paper_title(nodes, papers, macros), listed(paper_authors(nodes, papers), "ord", "author").toDF("paper_id", "authors"), paper_abstract(nodes, papers, sources),
        macros.groupBy("paper_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "body")))).alias("macros")),
        listed(packages(nodes), "ord", "package").toDF("paper_id", "packages"), listed(order, "file_ord", "path").toDF("paper_id", "include_order"),
        graphics_paths(nodes).withColumnRenamed("search", "graphicspaths"), refs, labels, theorems,
    ]
    out = papers
    for part in parts:
        out = out.join(part, "paper_id", "left")
    return out
