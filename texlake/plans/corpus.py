"""The tables of a corpus that queries share, each made when it is first asked for."""

from __future__ import annotations

from collections.abc import Collection
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scan import nodes_of, rescan, scan_spans
from ..functions.shared import cut
from ..operators import discover
from ..sources.corpus import derive_sources


#: What tells main files and inputs, and what defines macros and theorems.
STRUCTURE = ("documentclass", "document", "input", "include")
DEFINITIONS = ("newcommand", "renewcommand", "providecommand", "DeclareRobustCommand", "DeclareMathOperator", "newtheorem")


class Corpus:
    """Scan once, clustered by paper, then everything else from the written spans."""

    def __init__(self, spark: SparkSession, sf_dir: str, sources: DataFrame | None = None, keep: Collection[str] | None = None):
        self.keep = keep
        self.spark, self.sf_dir, self.plain = spark, sf_dir, derive_sources(spark, sf_dir) if sources is None else sources

    def variant(self, *pairs: tuple[str, str]) -> Corpus:
        """The corpus with other constructs: regular expressions and what they give way to (``oracles.sql`` takes the same)."""
        text = F.col("content")
        for old, new in pairs:
            text = F.regexp_replace(text, old, new)
        return Corpus(self.spark, self.sf_dir, self.__dict__.get("sources", self.plain).withColumn("content", text))

    def only(self, *names: str) -> Corpus:
        """The corpus with spans of some kinds or names alone, and those of its papers and inputs: the rest is not written."""
        narrow = Corpus(self.spark, self.sf_dir, self.plain, {*names, *STRUCTURE})
        if "sources" in self.__dict__:
            narrow.__dict__["sources"] = self.sources
        return narrow

    @cached_property
    def sources(self) -> DataFrame:
        """The files, written once: deriving them costs as much as a scan. ``plain`` is for those that read them once."""
        return cut(self.plain, "sources")

    @cached_property
    def spans(self) -> DataFrame:
        return cut(scan_spans(self.__dict__.get("sources", self.plain), keep=self.keep), "spans")

    @cached_property
    def nodes(self) -> DataFrame:
        return nodes_of(self.spans)

    @cached_property
    def environments(self) -> DataFrame:
        return self.spans.where("kind = 'environment'")

    def commands(self, *names: str) -> DataFrame:
        return self.spans.where((F.col("kind") == "command") & F.col("name").isin(*names))

    @cached_property
    def papers(self) -> DataFrame:
        return cut(discover.find_main(self.sources, self.nodes), "papers")

    @cached_property
    def edges(self) -> DataFrame:
        return discover.include_edges(self.nodes, self.sources)

    @cached_property
    def files(self) -> DataFrame:
        """Included files in order."""
        papers = self.papers  # first: with it the sources are written, which the scan then reads
        return cut(discover.include_order(cut(self.edges, "edges"), papers), "files")

    @cached_property
    def order(self) -> DataFrame:
        """All files in order."""
        return discover.file_order(self.files, self.sources)

    @cached_property
    def included(self) -> DataFrame:
        """Nodes of the included files, with file_ord."""
        files = self.files
        return cut(discover.in_order(self.nodes, files), "included")

    @cached_property
    def ordered(self) -> DataFrame:
        """Nodes of all files, with file_ord."""
        order = self.order
        return cut(discover.in_order(self.nodes, order), "ordered")

    @cached_property
    def own(self) -> Corpus:
        """The same corpus, scanned again with the papers' own macros and theorems."""
        scanned, sources = "spans" in self.__dict__, self.sources
        first = self
        if not scanned:
            # definitions alone are written of the first scan: most papers have some and are scanned again anyway
            first = self.only(*DEFINITIONS)
        forms = cut(discover.own_forms(first.ordered), "forms")
        spans = rescan(sources, self.spans, forms) if scanned else scan_spans(sources, forms=forms)
        again = Corpus(self.spark, self.sf_dir, sources)
        again.__dict__ |= {"sources": sources, "spans": cut(spans, "spans"), "papers": first.papers, "files": first.files, "order": first.order}
        return again

    @cached_property
    def macros(self) -> DataFrame:
        return discover.macro_definitions(self.ordered)
