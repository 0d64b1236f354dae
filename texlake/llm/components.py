"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


#: Links of sixteen bytes that one task takes at once.
FEW = 50_000


def _ties(*ends: tuple[str, str]):
    """A row of (a, b) for each of the ends: of one plan, where a union would have the whole of it twice."""
    return F.inline(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ends]))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: each node's (smaller or larger) neighbours are tied to its least neighbour."""
    both = edges.select(_ties(("a", "b"), ("b", "a"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    tied = both.join(least, "a")
    out = tied.where(F.col("b") > F.col("a")).select(_ties(("b", "m"))) if large else tied.select(_ties(("b", "m"), ("a", "m")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of ``links`` (a, b long; null ends and loops are ignored).

    A link table of at most FEW rows (a megabyte) is worked through in one task, without shuffles; a larger one in
    all of them. Every step is a written table. Hot nodes cost map-side combines and joins that Spark splits. An empty link table
    gives an empty result; repeated links count once.
    """
    edges = written(links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), "links")
    few = edges.count() <= FEW
    before = None
    while True:  # the steps grow with the logarithm of the longest chain
        for large in (True, False):  # written between the two, which keeps plans small
            old, edges = edges, written(_star(edges.coalesce(1) if few else edges, large), "stars")
            drop(old)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    named = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return named.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
