"""Operators on ranges [start, end) under key columns; most take any DataFrame that has those."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILE = ["paper_id", "path"]


def _before(keys: list[str], *order: Column | str):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def outermost(df: DataFrame, keys: list[str] = FILE, tie: str | None = None) -> DataFrame:
    """Rows that no other row contains; of equal ranges the first by ``tie``. Crossing ranges stay.

    A running maximum, not a join: linear in the rows of a file, whatever nests in what.
    """
    reached = F.max("end").over(_before(keys, F.col("start"), F.desc("end"), F.col(tie or "start")))
    return df.withColumn("_m", reached).where(F.col("_m").isNull() | (F.col("_m") < F.col("end"))).drop("_m")


def merge_ranges(df: DataFrame, keys: list[str] = FILE) -> DataFrame:
    """Overlapping and touching ranges as one; empty ones go."""
    rows = df.where("start < end").select(*keys, "start", "end")
    reached = F.max("end").over(_before(keys, "start", "end"))
    breaks = rows.withColumn("_b", F.when(reached.isNull() | (F.col("start") > reached), 1).otherwise(0))
    island = F.sum("_b").over(Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0))
    return breaks.withColumn("_i", island).groupBy(*keys, "_i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_i")


def _swept(df: DataFrame, ranges: DataFrame, keys: list[str], ties_first: bool) -> DataFrame:
    """``df`` with ``_reach``: the greatest end of the ranges that begin before each row's start (or, with ``ties_first``, at it).

    Both sides in one order and a running maximum: linear in a file's rows and ranges, without a join.
    """
    marks = ranges.select(*keys, "start", F.col("end").alias("_e"), F.lit(False).alias("_q"))
    both = df.withColumn("_q", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    order = (F.col("start"), F.col("_q") if ties_first else F.desc("_q"))
    reach = F.max("_e").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_reach", reach).where("_q").drop("_q", "_e")


def contained_in(df: DataFrame, ranges: DataFrame, keys: list[str] = FILE) -> DataFrame:
    """Rows inside some range."""
    return _swept(df, ranges, keys, True).where(F.col("_reach") >= F.col("end")).drop("_reach")


def not_contained_in(df: DataFrame, ranges: DataFrame, keys: list[str] = FILE) -> DataFrame:
    """Rows inside no range."""
    return _swept(df, ranges, keys, True).where(F.col("_reach").isNull() | (F.col("_reach") < F.col("end"))).drop("_reach")


def not_overlapping(df: DataFrame, ranges: DataFrame, keys: list[str] = FILE) -> DataFrame:
    """Rows that share no character with any range; an empty row is met by a range around its place."""
    some = ranges.where("start < end")
    behind = _swept(df, some, keys, False).where(F.col("_reach").isNull() | (F.col("_reach") <= F.col("start"))).drop("_reach")
    # the next range that begins at or after a row's start must begin at or after its end
    marks = some.select(*keys, "start", F.col("start").alias("_s"), F.lit(False).alias("_q"))
    both = behind.withColumn("_q", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    ahead = F.min("_s").over(Window.partitionBy(*keys).orderBy(F.desc("start"), "_q").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_next", ahead).where("_q").where(F.col("_next").isNull() | (F.col("_next") >= F.col("end"))).drop("_next", "_q", "_s")


def not_cut(points: DataFrame, ranges: DataFrame, keys: list[str] = FILE) -> DataFrame:
    """Rows whose ``start`` is strictly inside no range of ``ranges``, which must be disjoint."""
    return _swept(points, ranges, keys, False).where(F.col("_reach").isNull() | (F.col("_reach") <= F.col("start"))).drop("_reach")


def with_container(df: DataFrame, ranges: DataFrame, *columns: str, keys: list[str] = FILE) -> DataFrame:
    """The rows inside a range of ``ranges``, which must be disjoint, with that range's o_start, o_end and ``columns``."""
    held = F.struct(F.col("start").alias("o_start"), F.col("end").alias("o_end"), *columns)
    marks = ranges.select(*keys, "start", held.alias("_o"), F.lit(False).alias("_q"))
    both = df.withColumn("_q", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    last = F.last("_o", True).over(Window.partitionBy(*keys).orderBy("start", "_q").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_o", last).where(F.col("_q") & (F.col("end") <= F.col("_o.o_end"))).select(*df.columns, "_o.*")


def _kinds(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def _listed(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("s"), F.col("end").cast("int").alias("e")))).alias(name))


def texts_of(ranges: DataFrame, contents: DataFrame, keys: list[str] = FILE, cuts: DataFrame | None = None) -> DataFrame:
    """``ranges`` (different ones) with ``text``: their characters of the file, without what merged ``cuts`` cover.

    A file's content meets all its ranges at once, so a file costs its length and its ranges' lengths. Null contents are
    empty; ranges beyond a file's end stop there.
    """
    files = _listed(ranges.select(*keys, "start", "end").distinct(), keys, "_r").join(contents.select(*keys, F.col("content").alias("_text")), keys)
    files = files.join(_listed(cuts, keys, "_c"), keys, "left") if cuts is not None else files.withColumn("_c", F.expr("cast(null as array<struct<s:int,e:int>>)"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                text = row.column("_text")[0].as_py() or ""
                holes = [(c["s"], c["e"]) for c in row.column("_c")[0].as_py() or ()]
                ends = [e for _, e in holes]
                starts, stops, found = [], [], []
                for r in row.column("_r")[0].as_py():
                    at, parts = r["s"], []
                    j = bisect.bisect_right(ends, r["s"])
                    while j < len(holes) and holes[j][0] < r["e"]:
                        parts.append(text[at : max(at, holes[j][0])])
                        at = max(at, holes[j][1])
                        j += 1
                    parts.append(text[at : max(at, r["e"])])
                    starts.append(r["s"])
                    stops.append(r["e"])
                    found.append("".join(parts))
                named = [row.column(c).take(pa.array([0] * len(found), pa.int32())) for c in keys]
                yield pa.RecordBatch.from_arrays([*named, pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), pa.array(found, pa.string())], names=[*keys, "start", "end", "text"])

    return files.select(*keys, "_text", "_r", "_c").mapInArrow(pieces, f"{_kinds(ranges, keys)}, start int, end int, text string")


def _without(text: str, start: int, end: int, begins: list[int], ends: list[int]) -> str:
    """The characters of a range outside some ordered, disjoint ranges."""
    j = bisect.bisect_right(ends, start)
    if j == len(begins) or begins[j] >= end:
        return text[start : max(start, end)]
    parts = []
    while j < len(begins) and begins[j] < end:
        parts.append(text[start : max(start, begins[j])])
        start = max(start, ends[j])
        j += 1
    return "".join(parts) + text[start : max(start, end)]


def sliced(df: DataFrame, contents: DataFrame, keys: list[str] = FILE, **cuts: DataFrame) -> DataFrame:
    """``df`` with a text of each row's range for every name in ``cuts``: without what those ranges (any) cover.

    As ``slice_without``, but several texts come from one pass over a file, and the rows travel with their ranges, so
    that nothing is joined back and ``df`` is computed once.
    """
    carried = [c for c in df.columns if c not in keys]
    item = F.struct(F.col("start").cast("int").alias("_s"), F.col("end").cast("int").alias("_e"), *carried)
    files = df.where("start IS NOT NULL AND end IS NOT NULL").groupBy(*keys).agg(F.collect_list(item).alias("_r")).join(contents.select(*keys, F.col("content").alias("_content")), keys)
    names = list(cuts)
    for name, ranges in cuts.items():
        files = files.join(_listed(merge_ranges(ranges, keys), keys, f"_cut_{name}"), keys, "left")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, min(64, (32 << 20) * batch.num_rows // max(1, batch.nbytes)))  # long files go by fewer
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                lists = part.column("_r")
                of, flat = pc.list_parent_indices(lists), pc.list_flatten(lists)
                texts, sizes = [t or "" for t in part.column("_content").to_pylist()], pc.list_value_length(lists).to_pylist()
                starts, ends = flat.field("_s").to_pylist(), flat.field("_e").to_pylist()
                found = []
                for name in names:
                    holes = part.column(f"_cut_{name}")
                    spots = pc.list_flatten(holes)
                    begins, stops = spots.field("s").to_pylist(), spots.field("e").to_pylist()
                    at = hole = 0
                    out: list[str] = []
                    for text, n, m in zip(texts, sizes, pc.list_value_length(holes).to_pylist()):
                        some = hole + (m or 0)
                        b, e = begins[hole:some], stops[hole:some]
                        out += [_without(text, starts[k], ends[k], b, e) for k in range(at, at + n)]
                        at, hole = at + n, some
                    found.append(pa.array(out, pa.string()))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(of) for c in keys), *(flat.field(c) for c in carried), *found], names=[*keys, *carried, *names])

    kinds = _kinds(df, [*keys, *carried])
    return files.select(*keys, "_content", "_r", *(f"_cut_{name}" for name in names)).mapInArrow(pieces, ", ".join([kinds, *(f"{name} string" for name in names)]))


_ALONE = re.compile(r"[ \t]*\r?\n")


def line_of(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The line of a range that stands alone on it but for blanks, with its line end; else None."""
    behind = _ALONE.match(text, end)
    while start and text[start - 1] in " \t":
        start -= 1
    return (start, behind.end()) if behind and (start == 0 or text[start - 1] == "\n") else None


def alone_on_line(ranges: DataFrame, contents: DataFrame) -> DataFrame:
    """The ranges of files that have a line of their own but for blanks, with line_start and line_end (behind its line end).

    As in ``texts_of``, a file's content meets all its ranges at once; only the blanks around a range are read.
    """
    files = _listed(ranges.select(*FILE, "start", "end").distinct(), FILE, "_r").join(contents.select(*FILE, F.col("content").alias("_text")), FILE)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                text, found = row.column("_text")[0].as_py() or "", []
                for r in row.column("_r")[0].as_py():
                    line = line_of(text, r["s"], r["e"])
                    if line:
                        found.append((r["s"], r["e"], *line))
                named = [row.column(c).take(pa.array([0] * len(found), pa.int32())) for c in FILE]
                yield pa.RecordBatch.from_arrays([*named, *(pa.array([f[j] for f in found], pa.int32()) for j in range(4))], names=[*FILE, "start", "end", "line_start", "line_end"])

    return files.select(*FILE, "_text", "_r").mapInArrow(lines, f"{_kinds(ranges, FILE)}, start int, end int, line_start int, line_end int")


def slice_without(df: DataFrame, contents: DataFrame, ranges: DataFrame, keys: list[str] = FILE) -> DataFrame:
    """``df`` with ``text``: the file's characters of each row's range, with ``ranges`` cut out."""
    return df.join(texts_of(df, contents, keys, merge_ranges(ranges, keys)), [*keys, "start", "end"])


def smallest_container(df: DataFrame, ranges: DataFrame, keys: list[str] = FILE, strict: bool = False) -> DataFrame:
    """``df`` with ``container``: the shortest range (start, end, name) around each row, null without one.

    One pass over the rows and ranges of a file in order, with a stack of the ranges that are open; of equally short ones
    the first counts. ``strict`` leaves out ranges equal to the row.
    """
    kind = f"struct<{', '.join(f'{c}:{ranges.schema[c].dataType.simpleString()}' for c in ('start', 'end', 'name'))}>"
    rows = df.select(*keys, "start", "end").distinct().select(*keys, "start", "end", F.lit(1).alias("_q"), F.expr(f"cast(null as {kind})").alias("_r"))
    around = ranges.select(*keys, "start", "end", F.lit(0).alias("_q"), F.struct("start", "end", "name").alias("_r"))
    ordered = rows.unionByName(around).repartition(*keys).sortWithinPartitions(*keys, "start", F.desc("end"), "_q")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, open_ranges = None, []
        for batch in batches:
            of = list(zip(*(batch.column(c).to_pylist() for c in keys)))
            asked, found = [], []
            for k, (name, start, end, q, r) in enumerate(zip(of, *(batch.column(c).to_pylist() for c in ("start", "end", "_q", "_r")))):
                if name != file:
                    file, open_ranges = name, []
                while open_ranges and open_ranges[-1]["end"] < start:
                    open_ranges.pop()
                if not q:
                    open_ranges.append(r)
                    continue
                best = None
                for o in reversed(open_ranges):
                    if o["end"] < end or (strict and (o["start"], o["end"]) == (start, end)):
                        continue
                    if best is None or (o["end"] - o["start"], o["start"]) < (best["end"] - best["start"], best["start"]):
                        best = o
                    if best is not None and o["start"] < end - (best["end"] - best["start"]):
                        break  # those below began so early that they are longer
                asked.append(k)
                found.append(best)
            columns = [batch.column(c).take(pa.array(asked, pa.int64())) for c in (*keys, "start", "end")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, batch.schema.field("_r").type)], names=[*keys, "start", "end", "container"])

    held = ordered.mapInArrow(find, f"{_kinds(df, [*keys, 'start', 'end'])}, container {kind}")
    return df.join(held, [*keys, "start", "end"], "left")


def parent_environment(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the name of the innermost environment strictly around each."""
    found = smallest_container(nodes, nodes.where("kind = 'environment'"), FILE, strict=True)
    return found.withColumn("parent_environment", F.col("container.name")).drop("container")


def until_next(events: DataFrame, contents: DataFrame, keys: list[str] = FILE, body_end: Column | None = None) -> DataFrame:
    """``events`` with ``until`` and ``tail``: the characters from an event's end to the next event (or the body's end)."""
    following = F.lead("start").over(Window.partitionBy(*keys).orderBy("start", "end"))
    rows = events.withColumn("until", following)
    if body_end is None:
        rows = rows.join(contents.select(*FILE, F.length("content").alias("_n")), FILE).withColumn("until", F.coalesce("until", "_n")).drop("_n")
    else:
        rows = rows.withColumn("until", F.coalesce("until", body_end))
    tails = texts_of(rows.select(*FILE, F.col("end").alias("start"), F.col("until").alias("end")), contents)
    return rows.join(tails.select(*FILE, F.col("start").alias("end"), F.col("end").alias("until"), F.col("text").alias("tail")), [*FILE, "end", "until"])


def adjacent_label(headings: DataFrame, labels: DataFrame, contents: DataFrame) -> DataFrame:
    """``headings`` with ``attach``: where text goes that follows a heading and its label, if only blanks and comments
    stand between the two and the label is trusted; else the heading's own end."""
    both = headings.select(*FILE, "start", "end", F.lit(0).alias("_l"), F.lit(True).alias("_ok")).unionByName(labels.select(*FILE, "start", "end", F.lit(1).alias("_l"), (F.col("complete") & ~F.col("opaque")).alias("_ok")))
    # a label behind another heading doesn't touch this one, so the next row tells
    following = F.lead(F.struct("start", "end", "_l", "_ok")).over(Window.partitionBy(*FILE).orderBy("start", "_l"))
    near = both.withColumn("_n", following).where("_l = 0").select(*FILE, "start", "end", "_n")
    held = near.where("_n._l = 1 AND _n._ok AND _n.start >= end").select(*FILE, "start", "end", "_n")
    gaps = texts_of(held.select(*FILE, F.col("end").alias("start"), F.col("_n.start").alias("end")), contents)
    gaps = gaps.where(F.regexp_replace("text", r"%[^\r\n]*", "").rlike(r"\A\s*\z")).select(*FILE, F.col("start").alias("end"), F.col("end").alias("_to"))
    touching = held.withColumn("_to", F.col("_n.start")).join(gaps, [*FILE, "end", "_to"]).select(*FILE, "start", "end", F.col("_n.end").alias("attach"))
    return headings.join(touching, [*FILE, "start", "end"], "left").withColumn("attach", F.coalesce("attach", "end"))


def cut_points_to_ranges(points: DataFrame, forbid: DataFrame, keys: list[str] = FILE) -> DataFrame:
    """Ranges between neighbouring points; points inside ``forbid`` give way to its own ends."""
    merged = merge_ranges(forbid, keys)
    free = not_cut(points.select(*keys, F.col("at").alias("start")), merged, keys).withColumnRenamed("start", "at")
    ends = merged.select(*keys, F.explode(F.array("start", "end")).alias("at"))
    every = free.unionByName(ends).distinct()
    return every.withColumn("end", F.lead("at").over(Window.partitionBy(*keys).orderBy("at"))).where("end IS NOT NULL").withColumnRenamed("at", "start")


def mark_opaque(nodes: DataFrame) -> DataFrame:
    """``opaque`` also for every node inside an opaque one's range."""
    order = (F.col("start"), F.desc("end"), F.col("node_id"))
    reached = F.max(F.when(F.col("opaque"), F.col("end"))).over(_before(FILE, *order))
    return nodes.withColumn("opaque", F.col("opaque") | F.coalesce(reached >= F.col("end"), F.lit(False)))
