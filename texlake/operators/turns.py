"""Turns of a clean-up over files that carry their nodes: one row a file, so that no turn moves, joins or writes a file again.

A turn's edits are a column of the row, made of its nodes. The turn itself is narrow: edits are settled and applied, and
what they changed is scanned for the names that later turns read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from ..functions.scan import ARGUMENT, scan_rows, span_arrays
from .intervals import FILE

NODE = {
    "kind": "string", "node_id": "int", "name": "string", "start": "int", "end": "int", "arguments": f"array<{ARGUMENT}>", "command_token_end": "int",
    "begin_token_end": "int", "end_token_start": "int", "body_start": "int", "body_end": "int", "complete": "boolean", "opaque": "boolean",
}
_NODES = "array<struct<" + ",".join(f"{k}:{v}" for k, v in NODE.items()) + ">>"
_EDITS = "array<struct<start:int,end:int,replacement:string,pass_name:string,safety:string,how:string>>"
_EDIT = ("start", "end", "replacement", "pass_name", "safety", "how")


def edit(start: Column, end: Column, replacement: Column | str, name: str, safety: str = "safe", how: str | None = None) -> Column:
    """An edit as a value. ``how`` names a function of ``turned`` that has the last word on its range and text."""
    text = F.lit(replacement) if isinstance(replacement, str) else replacement
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), text.alias("replacement"), F.lit(name).alias("pass_name"), F.lit(safety).alias("safety"), F.lit(how).cast("string").alias("how"))


def of_nodes(kind: str, names: Collection[str], *edits: Callable[[Column], Column], also: Callable[[Column], Column] | None = None) -> Column:
    """The edits of each trusted node of a kind and some names, from the column ``nodes``."""
    wanted = lambda n: (n["kind"] == kind) & n["name"].isin(*names) & n["complete"] & ~n["opaque"]
    picked = F.filter("nodes", wanted if also is None else lambda n: wanted(n) & also(n))
    if len(edits) == 1:
        return F.transform(picked, edits[0])
    return F.flatten(F.transform(picked, lambda n: F.array(*(e(n) for e in edits))))


def _order(e: tuple) -> tuple:
    return e[0], -e[1], e[3], e[2] or ""


def settled(edits: list[tuple]) -> list[tuple]:
    """As ``rewrite.settle``, of the edits of one file: the outermost, and of several inserts at a place one."""
    wide, inserts, reached, behind = [], {}, -1, -1
    for e in sorted(set(edits), key=_order):
        if e[0] < e[1]:
            if reached < e[1]:
                if behind <= e[0]:
                    wide.append(e)
                behind = max(behind, e[1])
            reached = max(reached, e[1])
        elif e[0] == e[1]:
            inserts.setdefault(e[0], e)
    if not inserts:
        return wide
    out, k, reach = list(wide), 0, -1
    for at, e in sorted(inserts.items()):
        while k < len(wide) and wide[k][0] < at:
            reach = max(reach, wide[k][1])
            k += 1
        if reach <= at:
            out.append(e)
    return sorted(out, key=lambda e: (e[0], e[1]))


def rewritten(text: str | None, edits: list[tuple]) -> str | None:
    """The text after settled edits that are not fallbacks; as it is if one of them is out of its range."""
    done = [e for e in edits if e[4] in ("safe", "lossy")]
    if text is None or any(e[0] < 0 or e[1] > len(text) for e in done):
        return text
    out, at = [], 0
    for e in done:
        out += (text[at : e[0]], e[2] or "")
        at = e[1]
    return "".join(out) + text[at:]


def mentions(names: Collection[str]) -> re.Pattern:
    """Matches in every text that has a command or an environment of some names, and in few others."""
    either = "|".join(re.escape(n) for n in sorted(names))
    return re.compile(rf"\\(?:{either})(?![A-Za-z@])|\\begin\s*\{{\s*(?:{either})\s*\}}")


def turned(files: DataFrame, keep: Collection[str], edits: Column | None = None, how: dict[str, Callable[[str, tuple], tuple | None]] | None = None, again: bool = False, untrusted: bool = False) -> DataFrame:
    """``files`` (paper_id, path, content) after a turn, with ``nodes`` of the names in ``keep`` and ``passes``, those that had
    edits in a file in this turn or before, and ``changed``: whether this turn did.

    Without ``edits`` the files are scanned alone. A file without edits keeps its nodes, unless ``again``; one that names
    nothing in ``keep`` has none and is not scanned. With ``untrusted`` also opaque nodes of other names are kept.
    """
    key = files.schema["paper_id"].dataType
    rows = files.withColumn("edits", F.lit(None).cast(_EDITS) if edits is None else edits)
    rows = rows.select(*FILE, "content", *(F.col(c) if c in files.columns else F.lit(None).cast(t).alias(c) for c, t in (("nodes", _NODES), ("passes", "array<string>"))), "edits")
    some = F.coalesce(F.size("edits") > 0, F.lit(False))
    rows = rows.select(*FILE, "content", F.when(~some & F.lit(not again), F.col("nodes")).alias("nodes"), "passes", "edits")
    kind = to_arrow_type(_parse_datatype_string(_NODES))
    types = {f.name: f.type for f in kind.value_type}
    names, hows = frozenset(keep), how or {}
    named = mentions(names) if names else None

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, min(256, (16 << 20) * batch.num_rows // max(1, batch.nbytes)))  # long files go by fewer
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                texts, held = part.column("content").to_pylist(), part.column("nodes")
                passes, lists = part.column("passes").to_pylist(), part.column("edits")
                flat = pc.list_flatten(lists)
                every = list(zip(*(flat.field(c).to_pylist() for c in _EDIT)))
                has = held.is_valid().to_pylist()
                found, ends, pick, changed, at = [], [0], [], [], 0
                for k, size in enumerate(pc.list_value_length(lists).to_pylist()):
                    text, new = texts[k], texts[k]
                    if size:
                        mine = settled([x for e in every[at : at + size] for x in ([e] if e[5] is None else [hows[e[5]](text, e)]) if x is not None])
                        at += size
                        passes[k] = sorted({*(passes[k] or ()), *(e[3] for e in mine)})
                        new = texts[k] = rewritten(text, mine)
                    changed.append(new != text)
                    if has[k]:
                        pick.append(k)
                        continue
                    pick.append(len(texts) + len(ends) - 1)
                    if named is not None and new and named.search(new):
                        found += scan_rows(new, only=names, untrusted=untrusted)
                    ends.append(len(found))
                nodes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(span_arrays(found, types), fields=[pa.field(n, t) for n, t in types.items()]))
                nodes = nodes.cast(kind)
                nodes = pa.concat_arrays([held.cast(kind), nodes]).take(pa.array(pick, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("paper_id"), part.column("path"), pa.array(texts, pa.string()), nodes, pa.array(passes, pa.list_(pa.string())), pa.array(changed, pa.bool_())], names=[*FILE, "content", "nodes", "passes", "changed"])

    return rows.mapInArrow(turn, f"paper_id {key.simpleString()}, path string, content string, nodes {_NODES}, passes array<string>, changed boolean")


def nodes_in(files: DataFrame) -> DataFrame:
    """The nodes of the files as rows, in the columns of NODE."""
    return files.select(*FILE, F.explode("nodes").alias("_n")).select(*FILE, "_n.*")
