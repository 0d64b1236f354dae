"""One linear pass over TeX files that yields all spans with their offsets."""

from __future__ import annotations

import bisect
import re
from collections.abc import Collection, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import spread

#: Commands that cite.
CITES = ("parencite", "textcite", "autocite", "fullcite", "footcite", "citeauthor", "citetitle", "citep", "citet", "Citet", "Citep", "citealt", "citealp", "citenum", "citeyear")

#: Arguments of commands ({ required, [ optional, * star).
MACRO_ARGS = {
    "addtocounter": "{{", "addtolength": "{{", "adjustbox": "{{", "author": "{", "caption": "{", "captionof": "{{", "captionsetup": "*[{",
    "Call": "{{", "ccsdesc": "[{", "chapter": "*[{", "csgdef": "{{", "DeclareMathOperator": "*{{", "DeclareRobustCommand": "*{[[{",
    "DeclareSIUnit": "*[{{", "definecolor": "*[{{{", "ding": "{", "documentclass": "[{", "enlargethispage": "*{", "fancyfoot": "*[{",
    "fancyhead": "*[{", "fancyhf": "*[{", "fixme": "*{", "graphicspath": "{", "hphantom": "*{", "hspace": "*{", "Hy@raisedlink": "{",
    "hyperlink": "{{", "hyperref": "[{", "hypersetup": "*{", "hypertarget": "{{", "include": "{", "includegraphics": "[{", "input": "{",
    "label": "{", "linespread": "*{", "lstdefinestyle": "*{{", "lstset": "*{", "makecell": "*[{", "maketitle": "", "marginpar": "*{",
    "mintinline": "[{{", "multicolumn": "{{{", "newcommand": "*{[[{", "newcounter": "{", "newtheorem": "*{[{[", "pagestyle": "*{",
    "paragraph": "*[{", "pgfplotsset": "*{", "phantom": "*{", "providecommand": "*{[[{", "renewcommand": "*{[[{", "RequirePackage": "[{",
    "resizebox": "*{{{", "section": "*[{", "setcounter": "{{", "setlength": "{{", "sisetup": "*{", "stepcounter": "*{",
    "subsection": "*[{", "subsubsection": "*[{", "tcbset": "*{", "texorpdfstring": "{{", "textcircled": "{", "textsc": "{",
    "title": "[{", "todo": "*{", "usepackage": "[{", "usetikzlibrary": "*{", "vphantom": "*{", "vspace": "*{",
    "ref": "{", "eqref": "{", "autoref": "{", "Autoref": "{", "cref": "{", "Cref": "{", "cite": "[[{", "emph": "{", "textbf": "{", "textit": "{",
    "For": "{", "ForAll": "{", "If": "{", "ElsIf": "{", "While": "{", "Until": "{",
    **{name: "*[[{" for name in CITES},
}
#: Arguments of environments.
ENV_ARGS = {
    "adjustbox": "{", "algorithm": "[", "algorithm*": "[", "algorithmic": "[", "CCSXML": "", "comment": "", "lstlisting": "[",
    "longtable": "[{", "ltablex": "[{", "minipage": "[[[{", "minted": "[{", "NiceTabular": "[{[", "NiceTabular*": "[{[{[",
    "subequations": "", "subfigure": "[{", "tabu": "[{", "tabular": "{", "tabular*": "{", "tabularx": "[{{", "tabulary": "[{{",
    "tblr": "[{", "tikzpicture": "[", "wrapfigure": "[{{", "xltabular": "[{{",
    "theorem": "[", "lemma": "[", "proposition": "[", "corollary": "[", "definition": "[", "example": "[", "remark": "[", "assumption": "[", "claim": "[",
    "conjecture": "[", "observation": "[", "note": "[", "fact": "[", "property": "[", "condition": "[", "hypothesis": "[", "proof": "[",
}
#: Bodies that are text, not TeX.
_RAW = {"verbatim", "lstlisting", "minted", "comment"}
_DEFINES = {"newcommand", "renewcommand", "providecommand", "DeclareRobustCommand", "DeclareMathOperator", "newenvironment", "renewenvironment", "def"}
_TOKEN = re.compile(r"%[^\r\n]*|\\verb(?![A-Za-z@])\*?(?P<d>[^A-Za-z\s*])[^\r\n]*?(?P=d)|\\[A-Za-z@]+|\\(?s:.)|\\\Z|\$\$?|[{}\[\]]")
_GROUP_ONLY, _OPTION_ONLY = r"\{[^\\%{}\[\]]*\}", r"\[[^\\%{}\[\]]*\]"
_FLAT = {"{": re.compile(_GROUP_ONLY), "[": re.compile(_OPTION_ONLY)}
#: Whole calls of a form, where nothing is in their arguments.
_CALLS = {spec: "".join({"*": r"\*?", "[": f"(?:{_OPTION_ONLY})?", "{": _GROUP_ONLY}[kind] for kind in spec) for spec in {*MACRO_ARGS.values()} if spec.endswith("{")}
_OPTION, _GROUP = re.compile(r"[^\S\r\n]*\[[^\]]*\]"), re.compile(r"\s*\{[^{}]*\}")
_NAME = re.compile(r"\s*\{([^{}\\]*)\}")
_BLANK = re.compile(r"(?:[^\S\r\n]|\r?\n(?!\s*?\n))*")

ARGUMENT = "struct<start:int,end:int,text:string,opening:string,closing:string,complete:boolean,opaque:boolean>"
SPANS = (
    "kind string, node_id int, name string, start int, end int, arguments array<" + ARGUMENT + ">, command_token_end int, command_post_space_end int, "
    "begin_token_end int, end_token_start int, body_start int, body_end int, display boolean, opening string, closing string, complete boolean, opaque boolean"
)
_COLUMNS = [c.strip().split(" ")[0] for c in re.sub(r"<.*>", "", SPANS).split(",")]


def _either(names: Collection[str]) -> str:
    """An alternation of names, by their first letters."""
    first: dict[str, list[str]] = {}
    for name in sorted(names, key=len, reverse=True):
        first.setdefault(name[0], []).append(re.escape(name[1:]))
    return "(?:" + "|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in first.items()) + ")(?![A-Za-z@])"


@lru_cache(64)
def _few(only: frozenset[str]) -> re.Pattern:
    """Tokens of a scan for some names alone, behind all that makes none: comments, verbatim, escapes, groups and options without
    anything in them, and commands that nothing asks for and that are whole. Always matches, at the end at last."""
    forms: dict[str, list[str]] = {}
    for name, spec in MACRO_ARGS.items():
        if name not in only and name not in _DEFINES and spec in _CALLS:
            forms.setdefault(spec, []).append(name)
    calls = "".join(rf"\\{_either(names)}{_CALLS[spec]}|" for spec, names in forms.items())
    others = rf"\\(?!{_either({*only, *MACRO_ARGS, *_DEFINES, 'begin', 'end', 'verb'})})[A-Za-z@]+|"
    plain = rf"[^\\%{{}}\[\]]+|{_GROUP_ONLY}|{_OPTION_ONLY}|%[^\r\n]*|\\verb(?![A-Za-z@])\*?(?P<d>[^A-Za-z\s*])[^\r\n]*?(?P=d)|\\(?s:[^A-Za-z@])|\\\Z"
    return re.compile(rf"(?:{calls}{others}{plain})*+(?P<t>\\[A-Za-z@]+|[{{}}\[\]]|\Z)")


def _pairs(text: str, tokens: list[tuple[int, int, str]]) -> dict[int, int]:
    """Place of the closing brace or bracket of each opening one that is closed."""
    stack: list[tuple[str, int]] = []
    out: dict[int, int] = {}
    for start, _, t in tokens:
        if t in ("{", "["):
            stack.append((t, start))
        elif t == "]" and stack and stack[-1][0] == "[":
            out[stack.pop()[1]] = start
        elif t == "}":
            while stack and stack[-1][0] == "[":
                stack.pop()
            if stack:
                out[stack.pop()[1]] = start
    return out


def _tokens(text: str, env_args: dict[str, str], few: list[tuple[int, int]] | None = None, only: frozenset[str] = frozenset(MACRO_ARGS)) -> list[tuple[int, int, str]]:
    """Tokens by start. Bodies that are text have none: after the arguments of their environment the search goes on at its
    end (or stops, without one). With ``few``, which takes up those bodies, only what ``_few`` leaves of commands and braces."""
    out: list[tuple[int, int, str]] = []
    at, body, until = 0, -1, -1
    pattern, group = (_TOKEN, 0) if few is None else (_few(only), 2)
    while True:
        again = -1
        for m in pattern.finditer(text, at):
            start = m.start(group)
            if 0 <= body <= start:
                again = until
                break
            t = m.group(group)
            if not t:
                continue
            out.append((start, m.end(), t))
            if t == "\\begin" and body < 0:
                named = _NAME.match(text, m.end())
                name = named.group(1).strip() if named else ""
                if name in _RAW:
                    body = named.end()
                    for kind in env_args.get(name, ""):
                        arg = (_OPTION if kind == "[" else _GROUP).match(text, body)
                        body = arg.end() if arg else body
                    until = text.find("\\end{" + name + "}", body)
                    until = len(text) if until < 0 else until
                    if few is not None:
                        few.append((body, until))
        else:
            if body < 0:
                return out
            again = until
        at, body = again, -1


_CLOSING = {"$": "$", "$$": "$$", "\\(": "\\)", "\\[": "\\]"}


def math_in(text: str) -> list[tuple[int, int, str, str | None]]:
    """Math of a text by start: start, end, and the delimiters; the closing one of unclosed math is None."""
    if "$" not in text and "\\(" not in text and "\\[" not in text:
        return []
    out, opened = [], None
    for start, end, t in _tokens(text, ENV_ARGS):
        if opened is None:
            if t in _CLOSING:
                opened = (t, start)
        elif t == _CLOSING[opened[0]]:
            out.append((opened[1], end, opened[0], t))
            opened = None
    if opened is not None:
        out.append((opened[1], len(text), opened[0], None))
    return out


def scan_rows(text: str, macro_args: dict[str, str] = MACRO_ARGS, env_args: dict[str, str] = ENV_ARGS, only: frozenset[str] | None = None, untrusted: bool = False) -> list[list]:
    """Spans of one file in the columns of SPANS, by start: commands, environments, math, comments and environment tokens.

    An argument is (start, end, text, opening, closing, complete, opaque). Commands and environments inside an opaque one
    are opaque, as ``intervals.mark_opaque`` has it for other tables.

    With ``only``, commands and environments of these names alone, which node_id then counts; nothing is made of the others
    but what tells whether these are trusted. With ``untrusted`` also every command and environment that is opaque.
    """
    bodies: list[tuple[int, int]] = []
    if only is None:
        tokens = _tokens(text, env_args)
    else:  # a paper's own macros may have arguments, so all commands count where there are some
        tokens = _tokens(text, env_args, bodies, only if macro_args is MACRO_ARGS else frozenset({*only, *macro_args}))
    closing = _pairs(text, [t for t in tokens if len(t[2]) == 1])
    by_start: dict[int, int] = {}
    spans: list[list] = []
    n = len(text)

    def in_body(p: int) -> bool:
        return any(a <= p < b for a, b in bodies[max(0, bisect.bisect_right(bodies, (p, n)) - 1) :][:1])

    def argument(at: int, kind: str) -> tuple[tuple | None, int]:
        """The argument of a form at or after a place, and where it ends."""
        if kind == "*":
            return ((at, at + 1, "*", "", "", True, False), at + 1) if text[at : at + 1] == "*" else (None, at)
        p, opening = at, text[at : at + 1]
        if opening.isspace():
            p = _BLANK.match(text, at).end()
            opening = text[p : p + 1]
        if opening == ("[" if kind == "[" else "{"):
            end = closing.get(p)
            if end is None and only is not None:
                flat = _FLAT[opening].match(text, p)
                end = flat.end() - 1 if flat and not (bodies and in_body(p)) else None
            whole = end is not None
            stop = end + 1 if whole else n
            return (p, stop, text[p + 1 : end if whole else n], opening, "]" if kind == "[" else "}", whole, not whole), stop
        if kind == "[":
            return None, at
        if p >= n or opening in "}]%":
            return (at, at, "", "", "", False, True), at
        stop = p + 1
        if opening == "\\" and only is not None:
            stop = stop if bodies and in_body(p) else _TOKEN.match(text, p).end()
        elif opening == "\\":
            if not by_start:
                by_start.update((t[0], t[1]) for t in tokens)
            stop = by_start.get(p, stop)
        return (p, stop, text[p:stop], "", "", True, False), stop

    def arguments(at: int, spec: str) -> tuple[list[tuple | None], int, bool]:
        found = []
        for kind in spec:
            a, at = argument(at, kind)
            found.append(a)
            if a is not None and not a[5]:
                return found, at, False
        return found, at, True

    open_envs: list[list] = []
    named: dict[str, int] = {}  # how many environments of a name are open
    math: tuple[str, int] | None = None
    masked = 0
    for start, end, t in tokens:
        first = t[0]
        if first == "%":
            if only is None:
                spans.append(["comment", 0, None, start, end, None, None, None, None, None, None, None, None, None, None, True, False])
        elif t in _CLOSING or t == "\\)" or t == "\\]":
            if only is not None:
                continue
            if math is None:
                if t in _CLOSING:
                    math = (t, start)
            elif t == _CLOSING[math[0]]:
                spans.append(["math", 0, None, math[1], end, None, None, None, None, None, None, None, t in ("$$", "\\]"), math[0], t, True, False])
                math = None
        elif first != "\\" or len(t) < 2:
            continue
        elif t == "\\begin" or t == "\\end":
            m = _NAME.match(text, end)
            if m is None:
                continue
            name, stop = m.group(1).strip(), m.end()
            if only is None:
                spans.append(["env_token", 0, name, start, stop, None, None, None, None, None, None, None, None, None, None, True, False])
            if start < masked:
                continue
            if t == "\\begin":
                args, body, whole = arguments(stop, env_args.get(name, ""))
                # complete holds whether the arguments are, until the environment ends
                env = ["environment", 0, name, start, n, args, None, None, stop, None, body, n, None, None, None, whole, True]
                spans.append(env)
                open_envs.append(env)
                named[name] = named.get(name, 0) + 1
            elif named.get(name):
                while True:
                    env = open_envs.pop()
                    named[env[2]] -= 1
                    if env[2] == name:
                        break
                env[4], env[9], env[11], env[16] = stop, start, start, not env[15]
        elif t.startswith("\\verb") and not t[-1].isalpha():
            if only is None or "verb" in only:
                spans.append(["command", 0, "verb", start, end, [], end, end, None, None, None, None, None, None, None, True, False])
        elif t[1].isalpha() or t[1] == "@":
            name = t[1:]
            spec = macro_args.get(name)
            if only is not None and not spec and name not in only:
                continue  # it is whole, and nothing asks for it
            args, stop, whole = arguments(end, spec) if spec else ([], end, True)
            if name in _DEFINES:
                masked = max(masked, stop)
            if only is None or name in only or not whole:
                behind = _BLANK.match(text, end).end() if stop == end and text[end : end + 1].isspace() else end
                spans.append(["command", 0, name, start, stop, args, end, behind, None, None, None, None, None, None, None, whole, not whole])
    if math is not None:
        spans.append(["math", 0, None, math[1], n, None, None, None, None, None, None, None, math[0] in ("$$", "\\["), math[0], None, False, False])
    for env in open_envs:
        env[15] = False
    if only is not None:
        spans = [s for s in spans if s[16] or s[2] in only]
    spans.sort(key=_PLACE)
    reach = -1  # the farthest end of what is opaque so far: nodes up to there are opaque, too
    for k, s in enumerate(spans):
        s[1] = k
        if s[16]:
            s[15] = False  # also an environment that another one's end has closed
            reach = max(reach, s[4])
        elif reach >= s[4] and s[0] in _NODES:
            s[16] = True
    if only is not None:
        if untrusted and reach >= 0:
            return [s for s in scan_rows(text, macro_args, env_args) if s[0] in _NODES and (s[16] or s[2] in only)]
        spans = [s for s in spans if s[2] in only]
        for k, s in enumerate(spans):
            s[1] = k
    return spans


_NODES = ("command", "environment")


def _PLACE(span: list) -> tuple[int, int]:
    return span[3], -span[4]


def scan_text(text: str, macro_args: dict[str, str] = MACRO_ARGS, env_args: dict[str, str] = ENV_ARGS) -> list[dict]:
    """``scan_rows`` by name, without what a kind does not have."""
    names = [c.split(":")[0] for c in ARGUMENT[len("struct<") : -1].split(",")]
    out = []
    for row in scan_rows(text, macro_args, env_args):
        span = {c: x for c, x in zip(_COLUMNS, row) if x is not None or c in ("complete", "opaque")}
        if "arguments" in span:
            span["arguments"] = [a and dict(zip(names, a)) for a in span["arguments"]]
        out.append(span)
    return out


def _argument_column(lists: list[list[tuple | None] | None], kind: pa.ListType) -> pa.Array:
    """Lists of arguments as one Arrow column, from flat columns."""
    ends, flat = [0], []
    for args in lists:
        if args:
            flat += args
        ends.append(len(flat))
    none = (0, 0, None, None, None, None, None)
    fields = list(kind.value_type)
    parts = list(zip(*(none if a is None else a for a in flat))) or [()] * len(fields)
    held = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(parts, fields)], fields=fields, mask=pa.array([a is None for a in flat], pa.bool_()))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held, type=kind, mask=pa.array([x is None for x in lists], pa.bool_()))


def span_arrays(rows: list[list], types: dict[str, pa.DataType]) -> list[pa.Array]:
    """Rows of ``scan_rows`` as Arrow columns: those of SPANS that ``types`` has, in that order."""
    columns = list(zip(*rows)) or [()] * len(_COLUMNS)
    return [_argument_column(x, types[c]) if c == "arguments" else pa.array(x, types[c]) for c, x in zip(_COLUMNS, columns) if c in types]


def scan_spans(sources: DataFrame, macro_args: dict[str, str] | None = None, env_args: dict[str, str] | None = None, forms: DataFrame | None = None, keep: Collection[str] | None = None, untrusted: bool = False) -> DataFrame:
    """All spans of all files: one narrow pass, null contents as empty. ``filter(kind = ...)`` gives a table of one kind.

    With ``keep``, only spans of these kinds, or commands and environments of these names, leave the scan, as they are in the
    whole table. With ``untrusted`` they are commands and environments of these names and of ``forms``' environments, and
    every opaque one; their node_id only has their order.

    ``forms`` (paper_id, macro_args and env_args: maps of a name to its arguments, as from ``discover.own_forms``) are a paper's
    own; the library's names keep theirs.
    """
    macros, envs = MACRO_ARGS | (macro_args or {}), ENV_ARGS | (env_args or {})
    key = sources.schema["paper_id"].dataType
    schema = f"paper_id {key.simpleString()}, path string, {SPANS}"
    types = {f.name: to_arrow_type(f.dataType) for f in sources.sparkSession.createDataFrame([], schema).schema}

    formed, names = forms is not None, frozenset(keep or ())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, own = None, (macros, envs)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part, rows, sizes = batch.slice(i, 64), [], []
                given = part.column("_forms").to_pylist() if formed else None
                for k, text in enumerate(part.column("content").to_pylist()):
                    if given is not None and given[k] != before:
                        before = given[k]
                        own = (dict(before["m"] or ()) | macros, dict(before["e"] or ()) | envs) if before else (macros, envs)
                    if untrusted:
                        found = scan_rows(text or "", *own, only=names if own[1] is envs else names.union(own[1]), untrusted=True)
                    else:
                        found = scan_rows(text or "", *own)
                    if keep is not None and not untrusted:
                        found = [r for r in found if (r[2] in keep if r[0] in _NODES else False) or r[0] in keep]
                    rows += found
                    sizes.append(len(found))
                at = pa.array(np.repeat(np.arange(part.num_rows), sizes))
                arrays = [part.column("paper_id").take(at), part.column("path").take(at), *span_arrays(rows, types)]
                yield pa.RecordBatch.from_arrays(arrays, names=list(types))

    if not formed:
        return spread(sources.select("paper_id", "path", "content"), "paper_id", "path").mapInArrow(scan, schema)
    given = forms.select("paper_id", F.struct(F.col("macro_args").alias("m"), F.col("env_args").alias("e")).alias("_forms"))
    return spread(sources.select("paper_id", "path", "content"), "paper_id").join(given, "paper_id", "left").mapInArrow(scan, schema)


def rescan(sources: DataFrame, spans: DataFrame, forms: DataFrame) -> DataFrame:
    """``spans`` with those of the papers that have own forms scanned again; the others stay as they are."""
    own = forms.select("paper_id")
    return spans.join(own, "paper_id", "left_anti").unionByName(scan_spans(sources.join(own, "paper_id", "left_semi"), forms=forms))


def nodes_of(spans: DataFrame) -> DataFrame:
    """Commands and environments."""
    return spans.where("kind IN ('command', 'environment')")


def argument(nodes: DataFrame, name: str, index: int = -1) -> DataFrame:
    """Trusted commands of a name with their argument ``index`` (from 0; the last by default) as ``arg``, trimmed."""
    pick = F.try_element_at("arguments", F.lit(-1 if index < 0 else index + 1))
    return nodes.where((F.col("kind") == "command") & (F.col("name") == name) & F.col("complete") & ~F.col("opaque")).withColumn("arg", F.trim(pick["text"]))
