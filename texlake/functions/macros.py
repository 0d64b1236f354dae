"""Expansion of macros in short strings, and titles as a reader sees them."""

from __future__ import annotations

import re

#: Commands that a title is shown without, those of the first row with their argument.
NOTES = ("blfootnote", "footnote", "footnotetext", "thanks", "vspace", "hspace")
STYLES = ("Huge", "huge", "LARGE", "Large", "large", "normalsize", "small", "footnotesize", "scriptsize", "tiny", "bigskip", "medskip", "smallskip")
_DROPPED = re.compile(r"\\\\|\\(?:(?P<note>" + "|".join(NOTES) + r")\*?(?![A-Za-z@])\s*(?=\{)|(?:" + "|".join(STYLES) + r")(?![A-Za-z@]))")


def closing(text: str, at: int) -> int | None:
    """The place of the brace that closes the one at ``at``; escaped ones don't count."""
    depth, k = 0, at
    while k < len(text):
        if text[k] == "\\":
            k += 2
            continue
        depth += (text[k] == "{") - (text[k] == "}")
        if depth == 0:
            return k
        k += 1
    return None


def without_notes(text: str) -> str:
    """``text`` without notes (whatever braces they hold), skips and sizes; what is not closed stays."""
    out, at = [], 0
    for m in _DROPPED.finditer(text):
        if m.start() < at or m.group() == "\\\\":
            continue
        end = m.end() - 1
        if m.group("note"):
            end = closing(text, m.end())
            if end is None:
                continue
        out.append(text[at : m.start()])
        at = end + 1
    return "".join(out) + text[at:]


def title_text(raw: str, macros: dict[str, tuple[str, int, str | None, bool]]) -> str:
    """A title's text: no notes, macros expanded, line breaks as blanks, commands unwrapped five times, no braces."""
    text = expand(re.sub(r"\\\\(?:\[[^\]]*\])?", " ", without_notes(raw)), macros)
    text = without_notes(text)
    for _ in range(5):
        text = re.sub(r"\\[A-Za-z@]+\*?\{([^{}]*)\}", r"\1", text)
    return " ".join(re.sub(r"[{}]", "", text).split())


def filled(body: str, values: list[str], operator: bool = False) -> str | None:
    """A macro's body with its parameters; None if it asks for more than there are."""
    if any(int(n) > len(values) for n in re.findall(r"#([1-9])", body.replace("##", ""))):
        return None
    new = re.sub(r"##|#([1-9])", lambda r: "#" if r.group() == "##" else values[int(r.group(1)) - 1], body)
    return "\\operatorname{" + new + "}" if operator else new


def expand(text: str, macros: dict[str, tuple[str, int, str | None, bool]], depth: int = 5) -> str:
    """``text`` with known macros expanded, the outermost first, until nothing changes or ``depth`` rounds are done.

    Calls with too few arguments stay, as do those of macros whose body asks for more parameters than they have.
    Comments and what follows ``\\\\`` are no calls.
    """
    if not macros:
        return text
    token = re.compile(r"%[^\r\n]*|(?P<name>" + "|".join(re.escape(n) + r"(?![A-Za-z@])" for n in sorted(macros, key=len, reverse=True)) + r")|\\(?s:.)")
    single = re.compile(r"\\[A-Za-z@]+|\\(?s:.)|[^{}\[\]%\\]")

    def group(at: int, opening: str, closing: str) -> int | None:
        level, k = 0, at
        while k < len(text):
            if text[k] == "\\":
                k += 2
                continue
            level += (text[k] == opening) - (text[k] == closing)
            if level == 0:
                return k
            k += 1
        return None

    def values_of(k: int, count: int, default: str | None) -> tuple[list[str], int]:
        """The arguments after a name (fewer than ``count`` if one is missing), and where they end."""
        values: list[str] = []
        if count and default is not None:
            end = group(k, "[", "]") if text[k : k + 1] == "[" else None
            values.append(default if end is None else text[k + 1 : end])
            k = k if end is None else end + 1
        while len(values) < count:
            while text[k : k + 1].isspace():
                k += 1
            one = single.match(text, k)
            end = group(k, "{", "}") if text[k : k + 1] == "{" else None
            if end is not None:
                values.append(text[k + 1 : end])
                k = end + 1
            elif one:
                values.append(one.group())
                k = one.end()
            else:
                break
        return values, k

    for _ in range(depth):
        out, at = [], 0
        for m in token.finditer(text):
            if m.start() < at or m.group("name") is None:
                continue
            body, count, default, operator = macros[m.group("name")]
            values, k = values_of(m.end(), count, default)
            new = filled(body, values, operator) if len(values) == count else None
            if new is None:
                continue
            out += [text[at : m.start()], new]
            at = k
        grown = "".join(out) + text[at:]
        if grown == text:
            break
        text = grown
    return text
