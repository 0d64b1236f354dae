"""Column expressions on TeX text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_comments(text: Column) -> Column:
    """Without comments: from a % that no odd run of backslashes escapes to the end of its line; the line break stays."""
    return F.regexp_replace(text, r"(?<!\\)((?:\\\\)*)%[^\r\n]*", "$1")


def balanced_braces(text: Column) -> Column:
    """Whether every closing brace has its opening one before it and none stays open; escaped braces don't count."""
    braces = F.split(F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), r"[^{}]", ""), "")
    step = lambda a, c: F.struct(
        (a["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("depth"),
        (a["ok"] & ((c != "}") | (a["depth"] > 0))).alias("ok"),
    )
    return F.aggregate(braces, F.struct(F.lit(0).alias("depth"), F.lit(True).alias("ok")), step, lambda a: a["ok"] & (a["depth"] == 0))


def newline_style(text: Column) -> Column:
    """CRLF if the text has any, else LF."""
    return F.when(F.contains(text, F.lit("\r\n")), F.lit("\r\n")).otherwise(F.lit("\n"))


def normalize_newlines(text: Column, newline: Column) -> Column:
    """All line ends of ``text`` as ``newline``."""
    return F.replace(F.regexp_replace(text, "\r\n|\r", "\n"), F.lit("\n"), newline)


def letters(number: Column) -> Column:
    """1 is a, 26 is z, 27 is aa; up to three letters."""
    n = number - 1
    digit = lambda x: F.chr(F.lit(97) + F.pmod(x, F.lit(26)).cast("int"))
    second, third = F.floor(n / 26) - 1, F.floor((F.floor(n / 26) - 1) / 26) - 1
    return F.concat(F.when(third >= 0, digit(third)).otherwise(""), F.when(second >= 0, digit(second)).otherwise(""), digit(n))


def slice_text(text: str, start: Column, end: Column) -> Column:
    """Characters from ``start`` to before ``end``, from 0."""
    return F.substring(F.col(text), start + 1, end - start)
