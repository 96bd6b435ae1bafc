"""Column functions over Structured Text and names, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOM = "﻿"
#: Name prefixes of the ISA-88 layers (fixed values).
LAYERS = ("UM", "EM", "CM", "DM")


def strip(text: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def layer(name: Column) -> Column:
    lower = F.lower(name)
    out = F.lit("Other")
    for x in reversed(LAYERS):
        out = F.when(lower.startswith(f"{x.lower()}_"), x).otherwise(out)
    return out


def safe_xml(content: Column) -> Column:
    """Content without a byte order mark; null where it declares a document type."""
    text = F.regexp_replace(content, f"^{BOM}", "")
    return F.when(~text.contains("<!DOCTYPE"), text)


def newlines(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")


def stripped(code: Column) -> Column:
    """Code without comments and string literals."""
    code = F.regexp_replace(code, r"(?s)\(\*.*?\*\)", " ")
    code = F.regexp_replace(code, r"//[^\n]*", " ")
    return F.regexp_replace(code, r"'(?:[^'$]++|\$.)*+'", "''")


def blank_run(text: Column, n: int = 3) -> Column:
    """Whether n lines or more in a row hold nothing but spaces, tabs and a return."""
    return text.rlike(r"\n" + r"[ \t]*+\r?+\n" * n)


def camel_split(name: Column) -> Column:
    return F.regexp_replace(name, "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def base_type(data_type: Column) -> Column:
    """A type's name without a length, such as STRING(80)."""
    return strip(F.regexp_replace(data_type, r"\(.*$", ""))


def last_segment(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def direction(at: Column) -> Column:
    letter = F.upper(F.regexp_extract(at, "^%([IQMiqm])", 1))
    return F.when(letter == "I", "Input").when(letter == "Q", "Output").when(letter == "M", "Memory").otherwise("Unknown")


def diagram_label(text: Column) -> Column:
    """A label that a diagram may hold: marks with a meaning there become entities."""
    marks = {"#": "#35;", ";": "#59;", "&": "#amp;", "<": "#lt;", ">": "#gt;", '"': "#quot;", "(": "#40;", ")": "#41;", "[": "#91;", "]": "#93;", "|": "#124;"}
    table = F.create_map(*[F.lit(x) for pair in marks.items() for x in pair])
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(table[c], c)), "")
