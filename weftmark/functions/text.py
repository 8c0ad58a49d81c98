"""Column expressions shared by the operators; all of them stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Removes Unicode white space at both ends (SQL trim removes only spaces)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    """Null for null, empty and white-space-only strings, else the string as it is."""
    return F.when(F.length(strip(c)) > 0, c)


def section_hash(heading: Column, content: Column) -> Column:
    """SHA-256 in lower-case hex of heading, a newline and content."""
    return F.sha2(F.concat(heading, F.lit("\n"), content), 256)


def digest(c: Column) -> Column:
    """One spelling of a SHA-256 digest: lower case, without white space around it or an algorithm prefix.

    A null or blank hash gives null. A string without 64 hex digits is only trimmed and lower-cased.
    """
    low = F.lower(strip(c))
    hexed = F.regexp_extract(low, r"^(?:sha-?256\s*[:=]\s*)?([0-9a-f]{64})$", 1)
    return F.when(hexed != "", hexed).when(low != "", low)


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")


def lines_of(text: str, ends: bool = False) -> list[str]:
    """The lines of a text, which end at CR, LF or both and at nothing else, unlike those of `str.splitlines`."""
    lines = _LINE.findall(text)
    return lines if ends else [x.rstrip("\r\n") for x in lines]
