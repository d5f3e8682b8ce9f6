"""Whitespace-exact text functions.

The pipeline's text semantics are Python's: ``str.split()`` / ``str.strip()``
split and strip on every code point for which ``str.isspace()`` is true. Java's
``\\s`` (and even ``(?U)\\s``) and RE2's ``\\s`` cover different sets, so the
class is built here from that rule and written with ``\\x{..}`` escapes, a form
both Java regex (Spark) and RE2 (DuckDB oracle) accept.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F


def _whitespace_ranges() -> list[tuple[int, int]]:
    ranges: list[tuple[int, int]] = []
    for cp in range(sys.maxunicode + 1):
        if chr(cp).isspace():
            if ranges and ranges[-1][1] == cp - 1:
                ranges[-1] = (ranges[-1][0], cp)
            else:
                ranges.append((cp, cp))
    return ranges


def _class_body(ranges: list[tuple[int, int]]) -> str:
    parts = []
    for lo, hi in ranges:
        parts.append("\\x{%x}" % lo if lo == hi else "\\x{%x}-\\x{%x}" % (lo, hi))
    return "".join(parts)


WS_RANGES = _whitespace_ranges()
WS_CHARS = "".join(chr(c) for lo, hi in WS_RANGES for c in range(lo, hi + 1))
WS_BODY = _class_body(WS_RANGES)
WS = "[" + WS_BODY + "]"          # one whitespace code point
NON_WS = "[^" + WS_BODY + "]"     # one non-whitespace code point
STRIP_RE = "^" + WS + "+|" + WS + "+\\z"
# Line terminators of spark.read.text (and of the JSONL writers): \n, \r, \r\n.
LINE_SPLIT_RE = "\\r\\n|\\r|\\n"


def strip_ws(c: Column | str) -> Column:
    """Python ``str.strip()`` on a string column.

    ``btrim`` with the whitespace set walks code points from both ends only,
    so it costs the trimmed length, not the text length.
    """
    return F.btrim(_col(c), F.lit(WS_CHARS))


def remove_ws(c: Column | str) -> Column:
    """``''.join(s.split())``: drop every whitespace code point."""
    return F.regexp_replace(_col(c), WS + "+", "")


def is_blank(c: Column | str) -> Column:
    """``not s.strip()``; null counts as blank."""
    return F.coalesce(F.length(strip_ws(c)) == 0, F.lit(True))


def word_count(c: Column | str) -> Column:
    """``len(s.split())`` (P6): maximal runs of non-whitespace code points.

    Splits the stripped text on whitespace runs (no empty pieces can occur
    except for the empty text, which counts 0).
    """
    t = strip_ws(c)
    return F.when(F.length(t) == 0, F.lit(0)).otherwise(F.size(F.split(t, WS + "+", -1)))


def in_word_band(n_words: Column | str, low_exclusive: int = 100, high_inclusive: int = 200) -> Column:
    """``low < words <= high``.

    Written as one comparison on one occurrence of ``n``: Catalyst inlines the
    count expression into every predicate that names it, so the two-sided form
    would split the text twice more.
    """
    n = _col(n_words)
    width = high_inclusive - low_exclusive
    if width <= 0:
        return F.lit(False)
    return F.floor((n - F.lit(low_exclusive + 1)) / F.lit(float(width))) == F.lit(0)


def stop_cut(gen: Column | str, stop: str | None) -> Column:
    """keep the generation up to the first stop sequence (literal)."""
    g = _col(gen)
    if not stop:
        return g
    return F.split_part(g, F.lit(stop), F.lit(1))


def clean_generation(generated: Column | str, prompt: Column | str) -> Column:
    """remove every occurrence of the prompt, then strip.

    ``generated`` is prompt + model output, as the reference builds it. An empty
    prompt is a no-op, as in Python.
    """
    p = _col(prompt)
    g = _col(generated)
    removed = F.when(F.coalesce(F.length(p), F.lit(0)) == 0, g).otherwise(F.replace(g, p, F.lit("")))
    return strip_ws(removed)


def scrub(c: Column | str) -> Column:
    """undecodable bytes become U+FFFD, as Python's ``errors="replace"``."""
    return F.make_valid_utf8(_col(c))


# An escaped backslash, a valid surrogate-pair escape, or a lone surrogate escape.
_SURROGATE_ESCAPES = (r"(\\\\)|(\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2})"
                      r"|\\u[dD][89a-fA-F][0-9a-fA-F]{2}")


def drop_lone_surrogate_escapes(line: Column | str) -> Column:
    """F13 for JSON text: remove ``\\uD800``-``\\uDFFF`` escapes that do not form a pair.

    Python decodes such escapes to lone surrogates, which the training reader
    then drops (UTF-8 encode/decode with ``ignore``); Spark's JSON parser
    would turn them into ``?``. Escaped backslashes and valid pairs are kept.
    """
    c = _col(line)
    # Fast path: only lines holding a \\uD.. escape can need the regex.
    maybe = c.contains("\\ud") | c.contains("\\uD")
    return F.when(maybe, F.regexp_replace(c, _SURROGATE_ESCAPES, "$1$2")).otherwise(c)


def split_lines(c: Column | str) -> Column:
    """Split a text into lines on \\n, \\r and \\r\\n only."""
    return F.split(_col(c), LINE_SPLIT_RE, -1)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- Python helpers with the same semantics (unit-test references) -----------------
