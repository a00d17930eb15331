"""Scopes of source files: one pass over a file's lines says for each line where the braces that open at or
after it close."""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Comments and literals, which hold no scopes.
_SILENT = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)


def ends_of(text: str, quiet: bool = False) -> list[int]:
    """For each line (from 1) the line on which the braces that open at or after it close; the first line with a semicolon if
    it comes before any brace; the line itself where neither comes. Braces in comments and literals
    count, unless ``quiet``. Time follows the lines (times the logarithm of how often a depth returns)."""
    if quiet:
        text = _SILENT.sub(lambda m: "\n" * m[0].count("\n"), text)
    lines = text.split("\n")
    n, depth = len(lines), [0]
    for line in lines:
        depth.append(depth[-1] + line.count("{") - line.count("}"))
    places: dict[int, list[int]] = {}
    for at in range(1, n + 1):
        places.setdefault(depth[at], []).append(at)
    out, brace, stop = [0] * n, n + 1, n + 1
    for at in range(n, 0, -1):
        line = lines[at - 1]
        if "{" in line:
            brace = at
        if ";" in line:
            stop = at
        if stop < brace:
            out[at - 1] = stop
            continue
        level = places.get(depth[at - 1], [])
        k = bisect_left(level, brace)
        out[at - 1] = level[k] if brace <= n and k < len(level) else at
    return out


def scope_ends(text: Column, quiet: bool = False) -> Column:
    """``ends_of`` as a column: an array with a number for each line; null for a null text."""

    def ends(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else ends_of(t, quiet))

    return F.pandas_udf(ends, "array<int>")(text)
