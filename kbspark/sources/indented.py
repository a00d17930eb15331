"""Configuration in indented text: maps, lists and scalars, read without a parser that may not be there.

Read are block maps and lists, flow lists and maps on one line, quoted and plain scalars, literal and folded blocks, and
comments. Anchors, tags, several documents and keys that are not scalars are errors that name their line.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_INT, _FLOAT = re.compile(r"[-+]?\d+$"), re.compile(r"[-+]?(\d+\.\d*|\.\d+|\d+)([eE][-+]?\d+)?$")
# Plain scalars that are no text.
_WORDS = {"": None, "~": None, "null": None, "Null": None, "NULL": None, "true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", '"': '"', "\\": "\\", "/": "/"}
_QUOTED = re.compile(r"\"((?:[^\"\\]|\\.)*)\"|'((?:[^']|'')*)'")
_KEY = re.compile(r"((?:\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[^\s#\[\]{},\"'&*!|>%@-][^#:]*?|-[^\s#:][^#:]*?|[^\s\"'\[{&*!|>%@#-](?:[^:#]|:(?=\S)|(?<=\S)#)*?))\s*:(?=\s|$)")


class Malformed(ValueError):
    pass


def _text(match: re.Match) -> str:
    if match[1] is None:
        return match[2].replace("''", "'")
    return re.sub(r"\\(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "ux" and len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), match[1])


def _plain(text: str):
    if text in _WORDS:
        return _WORDS[text]
    if _INT.match(text):
        return int(text)
    return float(text) if _FLOAT.match(text) else text


def _uncommented(text: str) -> str:
    """A line without the comment at its end: a ``#`` after white space, outside quotes."""
    at = 0
    while at < len(text):
        if text[at] in "\"'" and (at == 0 or text[at - 1] in " \t[{,:"):
            quoted = _QUOTED.match(text, at)
            if quoted:
                at = quoted.end()
                continue
        if text[at] == "#" and (at == 0 or text[at - 1] in " \t"):
            return text[:at].rstrip()
        at += 1
    return text.rstrip()


def _flow(text: str, at: int, where: int):
    """A value inside brackets, from ``at`` on, and where it stops."""
    while at < len(text) and text[at] == " ":
        at += 1
    if at < len(text) and text[at] in "[{":
        closing, out = ("]", []) if text[at] == "[" else ("}", {})
        at += 1
        while True:
            while at < len(text) and text[at] in " ,":
                at += 1
            if at >= len(text):
                raise Malformed(f"line {where}: a bracket is not closed")
            if text[at] == closing:
                return out, at + 1
            value, at = _flow(text, at, where)
            if closing == "]":
                out.append(value)
                continue
            while at < len(text) and text[at] == " ":
                at += 1
            if text[at : at + 1] == ":":
                out[value], at = _flow(text, at + 1, where)
            else:
                out[value] = None
    if quoted := _QUOTED.match(text, at):
        return _text(quoted), quoted.end()
    stop = at
    while stop < len(text) and text[stop] not in ",]}" and not (text[stop] == ":" and text[stop + 1 : stop + 2] in ("", " ")):
        stop += 1
    return _plain(text[at:stop].strip()), stop


def _scalar(text: str, where: int):
    if text[:1] in "[{" and text:
        value, stop = _flow(text, 0, where)
        if text[stop:].strip():
            raise Malformed(f"line {where}: text after a bracket")
        return value
    if quoted := _QUOTED.match(text):
        if text[quoted.end() :].strip():
            raise Malformed(f"line {where}: text after a quote")
        return _text(quoted)
    if text[:1] in ("&", "*", "!", "%", "@", "`", '"', "'"):
        raise Malformed(f"line {where}: {text[:1]} is not read here")
    return _plain(text)


def parse(text: str):
    """The value that indented text stands for; nothing for an empty one. One pass, with the open maps and lists as a stack
    of indents."""
    lines = text.replace("\t", "    ").split("\n")
    root: list = [None]
    # Of each open container: its indent, itself, and how a value is put into what holds it.
    stack: list[tuple[int, object]] = []
    waiting: tuple[int, object, object] | None = (-1, root, 0)  # where a value that has yet to come goes: indent of its key, container, key

    def put(value) -> None:
        nonlocal waiting
        waiting[1][waiting[2]] = value
        waiting = None

    n = 0
    while n < len(lines):
        raw, n = lines[n].rstrip("\r"), n + 1
        line = _uncommented(raw)
        own = line.lstrip(" ")
        if not own or (own == "---" and n == 1) or own == "...":
            continue
        if own == "---":
            if root[0] is not None:
                raise Malformed(f"line {n}: a second document")
            continue
        indent = len(line) - len(own)
        while True:  # the entries of one line: any number of dashes, then a key or a value
            dash = own == "-" or own.startswith("- ")
            keyed = None if dash else _KEY.match(own)
            opens = dash or keyed
            while stack and (stack[-1][0] > indent or (stack[-1][0] == indent and opens and isinstance(stack[-1][1], list) != dash and not (dash and waiting is not None and waiting[0] == indent))):
                stack.pop()
                if waiting is not None and waiting[0] >= indent and not (dash and waiting[0] == indent):
                    waiting = None
            if waiting is not None and waiting[0] >= indent and not (dash and waiting[0] == indent):
                waiting = None  # the key before had no value
            if not opens:
                if waiting is None:
                    raise Malformed(f"line {n}: a value without a key")
                put(_scalar(own, n))
                break
            top = stack[-1][1] if stack and stack[-1][0] == indent and isinstance(stack[-1][1], list) == dash and (waiting is None or waiting[0] < 0) else None
            if top is None:
                if waiting is None:
                    raise Malformed(f"line {n}: this indent belongs to nothing")
                top = [] if dash else {}
                put(top)
                stack.append((indent, top))
            if dash:
                top.append(None)
                waiting = (indent, top, len(top) - 1)
                rest = own[1:].lstrip(" ")
                if not rest:
                    break
                indent += len(own) - len(rest)
                own = rest
                if not (own == "-" or own.startswith("- ") or _KEY.match(own)):
                    n = _value(own, n, lines, indent - 1, put)
                    break
                waiting = (indent - 1, top, len(top) - 1)
                continue
            key = keyed[1].strip()
            quoted = _QUOTED.fullmatch(key)
            name, rest = (_text(quoted) if quoted else key), own[keyed.end() :].strip()
            top[name] = None
            waiting = (indent, top, name)
            if rest:
                n = _value(rest, n, lines, indent, put)
            break
    return root[0]


def _value(text: str, n: int, lines: list[str], indent: int, put) -> int:
    """Puts the value that stands after a key or a dash; blocks take the lines below that are further in."""
    if not re.fullmatch(r"[|>][-+]?", text):
        put(_scalar(text, n))
        return n
    held = []
    while n < len(lines) and (not lines[n].strip() or len(lines[n]) - len(lines[n].lstrip(" ")) > indent):
        held.append(lines[n].rstrip("\r"))
        n += 1
    while held and not held[-1].strip():
        held.pop()
    width = min((len(x) - len(x.lstrip(" ")) for x in held if x.strip()), default=0)
    held = [x[width:] for x in held]
    if text[0] == "|":
        body = "\n".join(held)
    else:
        body = re.sub(r"(\n+)", lambda m: " " if len(m[1]) == 1 else m[1][1:], "\n".join(held))
    put(body if text.endswith("-") or not held else body + "\n")
    return n


def as_json(text: Column) -> Column:
    """Indented text as JSON, for ``from_json``; null for null, and an error of the job for text that is not read here."""

    def convert(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else json.dumps(parse(t), ensure_ascii=False))

    return F.pandas_udf(convert, "string")(text)


GOLDEN = "array<struct<query:string,last_verified_commit:string,expected_hits:array<string>,expected_graph_symbols:array<struct<symbol:string,from_file:string>>,verify_provenance:boolean>>"


def golden_sets(files: DataFrame) -> DataFrame:
    """path, query_id (from 0), query, last_verified_commit, expected_hits, expected_graph_symbols, verify_provenance: the
    entries of golden sets (path, content), which are a list, or a list under ``queries``. What is missing is empty or false."""
    own = as_json(F.col("content"))
    rows = files.select("path", own.alias("j"))
    listed = F.when(F.trim("j").startswith("["), F.from_json("j", GOLDEN)).otherwise(F.from_json("j", f"struct<queries:{GOLDEN}>")["queries"])
    entries = rows.select("path", F.posexplode(listed).alias("query_id", "q")).select("path", "query_id", "q.*")
    none = {"expected_hits": "array<string>", "expected_graph_symbols": "array<struct<symbol:string,from_file:string>>"}
    return entries.withColumns({c: F.coalesce(c, F.array().cast(t)) for c, t in none.items()} | {"verify_provenance": F.coalesce("verify_provenance", F.lit(False))})
