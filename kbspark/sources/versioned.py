"""What a version-control client prints, as rows: unified diffs and blames.

Each text is read once, from its first line to its last, with a state that carries the numbers of the
lines (a hunk says how many lines it has, so text that looks like a header inside a hunk is text).
Memory is that of one text and the rows of a part of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a record batch that a reader gives out, about.
BATCH = 20_000

_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
_GIT = re.compile(r'diff --git ("(?:a/)?(?:[^"\\]|\\.)*"|(?:a/)?.*) ("(?:b/)?(?:[^"\\]|\\.)*"|(?:b/)?.*)$')
_BLAME = re.compile(r"([0-9a-f]{40,64}) (\d+) (\d+)(?: \d+)?$")
_ESCAPED = re.compile(rb'\\([abfnrtv"\\]|[0-7]{3})')
# The escapes of quoted paths.
_ESCAPES = {b"a": b"\a", b"b": b"\b", b"f": b"\f", b"n": b"\n", b"r": b"\r", b"t": b"\t", b"v": b"\v", b'"': b'"', b"\\": b"\\"}

DIFF_ROWS = "file_no int, old_path string, path string, status string, kind string, old_line int, new_line int, text string"
BLAME_ROWS = "commit string, source_line int, line int, author string, author_mail string, author_time long, summary string, filename string, text string"


def unquoted(path: str) -> str:
    """A path as it is, without the quotes and escapes around unusual characters."""
    if not (len(path) > 1 and path[0] == path[-1] == '"'):
        return path
    raw = _ESCAPED.sub(lambda m: _ESCAPES.get(m[1]) or bytes([int(m[1], 8) & 255]), path[1:-1].encode())
    return raw.decode("utf-8", "replace")


def _side(path: str, prefix: str) -> str | None:
    """A path of a header line; none for the null device. A time stamp after a tab is no part of it."""
    own = unquoted(path.split("\t", 1)[0].rstrip("\r"))
    if own == "/dev/null":
        return None
    return own.removeprefix(prefix)


def _hunks(text: str) -> Iterator[tuple]:
    """file_no, old_path, path, status, lines, old_line, new_line: for each file one row without lines, after its headers, and
    one for each of its hunks, with the hunk's lines and the numbers at which it starts."""
    n, old, new, status = -1, None, None, "modified"
    told = True

    def header():
        return (n, old, new if new is not None else old, status, None, 0, 0)

    lines = text.split("\n")
    at, end = 0, len(lines)
    while at < end:
        line = lines[at]
        at += 1
        if hunk := _HUNK.match(line):
            if not told:
                yield header()
                told = True
            old_left, new_left, first = int(hunk[2] or 1), int(hunk[4] or 1), at
            while at < end and (old_left > 0 or new_left > 0):
                kind = lines[at][:1]
                at += 1
                if kind == "+":
                    new_left -= 1
                elif kind == "-":
                    old_left -= 1
                elif kind != "\\":
                    old_left, new_left = old_left - 1, new_left - 1
            yield (n, old, new if new is not None else old, status, lines[first:at], int(hunk[1]), int(hunk[3]))
        elif line.startswith("diff --git "):
            if not told:
                yield header()
            n, status, told = n + 1, "modified", False
            both = line[len("diff --git ") :].rstrip("\r")
            half = len(both) // 2
            if both[:1] != '"' and both[half : half + 1] == " " and both[2:half] == both[half + 3 :]:  # one name, maybe with spaces
                old, new = both[2:half], both[half + 3 :]
            elif names := _GIT.match(line.rstrip("\r")):
                old, new = _side(names[1], "a/"), _side(names[2], "b/")
        elif line.startswith("--- "):
            if told:  # a plain diff without a line of git's before it
                n, status, told, new = n + 1, "modified", False, None
            old = _side(line[4:], "a/")
            if old is None:
                status = "added"
        elif line.startswith("+++ "):
            new = _side(line[4:], "b/")
            if new is None:
                status = "deleted"
        elif line.startswith("new file mode"):
            status = "added"
        elif line.startswith("deleted file mode"):
            status = "deleted"
        elif line.startswith(("rename from ", "copy from ")):
            status, old = ("renamed" if line[0] == "r" else "copied"), unquoted(line.split(" from ", 1)[1].rstrip("\r"))
        elif line.startswith(("rename to ", "copy to ")):
            new = unquoted(line.split(" to ", 1)[1].rstrip("\r"))
        elif line.startswith(("Binary files ", "GIT binary patch")) and status == "modified":
            status = "binary"
        if status == "added":
            old = None
    if not told:
        yield header()


def read_diff(text: str) -> Iterator[tuple]:
    """file_no, old_path, path, status, kind, old_line, new_line, text: for each file one row of kind ``file``
    (status added, deleted, renamed, copied, binary or modified), and one for each line of its hunks, of kind
    ``+``, ``-`` or a space. A line that was taken away has no new number, a new one no old one."""
    for *file, lines, old_at, new_at in _hunks(text):
        if lines is None:
            yield (*file, "file", None, None, None)
            continue
        for line in lines:
            kind, rest = line[:1], line[1:]
            if kind == "+":
                yield (*file, "+", None, new_at, rest)
                new_at += 1
            elif kind == "-":
                yield (*file, "-", old_at, None, rest)
                old_at += 1
            elif kind != "\\":  # some tools leave the space of an empty line out
                yield (*file, " ", old_at, new_at, rest)
                old_at, new_at = old_at + 1, new_at + 1


def read_files(text: str) -> Iterator[tuple]:
    """old_path, path, status of each file of a diff."""
    return (x[1:4] for x in _hunks(text) if x[4] is None)


def read_changes(text: str, new: bool = True, old: bool = True) -> Iterator[tuple]:
    """path, side, line of each changed line: new ones by the new path and number, those that went by the old ones."""
    for _, old_path, path, _, lines, old_at, new_at in _hunks(text):
        for line in lines or ():
            kind = line[:1]
            if kind == "+":
                if new:
                    yield path, "new", new_at
                new_at += 1
            elif kind == "-":
                if old:
                    yield old_path, "old", old_at
                old_at += 1
            elif kind != "\\":
                old_at, new_at = old_at + 1, new_at + 1


def read_blame(text: str) -> Iterator[tuple]:
    """commit, source_line, line, author, author_mail, author_time, summary, filename, text: one row for each line of
    a porcelain blame. What is told of a commit once holds for all its lines."""
    commits: dict[str, dict[str, str]] = {}
    own, head = {}, None
    for line in text.split("\n"):
        if line.startswith("\t"):
            if head:
                time = own.get("author-time", "")
                yield (head[1], int(head[2]), int(head[3]), own.get("author"), own.get("author-mail"), int(time) if time.isdigit() else None, own.get("summary"), own.get("filename"), line[1:])
            head = None
        elif head is None and (found := _BLAME.match(line.rstrip("\r"))):
            head = found
            own = commits.setdefault(head[1], {})
        elif head is not None:
            key, _, value = line.partition(" ")
            own[key] = value.rstrip("\r")


def _rows(texts: DataFrame, read, schema: str, content: str) -> DataFrame:
    """All columns but the text, and those of each row that ``read`` makes of it; null texts have none."""
    own = StructType.fromDDL(schema)
    taken = {c.lower() for c in texts.columns if c != content} & {f.name.lower() for f in own}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are there already")
    keys = [c for c in texts.columns if c != content]
    kinds = [pa.int32() if f.dataType.simpleString() == "int" else pa.int64() if f.dataType.simpleString() == "bigint" else pa.string() for f in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, at = [], []  # of many texts, where they are short: a record batch costs as much as hundreds of rows
            for i in range(batch.num_rows):
                text = batch.column(content)[i].as_py()
                for row in read(text) if text is not None else ():
                    held.append(row)
                    at.append(i)
                    if len(held) >= BATCH:
                        yield made(batch, at, held)
                        held, at = [], []
            if held:
                yield made(batch, at, held)

    def made(batch: pa.RecordBatch, at: list[int], held: list[tuple]) -> pa.RecordBatch:
        place = pa.array(at, pa.int64())
        columns = [pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*(batch.column(k).take(place) for k in keys), *columns], names=[*keys, *own.names])

    return texts.mapInArrow(run, StructType([texts.schema[k] for k in keys] + list(own.fields)))


def diff_lines(texts: DataFrame, content: str = "content") -> DataFrame:
    """All other columns and the rows of ``read_diff`` for each unified diff. Texts that are null, empty or no diff
    have no rows; a column of the same name as one of the new ones is an error."""
    return _rows(texts, read_diff, DIFF_ROWS, content)


def changed_files(texts: DataFrame, content: str = "content") -> DataFrame:
    """All other columns and path, old_path, status of each file of a diff, also of those without hunks."""
    return _rows(texts, read_files, "old_path string, path string, status string", content)


def changes(texts: DataFrame, content: str = "content", side: str = "new") -> DataFrame:
    """All other columns and path, line of each changed line: by ``new`` numbers those that came, by ``old``
    numbers (and paths) those that went; ``both`` in one reading, with a column side."""
    if side == "both":
        return _rows(texts, read_changes, "path string, side string, line int", content)
    return _rows(texts, lambda text: ((p, n) for p, _, n in read_changes(text, side == "new", side == "old")), "path string, line int", content)


def blame_lines(texts: DataFrame, content: str = "content") -> DataFrame:
    """All other columns and the rows of ``read_blame`` for each porcelain blame."""
    return _rows(texts, read_blame, BLAME_ROWS, content)
