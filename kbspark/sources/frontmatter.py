"""Documents with a head of simple YAML between two lines of dashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import body_hash

# What a document must say, and where it may belong.
REQUIRED = ["kb_layer", "summary", "sources", "last_scan_commits", "stale"]
LAYERS = ["domain", "flow", "contract", "code", "rule", "navigation", "shared"]
_COMMIT = "struct<file:string,commit:string,body_hash:string>"


def _head(text: Column) -> Column:
    return F.regexp_extract(text, r"^---\r?\n([\s\S]*?)\r?\n---(?:\r?\n|$)", 1)


def _scalar(head: Column, key: str) -> Column:
    """A quoted or bare value; null where the key is missing or empty."""
    raw = F.regexp_extract(head, rf'(?m)^{key}:[ \t]*("(?:[^"\\]|\\.)*"|[^\r\n]*?)[ \t]*$', 1)
    quoted = F.regexp_replace(F.regexp_replace(F.regexp_extract(raw, r'(?s)^"(.*)"$', 1), r'\\"', '"'), r"\\\\", r"\\")
    return F.nullif(F.when(raw.startswith('"'), quoted).otherwise(raw), F.lit(""))


def _items(head: Column, key: str) -> Column:
    block = F.regexp_extract(head, rf"(?m)^{key}:[ \t]*\r?\n((?:[ \t]+-[^\n]*(?:\n|$))*)", 1)
    return F.transform(F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]+-[ \t]*([^\r\n]*?)[ \t]*\r?$"), F.lit(1)), lambda x: F.regexp_replace(x, r'^"(.*)"$', "$1"))


def parse(docs: DataFrame, text_col: str = "content") -> DataFrame:
    """Adds kb_layer, summary, stale, stale_reason, human_edited, sources, last_scan_commits and body.
    Quotes are unescaped; a missing list is empty; without a head, all of the text is body."""
    head, text = _head(F.col(text_col)), F.col(text_col)

    def part(x: Column, key: str) -> Column:
        return F.regexp_extract(x, rf"{key}:\s*\"?([^,\"}}]*)\"?", 1)

    commits = F.transform(_items(head, "last_scan_commits"), lambda x: F.struct(*(F.trim(part(x, k)).alias(k) for k in ("file", "commit", "body_hash"))))
    return docs.withColumns({
        "kb_layer": _scalar(head, "kb_layer"),
        "summary": _scalar(head, "summary"),
        "stale": _scalar(head, "stale") == "true",
        "stale_reason": _scalar(head, "stale_reason"),
        "human_edited": F.coalesce(_scalar(head, "human_edited") == "true", F.lit(False)),
        "sources": _items(head, "sources"),
        "last_scan_commits": commits.cast(f"array<{_COMMIT}>"),
        "body": F.regexp_replace(text, r"^---\r?\n[\s\S]*?\r?\n---(?:\r?\n|$)", ""),
    })


def serialize(docs: DataFrame) -> Column:
    """The text of a document: fields in a fixed order, quotes and backslashes escaped."""
    def quoted(c: Column) -> Column:
        return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))

    sources = F.array_join(F.transform("sources", lambda s: F.concat(F.lit("\n  - "), s)), "")
    commits = F.array_join(F.transform("last_scan_commits", lambda c: F.concat(F.lit("\n  - {file: "), c["file"], F.lit(", commit: "), c["commit"], F.lit(", body_hash: "), c["body_hash"], F.lit("}"))), "")
    optional = [F.when(F.col("stale_reason").isNotNull(), F.concat(F.lit("stale_reason: "), quoted(F.col("stale_reason")), F.lit("\n"))).otherwise(""), F.when(F.col("human_edited"), F.lit("human_edited: true\n")).otherwise("")]
    return F.concat(F.lit("---\nkb_layer: "), F.col("kb_layer"), F.lit("\nsummary: "), quoted(F.col("summary")), F.lit("\nsources:"), sources, F.lit("\nlast_scan_commits:"), commits, F.lit("\nstale: "), F.col("stale").cast("string"), F.lit("\n"), *optional, F.lit("---\n"), F.col("body"))


def created(rows: DataFrame) -> DataFrame:
    """Documents anew: each source gets its commit and the hash of the body. rows: kb_layer, summary,
    sources, commit, body."""
    commits = F.transform("sources", lambda s: F.struct(s.alias("file"), F.col("commit").alias("commit"), body_hash(F.col("body")).alias("body_hash")))
    return rows.withColumns({"last_scan_commits": commits, "stale": F.lit(False), "stale_reason": F.lit(None).cast("string"), "human_edited": F.lit(False)})


def problems(docs: DataFrame) -> DataFrame:
    """path, problem of documents that lack a required field or name no known layer."""
    missing = F.array(*(F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in REQUIRED), F.when(~F.col("kb_layer").isin(LAYERS), F.lit("unknown layer")))
    return docs.select("path", F.explode(F.filter(missing, lambda x: x.isNotNull())).alias("problem"))


def edited(docs: DataFrame) -> Column:
    """Whether a body was changed by hand since it was written."""
    stored = F.get("last_scan_commits", F.lit(0))["body_hash"]
    return F.coalesce(stored != body_hash(F.col("body")), F.lit(False))
