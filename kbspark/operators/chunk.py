"""Text chunking: short texts whole, others at method headers or headings, long parts by lines with
overlap. The overlap split carries state from line to line, so it is a fold over the lines of
one text; nothing crosses rows and nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import MAX_TOKENS, OVERLAP_TOKENS, SHORT_FILE_TOKENS, chars_per_token, estimate_tokens, extension, strip

# Characters kept for embedding, storing (documents, code) and showing.
EMBED_CHARS, STORE_CHARS, STORE_CODE_CHARS, SNIPPET_CHARS = 2000, 3000, 2000, 500
LINE_WIDTH = 80
MIN_SECTION_CHARS = 20

# Languages by extension, and the headers at which code is split.
LANGUAGES = {
    ".java": "java", ".kt": "kotlin", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript",
    ".jsx": "javascript", ".vue": "vue", ".py": "python", ".go": "go", ".rs": "rust",
}
DOC_EXTENSIONS = [".md", ".txt"]
_SCRIPT = r"^\s*(export\s+)?(async\s+)?(function|const|class)\s+\w+"
HEADERS = {
    "java": r"^\s*(public|private|protected|static|\s)*[\w<>\[\]]+\s+\w+\s*\(",
    "kotlin": r"^\s*(fun|override\s+fun|private\s+fun|internal\s+fun)\s+",
    "typescript": _SCRIPT, "javascript": _SCRIPT, "vue": _SCRIPT,
}
#: Statements that look like Java headers; ``strict`` leaves them out.
STATEMENTS = r"^\s*(return|else|new|throw)\b"


def language(path: Column) -> Column:
    found = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.element_at(found, extension(path)), F.lit("unknown"))


def source_kind(path: Column) -> Column:
    return F.when(extension(path).isin(DOC_EXTENSIONS), "doc").otherwise("code")


def is_short(text: Column) -> Column:
    return estimate_tokens(text) <= SHORT_FILE_TOKENS


def overlap_spans(text: Column, as_reference: bool = True) -> Column:
    """Spans of lines (first and last, from 1) of an overlapping split of a long text.

    A span ends once its characters, one more for each line, reach the limit; the next one starts a
    fixed number of lines back. With ``as_reference`` the step back may be the whole span, so a span
    can grow instead of moving on; without it every span starts after the start of the one before.
    """
    cpt = chars_per_token(text)
    known = F.struct((MAX_TOKENS * cpt).alias("limit"), F.ceil(OVERLAP_TOKENS * cpt / LINE_WIDTH).cast("int").alias("back"), F.transform(F.split(text, "\n", -1), lambda x: F.length(x)).alias("sizes"), F.length(text).alias("length"))
    # Inside the lambda these are values; as expressions they would be computed again for each line.
    return F.transform(F.array(known), lambda k: _spans(k, as_reference))[0]


def _spans(known: Column, as_reference: bool) -> Column:
    limit, back, sizes = known["limit"], known["back"], known["sizes"]
    start = F.struct(F.lit(1).alias("first"), F.lit(0).alias("line"), F.lit(0).alias("chars"), F.array().cast("array<struct<first:int,last:int>>").alias("out"))

    def step(s: Column, size: Column) -> Column:
        line, chars = s["line"] + 1, s["chars"] + size + 1
        held = line - s["first"] + 1
        steps = F.least(back, held if as_reference else F.greatest(held - 1, F.lit(0)))
        first = line - steps + 1
        # Characters of the lines that stay, with the line ends between them.
        kept = F.aggregate(F.slice(sizes, F.greatest(first, F.lit(1)), steps), F.lit(0), lambda a, b: a + b) + F.greatest(steps - 1, F.lit(0))
        full = F.struct(first.alias("first"), line.alias("line"), kept.alias("chars"), F.concat(s["out"], F.array(F.struct(s["first"].alias("first"), line.alias("last")))).alias("out"))
        more = F.struct(s["first"].alias("first"), line.alias("line"), chars.alias("chars"), s["out"].alias("out"))
        return F.when(chars >= limit, full).otherwise(more)

    def finish(s: Column) -> Column:
        rest = F.array(F.struct(s["first"].alias("first"), s["line"].alias("last")))
        return F.when(s["first"] <= s["line"], F.concat(s["out"], rest)).otherwise(s["out"])

    whole = F.array(F.struct(F.lit(1).alias("first"), F.size(sizes).alias("last")))
    return F.when(known["length"] > limit, F.aggregate(sizes, start, step, finish)).otherwise(whole)



def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each line: id, line (from 1) and its text; null texts have none."""
    return docs.select(F.col(id_col), F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "text")).select(id_col, (F.col("pos") + 1).alias("line"), "text")


def sections(docs: DataFrame, id_col: str = "path", text_col: str = "body") -> DataFrame:
    """Parts of documents at headings of up to three marks: id, heading, start_line, section (its
    text). The part before the first heading has an empty heading."""
    rows = lines(docs, id_col, text_col).withColumn("head", F.col("text").rlike(r"^#{1,3}\s"))
    upto = Window.partitionBy(id_col).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("part", F.sum(F.col("head").cast("int")).over(upto))
    parts = rows.groupBy(id_col, "part").agg(F.sort_array(F.collect_list(F.struct("line", "text", "head"))).alias("l"))
    first = F.col("l")[0]
    heading = F.when(first["head"], F.regexp_replace(first["text"], r"^#+\s*", "")).otherwise("")
    return parts.select(id_col, heading.alias("heading"), first["line"].alias("start_line"), F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("section"))


def long_enough(rows: DataFrame, text_col: str = "section") -> DataFrame:
    return rows.filter(F.length(strip(F.col(text_col))) >= MIN_SECTION_CHARS)


def numbered(text: Column, start_line: Column) -> Column:
    """Line numbers before the lines inside code fences."""
    rows = F.split(text, "\n", -1)
    start = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fence = F.startswith(x, F.lit("```"))
        shown = F.when(s["inside"] & ~fence, F.concat((start_line + s["n"]).cast("string"), F.lit("| "), x)).otherwise(x)
        return F.struct((s["inside"] != fence).alias("inside"), (s["n"] + 1).alias("n"), F.concat(s["out"], F.array(shown)).alias("out"))

    return F.array_join(F.aggregate(rows, start, step, lambda s: s["out"]), "\n")


def method_parts(files: DataFrame, strict: bool = False, path_col: str = "path", text_col: str = "content") -> DataFrame:
    """Code cut at method headers of its language: path, line_start, line_end, method_name, text.
    Blank parts go; files of languages without headers are one part. ``strict`` leaves out statements
    that look like headers."""
    rows = lines(files.filter(F.col(text_col).isNotNull()), path_col, text_col).withColumn("lang", language(F.col(path_col)))
    head = F.lit(False)
    for name, pattern in HEADERS.items():
        head = head | ((F.col("lang") == name) & F.col("text").rlike(pattern))
    if strict:
        head = head & ~F.col("text").rlike(STATEMENTS)
    rows = rows.withColumn("head", head)
    upto = Window.partitionBy(path_col).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("part", F.sum((F.col("head") & (F.col("line") > 1)).cast("int")).over(upto))
    parts = rows.groupBy(path_col, "part").agg(F.sort_array(F.collect_list(F.struct("line", "text", "head"))).alias("l"))
    first = F.col("l")[0]
    name = F.when(first["head"], F.nullif(F.regexp_extract(first["text"], r"(\w+)\s*\(", 1), F.lit("")))
    out = parts.select(path_col, first["line"].alias("line_start"), F.element_at("l", -1)["line"].alias("line_end"), name.alias("method_name"), F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))
    return out.filter(strip(F.col("text")) != "")


def file_chunks(files: DataFrame, as_reference: bool = False, path_col: str = "path", text_col: str = "content") -> DataFrame:
    """Chunks of files with their lines, class, method, language and kind: short files whole, others
    at method headers and then by lines with overlap."""
    described = files.filter(F.col(text_col).isNotNull()).select(F.col(path_col).alias("path"), F.col(text_col).alias("content"))
    described = described.withColumn("language", language(F.col("path"))).withColumn("source_type", source_kind(F.col("path")))
    named = F.nullif(F.regexp_extract("content", r"(?:class|interface|enum)\s+(\w+)", 1), F.lit(""))
    described = described.withColumn("class_name", F.when(F.col("language").isin("java", "kotlin"), named))
    info = described.drop("content")
    short = described.filter(is_short(F.col("content"))).select("path", F.lit(1).alias("line_start"), F.size(F.split("content", "\n", -1)).alias("line_end"), F.lit(None).cast("string").alias("method_name"), F.col("content").alias("text"))
    parts = method_parts(described.filter(~is_short(F.col("content"))), path_col="path", text_col="content")
    spans = parts.withColumn("span", F.explode(overlap_spans(F.col("text"), as_reference)))
    cut = F.array_join(F.slice(F.split("text", "\n", -1), F.col("span.first"), F.col("span.last") - F.col("span.first") + 1), "\n")
    long = spans.select("path", (F.col("line_start") + F.col("span.first") - 1).alias("line_start"), (F.col("line_start") + F.col("span.last") - 1).alias("line_end"), "method_name", cut.alias("text"))
    return short.unionByName(long).join(info, "path")
