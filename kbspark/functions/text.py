"""Text functions. All take and return columns and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token estimates.
CHARS_PER_TOKEN = 4.0
CHARS_PER_TOKEN_CJK = 1.5
MAX_TOKENS = 1000
OVERLAP_TOKENS = 200
SHORT_FILE_TOKENS = 800
CJK = "[一-鿿㐀-䶿]"


def chars_per_token(text: Column) -> Column:
    """1.5 where over 30 % of the characters are CJK, a weighted mean over 10 %, else 4."""
    n = F.length(text)
    ratio = F.when(n > 0, F.regexp_count(text, F.lit(CJK)) / n).otherwise(0.0)
    mixed = CHARS_PER_TOKEN * (1 - ratio) + CHARS_PER_TOKEN_CJK * ratio
    return F.when(ratio > 0.3, CHARS_PER_TOKEN_CJK).when(ratio > 0.1, mixed).otherwise(CHARS_PER_TOKEN)


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / chars_per_token(text)).cast("long")


def strip(text: Column) -> Column:
    """Without white space at either end (not only spaces)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalised_body(body: Column) -> Column:
    """CRLF to LF, blanks before line ends dropped, three or more line ends to two, ends stripped."""
    unix = F.regexp_replace(body, "\r\n", "\n")
    return strip(F.regexp_replace(F.regexp_replace(unix, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


def body_hash(body: Column) -> Column:
    return F.substring(F.sha2(normalised_body(body), 256), 1, 16)


def file_hash(content: Column) -> Column:
    return F.substring(F.md5(content), 1, 12)


def camel_to_snake(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(name, "([A-Z])", "_$1")), "^_", "")


def camel_to_kebab(name: Column, suffix: str = "") -> Column:
    """``suffix`` (``Enum``, ``Controller``) is dropped first."""
    bare = F.regexp_replace(name, f"{suffix}$", "") if suffix else name
    return F.regexp_replace(F.lower(F.regexp_replace(bare, "([A-Z])", "-$1")), "^-", "")


def kebab_to_camel(name: Column) -> Column:
    return F.array_join(F.transform(F.split(name, "-"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 20))), "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """With its dot; empty where there is none."""
    return F.regexp_extract(basename(path), r"[^.](\.[^.]*)$", 1)


def class_of_path(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"([A-Z]\w+)\.java$", 1), F.lit(""))


def handler_method(symbol: Column) -> Column:
    return F.nullif(F.regexp_extract(symbol, r"\.(\w+)#\d+$", 1), F.lit(""))


def ellipsis(text: Column, width: int = 40) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))).otherwise(text)


def round_half_up(value: Column, digits: int) -> Column:
    """Halves go up, also below zero."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def normal_path(path: Column) -> Column:
    """Resolves ``.`` and ``..`` segments by a fold over the segments."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda s, x: F.when(x != "..", F.concat(s, F.array(x))).when(F.size(s) > 0, F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(s))
    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(folded, "/"))
