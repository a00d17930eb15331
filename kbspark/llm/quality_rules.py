"""Quality rules whose cutoffs are chosen so that few good documents are rejected.

Each rule has a statistic that is larger for worse texts and an ordered list of cutoffs, lenient
ones first. On labelled good documents, of each stratum apart, a cutoff passes if the exact
binomial test rejects "this cutoff rejects more than ``risk`` of the good documents": the chance of
as few rejections as were seen, were the rate ``risk``, is at most the level of the test. Within a
rule and stratum, cutoffs are tested in their fixed order and testing stops at the first failure,
so these need no correction; strata and rules are corrected by Bonferroni. The risk of a stratum is
shared out among the rules, so that all rules together reject no more than ``risk`` of its good
documents, in all strata at once with probability 1 - ``error``. All of it is DataFrame
expressions; only one row for each stratum, rule and cutoff is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, stored

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8

#: Name of each rule, its statistic over the columns of ``measured``, and its cutoffs.
RULES: list[tuple[str, str, list[float]]] = [
    ("symbols", "n_symbols / word_chars", [0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01]),
    ("repeats", "n_repeat_words / n_words", [0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01]),
    ("lines", "n_dup_lines / n_lines", [0.8, 0.6, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05]),
    ("capitals", "n_capitals / word_chars", [0.8, 0.6, 0.4, 0.3, 0.2, 0.15, 0.1]),
    ("marks", "n_marks / word_chars", [0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03]),
]


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _repeat_words(ordered: Column) -> Column:
    """Words in windows that occur twice or more, by places of such windows in ascending order."""
    again = F.filter(ordered, lambda x, k: ((k > 0) & (ordered[k - 1]["h"] == x["h"])) | ((k + 1 < F.size(ordered)) & (ordered[F.least(k + 1, F.size(ordered) - 1)]["h"] == x["h"])))
    places = F.sort_array(F.transform(again, lambda x: x["at"]))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    total = F.aggregate(places, start, lambda s, p: F.struct((p + WINDOW).alias("end"), (s["n"] + WINDOW - F.greatest(F.lit(0), s["end"] - p)).alias("n")), lambda s: s["n"])
    return F.coalesce(total, F.lit(0).cast("long"))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Per row: doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
    n_capitals and n_marks (all long). Null texts have no word and count 0 everywhere; a null
    stratum is a stratum of its own. Windows of words are compared by 64-bit hashes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("(none)")).alias("stratum"), text.alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    n = F.size("hashes")
    rows = rows.withColumn("windows", F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - (WINDOW - 1))), lambda i: F.xxhash64(F.slice("hashes", i, WINDOW)))))
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("ordered", F.when(twice, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))))
    capitals = "".join(map(chr, [*range(0x41, 0x5B), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]))
    whole = F.length("text")
    return rows.select(
        "doc_id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.length(_without(F.col("text"), SPACES)).cast("long").alias("word_chars"),
        (whole - F.length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("ordered")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (whole - F.length(_without(F.col("text"), capitals))).cast("long").alias("n_capitals"),
        (whole - F.length(_without(F.col("text"), "!?"))).cast("long").alias("n_marks"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _statistics() -> Column:
    """One struct for each rule: its name and its statistic (0 where its denominator is)."""
    return F.array(*(F.struct(F.lit(name).alias("rule"), F.coalesce(F.expr(of.replace(" / ", " / nullif(") + ", 0)"), F.lit(0.0)).alias("value")) for name, of, _ in RULES))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X binomial in n trials of chance p, summed exactly in logarithms."""
    start = F.struct((n * F.log1p(F.lit(-p))).alias("term"), F.exp(n * F.log1p(F.lit(-p))).alias("sum"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1) / i) + F.log(F.lit(p / (1 - p)))
        return F.struct(term.alias("term"), (s["sum"] + F.exp(term)).alias("sum"))

    more = F.when(k > 0, F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long")))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(more, start, step, lambda s: s["sum"])


def cutoffs(good: DataFrame, risk: float, error: float) -> DataFrame:
    """The strictest cutoff that passes for each stratum and rule, from ``measured`` rows of good
    documents: stratum, rule, cutoff, n_good, n_rejected, chance. Strata without enough good
    documents, and those without any, have no row: nothing is rejected there."""
    grid = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(i).alias("place"), F.lit(c).alias("cutoff")) for name, _, all_c in RULES for i, c in enumerate(all_c)))
    values = good.filter(~base_failed()).withColumn("s", _statistics())
    # One sum for each rule and cutoff is taken in the same pass: no row is multiplied.
    sums = [F.sum(F.when(F.col("s")[r]["value"] > c, 1).otherwise(0)).cast("long").alias(f"r{r}_{i}") for r, (_, _, all_c) in enumerate(RULES) for i, c in enumerate(all_c)]
    wide = values.groupBy("stratum").agg(F.count("*").alias("n_good"), *sums)
    names = [f"r{r}_{i}" for r, (_, _, all_c) in enumerate(RULES) for i in range(len(all_c))]
    tests = wide.select("stratum", "n_good", F.explode(F.arrays_zip(grid.alias("t"), F.array(*names).alias("k"))).alias("z")).select("stratum", "n_good", "z.t.rule", "z.t.place", "z.t.cutoff", F.col("z.k").alias("n_rejected"))
    n_strata = wide.agg(F.greatest(F.count("*"), F.lit(1)).alias("n_strata"))
    chance = binomial_tail(F.col("n_good"), F.col("n_rejected"), risk / len(RULES))
    tested = tests.withColumn("chance", chance).join(F.broadcast(n_strata)).withColumn("passes", F.col("chance") <= error / (len(RULES) * F.col("n_strata")))
    so_far = Window.partitionBy("stratum", "rule").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = tested.withColumn("all_pass", F.min(F.col("passes").cast("int")).over(so_far) == 1).filter("all_pass")
    last = passed.groupBy("stratum", "rule").agg(F.max_by(F.struct("cutoff", "n_good", "n_rejected", "chance"), "place").alias("t"))
    return last.select("stratum", "rule", "t.*")


def judged(docs: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept and failed_rules (names of the rules that reject it).

    Texts without a word fail the base rules. Labels are the holdout: only rows with label 1 count,
    null labels do not, repeated label rows count once. With no labels at all only the base rules
    reject. Null identifiers match no label; repeated rows are judged alike. An empty table gives
    an empty one.
    """
    rows = stored(measured(docs, id_col, text_col, stratum_col), "measured")
    trusted = labels.filter(F.col(label_col) == 1).select(F.col(id_col).alias("doc_id")).distinct()
    chosen = cutoffs(rows.join(trusted, "doc_id", "left_semi"), risk, error)
    limits = stored(chosen.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("limits")), "limits")
    out = rows.join(limits, "stratum", "left").withColumn("s", _statistics())
    failed = F.filter("s", lambda x: F.coalesce(x["value"] > F.col("limits")[x["rule"]], F.lit(False)))
    out = out.withColumn("base_failed", base_failed()).withColumn("failed_rules", F.transform(failed, lambda x: x["rule"]))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), "failed_rules")


def oracle(risk: float = 0.05, error: float = 0.05) -> str:
    """The same as SQL over documents and labels, with windows compared as text."""
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    capitals = " || ".join(f"'{x}'" for x in ("".join(map(chr, [*range(0x41, 0x5B), *range(0xC0, 0xD7), *range(0xD8, 0xDF)])),))
    statistic = {name: of.replace(" / ", "::DOUBLE / nullif(") + ", 0)" for name, of, _ in RULES}
    stats = " UNION ALL ".join(f"SELECT row_id, stratum, '{name}' AS rule, coalesce({statistic[name]}, 0) AS value, doc_id, base_failed FROM f" for name in statistic)
    grid = ", ".join(f"('{name}', {i}, {c})" for name, _, all_c in RULES for i, c in enumerate(all_c))
    r = risk / len(RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(lang, '(none)') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT row_id, i, array_to_string(list_slice(words, i, i + {WINDOW - 1}), ' ') AS s FROM w, range(1, len(words) - {WINDOW - 2}) t(i) WHERE len(words) >= {WINDOW}),
rep AS (SELECT row_id, i FROM win QUALIFY count(*) OVER (PARTITION BY row_id, s) > 1),
cov AS (SELECT row_id, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n FROM (SELECT row_id, i, lead(i) OVER (PARTITION BY row_id ORDER BY i) AS nxt FROM rep) GROUP BY row_id),
f0 AS (SELECT w.row_id, doc_id, stratum, len(words)::BIGINT AS n_words, length(translate(text, {space}, ''))::BIGINT AS word_chars,
  (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, (length(text) - length(translate(text, {capitals}, '')))::BIGINT AS n_capitals,
  (length(text) - length(translate(text, '!?', '')))::BIGINT AS n_marks FROM w LEFT JOIN cov USING (row_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f0),
s AS ({stats}),
g(rule, place, cutoff) AS (VALUES {grid}),
n AS (SELECT s.stratum, g.rule, g.place, g.cutoff, count(*) AS n, count(*) FILTER (s.value > g.cutoff) AS k FROM s JOIN g USING (rule)
  WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY ALL),
t AS (SELECT *, list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({r}) + (n - i) * ln(1 - {r}))))
  <= {error} / ({len(RULES)} * (SELECT count(DISTINCT stratum) FROM n)) AS passes FROM n),
p AS (SELECT *, bool_and(passes) OVER (PARTITION BY stratum, rule ORDER BY place) AS ok FROM t),
c AS (SELECT stratum, rule, arg_max(cutoff, place) AS cutoff FROM p WHERE ok GROUP BY ALL),
x AS (SELECT row_id, list(s.rule) AS rules FROM s JOIN c ON s.stratum = c.stratum AND s.rule = c.rule WHERE s.value > c.cutoff GROUP BY row_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND x.rules IS NULL AS kept FROM f LEFT JOIN x USING (row_id)
"""
