"""Quality rules: a threshold table compiled into one Spark projection.

The counts of a text (words, characters in words, symbols, repeated lines, words
in repeated three-word windows, stop words, exclamation marks) are built-in
expressions over the row alone: no shuffle, no Python.  The rules compare whole
numbers (``scale * count <= percent * base``), so every engine agrees on them.

Null text: no words, base_failed.  Empty text: the same.  A null language counts as
listed.  Values equal to a bound pass.  Very long texts are counted whole, in time
that grows with their length (windows are sorted).  Repeated rows and ids: each row
is judged alone.  Empty table: no rows.  Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import words_of

# Common short words by language; texts in other languages skip the stop-word rule.
STOP_WORDS = {
    "de": "der die das und ist in den von zu mit sich auf für nicht ein eine es im dem auch als an".split(),
    "en": "the of and to a in is it that for was on are as with be by this at from he or an not".split(),
    "es": "de la el que en y a los se del las un por con una su para es al lo como más".split(),
    "fr": "de la le et les des en un une est que qui du dans par pour au sur pas il plus avec".split(),
}


@dataclass(frozen=True)
class Rule:
    """Passes where ``low * base <= 100 * count <= high * base`` (a bound of None is open)."""

    name: str
    count: str
    base: str
    low: int | None = None
    high: int | None = None


#: The threshold table: shares in percent of the base.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 200, 2000),
    Rule("symbol_share", "n_symbols", "n_words", None, 50),
    Rule("exclamation_share", "n_marks", "n_words", None, 30),
    Rule("repeated_line_share", "n_dup_lines", "n_lines", None, 50),
    Rule("bullet_line_share", "n_bullets", "n_lines", None, 90),
    Rule("stop_word_share", "n_stop_words", "n_words", 2, None),
)
#: Rules that only hold for languages with a stop-word list (or an unknown language).
LISTED_LANGUAGES_ONLY = {"stop_word_share"}

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the counts of each text."""
    text = F.col("text")
    rows = docs.select("doc_id", "lang", F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.select(
        "*",
        words_of(text).alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]")).alias("lines"),
    )
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})
    n = F.size("words")
    rows = rows.select(
        "doc_id",
        "lang",
        n.cast("long").alias("n_words"),
        _without(text, " \t\n\x0b\f\r").cast("long").alias("word_chars"),
        (F.length(text) - _without(text, SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length(text) - _without(text, "!")).cast("long").alias("n_marks"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"^[ \t]*[-*•]"))).cast("long").alias("n_bullets"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*stop))).cast("long").alias("n_stop_words"),
        "words",
    )
    # Three-word windows with their place, sorted: equal windows become neighbours.  Shifted arrays are zipped rather than
    # looked up by place, so that no expression is evaluated once per element wherever the optimizer puts it.
    shifted = F.arrays_zip(F.col("words").alias("a"), F.expr("slice(words, 2, size(words))").alias("b"), F.expr("slice(words, 3, size(words))").alias("c"))
    window = lambda x, i: F.struct(F.concat_ws(" ", x["a"], x["b"], x["c"]).alias("w"), i.alias("i"))
    rows = rows.select("*", F.when(F.col("n_words") >= 3, F.sort_array(F.transform(F.slice(shifted, F.lit(1), F.size("words") - 2), window))).alias("windows"))
    pairs = F.arrays_zip(F.col("windows").alias("x"), F.expr("slice(windows, 2, size(windows))").alias("y"))
    repeated = F.filter(pairs, lambda p: p["x"]["w"] == p["y"]["w"])
    places = F.flatten(F.transform(repeated, lambda p: F.array(*[p[k]["i"] + j for k in "xy" for j in (0, 1, 2)])))
    return rows.select(
        *[c for c in rows.columns if c not in ("words", "windows")],
        F.coalesce(F.size(F.array_distinct(places)), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean expression over the counts."""
    listed = F.coalesce(F.col("lang").isin(*STOP_WORDS), F.lit(True))
    out = F.lit(True)
    for r in rules:
        count, base = 100 * F.col(r.count), F.col(r.base)
        ok = F.lit(True)
        if r.low is not None:
            ok = ok & (count >= r.low * base)
        if r.high is not None:
            ok = ok & (count <= r.high * base)
        out = out & (ok | ~listed if r.name in LISTED_LANGUAGES_ONLY else ok)
    return out


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_words, the base counts, base_failed and kept, one row per row of docs."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        measure(docs)
        .withColumn("base_failed", failed)
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            (~F.col("base_failed") & verdict(rules)).alias("kept"),
        )
    )


def rules_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same table as a DuckDB condition."""
    parts = []
    for r in rules:
        ok = [f"100 * {r.count} >= {r.low} * {r.base}"] * (r.low is not None)
        ok += [f"100 * {r.count} <= {r.high} * {r.base}"] * (r.high is not None)
        text = " AND ".join(ok)
        if r.name in LISTED_LANGUAGES_ONLY:
            text = f"({text}) OR coalesce(lang NOT IN ({', '.join(repr(k) for k in STOP_WORDS)}), false)"
        parts.append(f"({text})")
    return " AND ".join(parts)


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[ \t-\r]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls FROM d),
wins AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
         FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
reps AS (SELECT rid, i FROM wins QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM reps) GROUP BY rid),
m AS (SELECT w.doc_id, w.lang, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        length(t) - length(replace(t, '!', '')) AS n_marks,
        len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        len(list_filter(ls, lambda x: regexp_matches(x, '^[ \t]*[-*•]'))) AS n_bullets,
        len(list_filter(ws, lambda x: list_contains([{", ".join(repr(w) for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))}], lower(x)))) AS n_stop_words,
        CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {rules_sql()} AS kept FROM b
"""
