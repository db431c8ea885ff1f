"""Operator 13: quality rules as a short-circuit cascade, in DataFrame functions alone.

Every rule is a Column that tells whether a text fails it. On a bounded sample each rule is run alone: what it takes
beyond a rule that is always false is its cost, the share of texts that it rejects its selectivity. The
cascade asks the rules in the order of rejection per cost, and a text that fails one is asked no more (a
CASE whose later branches are not evaluated). The order changes the work only: a text is kept if it fails no rule.

Measures are of the whole text: words, lines with a word, symbols, lines that repeat an earlier one, words in
windows that come more than once. Repeated windows are found by their 64-bit hashes; only texts in which
a hash comes twice sort them, and equal hashes are then compared word by word.

The rules' limits are those of everyday web filters, taken wide: they are for rubble, not for style.

Defined results: a null text counts as an empty one, has no words and fails the base rules; repeated rows give a row
each; without rows to sample the rules keep their given order; an empty table gives an empty one; further columns
are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import let

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 5
#: Texts of the sample on which rules are measured, on average.
SAMPLE_ROWS = 2000
MIN_WORDS = 10
REPEATED_PERCENT = 20


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def lines(text: Column) -> Column:
    """The lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def _windows(w: Column) -> Column:
    """A hash of each window of words, in the order of their starts."""
    of = lambda i: F.xxhash64(*[w[i + k] for k in range(WINDOW)])
    return F.when(F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), of)).otherwise(F.array().cast("array<long>"))


def _covered(starts: Column) -> Column:
    """Words under windows with these ascending starts."""
    more = F.aggregate(F.sequence(F.lit(1), F.size(starts)), F.lit(0).cast("long"), lambda acc, k: acc + F.when(k < F.size(starts), F.least(F.lit(WINDOW), F.get(starts, k) - F.get(starts, k - 1))).otherwise(F.lit(WINDOW)))
    return F.when(F.size(starts) > 0, more).otherwise(F.lit(0).cast("long"))


def _repeated(h: Column, w: Column) -> Column:
    """The words in windows that come more than once, from the windows' hashes and the words."""
    same = lambda a, b: (a["h"] == b["h"]) & (F.slice(w, a["i"] + 1, F.lit(WINDOW)) == F.slice(w, b["i"] + 1, F.lit(WINDOW)))
    beside = lambda s, x, k: ((k > 0) & same(x, F.get(s, k - 1))) | ((k < F.size(s) - 1) & same(x, F.get(s, k + 1)))
    placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    starts = let(placed, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: beside(s, x, k)), lambda x: x["i"])))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(starts, _covered))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with q_text, q_lines (number of lines with a word) and the measures n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Words and hashes are bound by `let`, so that a filter that is pushed below costs at most the same work again.
    """
    number = lambda c, name: c.cast("long").alias(name)
    of_words = lambda w, h: F.struct(number(F.size(w), "n"), number(F.length(F.array_join(w, "")), "chars"), number(_repeated(h, w), "repeat"))
    of_lines = lambda x: F.struct(number(F.size(x), "n"), number(F.size(x) - F.size(F.array_distinct(x)), "dup"))
    text = F.col("q_text")
    cut = docs.withColumn("q_text", F.coalesce(F.col(text_col), F.lit("")))
    cut = cut.withColumns({"q_w": let(words(text), lambda w: let(_windows(w), lambda h: of_words(w, h))), "q_l": let(lines(text), of_lines)})
    made = {"n_words": F.col("q_w.n"), "word_chars": F.col("q_w.chars"), "n_symbols": F.regexp_count("q_text", F.lit(SYMBOL)).cast("long"), "n_dup_lines": F.col("q_l.dup"), "n_repeat_words": F.col("q_w.repeat"), "q_lines": F.col("q_l.n")}
    return cut.withColumns(made).drop("q_w", "q_l")


@dataclass(frozen=True)
class Rule:
    """fails: a Column over what `measured` gives; it must be true or false, never null."""

    name: str
    fails: Column | Callable[[], Column]

    def column(self) -> Column:
        return self.fails() if callable(self.fails) else self.fails


BASE = (
    Rule("few_words", lambda: F.col("n_words") < MIN_WORDS),
    Rule("repeated_words", lambda: 100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words")),
)
#: Limits in whole numbers: per cent of words or lines, characters a word.
RULES = (
    Rule("word_length", lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))),
    Rule("symbols", lambda: 100 * F.col("n_symbols") > 20 * F.col("n_words")),
    Rule("repeated_lines", lambda: 100 * F.col("n_dup_lines") > 50 * F.col("q_lines")),
    Rule("no_letters", lambda: 100 * F.regexp_count("q_text", F.lit(r"[^\x20\x09-\x0D\p{L}]*\p{L}[^\x20\x09-\x0D]*")) < 60 * F.col("n_words")),
    Rule("ellipses", lambda: 100 * F.regexp_count("q_text", F.lit("(?md)(\\.\\.\\.|…)[\\x20\\x09\\x0D]*$")) > 30 * F.col("q_lines")),
    Rule("bullets", lambda: 100 * F.regexp_count("q_text", F.lit("(?md)^[\\x20\\x09]*[-*•‣●]")) > 90 * F.col("q_lines")),
    Rule("filler", lambda: F.contains(F.lower("q_text"), F.lit("lorem ipsum"))),
)


def ordered(sample: DataFrame, rules: Sequence[Rule] = RULES) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share of rejected texts) on a stored sample of `measured` rows, in the order of rejection per cost; no driver work beyond an aggregate a rule."""
    total = sample.count()
    if not total:
        return [(r, 0.0, 0.0) for r in rules]

    def timed(fails: Column) -> tuple[float, int]:
        took, n = [], 0
        for _ in range(2):  # the first one compiles
            began = time.perf_counter()
            n = sample.agg(F.count_if(fails).alias("n")).first()["n"]
            took.append(time.perf_counter() - began)
        return min(took), n

    idle, _ = timed(F.col("n_words") < 0)
    found = []
    for r in rules:
        took, n = timed(r.column())
        found.append((r, max(took - idle, 1e-3), n / total))
    return sorted(found, key=lambda x: -x[2] / x[1])


def verdict(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that a text fails, in this order; null where it fails none. Later branches are not evaluated."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for r in rules:
        out = out.when(r.column(), F.lit(r.name))
    return out


def cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with the measures, base_failed and kept: the base rules come first, the others in the order found on a sample of sample_rows texts on average."""
    rows = measured(docs, text_col)
    total = docs.count()
    part = docs.select(F.col(text_col).alias("text")).sample(min(1.0, sample_rows / max(total, 1)), seed=13)
    order = ordered(common.stored(measured(part), "quality-sample"), rules)
    base_failed = F.greatest(*[r.column() for r in base], F.lit(False))
    out = rows.withColumn("base_failed", base_failed)
    return out.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict([r for r, _, _ in order]).isNull()))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cascade(common.documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    cut AS (SELECT rid, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
    wins AS (SELECT rid, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k : k + 4], ' '))) AS win FROM cut WHERE len(w) >= 5),
    twice AS (SELECT rid, win FROM wins GROUP BY ALL HAVING count(*) > 1),
    words AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM wins JOIN twice USING (rid, win)) GROUP BY rid),
    m AS (SELECT doc_id, t, w, l, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM cut LEFT JOIN words USING (rid)),
    b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT base_failed AND NOT (word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_symbols > 20 * n_words OR 100 * n_dup_lines > 50 * len(l)
            OR 100 * len(list_filter(w, lambda x: regexp_matches(x, '\pL'))) < 60 * n_words OR 100 * len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\r]*$'))) > 30 * len(l)
            OR 100 * len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^[ \t]*[-*•‣●]'))) > 90 * len(l) OR contains(lower(t), 'lorem ipsum')) AS kept
    FROM b
"""
