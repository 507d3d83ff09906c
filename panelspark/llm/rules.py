"""Quality rules as a short-circuit cascade.

A rule is a Column that is true for a text that fails it, on top of statistics of the text.
``measure_rules`` runs every rule alone over a sample and notes its cost (time of the run
less that of an empty rule) and its selectivity (share of rows rejected); ``cascade`` tests
the rules in order of rejections per cost in one CASE, so that a row leaves at its first
failed rule and the later, dearer statistics of that row are never computed.

Statistics are of two kinds. Those of ``STATS`` are cheap or wanted for every row;
``judged_stats`` makes them columns, and the sample is measured with them as columns too, so a rule
on them costs a comparison. Those of ``DEAR`` (distinct words, distinct code points, lines left
open) are computed by no one but the rules that name them, inside the cascade: a row that fails an
earlier rule never pays for them.

The order changes the time a cascade takes, never its verdict.

Defined results: a missing text is treated as empty, which has no words and fails
``few_words``; rows that repeat get equal verdicts; an empty table gives an empty result
(and the rules keep their given order).
"""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import WORD, n_words

BLANK_CLASS = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
OPEN_LINE = r"(?:\.\.\.|\x{2026})[\x20\x09-\x0D]*\z"


def let(value: Column, body) -> Column:
    """``body`` over ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def word_array(text: Column) -> Column:
    return F.filter(F.split(text, BLANK_CLASS + "+"), lambda w: w != "")


def word_chars(text: Column) -> Column:
    """Code points in words."""
    return (F.char_length(text) - F.regexp_count(text, F.lit(BLANK_CLASS))).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOLS)).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(text: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur twice or more in the text.

    Windows are 64-bit hashes of their words' hashes. A text without equal windows stops
    there; otherwise windows are sorted with their positions, those equal to a neighbour
    are kept, and the union of their spans is measured.
    """
    hashes = F.transform(word_array(text), lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - window)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(window)]))

    def repeated(keys: Column) -> Column:
        placed = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        same = let(placed, lambda s: F.transform(
            F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["k"] == x["k"], F.lit(False))
                     | F.coalesce(F.get(s, j + 1)["k"] == x["k"], F.lit(False))),
            lambda x: x["i"]))
        return let(F.array_sort(same), lambda at: F.aggregate(
            F.transform(at, lambda p, j: F.least(F.lit(window), F.coalesce(F.get(at, j + 1) - p, F.lit(window)))),
            F.lit(0), lambda a, b: a + b))

    def count(h: Column) -> Column:
        covered = let(windows(h), lambda keys: F.when(
            F.size(F.array_distinct(keys)) < F.size(keys), repeated(keys)).otherwise(F.lit(0)))
        return F.when(F.size(h) >= window, covered).otherwise(F.lit(0))

    return let(hashes, count).cast("long")


def n_lines(text: Column) -> Column:
    return F.size(F.split(text, "\n")).cast("long")


#: Statistics of a text, by name.
STATS = {
    "n_lines": n_lines,
    "n_words": n_words,
    "word_chars": word_chars,
    "n_symbols": n_symbols,
    "n_dup_lines": n_dup_lines,
    "n_repeat_words": n_repeat_words,
}


def n_kinds(text: Column) -> Column:
    """Distinct words."""
    return F.size(F.array_distinct(word_array(text))).cast("long")


def n_letters(text: Column) -> Column:
    """Distinct code points."""
    return F.size(F.array_distinct(F.split(text, ""))).cast("long")


def n_open_lines(text: Column) -> Column:
    """Lines that end in an ellipsis."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(OPEN_LINE))).cast("long")


#: Statistics that only rules read, by name.
DEAR = {"n_kinds": n_kinds, "n_letters": n_letters, "n_open_lines": n_open_lines}


def base_rules(stat: Mapping[str, Column]) -> dict[str, Column]:
    """The two rules every text must pass."""
    return {
        "few_words": stat["n_words"] < 10,
        "repeats": 100 * stat["n_repeat_words"] > 20 * stat["n_words"],
    }


def default_rules(stat: Mapping[str, Column]) -> dict[str, Column]:
    """Base rules and limits on word length, symbols, repeated lines, distinct words (one in ten of the
    first 1,000 words, so long texts need 100), distinct code points and open lines (true: rejected)."""
    words = stat["n_words"]
    return base_rules(stat) | {
        "short_words": stat["word_chars"] < 2 * words,
        "long_words": stat["word_chars"] > 15 * words,
        "symbols": 10 * stat["n_symbols"] > words,
        "dup_lines": (10 * stat["n_dup_lines"] > 3 * stat["n_lines"]) & (stat["n_dup_lines"] > 1),
        "few_kinds": 10 * stat["n_kinds"] < F.least(words, F.lit(1000)),
        "few_letters": stat["n_letters"] < 8,
        "open_lines": (10 * stat["n_open_lines"] > 3 * stat["n_lines"]) & (stat["n_open_lines"] > 1),
    }


def lazy_stats(text: Column) -> dict[str, Column]:
    """Every statistic as an expression of the text: a rule computes only what it names."""
    text = F.coalesce(text, F.lit(""))
    return {k: f(text) for k, f in (STATS | DEAR).items()}


def held_stats(text: Column) -> dict[str, Column]:
    """The statistics where those of ``STATS`` are columns: the others are expressions of the text."""
    return lazy_stats(text) | {k: F.col(k) for k in STATS}


def measure_rules(docs: DataFrame, rules: Mapping[str, Column], sample_rows: int = 2000,
                  seed: int = 17, stats: Mapping[str, Column] | None = None) -> list[tuple[str, float, float]]:
    """(rule, seconds, share of rows rejected) over a random sample of about ``sample_rows`` rows;
    ``stats`` are columns that the rules read, added to the sampled rows."""
    total = docs.count()
    sample = docs.sample(min(1.0, sample_rows / max(1, total)), seed).withColumns(dict(stats or {})).persist()
    try:
        rows = sample.count()

        def run(rule: Column) -> tuple[float, int]:
            began = time.perf_counter()
            n = sample.agg(F.count(F.when(rule, 1))).first()[0]
            return time.perf_counter() - began, n

        run(F.lit(False))
        empty = run(F.lit(False))[0]
        found = []
        for name, rule in rules.items():
            seconds, rejected = run(rule)
            found.append((name, max(seconds - empty, 1e-4), rejected / max(1, rows)))
        return found
    finally:
        sample.unpersist()


def by_rejection_per_cost(measured: Sequence[tuple[str, float, float]]) -> list[str]:
    """Rule names, most rejections per second first (ties keep the given order)."""
    return [m[0] for m in sorted(measured, key=lambda m: -m[2] / m[1])]


def cascade(rules: Mapping[str, Column], order: Sequence[str]) -> Column:
    """Name of the first failed rule in ``order``, NULL if all are passed."""
    tests = [(rules[name], F.lit(name)) for name in order]
    head, *rest = tests
    return reduce(lambda c, t: c.when(*t), rest, F.when(*head))


def rule_order(docs: DataFrame, text_col: str = "text", rules=default_rules, sample_rows: int = 2000) -> list[str]:
    """The order of a cascade, from what the rules cost and reject on a sample."""
    own = rules(lazy_stats(F.col(text_col)))
    return by_rejection_per_cost(measure_rules(docs.select(text_col), own, sample_rows))


def failed_rule(docs: DataFrame, text_col: str = "text", rules=default_rules, sample_rows: int = 2000,
                out: str = "failed_rule") -> DataFrame:
    """``docs`` with the first rule each text fails (NULL: kept); only the statistics that the
    cascade comes to are computed."""
    order = rule_order(docs, text_col, rules, sample_rows)
    return docs.withColumn(out, cascade(rules(lazy_stats(F.col(text_col))), order))


def judged_stats(docs: DataFrame, text_col: str = "text", rules=default_rules, sample_rows: int = 2000,
                 out: str = "failed_rule") -> DataFrame:
    """As :func:`failed_rule`, with every statistic of ``STATS`` as a column; the cascade reads these
    columns and computes those of ``DEAR`` only for the rows that come to a rule on them. Columns of
    these names are replaced."""
    stats = {k: f(F.coalesce(F.col(text_col), F.lit(""))) for k, f in STATS.items()}
    own = rules(held_stats(F.col(text_col)))
    order = by_rejection_per_cost(measure_rules(docs.select(text_col), own, sample_rows, stats=stats))
    return docs.withColumns(stats).withColumn(out, cascade(own, order))
