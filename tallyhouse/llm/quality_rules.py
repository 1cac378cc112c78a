"""Quality rules (10) as a short-circuit cascade.

Rules look at measures of a text. Each rule's cost and selectivity are estimated on a sample: how long the sample takes
with the rule, and how many of its rows it rejects. Rules are then asked in the order of rejections per cost, and a
row's remaining rules are not asked once one rejects it. The order is for speed only: a row is kept if no rule rejects
it, whatever the order.

Everything is counted in the row, without shuffles: words in repeated windows by hashes of the words of a window,
sorted within the row only where some window occurs twice.

Defined results: a null or empty text has no words and fails the least number of words; repeated rows are each answered; other
columns are not looked at. Only DataFrame functions are used. Windows are told apart by 64-bit hashes.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.sources.store import Store

SPACE = "\x20\t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
#: About so many rows are looked at to order the rules.
SAMPLE_ROWS = 1000

Rule = Callable[[dict[str, Column]], Column]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: a lambda's variable is never written out again by the optimiser."""
    return F.transform(F.array(value), use)[0]


def _windows(hashes: Column) -> Column:
    """A hash for each window of words, from the hashes of the words."""
    starts = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
    windows = F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))
    return F.when(F.size(hashes) >= WINDOW, windows).otherwise(F.array().cast("array<bigint>"))


def _twins(pairs: Column) -> Column:
    """Places of the windows that have an equal one, in order, from sorted pairs of hash and place."""
    alike = lambda x, k: (x["h"] == F.get(pairs, k - 1)["h"]) | (x["h"] == F.get(pairs, k + 1)["h"])
    return F.array_sort(F.array_compact(F.transform(pairs, lambda x, k: F.when(alike(x, k), x["p"]))))


def _covered(starts: Column) -> Column:
    """Words covered by windows at the given places."""
    fresh = F.transform(starts, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - p, F.lit(WINDOW))))
    return F.aggregate(fresh, F.lit(0), lambda total, n: total + n)


def _n_repeat_words(windows: Column) -> Column:
    """Words in windows that occur twice or more; sorts only where there is such a window."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(
        _let(pairs, lambda sorted_pairs: _let(_twins(sorted_pairs), _covered))
    )


def measures(text: Column) -> dict[str, Column]:
    """Measures of a text that is not null. Those of words share one look at the words."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.length(F.btrim(line, F.lit(SPACE))) > 0)
    by_words = _let(
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        lambda words: F.struct(
            F.size(words).alias("n_words"),
            _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _let(_windows(h), _n_repeat_words)).alias(
                "n_repeat_words"
            ),
        ),
    )
    by_lines = _let(lines, lambda some: F.struct(F.size(some).alias("n_lines"), (F.size(some) - F.size(F.array_distinct(some))).alias("n_dup_lines")))
    return {
        "by_words": by_words,
        "by_lines": by_lines,
        "word_chars": F.length(F.translate(text, SPACE, "")),
        "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
        "n_upper": F.length(text) - F.length(F.translate(text, UPPER, "")),
        "n_lower": F.length(text) - F.length(F.translate(text, LOWER, "")),
    }


#: Where the measures that rules and results name are found among ``measures``.
FIELDS = {
    "n_words": "by_words.n_words",
    "word_chars": "word_chars",
    "n_symbols": "n_symbols",
    "n_lines": "by_lines.n_lines",
    "n_dup_lines": "by_lines.n_dup_lines",
    "n_upper": "n_upper",
    "n_lower": "n_lower",
    "n_repeat_words": "by_words.n_repeat_words",
}


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the measures of each document."""
    raw = docs.select("doc_id", *[m.alias(name) for name, m in measures(F.coalesce("text", F.lit(""))).items()])
    return raw.select("doc_id", *[F.col(path).cast("long").alias(name) for name, path in FIELDS.items()])


#: What a rule rejects, by name.
RULES: dict[str, Rule] = {
    "too_few_words": lambda m: m["n_words"] < LEAST_WORDS,
    "repeated_words": lambda m: 100 * m["n_repeat_words"] > MOST_REPEATED_PERCENT * m["n_words"],
    "symbols": lambda m: 100 * m["n_symbols"] > 10 * m["word_chars"],
    "repeated_lines": lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"],
    "word_length": lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 25 * m["n_words"]),
    "shouting": lambda m: 100 * m["n_upper"] > 60 * (m["n_upper"] + m["n_lower"]),
}
BASE = ("too_few_words", "repeated_words")


def rule_order(docs: DataFrame, store: Store, rules: dict[str, Rule] = RULES, rows: int = SAMPLE_ROWS) -> list[str]:
    """The rules by rejections per second on a sample of about ``rows`` rows, taken by the hash of the id."""
    total = docs.count()
    share = min(1.0, rows / max(1, total))
    sample = store.write(
        "sample", docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    )

    def timed(rule: Rule | None) -> tuple[float, int]:
        held = {name: F.col(name) for name in FIELDS}
        test = F.count_if(rule(held)) if rule else F.count("text")
        start = time.perf_counter()
        hits = (measured(sample) if rule else sample).agg(test).first()[0]
        return time.perf_counter() - start, hits

    timed(None)
    empty = timed(None)[0]
    rate = {}
    for name, rule in rules.items():
        seconds, hits = timed(rule)
        rate[name] = hits / max(seconds - empty, 1e-3)
    return sorted(rules, key=lambda name: -rate[name])


def cascade(frame: DataFrame, order: list[str], rules: dict[str, Rule] = RULES) -> DataFrame:
    """The frame, which holds the measures as columns, with ``rejected``: whether some rule rejects the row."""
    held = {name: F.col(name) for name in FIELDS}
    first, *rest = order
    verdict = reduce(
        lambda case, name: case.when(rules[name](held), F.lit(True)), rest, F.when(rules[first](held), F.lit(True))
    )
    return frame.withColumn("rejected", verdict.otherwise(F.lit(False)))


def quality_rules(docs: DataFrame, store: Store, rules: dict[str, Rule] = RULES) -> DataFrame:
    """``doc_id``, the measures, ``base_failed`` and ``kept`` for each document."""
    order = rule_order(docs, store, rules)
    held = {name: F.col(name) for name in FIELDS}
    base = reduce(Column.__or__, [RULES[name](held) for name in BASE])
    return cascade(measured(docs), order, rules).select(
        "doc_id", *FIELDS, base.alias("base_failed"), (~base & ~F.col("rejected")).alias("kept")
    )
