"""Quality rules as a short-circuit cascade.

Each rule rejects a document by one condition. Its cost and its rejections are measured
on a sample; rules then run in the order of rejections per cost, as one CASE expression,
which stops at the first rule that rejects. A verdict does not depend on the order.

A cost is the least time of some runs over the sample, less that of a run without a rule,
as a power of two, so that the noise of a job does not decide. Measures that are wanted as
columns are computed for all rows and cost nothing more in a rule; the other measures are
evaluated by the CASE expression, only for rows that no rule before has rejected.

Defined cases: a null text is empty and has no words; an empty table gives an empty
result; repeated rows are judged each; other columns stay as they are.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlane.llm.common import checkpointed, let, words_of

#: Rows on which cost and selectivity are estimated; the verdicts do not depend on it.
SAMPLE_ROWS = 2_000
RUNS = 2

SYMBOLS = "#*$%&|<>"


def _chars(text: Column) -> Column:
    return F.length(F.translate(text, " \t\n\x0b\x0c\r", ""))


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more: equal windows are neighbours
    once sorted by hash, and sorted starts add at most 3 words each."""

    def starts(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")),
        )
        return let(F.sort_array(windows), lambda s: F.sort_array(F.transform(F.filter(
            s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
        ), lambda x: x["p"])))

    def covered(p: Column) -> Column:
        zero = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        step = lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"))
        return F.aggregate(p, zero, step, lambda a: a["n"])

    return F.when(F.size(words) < 4, 0).otherwise(let(starts(words), covered))


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    return let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a)))


def measures(text: Column) -> dict[str, Column]:
    """The numbers that the rules look at, each from the text alone."""
    t = F.coalesce(text, F.lit(""))
    words = words_of(t)
    return {
        "n_words": F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"),
        "word_chars": _chars(t).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": _dup_lines(t).cast("long"),
        "n_repeat_words": let(words, _repeat_words).cast("long"),
        "n_lines": F.size(F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)).cast("long"),
        "n_upper": (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}", ""))).cast("long"),
        "n_marks": (F.length(t) - F.length(F.translate(t, "!?", ""))).cast("long"),
    }


#: Rules by name; each is true for a document that it rejects. m: the measures.
RULES: dict[str, Callable[[dict[str, Column]], Column]] = {
    "too_few_words": lambda m: m["n_words"] < 50,
    "repeated_words": lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"],
    "symbols": lambda m: 100 * m["n_symbols"] > 30 * m["n_words"],
    "word_length": lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"]),
    "repeated_lines": lambda m: 100 * m["n_dup_lines"] > 30 * m["n_lines"],
    "capitals": lambda m: 100 * m["n_upper"] > 50 * m["word_chars"],
    "marks": lambda m: 100 * m["n_marks"] > 60 * m["n_words"],
}

BASE_RULES = ("too_few_words", "repeated_words")


def ordered_rules(docs: DataFrame, text: str = "text", rules=None, rows: int = SAMPLE_ROWS, free: tuple[str, ...] = ()) -> list[tuple[str, float, float]]:
    """(rule, seconds, share rejected) in the order in which the cascade runs them. free:
    measures that cost nothing, as they are columns. The sample is of all partitions alike."""
    rules = rules or RULES
    t = docs.select(F.col(text).alias("t"))
    names = list(measures(F.col("t")))
    sample = t.sample(min(1.0, rows / max(1, t.count())), 11)
    sample = checkpointed(sample.select("t", *[measures(F.col("t"))[k].alias(k) for k in free]))
    m = {k: F.col(k) if k in free else measures(F.col("t"))[k] for k in names}
    n = max(1, sample.count())
    hits = sample.agg(*[F.count_if(F.coalesce(rule(m), F.lit(False))).alias(k) for k, rule in rules.items()]).first()

    def seconds(condition: Column) -> float:
        def once() -> float:
            began = time.perf_counter()
            sample.agg(F.count_if(F.coalesce(condition, F.lit(False)))).collect()
            return time.perf_counter() - began

        return min(once() for _ in range(RUNS))

    base = seconds(F.col("t") == "")
    cost = {k: 2.0 ** round(math.log2(max(seconds(rule(m)) - base, 2.0**-10))) for k, rule in rules.items()}
    found = [(k, cost[k], hits[k] / n) for k in rules]
    return sorted(found, key=lambda x: (-x[2] / x[1], x[1], x[0]))


def verdict(m: dict[str, Column], order: list[str], rules=None) -> Column:
    """True where no rule rejects; later rules are not evaluated after a rejection."""
    rules = rules or RULES
    out = F.lit(True)
    for name in reversed(order):
        out = F.when(rules[name](m), F.lit(False)).otherwise(out)
    return out


def judged(docs: DataFrame, text: str = "text", rules=None) -> DataFrame:
    """docs with a column kept: the cascade over expressions that are evaluated only
    as far as the verdict needs them."""
    order = [x[0] for x in ordered_rules(docs, text, rules)]
    return docs.withColumn("kept", verdict(measures(F.col(text)), order, rules))


#: Measures that measured() returns for all rows.
WANTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", wanted: tuple[str, ...] = WANTED) -> DataFrame:
    """doc_id, the wanted measures and kept. The other measures are evaluated in the cascade,
    only as far as a verdict needs them."""
    order = [x[0] for x in ordered_rules(docs, text, free=wanted)]
    every = measures(F.col(text))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"), *[every[k].alias(k) for k in wanted])
    m = {k: F.col(k) if k in wanted else c for k, c in measures(F.col("t")).items()}
    return rows.select("doc_id", *wanted, verdict(m, order).alias("kept"))


def query(docs: DataFrame) -> DataFrame:
    m = {k: F.col(k) for k in ("n_words", "n_repeat_words")}
    failed = RULES["too_few_words"](m) | RULES["repeated_words"](m)
    return measured(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept")


