"""Quality rules as weak supervision, with DataFrame functions alone.

Each rule votes good (1), bad (0) or abstains (null). Expectation-maximisation over the counted vote patterns estimates
how accurate each rule is and how common good documents are; a document is kept by its posterior probability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_UPPER, SPACES, land

WORDS_IN_WINDOW = 5
SYMBOLS = "#*$%&|<>"
STOP_WORDS = ("the of and to in is that for with der die und von den mit ist le la les de et des un une el los que y en con").split()
#: Rules over the features of :func:`features`, in SQL; a rule abstains where no branch holds.
RULES = {
    "length": "CASE WHEN n_words >= 40 THEN 1 WHEN n_words < 15 THEN 0 END",
    "word_length": "CASE WHEN word_chars >= 3 * n_words AND word_chars <= 10 * n_words THEN 1 ELSE 0 END",
    "symbols": "CASE WHEN 50 * n_symbols <= n_words THEN 1 WHEN 8 * n_symbols > n_words THEN 0 END",
    "lines": "CASE WHEN n_dup_lines = 0 THEN 1 WHEN 5 * n_dup_lines > n_lines THEN 0 END",
    "repeats": "CASE WHEN 20 * n_repeat_words <= n_words THEN 1 WHEN 5 * n_repeat_words > n_words THEN 0 END",
    "sentences": "CASE WHEN 30 * n_sentences >= n_words THEN 1 WHEN 200 * n_sentences < n_words THEN 0 END",
    "capitals": "CASE WHEN 5 * n_capitals <= n_letters THEN 1 WHEN 2 * n_capitals > n_letters THEN 0 END",
    "stop_words": "CASE WHEN n_stop_words >= 3 THEN 1 WHEN n_stop_words = 0 THEN 0 END",
    "shouts": "CASE WHEN 5 * n_shouts > n_words THEN 0 END",
}
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"
START = {"prior": 0.7, "accuracy": 0.8}
#: What the start counts for: rows of the prior, votes of each rule. Accuracies stay within the two limits.
WEIGHT, LOWEST, HIGHEST = 10.0, 0.5, 0.995


def _without(text: Column, letters: str) -> Column:
    """Code points of ``text`` among ``letters``."""
    return (F.length(text) - F.length(F.translate(text, letters, ""))).cast("long")


def _shifted(xs: Column, by: int) -> Column:
    return F.slice(xs, by + 1, F.greatest(F.size(xs) - by, F.lit(0)))


def repeat_words(hashes: Column) -> Column:
    """Words in windows of five that occur twice or more in one text, from the hashes of its words."""
    two = F.zip_with(hashes, _shifted(hashes, 1), lambda a, b: F.xxhash64(a, b))
    four = F.zip_with(two, _shifted(two, 2), lambda a, b: F.xxhash64(a, b))
    five = F.zip_with(four, _shifted(hashes, 4), lambda a, b: F.xxhash64(a, b))
    return F.slice(five, 1, F.greatest(F.size(hashes) - (WORDS_IN_WINDOW - 1), F.lit(0)))


def covered(windows: Column) -> Column:
    """Words covered by repeated windows: repeated values lie next to each other once sorted."""
    ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    marked = F.zip_with(ranked, _shifted(ranked, 1), lambda a, b: F.struct(a["i"].alias("i"), b["i"].alias("j"), (a["h"] == b["h"]).alias("same")))
    starts = F.sort_array(F.array_distinct(F.flatten(F.transform(F.filter(marked, lambda m: m["same"]), lambda m: F.array(m["i"], m["j"])))))
    return F.aggregate(F.zip_with(starts, _shifted(starts, 1), lambda a, b: F.least(F.coalesce(b - a, F.lit(WORDS_IN_WINDOW)), F.lit(WORDS_IN_WINDOW))),
                       F.lit(0), lambda s, x: s + x)


def features(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document with the counts that the rules use. Null counts as an empty text, without words."""
    body = F.coalesce(F.col(text), F.lit(""))
    one = docs.select(*carry, body.alias("__text"), F.array_remove(F.split(body, f"[{SPACES}]+"), "").alias("__words"),
                      F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{SPACES}]")).alias("__lines"))
    two = one.select(*carry, "__text", F.size("__words").cast("long").alias("n_words"),
                     F.size(F.array_intersect("__words", F.array(*[F.lit(w) for w in STOP_WORDS]))).alias("n_stop_words"),
                     F.size("__lines").cast("long").alias("n_lines"), (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
                     F.transform("__words", lambda w: F.xxhash64(w)).alias("__hashes"))
    three = two.withColumn("__windows", repeat_words(F.col("__hashes"))).drop("__hashes")
    t = F.col("__text")
    return three.select(
        *carry, "n_words", F.length(F.regexp_replace(t, f"[{SPACES}]+", "")).cast("long").alias("word_chars"), _without(t, SYMBOLS).alias("n_symbols"),
        "n_dup_lines", F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), covered(F.col("__windows"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_lines", F.regexp_count(t, F.lit(r"[.!?](\n|\z)|[.!?] ")).cast("long").alias("n_sentences"), _without(t, ASCII_UPPER).alias("n_capitals"),
        _without(t, ASCII_UPPER + ASCII_UPPER.lower()).alias("n_letters"), F.col("n_stop_words").cast("long").alias("n_stop_words"), _without(t, "!").alias("n_shouts"))


def votes(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    return rows.select("*", *[F.expr(sql).cast("int").alias(f"vote_{name}") for name, sql in rules.items()])


def posterior_sql(prior: str, accuracy: dict[str, str]) -> str:
    """Posterior probability of a good document from its votes."""
    odds = [f"ln(({prior}) / (1 - ({prior})))"]
    odds += [f"CASE vote_{n} WHEN 1 THEN ln(({a}) / (1 - ({a}))) WHEN 0 THEN -ln(({a}) / (1 - ({a}))) ELSE 0 END" for n, a in accuracy.items()]
    return f"1 / (1 + exp(-({' + '.join(odds)})))"


def maximise_sql(names) -> dict[str, str]:
    """Aggregates over patterns with count n and posterior q: the next prior and accuracies."""
    out = {"prior": f"(sum(n * q) + {WEIGHT * START['prior']}) / (sum(n) + {WEIGHT})"}
    for name in names:
        right = f"sum(CASE vote_{name} WHEN 1 THEN n * q WHEN 0 THEN n * (1 - q) ELSE 0 END)"
        out[name] = f"least({HIGHEST}, greatest({LOWEST}, ({right} + {WEIGHT * START['accuracy']}) / (sum(CASE WHEN vote_{name} IS NULL THEN 0 ELSE n END) + {WEIGHT})))"
    return out


def estimate(voted: DataFrame, names, iterations: int = 12) -> tuple[float, dict[str, float]]:
    """(prior, accuracy of each rule) by expectation-maximisation over the distinct vote patterns of all rows.

    There are at most 3 ** len(names) patterns; only the parameters, a number for each rule, come to the driver."""
    names = list(names)
    patterns = land(voted.groupBy(*[f"vote_{n}" for n in names]).agg(F.count(F.lit(1)).cast("double").alias("n")).coalesce(1), "vote-patterns")
    prior, accuracy = START["prior"], dict.fromkeys(names, START["accuracy"])
    step = [F.expr(sql).alias(k) for k, sql in maximise_sql(names).items()]
    for _ in range(iterations):
        q = posterior_sql(repr(prior) + "D", {n: repr(a) + "D" for n, a in accuracy.items()})
        got = patterns.withColumn("q", F.expr(q)).agg(*step).first()
        if got["prior"] is None:
            break
        prior, accuracy = got["prior"], {n: got[n] for n in names}
    return prior, accuracy


def judge(docs: DataFrame, rules: dict[str, str] | None = None, threshold: float = 0.5, iterations: int = 12, text: str = "text",
          carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Features, votes, posterior, base_failed and kept of every document.

    A null or empty text has no words: it fails the base rule. Repeated rows are judged alike and all count. An empty table
    gives an empty one; other columns than ``carry`` and ``text`` are not read. ``rules`` adds to or replaces :data:`RULES`."""
    rules = RULES | (rules or {})
    rows = land(votes(features(docs, text, carry), rules), "quality-votes")
    prior, accuracy = estimate(rows, rules, iterations)
    q = F.expr(posterior_sql(repr(prior) + "D", {n: repr(a) + "D" for n, a in accuracy.items()}))
    failed = F.expr(BASE_FAILED)
    return rows.select("*", q.alias("posterior"), failed.alias("base_failed"), (~failed & (q >= threshold)).alias("kept"))
