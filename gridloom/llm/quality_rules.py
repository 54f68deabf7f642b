"""Quality rules: text statistics as SQL expressions, and a decision list learned from labelled statistics.

The statistics are one projection over the texts: no shuffle, no Python. The decision list is learned on the driver from a
bounded sample of labelled rows (``SAMPLE``): sequential covering grows a conjunction of thresholds by information gain on
two thirds of the sample, prunes it on the rest, and goes on without the rows that it covers. What is learned becomes one
ordered conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a list is learned from, at most: those with the least hashed ids.
SAMPLE = 20_000
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Thresholds tried for each statistic, terms of a rule, rules of a list, rejected rows that a rule needs, its least precision.
CUTS, TERMS, RULES, LEAST, PRECISION = 48, 4, 12, 5, 0.95
SPACE = " \t\n\x0b\f\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_distinct_words")
#: What rules are made of; each is 0 where its divisor is.
RATES = {
    "n_words": "cast(n_words as double)",
    "mean_word": "coalesce(word_chars / nullif(n_words, 0), 0D)",
    "symbol_rate": "coalesce(n_symbols / nullif(word_chars, 0), 0D)",
    "dup_line_rate": "coalesce(n_dup_lines / nullif(n_lines, 0), 0D)",
    "repeat_rate": "coalesce(n_repeat_words / nullif(n_words, 0), 0D)",
    "upper_rate": "coalesce(n_upper / nullif(word_chars, 0), 0D)",
    "distinct_rate": "coalesce(n_distinct_words / nullif(n_words, 0), 0D)",
}


def with_statistics(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with the columns of ``COUNTS`` (replacing columns of those names); a null text counts as empty."""
    ws, t = r"[\x20\x09-\x0D]", F.coalesce(F.col(text), F.lit(""))
    inner = F.trim(t, F.lit(SPACE))
    staged = (
        docs.withColumn("__words", F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, ws + "+")))
        .withColumn("__lines", F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(SPACE)) != ""))
        .withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
        .withColumn(
            "__windows",
            F.when(F.size("__hashes") < window, F.array().cast("array<bigint>")).otherwise(
                F.transform(F.sequence(F.lit(1), F.size("__hashes") - (window - 1)), lambda i: F.xxhash64(F.slice("__hashes", i, window)))
            ),
        )
        .withColumn("__twice", F.size(F.array_distinct("__windows")) < F.size("__windows"))
        .withColumn("__sorted", F.when(F.col("__twice"), F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
        .withColumn(
            "__starts",
            F.array_sort(
                F.transform(
                    F.filter("__sorted", lambda s, k: (F.get("__sorted", k - 1)["h"] == s["h"]) | (F.get("__sorted", k + 1)["h"] == s["h"])),
                    lambda s: s["i"],
                )
            ),
        )
    )
    covered = F.aggregate(
        "__starts",
        F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(window), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    values = {
        "n_words": F.size("__words"),
        "word_chars": F.length(F.array_join("__words", "")),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_lines": F.size("__lines"),
        "n_upper": F.regexp_count(t, F.lit(r"\p{Lu}")),
        "n_distinct_words": F.size(F.array_distinct("__hashes")),
    }
    staged = staged.drop(*COUNTS).withColumns({k: v.cast("long") for k, v in values.items()})
    return staged.drop("__words", "__lines", "__hashes", "__windows", "__twice", "__sorted", "__starts")


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above, threshold); what it covers is rejected."""

    terms: tuple[tuple[str, bool, float], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([(x[f] > t) if above else (x[f] <= t) for f, above, t in self.terms])

    def condition(self) -> Column:
        out = F.lit(True)
        for f, above, t in self.terms:
            rate = F.expr(RATES[f])
            out = out & ((rate > F.lit(t)) if above else (rate <= F.lit(t)))
        return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, on: np.ndarray) -> list[tuple[str, bool, float]]:
    terms, cover = [], on.copy()
    cuts = {f: np.unique(np.quantile(v[on], np.linspace(0, 1, CUTS))) for f, v in x.items()}
    while len(terms) < TERMS and (cover & ~bad).any():
        p0, n0 = (cover & bad).sum(), (cover & ~bad).sum()
        base, best = np.log2(p0 / (p0 + n0)), (0.0, None)
        for f, v in x.items():
            pos, neg = np.sort(v[cover & bad]), np.sort(v[cover & ~bad])
            low_p, low_n = np.searchsorted(pos, cuts[f], "right"), np.searchsorted(neg, cuts[f], "right")
            for above in (False, True):
                p, n = (p0 - low_p, n0 - low_n) if above else (low_p, low_n)
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - base), 0.0)
                k = int(gain.argmax())
                if gain[k] > best[0] + 1e-9:
                    best = (gain[k], (f, above, float(cuts[f][k])))
        if best[1] is None:
            break
        f, above, t = best[1]
        low, high = x[f][cover & (x[f] <= t)], x[f][cover & (x[f] > t)]
        # halfway between the values that the threshold parts
        terms.append((f, above, float((low.max() + high.min()) / 2) if len(low) and len(high) else t))
        cover &= Rule((terms[-1],)).covers(x)
    return terms


def learn_list(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """Rules for rejection, in order; every third row prunes."""
    rules: list[Rule] = []
    left, pruner = np.ones(len(bad), bool), np.arange(len(bad)) % 3 == 2
    while len(rules) < RULES and (left & ~pruner & bad).sum() >= LEAST:
        terms = _grow(x, bad, left & ~pruner)
        scored = []
        for k in range(1, len(terms) + 1):
            cover = Rule(tuple(terms[:k])).covers(x) & left
            p, n = (cover & pruner & bad).sum(), (cover & pruner & ~bad).sum()
            scored.append(((p - n) / max(p + n, 1), -k, (cover & bad).sum() / max(cover.sum(), 1), p))
        if not scored:
            break
        worth, k, precision, p = max(scored)
        if precision < PRECISION or worth < 2 * PRECISION - 1 or not p:
            break
        rules.append(Rule(tuple(terms[:-k])))
        left &= ~rules[-1].covers(x)
    return rules


def sampled(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, __quality) of at most ``sample`` labelled ids, those with the least hashes."""
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("__quality"))
    return chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def learn(statistics: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """A decision list from rows of :func:`with_statistics` joined with :func:`sampled` labels."""
    rows = statistics.select(*(F.expr(e).alias(f) for f, e in RATES.items()), "__quality", F.xxhash64("doc_id").alias("__at"))
    rows = rows.orderBy("__at", *RATES).limit(sample).collect()
    if not rows:
        return []
    return learn_list({f: np.array([r[f] for r in rows]) for f in RATES}, np.array([r["__quality"] == 0 for r in rows]))


def verdict(rules: list[Rule]) -> Column:
    """The list as an ordered conditional: false where a rule rejects, else true."""
    if not rules:
        return F.lit(True)
    out = F.when(rules[0].condition(), False)
    for rule in rules[1:]:
        out = out.when(rule.condition(), False)
    return out.otherwise(True)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judge(statistics: DataFrame, rules: list[Rule]) -> DataFrame:
    """With ``base_failed`` and ``kept``: rows that fail the base rules are rejected before the list is asked."""
    return statistics.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they were. Without usable labels only the base rules hold.

    Learning reads the texts once, for the sampled ids alone; the filter is one more projection, so texts never move.
    """
    chosen = F.broadcast(sampled(labels))  # at most SAMPLE rows of two numbers
    rules = learn(with_statistics(docs.select("doc_id", "text").join(chosen, "doc_id")))
    # a filter would move below the statistics and repeat them in every place that it names: the row number keeps it above
    held = with_statistics(docs.select(F.struct("*").alias("__row"), F.col("text"))).withColumn("__place", F.monotonically_increasing_id())
    return judge(held, rules).where("kept and __place >= 0").select("__row.*")


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns, one row for each input row; null and empty texts have no words and fail. Ties and repeated
    rows are judged alike; other columns of ``docs`` are ignored; an empty table gives an empty one."""
    from ._base import write

    statistics = write(with_statistics(docs.select("doc_id", "text")).drop("text"), "statistics")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rules = learn(statistics.join(F.broadcast(sampled(labels)), "doc_id"))  # at most SAMPLE rows of two numbers
    return judge(statistics, rules).select(columns)
