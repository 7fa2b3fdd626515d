"""Quality rules under weak supervision.

Each rule looks at counts of a text and votes +1 (good), -1 (bad) or abstains
(0). Votes are counted by pattern over all rows; expectation-maximisation over
these counts (at most 3 to the number of rules, whatever the input) estimates,
without any label, the share of good texts and each rule's accuracies: how often
it votes +1, 0 and -1 on a good text and on a bad one. A rule whose +1 says
little, because bad texts get it too, thus weighs little there and may weigh much
where it votes -1. The posterior of a text is its prior log odds plus the log
ratio of each vote's rates; it is kept where that probability is at least one
half.

A null or empty text has no words: all counts are 0 and the base check fails.
Repeated rows count as often as they occur. An empty table leaves the model at
its starting values.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, words

WINDOW = 8
STEPS = 200
#: What a rule is taken to do before anything is seen (+1, 0, -1), worth START_WEIGHT votes: on good texts, on bad ones.
START = {1: (0.80, 0.18, 0.02), 0: (0.35, 0.30, 0.35)}
START_WEIGHT = 20
PRIOR = 0.7

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals", "n_ends", "n_distinct_words")


def _let(value: Column, body) -> Column:
    """body(value) with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(all_words: Column, n: int = WINDOW) -> Column:
    """Words that lie in an n-word window which occurs at least twice in the text; n is a power of two.

    Windows are told apart by a 64-bit hash, of twice as many words at each step. Only
    a text with a repeated hash sorts its windows; the union of windows of one length
    is then a sum over neighbours."""
    last = F.size(all_words) - n

    def doubled(h: Column, span: int) -> Column:
        if span == n:
            return covered(h)
        left = F.size(h) - span
        return _let(F.zip_with(F.slice(h, 1, left), F.slice(h, span + 1, left), lambda x, y: F.xxhash64(x, y)), lambda wider: doubled(wider, 2 * span))

    def covered(h: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            def repeated(x: Column, k: Column) -> Column:
                before = (k > 0) & (F.get(s, k - 1)["h"] == x["h"])
                after = (k < F.size(s) - 1) & (F.get(s, k + 1)["h"] == x["h"])
                return before | F.coalesce(after, F.lit(False))

            places = F.array_sort(F.transform(F.filter(s, repeated), lambda x: x["i"]))
            return _let(
                places,
                lambda p: F.aggregate(
                    F.transform(p, lambda x, k: F.least(F.lit(n), F.coalesce(F.get(p, k + 1) - x, F.lit(n)))), F.lit(0), lambda a, x: a + x
                ),
            )

        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(pairs, of_sorted))

    each = F.transform(all_words, lambda x: F.xxhash64(x))
    return F.when(last >= 0, _let(each, lambda h: doubled(h, 1))).otherwise(F.lit(0)).cast("long")


def counted(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows with a struct ``tessera_q`` of counts of the text."""
    body = F.coalesce(F.col(text), F.lit(""))
    # Generated rows, one for each, keep what is mentioned again from being worked out anew at each mention.
    staged = df.withColumn("tessera_w", F.explode(F.array(words(F.col(text)))))
    w = F.col("tessera_w")

    def chars(pattern: str) -> Column:
        return (F.length(body) - F.length(F.regexp_replace(body, pattern, ""))).cast("long")

    lines = F.filter(F.split(body, "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "")
    line_counts = _let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"),
            F.size(F.filter(x, lambda y: F.rtrim(y).rlike('[.!?:;"\')]\\r?$'))).cast("long").alias("ends"),
        ),
    )
    staged = staged.withColumn("tessera_l", F.explode(F.array(line_counts)))
    values = {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": F.col("tessera_l.dup"),
        "n_repeat_words": repeat_words(w),
        "n_lines": F.col("tessera_l.n"),
        "n_letters": chars("\\p{L}+"),
        "n_capitals": chars("\\p{Lu}+"),
        "n_ends": F.col("tessera_l.ends"),
        "n_distinct_words": F.size(F.array_distinct(w)).cast("long"),
    }
    counts = F.struct(*[v.alias(k) for k, v in values.items()])
    return staged.withColumn("tessera_q", F.explode(F.array(counts))).drop("tessera_w", "tessera_l")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules(q: str = "tessera_q") -> dict[str, Column]:
    """Votes by rule. A text without words gets no vote but from ``length``."""
    c = lambda name: F.col(f"{q}.{name}")
    n, size = c("n_words"), c("word_chars")
    some = n > 0
    return {
        "length": _vote(n >= 50, n < 20),
        "word_size": _vote(some & (size >= 3 * n) & (size <= 9 * n), some & ((size < 2 * n) | (size > 14 * n))),
        "symbols": _vote(some & (50 * c("n_symbols") < n), some & (10 * c("n_symbols") > n)),
        "lines": _vote((c("n_lines") >= 4) & (c("n_dup_lines") == 0), (c("n_lines") >= 2) & (10 * c("n_dup_lines") > 3 * c("n_lines"))),
        "windows": _vote(some & (100 * c("n_repeat_words") <= 5 * n), some & (100 * c("n_repeat_words") > 20 * n)),
        "capitals": _vote(some & (c("n_letters") > 0) & (10 * c("n_capitals") < c("n_letters")), 10 * c("n_capitals") > 4 * c("n_letters")),
        "letters": _vote(some & (100 * c("n_letters") >= 90 * size), some & (100 * c("n_letters") < 80 * size)),
        "sentences": _vote((c("n_lines") > 0) & (2 * c("n_ends") >= c("n_lines")), (c("n_lines") >= 5) & (10 * c("n_ends") < c("n_lines"))),
        "variety": _vote((n >= 20) & (10 * c("n_distinct_words") >= 3 * n), (n >= 50) & (20 * c("n_distinct_words") < n)),
    }


@dataclass(frozen=True)
class Model:
    """prior: share of good texts. rates: by rule, for good and bad texts, of the votes +1, 0 and -1."""

    prior: float
    rates: dict[str, tuple[tuple[float, float, float], tuple[float, float, float]]]

    def weights(self, name: str) -> tuple[float, float, float]:
        good, bad = self.rates[name]
        return tuple(math.log(g / b) for g, b in zip(good, bad))

    def log_odds(self, votes: dict[str, Column]) -> Column:
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, vote in votes.items():
            up, none, down = self.weights(name)
            total = total + F.when(vote > 0, F.lit(up)).when(vote < 0, F.lit(down)).otherwise(F.lit(none))
        return total


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], int]], names: list[str], steps: int = STEPS) -> Model:
    """Prior and rates from (votes, number of rows). Good texts are those that rules favour: a rule's
    -1 is never taken to be likelier on good texts than on bad ones, nor its +1 on bad ones."""
    prior, rates = PRIOR, {name: (START[1], START[0]) for name in names}
    rows = sum(n for _, n in patterns)
    for _ in range(steps if rows else 0):
        model = Model(prior, rates)
        weight = [model.weights(name) for name in names]
        seen = [[[START_WEIGHT * x for x in START[y]] for y in (1, 0)] for _ in names]
        good = 0.0
        for votes, n in patterns:
            odds = math.log(prior / (1 - prior)) + sum(w[1 - v] for v, w in zip(votes, weight))
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            good += n * p
            for j, v in enumerate(votes):
                seen[j][0][1 - v] += n * p
                seen[j][1][1 - v] += n * (1 - p)
        fresh = {}
        for name, (g, b) in zip(names, seen):
            g, b = [x / sum(g) for x in g], [x / sum(b) for x in b]
            for k, high, low in ((0, g, b), (2, b, g)):
                if high[k] < low[k]:
                    high[k] = low[k] = (high[k] + low[k]) / 2
            fresh[name] = tuple(x / sum(g) for x in g), tuple(x / sum(b) for x in b)
        share = min(0.99, max(0.01, good / rows))
        moved = max([abs(share - prior)] + [abs(x - y) for n in names for a, c in zip(fresh[n], rates[n]) for x, y in zip(a, c)])
        prior, rates = share, fresh
        if moved < 1e-9:
            break
    return Model(prior, rates)


def fit(counts: DataFrame) -> Model:
    """The model of rows that carry ``tessera_q``, from all that pass the base check: of the others
    the verdict is known, and their many short texts would pass for the one kind of bad text."""
    votes = rules()
    names = list(votes)
    seen = counts.where(~base_failed()).select([v.alias(k) for k, v in votes.items()]).groupBy(*names).count().collect()
    return expectation_maximisation(sorted((tuple(r[:-1]), r[-1]) for r in map(tuple, seen)), names)


def base_failed(q: str = "tessera_q") -> Column:
    n = F.col(f"{q}.n_words")
    return (n < 20) | (100 * F.col(f"{q}.n_repeat_words") > 30 * n)


def kept(model: Model, q: str = "tessera_q") -> Column:
    return ~base_failed(q) & (model.log_odds(rules(q)) >= 0)


def judge(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its key, counts, the posterior probability of being good and the verdict."""
    counts = cut(counted(df.select(key, text), text).select(key, "tessera_q"))
    model = fit(counts)
    odds = model.log_odds(rules())
    return counts.select(
        key,
        *[F.col(f"tessera_q.{c}").alias(c) for c in COUNTS],
        base_failed().alias("base_failed"),
        (1 / (1 + F.exp(-odds))).alias("quality"),
        kept(model).alias("kept"),
    )


def filtered(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows that are kept, with their columns as they were: one pass for the model, one for the verdicts.
    Rows stored with their counts would save the second count, but cost as much disk as the input."""
    columns = df.columns
    model = fit(counted(df.select(text), text).select("tessera_q"))
    return counted(df, text).where(kept(model)).select(*columns)
