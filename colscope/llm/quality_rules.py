"""Quality by weak supervision: rules vote or abstain, and expectation-maximisation finds how far to trust each.

Every rule looks at a few counts of a text and votes good (1), bad (-1) or abstains (0). Texts are grouped by their votes;
from the counts of these patterns (at most 3 to the number of rules, whatever the corpus) the share of good texts and each
rule's accuracy are estimated, without labels. The posterior that a text is good, a sum of log odds of the rules that
voted, decides in place of a filter that all rules must pass.

Counts are taken over whole texts by built-in functions; a null text counts as empty. A text that fails the base test (too
few words, or most of them in three-word windows that repeat) is dropped whatever the posterior. Without rows there is
nothing to estimate and the result is empty. Rows repeat as they are. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.functions.staging import staged
from colscope.llm.common import BLANKS, WORD, quoted

LEAST_WORDS = 50
ROUNDS = 100
GOOD, ON_GOOD, ON_BAD, STRENGTH = 0.8, 0.95, 0.5, 0.01


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """The votes, from the columns of `measured`."""
    words, lines, letters = F.col("n_words"), F.col("n_lines"), F.col("n_letters")
    chars = F.col("word_chars")
    return {
        "length": _vote(words >= 100, words < 20),
        "word_length": _vote((chars >= 3 * words) & (chars <= 12 * words), (2 * chars < 5 * words) | (chars > 16 * words)),
        "symbols": _vote(20 * F.col("n_symbols") <= words, 4 * F.col("n_symbols") > words),
        "lines": _vote((lines >= 4) & (10 * F.col("n_dup_lines") <= lines), 10 * F.col("n_dup_lines") > 3 * lines),
        "repeats": _vote(10 * F.col("n_repeat_words") <= words, 10 * F.col("n_repeat_words") > 3 * words),
        "marks": _vote(20 * F.col("n_marks") <= words, 5 * F.col("n_marks") > words),
        "letters": _vote(100 * letters >= 90 * chars, 100 * letters < 85 * chars),
        "capitals": _vote(8 * F.col("n_capitals") <= letters, 2 * F.col("n_capitals") > letters),
        "stops": _vote((100 * F.col("n_stops") >= words) & (4 * F.col("n_stops") <= words), 2 * F.col("n_stops") > words),
    }


def _kept_chars(dropped: str) -> Column:
    """Code points left after deleting what a pattern matches."""
    return F.length(F.regexp_replace("text", dropped, "")).cast("long")


def _repeats() -> Column:
    """Words covered by three-word windows that occur twice or more, from the hashes `windows` in order of place."""
    paired = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def again(s: Column) -> Column:
        def differs(x: Column, at: Column) -> Column:
            return F.coalesce(F.get(s, at)["h"] == x["h"], F.lit(False))

        twice = F.filter(s, lambda x, i: differs(x, i - 1) | differs(x, i + 1))
        covered = F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
        return F.size(F.array_distinct(F.flatten(covered)))

    whole = F.size("windows") == F.size(F.array_distinct("windows"))
    return F.when(whole, 0).otherwise(F.get(F.transform(F.array(paired), again), F.lit(0))).cast("long")


def measured(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The counts of each text. `inline` of one struct keeps the word array from being computed again for each use."""
    texts = docs.select(quoted(id).alias("doc_id"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    split = texts.select("doc_id", "text", F.inline(F.array(F.struct(
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines")))))
    n_words = F.size("words")
    windows = F.transform(F.slice("words", 1, F.greatest(n_words - 2, F.lit(0))),
                          lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    counted = split.select("doc_id", F.inline(F.array(F.struct(
        n_words.cast("long").alias("n_words"), _kept_chars(BLANKS).alias("word_chars"),
        (F.length("text") - _kept_chars(r"[#*$%&|<>]+")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]+")).cast("long").alias("n_marks"),
        (F.length("text") - _kept_chars(r"[.!?]+")).cast("long").alias("n_stops"),
        _kept_chars(r"[^\p{L}]+").alias("n_letters"), _kept_chars(r"[^\p{Lu}]+").alias("n_capitals"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows")))))
    return counted.withColumn("n_repeat_words", _repeats()).drop("windows")


@dataclass(frozen=True)
class Beliefs:
    """The share of good texts, and how often each rule that votes is right: on good texts and on bad ones. A rule is one
    sort of fault as a rule, so it misses many bad texts while its bad votes are nearly always right."""

    good: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def weights(self) -> list[tuple[float, float]]:
        """Log odds that a good vote and a bad vote of each rule add."""
        return [(math.log(g / (1 - b)), math.log((1 - g) / b)) for g, b in zip(self.on_good, self.on_bad, strict=True)]

    def log_odds(self, votes: tuple[int, ...]) -> float:
        given = sum((w[0] if v > 0 else w[1]) for v, w in zip(votes, self.weights(), strict=True) if v)
        return math.log(self.good / (1 - self.good)) + given


def _held(value: float, least: float, most: float) -> float:
    return min(most, max(least, value))


def estimate(patterns: Mapping[tuple[int, ...], int], rounds: int = ROUNDS) -> Beliefs:
    """Expectation-maximisation over the number of texts by pattern of votes. The estimates are held near their starting
    values by STRENGTH of the texts, and every rule better than chance, so that good stays good."""
    total, size = sum(patterns.values()), len(next(iter(patterns), ()))
    now = Beliefs(GOOD, (ON_GOOD,) * size, (ON_BAD,) * size)
    pseudo = STRENGTH * total
    for _ in range(rounds if total else 0):
        share, weight = 0.0, [[0.0] * 4 for _ in range(size)]  # good voted, good right, bad voted, bad right
        for votes, n in patterns.items():
            p = 1 / (1 + math.exp(-_held(now.log_odds(votes), -500.0, 500.0)))
            share += n * p
            for w, v in zip(weight, votes, strict=True):
                if v:
                    w[0] += n * p
                    w[1] += n * p * (v > 0)
                    w[2] += n * (1 - p)
                    w[3] += n * (1 - p) * (v < 0)
        on_good = tuple(_held((w[1] + pseudo * ON_GOOD) / (w[0] + pseudo), 0.6, 0.999) for w in weight)
        on_bad = tuple(_held((w[3] + pseudo * ON_BAD) / (w[2] + pseudo), 1.05 - g, 0.99) for w, g in zip(weight, on_good, strict=True))
        new = Beliefs(_held((share + pseudo * GOOD) / (total + pseudo), 0.01, 0.99), on_good, on_bad)
        moved = max(abs(a - b) for a, b in zip((new.good, *new.on_good, *new.on_bad), (now.good, *now.on_good, *now.on_bad), strict=True))
        now = new
        if moved < 1e-9:
            break
    return now


def judged(docs: DataFrame, threshold: float = 0.5, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The counts of each text, its votes, base_failed, the posterior and kept."""
    votes = rules()
    names = list(votes)
    rows = staged(measured(docs, id, text).select("*", *[v.cast("int").alias(f"vote_{k}") for k, v in votes.items()]))
    table = rows.groupBy(*[f"vote_{k}" for k in names]).count().collect()  # at most 3 ** 9 rows
    beliefs = estimate({tuple(r[: len(names)]): r["count"] for r in sorted(table)})
    odds = F.lit(math.log(beliefs.good / (1 - beliefs.good)))
    for name, (up, down) in zip(names, beliefs.weights(), strict=False):
        vote = F.col(f"vote_{name}")
        odds = odds + F.when(vote > 0, up).when(vote < 0, down).otherwise(0.0)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
