"""Quality rules combined by weak supervision, in DataFrame functions only.

Counts of each text feed rules that vote that it is good, that it is bad, or abstain. Each rule looks at something of its own, so that
their errors may be taken as independent: symbols, letters among the other characters, capitals among the letters,
words that are common in any text of a language, repeats, equal lines, ends of lines, lengths. Rules are
not trusted alike: expectation-maximisation over the patterns of votes of all documents (three
votes to the power of the rules at most, whatever the input) estimates how often each rule gives
each vote on good and on bad texts, and a text stays if the posterior probability that it is good reaches
``KEEP``. A good vote never speaks against a text nor a bad one for it, so that the classes can't change places, and no rule counts for
more than ``TRUST`` to 1, so that none decides alone against the others. Texts that fail the base rules are out beforehand and don't enter the estimate.

A word is a run of characters other than the six ASCII white-space ones. Null and empty texts have
no words, fail the base rules and are not kept. Repeated rows are judged alike and each counts in the estimate. Very long texts are
worked on whole. An empty table gives an empty table. Only key and text are read; further columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import fresh, stored

KEEP = 0.5
#: Rounds of expectation-maximisation; the share of each class that is added as votes in the proportion of all texts; the most that a rule counts for.
ROUNDS, SMOOTH, TRUST = 60, 0.01, 19
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
# The commonest words of English, French, German and Spanish.
COMMON = "the of and to in is that for it was on are as with be this from or an by not le la les de des du et un une est dans que qui pour sur pas avec au en der die das und ist ein eine den von zu mit auf für nicht im dem sich el los las y del por con para se no su al lo".split()

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals", "n_common", "n_ended"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it occurs there."""
    return F.transform(F.array(value), body)[0]


def repeated(words: Column) -> Column:
    """How many words stand in three-word windows that occur twice or more; windows go by 64-bit hashes."""

    def covered(keys: Column) -> Column:
        # the windows sorted by hash, equal ones side by side; then their places in order,
        # each covering up to three words before the next one begins
        def places(ordered: Column) -> Column:
            twin = F.filter(ordered, lambda x, i: (F.get(ordered, i - 1)["h"] == x["h"]) | (F.get(ordered, i + 1)["h"] == x["h"]))
            return F.array_sort(F.transform(twin, lambda x: x["i"]))

        def width(at: Column) -> Column:
            steps = F.zip_with(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(3)))
            return F.aggregate(steps, F.lit(3), lambda total, x: total + x)

        ordered = F.array_sort(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), 0).otherwise(let(let(ordered, places), width))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return let(let(words, windows), covered)


def counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, the counts of ``COUNTS``), all long."""
    whole = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key).alias("key"), whole.alias("whole"))
    split = base.select("key", "whole", F.array_remove(F.split("whole", r"[\x20\x09-\x0D]+"), "").alias("words"), F.filter(F.split("whole", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    only = lambda kind: F.char_length(F.regexp_replace("whole", f"[^{kind}]+", ""))
    found = {
        "n_words": F.size("words"),
        "word_chars": F.char_length(F.array_join("words", "")),
        "n_symbols": only(SYMBOLS),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.when(F.size("words") < 4, 0).otherwise(repeated(F.col("words"))),
        "n_lines": F.size("lines"),
        "n_letters": only(r"\p{L}\p{M}"),
        "n_capitals": only(r"\p{Lu}"),
        "n_common": F.size(F.filter("words", lambda w: F.lower(w).isin(COMMON))),
        "n_ended": F.size(F.filter("lines", lambda x: x.rlike(r"[.!?\u2026\u3002][\"'\u00BB\u201D\u2019)]*[\x20\x09-\x0D]*$"))),
    }
    return split.select("key", *(c.cast("long").alias(n) for n, c in found.items()))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def votes() -> dict[str, Column]:
    """Each rule's vote: 1 good, -1 bad, 0 abstains."""
    share = lambda part, whole: F.col(part) / F.greatest(whole, F.lit(1))
    vote = lambda good, bad: F.when(bad, -1).when(good, 1).otherwise(0)
    words, lines, length = F.col("n_words"), F.col("n_lines"), F.col("word_chars") / F.col("n_words")
    symbols, letters, capitals = share("n_symbols", words), share("n_letters", F.col("word_chars") - F.col("n_symbols")), share("n_capitals", F.col("n_letters"))
    common, repeats, same, ended = share("n_common", words), share("n_repeat_words", words), share("n_dup_lines", lines), share("n_ended", lines)
    return {
        "length": vote(words >= 100, F.lit(False)),
        "word_length": vote(length.between(3.0, 10.0), (length < 2.5) | (length > 14.0)),
        "symbols": vote(symbols <= 0.05, symbols > 0.15),
        "letters": vote(letters >= 0.90, letters < 0.75),
        "capitals": vote(capitals <= 0.12, capitals > 0.30),
        "common": vote(common >= 0.10, common < 0.04),
        "repeats": vote(repeats <= 0.10, repeats > 0.25),
        "lines": vote(same <= 0.10, same > 0.30),
        "ended": vote(ended >= 0.80, ended < 0.40),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[dict[int, float]]]:
    """(prior log-odds, for each rule and vote the log-odds that it adds) from the counts of vote patterns.

    At first each rule counts for e to 1.
    """
    rules, whole, most = len(patterns[0][0]) if patterns else 0, sum(n for _, n in patterns), math.log(TRUST)
    good = [1 / (1 + math.exp(-sum(p))) for p, _ in patterns]
    prior, odds = 0.0, [dict.fromkeys((-1, 0, 1), 0.0) for _ in range(rules)]
    for _ in range(ROUNDS if patterns else 0):
        total = [sum(n * (g if side else 1 - g) for (_, n), g in zip(patterns, good)) for side in (False, True)]
        prior = math.log((total[True] + 1) / (total[False] + 1))
        for r in range(rules):
            for v in (-1, 0, 1):
                usual = (sum(n for p, n in patterns if p[r] == v) + 1) / (whole + 3)
                chance = [(sum(n * (g if side else 1 - g) for (p, n), g in zip(patterns, good) if p[r] == v) + (SMOOTH * total[side] + 1e-6) * usual) / (total[side] * (1 + SMOOTH) + 1e-6) for side in (False, True)]
                odds[r][v] = max(0.0 if v > 0 else -most, min(0.0 if v < 0 else most, math.log(chance[True] / chance[False])))
        good = [1 / (1 + math.exp(-prior - sum(o[v] for o, v in zip(odds, p)))) for p, _ in patterns]
    return prior, odds


def verdict(found: DataFrame) -> DataFrame:
    """``found``, which holds the counts of every text, with base_failed, posterior (null where base_failed) and kept.

    ``found`` is read twice: for the patterns of votes of all texts, and for the verdicts.
    """
    rules = votes()
    names = fresh(found, *rules)
    judged = found.withColumn("base_failed", base_failed()).withColumns(dict(zip(names, rules.values())))
    patterns = [(tuple(r[:-1]), r[-1]) for r in judged.filter("NOT base_failed").groupBy(*names).count().orderBy(*names).collect()]
    prior, odds = estimate(patterns)
    total = F.lit(prior)
    for name, own in zip(names, odds):
        total = total + F.when(F.col(name) == 1, own[1]).when(F.col(name) == -1, own[-1]).otherwise(own[0])
    out = judged.withColumn("posterior", F.when(~F.col("base_failed"), 1 / (1 + F.exp(-total))))
    return out.withColumn("kept", F.coalesce(F.col("posterior") >= KEEP, F.lit(False))).drop(*names)


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, counts, base_failed, posterior, kept) for every row of ``docs``."""
    return verdict(stored(counts(docs, key, text))).withColumnRenamed("key", key)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is kept, judged with the estimate over all of them."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    return verdict(stored(counts(rows, "row", "text"))).filter("kept").select("key.*")
