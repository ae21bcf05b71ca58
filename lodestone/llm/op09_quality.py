"""Quality rules by weak supervision, with DataFrame functions only.

Each rule votes good (1) or bad (-1) or abstains (0). Votes are counted by pattern over all
documents (at most 3**rules patterns, whatever the number of documents), expectation-maximisation
fits how often each rule votes what for good and for bad documents and the share of good ones,
and a document's posterior probability of being good follows from its own votes.

How often good documents trip a rule can't be told from votes where a kind of junk trips that rule
alone: "rare among the good" and "common among one kind of the bad" fit the counts alike. The bound
`ALARM` settles it. Its effect: one objection of a well-measured rule outweighs the good votes of
the others, so that the verdict is close to all-must-pass; abstaining near a rule's limits, and
missing votes, are what the posterior adds. Without the bound EM keeps over half of the labelled
junk of the test tables (README).

Defined results: a null or blank text has no words and fails the base rules; an empty table gives
an empty result; repeated rows count each; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import shared

SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
KEEP = 0.5
#: Rules are written so that a good document trips one this rarely; EM may find less, never more. Without that bound it
#: would take one kind of junk, on which several rules agree, for the only kind.
ALARM = 0.001
#: Rules: feature, bad at or beyond, good up to (upper bounds), as shares of words, lines or characters.
RULES: dict[str, tuple[float, float]] = {"symbols": (0.1, 0.02), "repeats": (0.3, 0.1), "dup_lines": (0.4, 0.1), "capitals": (0.3, 0.1), "marks": (0.5, 0.2)}
VOTES = [*RULES, "word_length", "length"]


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def features(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_marks) of each row."""
    text = F.col("text")
    base = docs.select(docs[id_column].alias("doc_id"), F.coalesce(docs[text_column].cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("w", F.array_remove(F.split(text, SPACES), ""))
    w, n = F.col("w"), F.size("w")
    hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))).otherwise(F.array().cast("array<long>"))
    base = base.select("doc_id", "text", n.alias("n"), hashes.alias("h"))
    h = F.col("h")
    # windows in order of hash and place; a repeated one stands next to its like
    ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    base = base.withColumn("r", F.when(F.size(F.array_distinct(h)) < F.size(h), ranked).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    r = F.col("r")
    same = F.filter(r, lambda x, k: ((k > 0) & (F.get(r, k - 1)["h"] == x["h"])) | (F.get(r, k + 1)["h"] == x["h"]))
    base = base.withColumn("at", F.array_sort(F.transform(same, lambda x: x["i"])))
    # each repeated window adds the words up to the next one's start, three at most
    places = F.aggregate("at", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda s, x: F.struct((s["n"] + F.least(F.lit(3), x - s["last"])).alias("n"), x.alias("last")), lambda s: s["n"])
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return base.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        _without(text, " \t\n\x0b\x0c\r").cast("long").alias("word_chars"),
        (F.length(text) - _without(text, SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        places.cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.length(text) - _without(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long").alias("n_capitals"),
        (F.length(text) - _without(text, ".!?")).cast("long").alias("n_marks"),
    )


def votes(found: DataFrame) -> DataFrame:
    """features() with a column v_<rule> for each rule."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    share = {"symbols": F.col("n_symbols") / n, "repeats": F.col("n_repeat_words") / n, "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), "capitals": F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1)), "marks": F.col("n_marks") / n}
    mean = F.col("word_chars") / n
    out = {f"v_{k}": F.when(share[k] >= bad, -1).when(share[k] <= good, 1).otherwise(0) for k, (bad, good) in RULES.items()}
    out["v_word_length"] = F.when((mean < 3) | (mean > 10), -1).when(mean.between(4, 7), 1).otherwise(0)
    out["v_length"] = F.when(F.col("n_words") < 20, -1).when(F.col("n_words") >= 100, 1).otherwise(0)
    return found.withColumns(out)


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200, alarm: float = ALARM) -> tuple[float, list[dict[int, float]], list[tuple[float, float]]]:
    """Share of good documents, log-odds of each rule's votes, and how often each rule objects to (good, bad), by EM.

    Rates count votes only: to abstain says nothing. Pseudo-counts keep a rule that is silent neutral.
    """
    rules = len(patterns[0][0]) if patterns else len(VOTES)
    total = sum(n for _, n in patterns)
    share, rates = 0.8, [(alarm, 0.4)] * rules

    def odds_of(rates: list[tuple[float, float]]) -> list[dict[int, float]]:
        return [{-1: math.log(good / bad), 0: 0.0, 1: math.log((1 - good) / (1 - bad))} for good, bad in rates]

    odds = odds_of(rates)
    for _ in range(rounds if total else 0):
        objections = [[20 * alarm, 8.0] for _ in range(rules)]
        voted = [[20.0, 20.0] for _ in range(rules)]
        sure = 0.0
        for pattern, n in patterns:
            p = posterior(pattern, share, odds)
            sure += n * p
            for k, v in enumerate(pattern):
                if v:
                    for y, weight in enumerate((n * p, n * (1 - p))):
                        voted[k][y] += weight
                        objections[k][y] += weight * (v < 0)
        share = min(max((sure + 1) / (total + 2), 1e-6), 1 - 1e-6)
        # an objection never speaks for a document: bad ones meet it at least as often as good ones
        good = [min(o[0] / v[0], alarm) for o, v in zip(objections, voted)]
        rates = [(g, min(max(o[1] / v[1], g), 1 - 1e-6)) for g, o, v in zip(good, objections, voted)]
        new = odds_of(rates)
        moved = max(abs(new[k][v] - odds[k][v]) for k in range(rules) for v in (-1, 1))
        odds = new
        if moved < 1e-9:
            break
    return share, odds, rates


def posterior(pattern: tuple[int, ...], share: float, odds: list[dict[int, float]]) -> float:
    x = math.log(share / (1 - share)) + sum(odds[k][v] for k, v in enumerate(pattern))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def judge(docs: DataFrame, keep: float = KEEP, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """features() of each row, base_failed, quality (posterior probability of being good) and kept."""
    voted = shared.written(votes(features(docs, id_column, text_column)), "votes")
    columns = [f"v_{k}" for k in VOTES]
    counted = voted.groupBy(*columns).agg(F.count("*").alias("n")).collect()  # at most 3**7 rows
    share, odds, _ = fit(sorted((tuple(r[c] for c in columns), r["n"]) for r in counted))
    score = F.lit(math.log(share / (1 - share))) + reduce(lambda a, b: a + b, [F.when(F.col(c) == -1, o[-1]).when(F.col(c) == 1, o[1]).otherwise(o[0]) for c, o in zip(columns, odds)])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    quality = 1 / (1 + F.exp(-score))
    return voted.withColumns({"base_failed": failed, "quality": quality}).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep))


def brute_force(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) by plain Python."""
    import re
    from collections import Counter

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if seen[w[i], w[i + 1], w[i + 2]] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), len(covered)
