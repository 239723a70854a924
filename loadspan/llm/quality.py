"""Quality rules by weak supervision (operator 3). DataFrame functions only.

Each rule votes good (1) or bad (0), or abstains (null). Expectation maximisation over the counts of the vote
patterns, of which there are at most 3 ** number of rules whatever the corpus holds, estimates how often each rule
is right among good and among bad documents, and the share of good documents; a document's posterior probability of
being good replaces a filter that every rule must pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadspan.llm.tables import written

#: A rule's rates (right among good, right among bad) to start from, and at least.
START, LEAST = (0.98, 0.4), (0.9, 0.2)
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long), and further shares for the rules.

    Null and empty texts have no words and zeros everywhere; whatever the length of a text, all of it counts.
    n_dup_lines: lines (split at \\n) with a word that equal an earlier line. n_repeat_words: words in windows of
    five words that are found twice or more in the text, first included.
    """
    base = df.withColumn("_t", F.coalesce(F.col(text).cast("string"), F.lit(""))).withColumn("_w", _words(F.col("_t")))
    lines = F.filter(F.split("_t", "\n"), lambda s: s.rlike(WORD))
    base = base.withColumns({
        "n_words": F.size("_w").cast("long"),
        "_n_chars": F.length("_t").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace("_t", f"[^{SYMBOLS}]+", "")).cast("long"),
        "_n_upper": (F.length("_t") - F.length(F.regexp_replace("_t", r"\p{Lu}+", ""))).cast("long"),
        "_n_letters": F.length(F.regexp_replace("_t", r"[^\p{L}]+", "")).cast("long"),
        "_n_marked": F.regexp_count("_t", F.lit(r"[#*$%&|<>]+")).cast("long"),
        "_n_shouted": F.regexp_count("_t", F.lit(r"\p{Lu}{2,}")).cast("long"),
        "_n_exclaimed": F.regexp_count("_t", F.lit("!!+")).cast("long"),
        "_lines": lines,
        "_n_distinct": F.size(F.array_distinct("_w")).cast("long"),
    })
    window = lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(5)])
    windows = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 5), window)
    base = base.withColumn("_h", F.when(F.col("n_words") >= 6, windows))
    # most texts have no window twice, which is cheap to tell; only the others' windows are sorted
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    base = base.withColumn("_s", F.when(repeats, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda i, j: F.get("_s", i)["h"] == F.get("_s", j)["h"]
    again = F.filter("_s", lambda s, i: F.coalesce(same(i, i + 1), F.lit(False)) | ((i > 0) & F.coalesce(same(i, F.greatest(i - 1, F.lit(0))), F.lit(False))))
    base = base.withColumn("_r", F.coalesce(F.sort_array(F.transform(again, lambda s: s["i"])), F.array().cast("array<int>")))
    covered = F.aggregate(
        F.transform("_r", lambda x, i: F.least(F.lit(5), F.coalesce(F.get("_r", i + 1) - x, F.lit(5)))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return base.withColumns({
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": covered,
    }).drop("_t", "_w", "_lines", "_h", "_s", "_r")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _between(value: Column, good: float, bad: float) -> Column:
    """Good up to the one, bad from the other on, no vote in between."""
    return F.when(value <= good, 1).when(value >= bad, 0)


def votes() -> dict[str, Column]:
    """The rules, on with_statistics' columns: 1 good, 0 bad, null abstains. A share of nothing abstains."""
    words = F.col("n_words").cast("double")
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    return {
        "length": F.when(words >= 20, 1).when(words < 8, 0),
        "word_length": F.when((F.col("word_chars") >= 2.5 * words) & (F.col("word_chars") <= 11 * words), 1).when((F.col("word_chars") < 2 * words) | (F.col("word_chars") > 14 * words), 0),
        "symbols": _between(share("n_symbols", "word_chars"), 0.02, 0.1),
        "duplicate_lines": F.when(F.col("n_lines") >= 4, _between(share("n_dup_lines", "n_lines"), 0.1, 0.4)),
        "repeated_words": _between(share("n_repeat_words", "n_words"), 0.05, 0.2),
        "variety": F.when(words >= 30, F.when(F.col("_n_distinct") >= 0.3 * F.least(words, F.lit(300.0)), 1).when(F.col("_n_distinct") < 0.15 * F.least(words, F.lit(300.0)), 0)),
        "letters": F.when(F.col("word_chars") >= 20, F.when(F.col("_n_letters") >= 0.85 * F.col("word_chars"), 1).when(F.col("_n_letters") < 0.7 * F.col("word_chars"), 0)),
        "marked_words": _between(share("_n_marked", "n_words"), 0.05, 0.25),
        "shouting": _between(share("_n_shouted", "n_words"), 0.1, 0.4),
        "exclamations": _between(share("_n_exclaimed", "n_words"), 0.02, 0.2),
        "capitals": F.when(F.col("_n_letters") >= 20, _between(share("_n_upper", "_n_letters"), 0.2, 0.5)),
    }


def expectation_maximisation(patterns: list[tuple[tuple, int]], rounds: int = 200, prior: float = 0.9) -> tuple[float, list[tuple[float, float]]]:
    """(share of good, for each rule P(vote good | good) and P(vote bad | bad)) from (pattern, count) pairs.

    Starts from START, and keeps to LEAST: a rule seldom faults a good document, but each finds only some kinds of bad
    ones, and a fault is always evidence against a document, so rules can't swap the two classes. Counts of one on
    either side keep each estimate inside (0, 1). Without patterns the start values are returned.
    """
    if not patterns:
        return prior, []
    n_rules = len(patterns[0][0])
    rates = [START] * n_rules
    for _ in range(rounds):
        good = [1.0] * n_rules
        cast_good = [2.0] * n_rules
        bad = [1.0] * n_rules
        cast_bad = [2.0] * n_rules
        total_good, total = 1.0, 2.0
        for votes_, count in patterns:
            p = posterior(votes_, prior, rates)
            total_good += p * count
            total += count
            for i, v in enumerate(votes_):
                if v is not None:
                    cast_good[i] += p * count
                    cast_bad[i] += (1 - p) * count
                    good[i] += p * count * v
                    bad[i] += (1 - p) * count * (1 - v)
        new = [(max(LEAST[0], g / a), max(LEAST[1], b / c)) for g, a, b, c in zip(good, cast_good, bad, cast_bad)]
        moved = abs(total_good / total - prior) + sum(abs(x - y) for a, b in zip(new, rates) for x, y in zip(a, b))
        prior, rates = total_good / total, new
        if moved < 1e-9:
            break
    return prior, rates


def posterior(pattern: tuple, prior: float, rates: list[tuple[float, float]]) -> float:
    odds = math.log(prior / (1 - prior))
    for v, (g, b) in zip(pattern, rates):
        if v is not None:
            odds += math.log(g / (1 - b)) if v else math.log((1 - g) / b)
    return 1 / (1 + math.exp(-odds))


def judged(df: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """df's columns with the statistics, base_failed, p_good and kept: with_statistics(), then judge()."""
    return judge(with_statistics(df, text), threshold)


def judge(statistics: DataFrame, threshold: float = 0.5) -> DataFrame:
    """with_statistics' rows with base_failed, p_good and kept.

    kept is false where base_failed, else p_good >= threshold. Rows in equal words are judged alike; an empty table
    stays empty. The rows are written to the shared folder once and read for both passes.
    """
    rules = votes()
    names = list(rules)
    stats = written(statistics.withColumns({f"_v_{k}": v.cast("int") for k, v in rules.items()}), "quality")
    seen = stats.groupBy([F.col(f"_v_{k}").alias(k) for k in names]).agg(F.count(F.lit(1)).alias("n")).collect()
    prior, rates = expectation_maximisation([(tuple(r[k] for k in names), r["n"]) for r in seen])
    odds = F.lit(math.log(prior / (1 - prior)))
    for k, (g, b) in zip(names, rates or [START] * len(names)):
        vote = F.col(f"_v_{k}")
        odds = odds + F.when(vote == 1, math.log(g / (1 - b))).when(vote == 0, math.log((1 - g) / b)).otherwise(0.0)
    failed = F.coalesce(base_failed(), F.lit(False))
    judged_ = stats.withColumn("p_good", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
    return judged_.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold)).drop(*[f"_v_{k}" for k in names])
