"""Quality rules whose cutoffs are chosen under a guarantee: how many good documents may be rejected.

Each rule compares one ratio of a document with a cutoff. A vector of cutoffs, one for each rule, is a level of
strictness: at level t every rule cuts off where its ratio leaves at most a share t of the stratum's documents above, times the
rule's weight. A rule weighs by how many more of the documents labelled bad than of all it rejects at one fixed share. The levels are so laid
out from documents without labels and from bad ones: they are fixed before any good document is looked at. For every stratum
(language) and level the labelled good documents count how many all rules together would reject; a level is admissible when the
exact binomial tail says that a rejection rate of ``RISK`` would give so few with a probability below the test level. Stricter vectors
never reject less, so the levels of a stratum form one fixed sequence, tested from the mildest on up to the first that
fails, which needs no correction within itself; across strata the test level is ``ALPHA`` divided by their number (Bonferroni). The
strictest admissible vector is used; strata with too few labels get none. All labelled documents serve as holdout.

Everything runs as DataFrame expressions inside the JVM.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provframe.llm.common import SPACE_CLASS, materialize

#: The base rules: fewest words; most words in repeated windows, in percent.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
WINDOW = 5
#: Of the good documents of a stratum at most this share may be rejected by all rules together, and this
#: holds for all strata at once with probability 1 - ALPHA.
RISK, ALPHA = 0.015, 0.05
#: A rule's ratio is rounded up to whole steps of its scale; a document is rejected above the cutoff.
STEPS = 1000
#: Levels: the share of all documents that a rule may leave above its cutoff, from MILDEST on, each so many times the one before.
MILDEST, GROWTH, LEVELS = 0.0005, 1.08, 80
#: The share at which rules are weighed: one that rejects bad documents no more often than others has weight zero, one that rejects all of them 1.
WEIGHED_AT = 0.05
SYMBOLS = "#*$%&|<>"
SPACES = (" ", "\t", "\n", "\v", "\f", "\r")


def _without(text: Column, characters: str | tuple[str, ...]) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), characters, text)


def word_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words for every row; null counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*also, F.col(id_col).alias("doc_id"), text.alias("t"), F.filter(F.split(text, f"[{SPACE_CLASS}]+"), lambda w: w != "").alias("w"))
    n = F.size("w").cast("long")
    lines = F.filter(F.split("t", "\n"), lambda line: line.rlike(f"[^{SPACE_CLASS}]"))
    # A window is known by a hash of its five words, in order of position.
    window = F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(WINDOW)]))
    rows = rows.select(
        *also,
        "doc_id",
        n.alias("n_words"),
        F.char_length(_without(F.col("t"), SPACES)).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(_without(F.col("t"), tuple(SYMBOLS)))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(n >= WINDOW, window).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    # Only texts that hold some window twice, seen from distinct values, need the positions sorted by hash.
    twice = F.size("h") > F.size(F.array_distinct("h"))
    placed = F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("p", F.when(twice, placed))
    found = F.filter("p", lambda x, i: F.get("p", i - 1)["h"].eqNullSafe(x["h"]) | F.get("p", i + 1)["h"].eqNullSafe(x["h"]))
    rows = rows.withColumn("s", F.sort_array(F.transform(found, lambda x: x["i"])))
    # A repeated window adds the words up to the next one, five at most.
    gain = F.transform("s", lambda x, i: F.least(F.coalesce(F.get("s", i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
    repeated = F.coalesce(F.aggregate(gain, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    return rows.select(*also, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated.alias("n_repeat_words"))


RULES = ("symbols", "repeats", "lines", "long_words", "short_words")


def rule_values() -> dict[str, Column]:
    """The ratio of each rule, 0 to 1 over the scale of cutoffs; values beyond the scale count as its end."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    mean = F.col("word_chars") / words
    return {
        "symbols": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
        "lines": F.col("n_dup_lines") / words,
        "long_words": (mean - 4) / 16,
        "short_words": (8 - mean) / 8,
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def log_factorial(x: Column) -> Column:
    """ln x! by Stirling's series, shifted to where its error is below 1e-12."""
    shift = 8
    y = x.cast("double") + 1 + shift
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return series - reduce(lambda a, b: a + b, [F.log(x + 1 + k) for k in range(shift)])


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X binomial with n trials, where k is at most n * rate; 1.0 beyond.

    The terms fall from j = k downwards, each at most k (1 - rate) / ((n - k + 1) rate) times the one above, so what lies beyond
    some terms is below 1e-15 of the first. Near the mean these are about sqrt(70 n) terms, never more than 12,000: there the tail is no
    longer small, and the part summed is a lower bound of it close to one half.
    """
    k, n = k.cast("long"), n.cast("long")
    first = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.lit(math.log(rate)) + (n - k) * F.lit(math.log1p(-rate))
    fall = F.log((k * F.lit(1 - rate)) / ((n - k + 1) * F.lit(rate)))
    enough = F.when(fall < 0, F.ceil(F.lit(math.log(1e-15)) / fall)).otherwise(F.lit(12_000))
    terms = F.least(k, enough, F.lit(12_000)).cast("int")
    state = lambda term, total: F.struct(term.alias("term"), total.alias("total"))

    def step(a: Column, i: Column) -> Column:
        j = k - i + 1  # from the term of j to the one of j - 1
        term = a["term"] * (j * F.lit(1 - rate)) / ((n - j + 1) * F.lit(rate))
        return state(term, a["total"] + term)

    over = F.when(terms >= 1, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(over, state(F.lit(1.0), F.lit(1.0)), step, lambda a: a["total"])
    return F.when(k > n * F.lit(rate), F.lit(1.0)).otherwise(F.least(F.exp(first + F.log(total)), F.lit(1.0)))


def _cutoff_at(share: Column) -> Column:
    """The smallest step of ``tails`` with at most such a share above."""
    return F.array_min(F.transform(F.filter("tails", lambda x: x["above"] <= share), lambda x: x["step"]))


def level_cutoffs(statistics: DataFrame, labelled: DataFrame, stratum: str, steps: int = STEPS) -> DataFrame:
    """(stratum, rule, cutoffs): the rule's cutoff at each level, from the stratum's documents without a label and all bad ones.

    Without any bad document all rules weigh 1.
    """
    passing = statistics.where(~base_failed())
    unseen = passing.join(labelled, F.col("doc_id") == F.col("label_id"), "left_anti")
    counts = unseen.select(F.col(stratum).alias("stratum"), _rule_steps(steps)).groupBy("stratum", "r.rule", "r.step").agg(F.count(F.lit(1)).alias("n"))
    each = Window.partitionBy("stratum", "rule")
    above = F.coalesce(F.sum("n").over(each.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / F.sum("n").over(each)
    # At most STEPS + 1 different steps for each stratum and rule.
    tails = counts.select("stratum", "rule", "step", above.alias("above")).groupBy("stratum", "rule").agg(F.collect_list(F.struct("step", "above")).alias("tails"))
    bad = passing.join(labelled.where("quality = 0"), F.col("doc_id") == F.col("label_id"), "left_semi").select(F.col(stratum).alias("of"), _rule_steps(steps)).select("of", F.col("r.rule").alias("of_rule"), "r.step")
    reached = bad.join(tails, (F.col("of") == F.col("stratum")) & (F.col("of_rule") == F.col("rule"))).select("rule", (F.col("step") > _cutoff_at(F.lit(WEIGHED_AT))).alias("hit"))
    gain = (F.avg(F.col("hit").cast("int")) / WEIGHED_AT - 1) / (1 / WEIGHED_AT - 1)
    weights = reached.groupBy("rule").agg(F.greatest(gain, F.lit(0.0)).alias("weight"))
    tails = tails.join(weights, "rule", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    levels = F.array(*[F.lit(MILDEST * GROWTH**k) for k in range(LEVELS)])
    at = lambda level: F.when(F.col("weight") > 0, _cutoff_at(level * F.col("weight"))).otherwise(F.lit(steps))
    return tails.select("stratum", "rule", F.transform(levels, at).alias("cutoffs"))


def choose_cutoffs(statistics: DataFrame, labels: DataFrame, stratum: str, risk: float = RISK, alpha: float = ALPHA, steps: int = STEPS) -> DataFrame:
    """(stratum, level, rejected, good, rule, cutoff): the strictest admissible vector of each stratum that has one, a row for each rule.

    ``rejected`` of the stratum's ``good`` labelled documents lie above a cutoff of the vector.
    """
    labelled = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg(F.max("quality").alias("quality"))
    sequences = level_cutoffs(statistics, labelled, stratum, steps)
    known = statistics.where(~base_failed()).join(labelled.where("quality = 1"), F.col("doc_id") == F.col("label_id"), "left_semi")
    wide = sequences.groupBy(F.col("stratum").alias("of")).pivot("rule", list(RULES)).agg(F.first("cutoffs"))
    met = known.join(wide, F.col(stratum) == F.col("of"))
    # Cutoffs fall from level to level: as many levels as don't reject the value come before the first that does.
    first = [_levels_below(F.col(r), _step(v, steps)) for r, v in rule_values().items()]
    hit = met.select(F.col(stratum).alias("stratum"), F.least(*first).alias("level"))
    counts = hit.groupBy("stratum", "level").agg(F.count(F.lit(1)).alias("n"))
    good = counts.groupBy("stratum").agg(F.sum("n").alias("good"), F.map_from_entries(F.collect_list(F.struct("level", "n"))).alias("hits"))
    tests = good.select("stratum", "good", "hits", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level"))
    below = F.filter(F.map_entries("hits"), lambda e: e["key"] <= F.col("level"))
    tests = tests.withColumn("rejected", F.aggregate(below, F.lit(0).cast("long"), lambda a, e: a + e["value"]))
    strata = good.agg(F.count(F.lit(1)).alias("strata"))
    tests = tests.crossJoin(F.broadcast(strata))  # one row
    # Later levels reject no less, so all levels before an admissible one are admissible too.
    admissible = tests.where(binomial_tail(F.col("rejected"), F.col("good"), risk) <= F.lit(alpha) / F.col("strata"))
    chosen = admissible.groupBy("stratum").agg(F.max_by(F.struct("level", "rejected", "good"), "level").alias("best")).select("stratum", "best.*")
    return chosen.join(sequences, "stratum").select("stratum", "level", "rejected", "good", "rule", F.get("cutoffs", F.col("level")).alias("cutoff"))


def _levels_below(cutoffs: Column, step: Column) -> Column:
    return F.size(F.filter(cutoffs, lambda c: c >= step))


def _rule_steps(steps: int) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), _step(v, steps).alias("step")) for r, v in rule_values().items()])).alias("r")


def _step(value: Column, steps: int) -> Column:
    return F.least(F.greatest(F.ceil(value * steps), F.lit(0)), F.lit(steps)).cast("int")


def rated(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The statistics with base_failed, rejected_by and kept for every row of ``docs``.

    Null and empty texts have no words and fail the base rules. A null stratum is a stratum of its own. Repeated rows are rated each; ids may be null;
    labels of unknown ids and null labels don't count, of several labels for an id the largest does; a stratum needs documents
    without labels too, which lay out its levels. An empty table gives no row. Texts of any length are read whole. Extra columns aren't read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"))
    statistics = materialize(word_statistics(rows, also=("stratum",)), "word-statistics")
    cutoffs = choose_cutoffs(statistics, labels, "stratum")
    wide = cutoffs.groupBy("stratum").pivot("rule", list(RULES)).agg(F.min("cutoff"))
    wide = wide.select(F.col("stratum").alias("of"), *[F.col(r).alias(f"cut_{r}") for r in RULES])
    joined = statistics.join(wide, F.col("stratum") == F.col("of"), "left")
    reasons = [F.when(_step(v, STEPS) > F.col(f"cut_{r}"), F.lit(r)) for r, v in rule_values().items()]
    joined = joined.withColumn("base_failed", base_failed()).withColumn("rejected_by", F.concat_ws(",", *reasons))
    kept = ~F.col("base_failed") & (F.col("rejected_by") == "")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "rejected_by")
