"""Rule-based quality filter: a threshold table compiled into one Spark projection.

`measured` adds the measures of every whole text; `compiled` turns rows of `RULES` into one boolean
expression; `judged` joins both. No user functions, no shuffle.

Words are `[^\\x20\\x09-\\x0D]+`. Defined cases: a null or empty text has no words, all measures 0, and
fails the base rule; repeated rows are judged each; other columns are carried, and a column that has
the name of a measure is replaced by it; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = r"[ \t-\r]"

#: Common short words of the corpus languages; a text of running prose has some of them.
STOP_WORDS = (
    "the and of to in is it that was for on are with as be this by or at from "
    "der die das und ist nicht ein eine zu den mit von auf sich dem im für "
    "le la les de des et est une un du que qui pour dans en au avec "
    "el los las y es una por con para del se no lo"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a text while low <= measure <= high; None leaves a side open."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The threshold table. A ratio without a denominator counts as 0.
RULES = (
    Rule("mean_word_chars", 2.0, 20.0),
    Rule("symbol_ratio", None, 0.25),
    Rule("stop_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.4),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")


def ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "n_words"),
    "stop_ratio": ("n_stop_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
}


def measured(docs: DataFrame) -> DataFrame:
    """docs with the columns of MEASURES."""
    carried = [c for c in docs.columns if c not in MEASURES]
    text = F.coalesce("text", F.lit(""))
    base = docs.select(
        *carried, text.alias("__tessera_t"), F.array_remove(F.split(text, f"{_SPACE}+"), "").alias("__tessera_w"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]")).alias("__tessera_l"))
    n = F.size("__tessera_w")
    grams = F.when(n >= 3, F.arrays_zip(
        F.slice("__tessera_w", F.lit(1), F.greatest(n - 2, F.lit(0))).alias("a"), F.slice("__tessera_w", F.lit(2), F.greatest(n - 2, F.lit(0))).alias("b"),
        F.slice("__tessera_w", F.lit(3), F.greatest(n - 2, F.lit(0))).alias("c")))
    base = base.select("*", F.when(n >= 3, F.transform(grams, lambda g: F.concat_ws(" ", g["a"], g["b"], g["c"])))
                       .otherwise(F.array().cast("array<string>")).alias("__tessera_g"))
    # Most texts repeat no window: only the others are sorted, equal windows side by side.
    base = base.select("*", F.when(
        F.size(F.array_distinct("__tessera_g")) < F.size("__tessera_g"),
        F.sort_array(F.transform("__tessera_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))).alias("__tessera_s"))
    at = F.sort_array(F.transform(
        F.filter("__tessera_s", lambda x, i: (x["g"] == F.get("__tessera_s", i - 1)["g"]) | (x["g"] == F.get("__tessera_s", i + 1)["g"])),
        lambda x: x["i"]))
    base = base.select("*", F.when(F.col("__tessera_s").isNotNull(), at).alias("__tessera_p"))
    covered = F.aggregate(
        F.transform("__tessera_p", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("__tessera_p", i + 1) - x, F.lit(3)))),
        F.lit(0), lambda a, x: a + x)
    long = lambda c, name: c.cast("long").alias(name)
    # A one-row generator: filters on measures stay above it, so nothing below is computed twice.
    return base.select(*carried, F.inline(F.array(F.struct(
        long(F.size("__tessera_w"), "n_words"), long(F.length(F.array_join("__tessera_w", "")), "word_chars"),
        long(F.length(F.regexp_replace("__tessera_t", r"[^#*$%&|<>]+", "")), "n_symbols"),
        long(F.size("__tessera_l"), "n_lines"), long(F.size("__tessera_l") - F.size(F.array_distinct("__tessera_l")), "n_dup_lines"),
        long(F.coalesce(covered, F.lit(0)), "n_repeat_words"),
        long(F.size(F.filter("__tessera_w", lambda w: F.lower(w).isin(*STOP_WORDS))), "n_stop_words")))))


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean expression over measured columns."""
    kept = F.lit(True)
    for rule in rules:
        value = ratio(*RATIOS[rule.measure]) if rule.measure in RATIOS else F.col(rule.measure)
        if rule.low is not None:
            kept &= value >= rule.low
        if rule.high is not None:
            kept &= value <= rule.high
    return kept


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with MEASURES, base_failed and kept."""
    carried = measured(docs.drop("base_failed", "kept"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return carried.select("*", failed.alias("base_failed"), (~failed & compiled(rules)).alias("kept"))
