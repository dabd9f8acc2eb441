"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Every rule is a ratio of two counts with a least and a most value. Counts are Catalyst expressions over the
text, its words and its lines; :func:`compile_rules` turns the table into columns and one verdict, so a
corpus is judged in one scan without user functions and without a shuffle.

Defined cases: a null or empty text has no words, so every count is 0 and the text is rejected by the
length rule; a very long text is measured whole; an empty table gives an empty result; repeated rows and rows with equal ids are judged one by one; extra columns, whatever their
names, are ignored by :func:`measure` (it returns the columns asked for) and kept by :func:`keep`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import WORD_RE

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to a in is that for it was on with be as by this are at from or an he "
    "de la le et les des en un du une que pour est qui dans par pas au sur avec "
    "der die und den von zu das sich mit auf für ist nicht im dem ein eine als "
    "el y los se del las por no con su para al lo es"
).split()
_SPACES = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Keeps a text if least <= numerator / denominator <= most; a zero denominator keeps it."""

    name: str
    numerator: str
    denominator: str | None
    least: float | None = None
    most: float | None = None


#: Production thresholds. Counts are named in :data:`COUNTS`.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 16.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.3),
    Rule("exclamations_per_word", "n_exclaims", "n_words", None, 0.4),
    Rule("stop_word_share", "n_stop_words", "n_words", 0.04, None),
    Rule("duplicate_line_share", "n_dup_lines", "n_lines", None, 0.6),
)


def _repeated_window_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more. Sorting puts equal windows side by side."""
    starts = F.sequence(F.lit(0), F.size(words) - 3)
    windows = F.sort_array(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", words[i], words[i + 1], words[i + 2]).alias("g"), i.alias("p"))))
    # one-element array: binds the sorted windows to a variable, so that they are made once
    repeated = F.transform(
        F.array(windows),
        lambda s: F.transform(
            F.filter(
                F.sequence(F.lit(0), F.size(s) - 1),
                lambda i: ((i > 0) & (s[F.greatest(i - 1, F.lit(0))]["g"] == s[i]["g"])) | ((i < F.size(s) - 1) & (s[F.least(i + 1, F.size(s) - 1)]["g"] == s[i]["g"])),
            ),
            lambda i: s[i]["p"],
        ),
    )[0]
    covered = F.array_distinct(F.flatten(F.transform(repeated, lambda p: F.array(p, p + 1, p + 2))))
    return F.when(F.size(words) >= 3, F.size(covered)).otherwise(0)


#: name -> expression over the columns _t (text), _w (words), _l (lines with a word).
COUNTS = {
    "n_words": lambda: F.size("_w"),
    "word_chars": lambda: F.length(F.regexp_replace("_t", _SPACES, "")),
    "n_symbols": lambda: F.length("_t") - F.length(F.translate("_t", _SYMBOLS, "")),
    "n_exclaims": lambda: F.length("_t") - F.length(F.translate("_t", "!", "")),
    "n_stop_words": lambda: F.size(F.filter("_w", lambda w: F.lower(w).isin(STOP_WORDS))),
    "n_lines": lambda: F.size("_l"),
    "n_dup_lines": lambda: F.size("_l") - F.size(F.array_distinct("_l")),
    "n_repeat_words": lambda: _repeated_window_words(F.col("_w")),
}


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean column: all rules hold. Bounds are multiplied out, so nothing is divided."""
    verdict = F.lit(True)
    for rule in rules:
        top, bottom = F.col(rule.numerator), F.col(rule.denominator) if rule.denominator else F.lit(1)
        if rule.least is not None:
            verdict &= top >= F.lit(rule.least) * bottom
        if rule.most is not None:
            verdict &= top <= F.lit(rule.most) * bottom
    return verdict


def _measured(df: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    cut = df.select(*keep, t.alias("_t"), F.regexp_extract_all(t, F.lit(WORD_RE), F.lit(0)).alias("_w"), F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    return cut.withColumns({name: make().cast("long") for name, make in COUNTS.items()})


def measure(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, all counts, base_failed and kept for every row of *df*."""
    out = _measured(df, text, [F.col(key)]).withColumn("base_failed", base_failed())
    return out.select(key, *COUNTS, "base_failed", (~F.col("base_failed") & compile_rules(rules)).alias("kept"))


def keep(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of *df* that all rules keep, with the columns of *df*."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    # a filter on the counts would be pushed below them, and their expressions into it, again for each use and each
    # word; it stays where it is above a projection with a column that isn't deterministic
    out = _measured(df, text, [row.alias("_row")]).select("*", F.monotonically_increasing_id().alias("_n"))
    return out.where(~base_failed() & compile_rules(rules) & (F.col("_n") >= 0)).select("_row.*")
