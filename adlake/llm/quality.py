"""Quality rules: a threshold table compiled into one Spark projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlake.llm.common import bind, words_of

#: Frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for on with as was by be this are or an at from he a "
    "der die das und in zu den mit ist für im von auf des ein eine nicht dem sich "
    "de la le les et des un une du en que qui est dans pour par sur pas au avec "
    "el la los las de que y en un una por con para se su al no es del lo"
).split()

#: The characters counted as symbols.
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``metric`` must lie within ``[least, most]``; None leaves a side open."""

    metric: str
    least: float | None = None
    most: float | None = None

    def holds(self, value: Column) -> Column:
        inside = F.lit(True)
        if self.least is not None:
            inside = inside & (value >= F.lit(float(self.least)))
        if self.most is not None:
            inside = inside & (value <= F.lit(float(self.most)))
        return inside


#: The threshold table. Ratios are per word, or per line that holds a word.
RULES = (
    Rule("mean_word_chars", 2.5, 12),
    Rule("symbols_per_word", most=0.1),
    Rule("exclamations_per_word", most=0.5),
    Rule("stop_word_ratio", least=0.05),
    Rule("dup_line_ratio", most=0.5),
    Rule("bullet_line_ratio", most=0.9),
    Rule("ellipsis_line_ratio", most=0.3),
)

#: A text with fewer words, or a larger share of repeated words, fails at once.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more, the first one included.

    Windows are compared by 64-bit hash. Only a text with a repeated window is
    sorted, so the common case is linear in its words, and none is quadratic.
    """

    def windows(ws: Column) -> Column:
        return F.transform(
            F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 2, F.lit(0))),
            lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)),
        )

    def repeated_starts(hashes: Column) -> Column:
        ordered = F.sort_array(
            F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at")))
        )

        def starts(rows: Column) -> Column:
            def again(row: Column, i: Column) -> Column:
                before = F.get(rows, i - 1)["h"]
                after = F.get(rows, i + 1)["h"]
                return before.eqNullSafe(row["h"]) | after.eqNullSafe(row["h"])

            return F.sort_array(F.transform(F.filter(rows, again), lambda row: row["at"]))

        return bind(ordered, starts)

    def covered(starts: Column) -> Column:
        first = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            starts,
            first,
            lambda seen, at: F.struct(
                at.alias("last"),
                (seen["n"] + F.least(at - seen["last"], F.lit(3))).alias("n"),
            ),
            lambda seen: seen["n"],
        )

    def count(hashes: Column) -> Column:
        any_twice = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(any_twice, covered(repeated_starts(hashes))).otherwise(F.lit(0))

    return bind(windows(words), count).cast("long")


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def metrics(words: Column, lines: Column, text: Column) -> dict[str, Column]:
    """All counts of one text; ``lines`` are those that hold a word."""
    both_cases = sorted({*STOP_WORDS, *(word.capitalize() for word in STOP_WORDS)})
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeat_words(words),
        "n_lines": F.size(lines).cast("long"),
        "n_stop_words": F.size(F.filter(words, lambda w: w.isin(both_cases))).cast("long"),
        "n_exclamations": F.regexp_count(text, F.lit("!")).cast("long"),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[-*•]"))).cast("long"),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).cast(
            "long"
        ),
    }


def verdicts(rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """``base_failed``, ``broken_rules`` (their metrics) and ``kept`` from counts."""
    words, lines = F.col("n_words"), F.col("n_lines")
    ratios = {
        "mean_word_chars": _ratio(F.col("word_chars"), words),
        "symbols_per_word": _ratio(F.col("n_symbols"), words),
        "exclamations_per_word": _ratio(F.col("n_exclamations"), words),
        "stop_word_ratio": _ratio(F.col("n_stop_words"), words),
        "dup_line_ratio": _ratio(F.col("n_dup_lines"), lines),
        "bullet_line_ratio": _ratio(F.col("n_bullet_lines"), lines),
        "ellipsis_line_ratio": _ratio(F.col("n_ellipsis_lines"), lines),
    }
    failed = (words < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > words * MAX_REPEAT_PERCENT
    )
    held = [rule.holds(ratios[rule.metric]) for rule in rules]
    broken = F.array_compact(
        F.array(*[F.when(~ok, F.lit(rule.metric)) for ok, rule in zip(held, rules, strict=True)])
    )
    kept = ~failed
    for ok in held:
        kept = kept & ok
    return {"base_failed": failed, "broken_rules": broken, "kept": kept}


def judge(
    docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """One row per row of ``docs``: its columns as struct ``row``, the counts, the
    broken rules and the verdict.

    Null text counts as empty: no words, hence ``base_failed``. Nulls elsewhere and
    extra columns of any name stay in ``row`` untouched, so no name can clash.
    Repeated rows are judged one by one; an empty table gives no rows. Work per text
    grows as n log n at most.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    parts = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"),
        whole.alias("body"),
        words_of(whole).alias("words"),
        F.filter(
            F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")
        ).alias("lines"),
    )
    counts = metrics(F.col("words"), F.col("lines"), F.col("body"))
    # As a generator's output the counts are computed once; a filter on them isn't
    # pushed down into the split text, where each word would split it again.
    counted = parts.select(
        F.inline(F.array(F.struct("row", *[c.alias(n) for n, c in counts.items()])))
    )
    return counted.select("*", *[c.alias(n) for n, c in verdicts(rules).items()])


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their own columns."""
    return judge(docs, text).where("kept").select("row.*")
