"""Line dedup by distinct-site spread, from mergeable sketches and exact recounts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlake.llm.common import stored

#: A line on this many distinct sites or more is boilerplate.
MIN_SITES = 5

#: log2 of a sketch's registers.
LG_K = 12

#: Stands for a null site, which counts as one site of its own.
NO_SITE = "\x00"


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _occurrences(docs: DataFrame, text: str, site: str) -> DataFrame:
    """One row per text, site and distinct line hash; lines without a word are left out."""
    hashes = F.array_distinct(
        F.transform(F.filter(_lines(F.col(text)), has_word), lambda line: F.xxhash64(line))
    )
    return docs.select(
        F.xxhash64(text).alias("of_text"),
        F.coalesce(F.col(site).cast("string"), F.lit(NO_SITE)).alias("at_site"),
        F.explode(hashes).alias("line"),
    )


def spread_lines(seen: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """Hashes of the lines seen on ``min_sites`` distinct sites or more.

    One HyperLogLog sketch per line merges over all tasks. Lines whose estimate lies
    within five standard errors of the threshold (two sites at least) are counted
    exactly; beyond that band the sketch decides.
    """
    sketched = (
        seen.groupBy("line")
        .agg(F.hll_sketch_agg("at_site", lg_k).alias("sites"))
        .select("line", F.hll_sketch_estimate("sites").alias("n"))
    )
    band = max(2, math.ceil(5 * 1.04 / math.sqrt(2**lg_k) * min_sites))
    judged = stored(sketched.where(F.col("n") >= min_sites - band), "spread")
    sure = judged.where(F.col("n") > min_sites + band).select("line")
    near = judged.where(F.col("n") <= min_sites + band).select("line")
    exact = (
        seen.join(near, "line", "left_semi")
        .groupBy("line", "at_site")
        .agg(F.lit(1).alias("once"))
        .groupBy("line")
        .agg(F.count("once").alias("n"))
        .where(F.col("n") >= min_sites)
        .select("line")
    )
    return stored(sure.unionByName(exact), "boilerplate")


def drop_spread_lines(
    docs: DataFrame,
    text: str = "text",
    site: str = "source",
    min_sites: int = MIN_SITES,
) -> DataFrame:
    """One row per row of ``docs``: its columns as struct ``row``, the text without
    boilerplate as ``text``, and ``n_lines`` and ``n_removed``, lines that hold a word.

    Every occurrence of a boilerplate line goes from every text that has a worded line of
    its own, however little of it is left. A text all of whose worded lines are boilerplate
    is a copy, on which near-dedup decides, and stays as it is. Lines are told apart by
    64-bit hash.
    Null text stays null with no lines; a null site is a site of its own; repeated rows
    are treated alike; an empty table gives no rows. The lines of a text are judged
    once per distinct text, so a text that a third of all rows share is no hot key but
    in the last join, which Spark splits.
    """
    seen = stored(_occurrences(docs, text, site), "lines")
    spread = spread_lines(seen, min_sites)
    of_text = stored(
        seen.select("of_text", "line")
        .join(spread, "line")
        .groupBy("of_text")
        .agg(F.collect_set("line").alias("spread")),
        "text-lines",
    )
    rows = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"),
        F.xxhash64(text).alias("of_text"),
    ).join(of_text.hint("merge"), "of_text", "left")
    lines = _lines(F.col("row")[text])
    removed = F.filter(
        lines, lambda line: has_word(line) & F.array_contains("spread", F.xxhash64(line))
    )
    worded = F.filter(lines, has_word)
    cut = F.col("spread").isNotNull() & (F.size(removed) < F.size(worded))
    left = F.filter(
        lines, lambda line: ~(has_word(line) & F.array_contains("spread", F.xxhash64(line)))
    )
    return rows.select(
        "row",
        F.when(cut, F.array_join(left, "\n")).otherwise(F.col("row")[text]).alias("text"),
        F.coalesce(F.size(worded), F.lit(0)).cast("long").alias("n_lines"),
        F.when(cut, F.size(removed)).otherwise(F.lit(0)).cast("long").alias("n_removed"),
    )


def without_boilerplate(docs: DataFrame, text: str = "text", site: str = "source") -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``; ``n_chars``, where there
    is such a column, follows. No row goes."""
    cleaned = drop_spread_lines(docs, text, site)
    columns = []
    for name, kind in docs.dtypes:
        value = F.col("row")[name]
        if name == text:
            value = F.col("text")
        elif name == "n_chars":
            value = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(value).cast(kind)
        columns.append(value.alias(name))
    return cleaned.select(*columns)
