"""Quality rules with adaptive thresholds (DataFrame functions only).

Word, symbol, line and repetition counts come from the whole text. Instead of fixed cutoffs, each
language and source gets its own: the quartiles of a mergeable quantile sketch, widened by a multiple of
their distance. Groups with few documents take the sketch merged over their language, and languages with
few documents the one merged over everything.

Null or empty text counts as no words and fails the base rules. Null language or source form groups of
their own. Repeated rows each get their own result; other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.operators.shaping import evaluate_once
from chatlake.session import cut_lineage

SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Items a sketch level keeps: quartiles are exact up to this many values, and within 0.1 % beyond.
SKETCH_SIZE = 4096
#: Documents a group needs for thresholds of its own.
MIN_GROUP = 200
#: A value is far off beyond the upper (or lower) quartile by this many quartile distances ...
SPREAD = 3.0
#: ... and by at least this much, so that a group of nearly equal documents does not lose any.
MARGINS = {
    "symbol_share": 0.10,
    "dup_line_share": 0.30,
    "repeat_share": 0.20,
    "mean_word_chars": 3.0,
}


def _repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice.

    The window hashes are sorted with their places; equal neighbours are repeats. Sorted starts then cover
    three words each, less where the next start is nearer.
    """
    places = F.sequence(F.lit(0), F.size(words) - 3)
    hashes = F.transform(
        places, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )
    return F.when(F.size(words) >= 3, hashes).otherwise(F.array().cast("array<bigint>"))


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each text."""
    base = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = evaluate_once(
        base,
        {
            "_words": F.array_remove(F.split("_text", SPACE + "+"), ""),
            "_lines": lines,
            "word_chars": F.char_length(F.translate("_text", SPACES, "")),
            "n_symbols": F.char_length("_text") - F.char_length(F.translate("_text", SYMBOLS, "")),
        },
    ).drop("_text")
    hashed = evaluate_once(split, {"_hashes": _repeated_words(F.col("_words"))})
    placed = F.array_sort(
        F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    )
    # sorting the bare hashes is cheap and settles most texts: no hash twice, nothing repeats
    some = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    sorted_ = evaluate_once(
        hashed.withColumn("_some", some),
        {"_sorted": F.when(F.col("_some"), placed)},
    )
    same = lambda k, h: F.coalesce(F.get(F.col("_sorted"), k)["h"] == h, F.lit(False))
    twins = F.filter("_sorted", lambda x, k: same(k - 1, x["h"]) | same(k + 1, x["h"]))
    starts = evaluate_once(
        sorted_, {"_starts": F.array_sort(F.transform(twins, lambda x: x["i"]))}
    )
    covered = F.aggregate(
        "_starts",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(3), i - acc["last"])).cast("long").alias("n"), i.alias("last")
        ),
        lambda acc: acc["n"],
    )
    return starts.select(
        "doc_id",
        "lang",
        "source",
        F.size("_words").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
    )


def _shares(counts: DataFrame) -> DataFrame:
    """The values that thresholds are set for; 0 where there is nothing to divide by."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return counts.withColumns(
        {
            "symbol_share": share("n_symbols", "word_chars"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "mean_word_chars": share("word_chars", "n_words"),
        }
    )


def _levels(source: str | None, lang: str | None) -> Column:
    """Name of a sketch level; null and the text "null" stay apart."""
    part = lambda c: F.when(F.col(c).isNull(), "n").otherwise(F.concat(F.lit("v"), c))
    if source is not None:
        return F.to_json(F.array(part(lang), part(source)))
    return F.to_json(F.array(part(lang))) if lang is not None else F.lit("[]")


def thresholds(shares: DataFrame, min_group: int = MIN_GROUP, spread: float = SPREAD) -> DataFrame:
    """lang, source and low_* and high_* for each value, one row per group of the input.

    One sketch per group is made where the rows are; the sketches of a language and of everything are
    merged from those. Documents without words do not count.
    """
    sketches = [
        F.kll_sketch_agg_double(name, F.lit(SKETCH_SIZE)).alias(name) for name in MARGINS
    ]
    groups = cut_lineage(
        shares.groupBy("lang", "source").agg(
            F.count(F.lit(1)).alias("rows"), *sketches
        )
    )
    levels = F.array(_levels("source", "lang"), _levels(None, "lang"), _levels(None, None))
    merged = (
        groups.withColumn("level", F.explode(levels))
        .groupBy("level")
        .agg(
            F.sum("rows").alias("rows"),
            *[F.kll_merge_agg_double(name).alias(name) for name in MARGINS],
        )
    )
    bounds = {}
    for name, margin in MARGINS.items():
        q1 = F.kll_sketch_get_quantile_double(name, F.lit(0.25))
        q3 = F.kll_sketch_get_quantile_double(name, F.lit(0.75))
        reach = F.greatest((q3 - q1) * spread, F.lit(margin))
        bounds[f"low_{name}"] = q1 - reach
        bounds[f"high_{name}"] = q3 + reach
    limits = merged.select("level", "rows", *[c.alias(n) for n, c in bounds.items()])
    # the narrowest level with enough documents; the last one always serves
    candidates = groups.select("lang", "source", F.posexplode(levels).alias("_pos", "level"))
    chosen = (
        candidates.join(limits, "level")
        .where((F.col("rows") >= min_group) | (F.col("_pos") == 2))
        .groupBy("lang", "source")
        .agg(F.min_by(F.struct(*bounds), "_pos").alias("_limits"))
    )
    return chosen.select("lang", "source", "_limits.*")


def judge(docs: DataFrame, min_group: int = MIN_GROUP, spread: float = SPREAD) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document."""
    counts = cut_lineage(text_counts(docs))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = _shares(counts).withColumn("base_failed", failed).alias("d")
    limits = thresholds(_shares(counts.where("n_words > 0")), min_group, spread).alias("t")
    same = F.col("d.lang").eqNullSafe(F.col("t.lang")) & F.col("d.source").eqNullSafe(
        F.col("t.source")
    )
    inside = F.lit(True)
    for name in MARGINS:
        inside &= F.col(name).between(F.col(f"low_{name}"), F.col(f"high_{name}"))
    return rows.join(limits, same, "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"),
    )
