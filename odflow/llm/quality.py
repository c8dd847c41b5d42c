"""Quality rules with thresholds that fit themselves to each language and source. Native expressions throughout.

Per text: words, characters, symbols, repeated lines, words in repeated 3-word windows. Mergeable quantile sketches
(Greenwald-Khanna summaries, percentile_approx, merged over tasks) of three ratios for each (lang, source) and each lang
give quartiles; a text leaves if a ratio lies beyond both fences: quartile +- reach * (interquartile range + slack). Where a source's quartile is beyond its language's fence, that one holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflow.llm.common import stored

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: Ratio: slack in its own unit, whether low values are bad as well as high ones.
RATIOS = {"symbols_per_word": (0.05, False), "chars_per_word": (0.5, True), "dup_lines_per_word": (0.01, False)}


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of every row.

    Null text has no words; its counts are 0 and it fails. Other columns are ignored, repeated rows each have a row.
    Windows are compared by 64-bit hashes within one text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))

    def counts(words: Column) -> Column:
        n = F.size(words)
        at = F.sequence(F.lit(0), n - 3)
        hashes = F.when(n > 3, F.transform(at, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))
        return F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _once(hashes, covered).cast("long").alias("n_repeat_words"),
        )

    def covered(hashes: Column) -> Column:
        # most texts repeat no window: a set of hashes tells that without sorting
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _once(F.sort_array(F.arrays_zip(hashes.alias("h"), F.sequence(F.lit(0), F.size(hashes) - 1).alias("i"))), repeated)).otherwise(0)

    def repeated(trios: Column) -> Column:
        # sorted by hash, then place: neighbours of equal hash are windows found twice
        same = F.zip_with(trios, F.slice(trios, 2, F.size(trios)), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])))
        at = F.array_sort(F.array_distinct(F.flatten(F.filter(same, lambda p: p.isNotNull()))))
        # a window covers three words, or as many as lie before the next one
        step = lambda starts: F.zip_with(starts, F.slice(starts, 2, F.size(starts)), lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3))))
        return F.aggregate(_once(at, step), F.lit(0), lambda a, x: a + x)

    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.select(
        "doc_id", "lang", "source",
        _once(F.array_remove(F.split(text, SPACE), ""), counts).alias("c"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _once(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    base = counted.select("doc_id", "lang", "source", "c.n_words", "c.word_chars", "n_symbols", "n_dup_lines", "c.n_repeat_words")
    return base.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _once(value: Column, use) -> Column:
    """use(value) with the value worked out once a row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _ratio(name: str) -> Column:
    count = {"symbols_per_word": "n_symbols", "chars_per_word": "word_chars", "dup_lines_per_word": "n_dup_lines"}[name]
    return F.try_divide(F.col(count).cast("double"), F.col("n_words").cast("double"))


def thresholds(scored: DataFrame, reach: float = 6.0, accuracy: int = 10_000) -> DataFrame:
    """(lang, source, level, <ratio>_lo, _hi, _q1, _q3): fences and quartiles by (lang, source) at level 0 and by lang at level 1.

    Learned from rows that pass the base rules. ``reach`` interquartile ranges (with a slack) beyond the quartiles.
    """
    sketches = [F.percentile_approx(_ratio(name), [0.25, 0.75], accuracy).alias(name) for name in RATIOS]
    quartiles = scored.filter(~F.col("base_failed")).rollup("lang", "source").agg(F.grouping_id().cast("int").alias("level"), *sketches).filter("level < 3")
    fences = []
    for name, (slack, low_too) in RATIOS.items():
        low, high = F.get(name, F.lit(0)), F.get(name, F.lit(1))
        width = reach * (high - low + slack)
        fences += [(low - width if low_too else F.lit(float("-inf"))).alias(f"{name}_lo"), (high + width).alias(f"{name}_hi"), low.alias(f"{name}_q1"), high.alias(f"{name}_q3")]
    return quartiles.select("lang", "source", "level", *fences)


def verdicts(docs: DataFrame, reach: float = 6.0) -> DataFrame:
    """``features`` and kept: base rules passed and no ratio beyond the fences of its lang and source and of its lang.

    A source whose own quartile lies beyond its language's fence is mostly or largely junk: the language's fence holds there.
    A null lang or source is a group of its own. A group without rows that pass the base rules rejects nothing more.
    """
    # a few numbers a row: written once, so that texts are read once
    scored = stored(features(docs))
    limits = thresholds(scored, reach)
    own, wide = limits.filter("level = 0").alias("own"), limits.filter("level = 1").alias("wide")
    rows = scored.alias("d")
    joined = rows.join(own, F.col("d.lang").eqNullSafe(F.col("own.lang")) & F.col("d.source").eqNullSafe(F.col("own.source")), "left").join(wide, F.col("d.lang").eqNullSafe(F.col("wide.lang")), "left")
    beyond = F.lit(False)
    for name in RATIOS:
        value = _ratio(name)
        at = lambda t, end: F.col(f"{t}.{name}_{end}")  # noqa: B023,E731
        high = (value > at("wide", "hi")) & ((value > at("own", "hi")) | (at("own", "q3") > at("wide", "hi")))
        low = (value < at("wide", "lo")) & ((value < at("own", "lo")) | (at("own", "q1") < at("wide", "lo")))
        beyond |= F.coalesce(high | low, F.lit(False))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return joined.select(*(F.col(f"d.{c}").alias(c) for c in names), (~F.col("d.base_failed") & ~beyond).alias("kept"))
