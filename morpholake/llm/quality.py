"""Quality rules with adaptive thresholds, in DataFrame functions only.

Every text gets its measures in one scan: how many symbols, repeated lines and repeated words it has, and the mean length
of its words.  Thresholds come from Spark's mergeable quantile sketches (percentile_approx) per language and source:
partial sketches per task, one row per group after the shuffle, so a hot source costs no more than a small one.  Each
group's threshold is shrunk towards its language's, that towards the whole corpus's, by the number of texts behind it, so
a small group leans on the larger one.  The thresholds then join the measures, and what lies outside is dropped.

Word length has a middle half, so its fences are quartiles widened by their distance.  Shares are zero in most texts: the
fence is the group's LEVEL quantile, and no lower than one event in its median text.  Junk must not raise the fences that
should stop it, so quantiles of shares are taken over the texts whose word length is inside.  A text is outside where it
has more events than chance explains at the fence's rate (Z standard deviations of a Poisson number of events).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP_CHARS, WORD_GAP, column, materialize

WINDOW = 8
SYMBOLS = "#*$%&|<>"
ACCURACY = 10_000
LEVEL = 0.95
FENCE = 3.0
Z = 3.0
#: So many texts count as much as the parent's threshold does.  Behind the whole corpus stand half and twice its median word length, and a share of one.
PRIOR = 200
#: Share -> (count, out of, what one event counts: two windows for words, as a repeated window is there twice).
SHARES = {"symbol_share": ("n_symbols", "n_words", 1), "dup_line_share": ("n_dup_lines", "n_lines", 1), "repeat_share": ("n_repeat_words", "n_words", 2 * WINDOW)}


def measures(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep columns, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long); a null text has none of anything.

    Counts are of code points; lines are split at \\n and count only if they hold a word."""
    base = docs.select(*map(column, keep), F.coalesce(column(text), F.lit("")).alias("_t"))
    base = base.select(*keep, "_t", F.filter(F.split("_t", WORD_GAP), lambda w: w != "").alias("_w"))
    n = F.size("_w") - (WINDOW - 1)
    lines = F.filter(F.split("_t", "\n", -1), lambda x: F.translate(x, GAP_CHARS, "") != "")
    hashes = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice("_w", i, WINDOW))))
    counted = base.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_l"),
        hashes.alias("_h"),
    )
    # Most texts repeat no window: only the others sort their windows.
    again = F.size(F.array_distinct("_h")) < F.size("_h")
    placed = F.when(again, F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    counted = counted.select(*keep, "n_words", "word_chars", "n_symbols", F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), placed.alias("_p"))
    twice = F.filter("_p", lambda p, i: (F.get(F.col("_p"), i - 1)["h"] == p["h"]) | (F.get(F.col("_p"), i + 1)["h"] == p["h"]))
    counted = counted.withColumn("_i", F.array_sort(F.transform(twice, lambda p: p["i"])))
    # Each such window adds the words up to the next one's start, WINDOW at most.
    words = F.aggregate(F.transform("_i", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_i"), k + 1) - x, F.lit(WINDOW))).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return counted.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(words, F.lit(0)).alias("n_repeat_words"))


def ratios(measured: DataFrame) -> DataFrame:
    """Adds the SHARES and word_length; null for a text without words."""
    made = {share: F.col(k) / F.when(F.col(n) > 0, F.col(n)) for share, (k, n, _) in SHARES.items()}
    return measured.withColumns(made | {"word_length": F.col("word_chars") / F.when(F.col("n_words") > 0, F.col("n_words"))})


def shrunk(rated: DataFrame, n: Column, own: dict[str, Column], whole: dict[str, Column], by: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """by columns and own's thresholds of every group: (n * own + PRIOR * parent) / (n + PRIOR), from the corpus down.

    n, own: aggregates over a group's rows; whole: what stands behind the corpus, in terms of own's names and aggregates'.
    One pass over the rows makes all three levels; a group whose n is 0 has its parent's thresholds."""
    upper, lower = by
    levels = materialize(rated.rollup(upper, lower).agg(F.grouping_id().alias("_level"), n.alias("_n"), *(x.alias(k) for k, x in own.items())), "levels")

    def blend(at: str, parent: dict[str, Column]) -> list[Column]:
        size = F.col(f"{at}._n")
        return [F.coalesce((size * F.col(f"{at}.{k}") + PRIOR * parent[k]) / (size + PRIOR), parent[k]).alias(k) for k in whole]

    top = levels.filter("_level = 3").alias("t").select(*blend("t", whole)).first()  # one row of bounded size
    if top is None:
        return levels.select(upper, lower, *whole)
    middle = levels.filter("_level = 1").alias("m").select(F.col(f"m.{upper}").alias("_up"), *blend("m", {k: F.lit(top[k]) for k in whole}))
    low = levels.filter("_level = 0").alias("l").join(middle.alias("m"), F.col(f"l.{upper}").eqNullSafe(F.col("m._up")))
    return low.select(f"l.{upper}", f"l.{lower}", *blend("l", {k: F.col(f"m.{k}") for k in whole}))


def with_thresholds(rated: DataFrame, thresholds: DataFrame) -> DataFrame:
    """rated with the threshold columns of its language and source."""
    named = thresholds.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    return rated.join(named, rated["lang"].eqNullSafe(named["_lang"]) & rated["source"].eqNullSafe(named["_source"]), "left").drop("_lang", "_source")


def length_fences(rated: DataFrame) -> DataFrame:
    """lang, source, low, high: fences of word_length from the quartiles of the texts that pass the base rule."""
    value = F.when(~F.col("base_failed"), F.col("word_length"))
    q = F.percentile_approx(value, [0.25, 0.5, 0.75], ACCURACY)
    wide = FENCE * (F.get(q, 2) - F.get(q, 0))
    own = {"low": F.get(q, 0) - wide, "high": F.get(q, 2) + wide, "middle": F.get(q, 1)}
    return shrunk(rated, F.count(value), own, {"low": F.col("t.middle") / 2, "high": F.col("t.middle") * 2})


def share_fences(rated: DataFrame) -> DataFrame:
    """lang, source and a fence of each share, from the texts that pass the base rule and whose word length is inside."""
    fit = ~F.col("base_failed") & F.col("length_inside")
    own = {}
    for share, (_, n, event) in SHARES.items():
        own[share] = F.greatest(F.percentile_approx(F.when(fit, F.col(share)), LEVEL, ACCURACY), event / F.percentile_approx(F.when(fit, F.col(n)), 0.5, ACCURACY))
    return shrunk(rated, F.count(F.when(fit, F.col("word_length"))), own, {share: F.lit(1.0) for share in SHARES})


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept: one row per row of docs.

    base_failed: under 20 words, or over 30 % of words in repeated windows.  kept: not base_failed and inside the four
    thresholds of its language and source.  A null language or source is a group of its own.  Null and empty texts fail the
    base rule.  Repeated rows each count; an empty table gives an empty result.  Other columns are not read."""
    named = docs.select(column(doc_id).alias("doc_id"), column(lang).alias("lang"), column(source).alias("source"), column(text).alias("text"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rated = ratios(materialize(measures(named, ["doc_id", "lang", "source"]), "measures")).withColumn("base_failed", failed)
    inside = F.col("word_length").between(F.col("low"), F.col("high"))
    rated = with_thresholds(rated, length_fences(rated)).withColumn("length_inside", F.coalesce(inside, F.lit(False)))
    fences = share_fences(rated).withColumnsRenamed({share: f"most_{share}" for share in SHARES})
    kept = ~F.col("base_failed") & F.col("length_inside")
    for share, (k, n, event) in SHARES.items():
        expected = F.col(n) * F.col(f"most_{share}")
        kept = kept & (F.col(k) <= expected + Z * F.sqrt(event * expected))
    return with_thresholds(rated, fences).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
