"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A mask names the positions of a window that count; the others are ignored, so a changed word there does not hide a copy.
Each window of a document and of a benchmark item is hashed once per mask; equal hashes join, and around each hit the
words of document and item are compared position by position: a stretch of VERIFY words (a shorter item: the whole)
with at least SHARE of them equal is a leak, wherever it stands.

The masks miss nothing that the comparison accepts: of any VERIFY words of which at most two differ, one of MASKS fits
somewhere; a shorter item of which k words may differ has masks of its own, each leaving out k of k + 2 interleaved
groups of positions.  Tests enumerate all substitutions.  Letters of scripts without spaces count as words.

What surrounds a window in an item is a passage: equal passages of several items are compared once, and their items are
looked up afterwards, so wording that all items share costs no more than wording of one.  Hashes of the benchmark are
counted first: up to BROADCAST_SEEDS they are broadcast (a row is some 40 bytes), and the documents' windows stream past
without a shuffle.  Beyond, documents are written as numbered arrays of words; only (row, position, hash) goes to the
join, hits are made distinct, and words are fetched by row for the hits alone.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, free_name, materialize

MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 5, 6, 7), (0, 1, 2, 5, 7, 8))
VERIFY = 13
SHARE = 0.8
BROADCAST_SEEDS = 2_000_000
BROADCAST_WORDS = 8_000_000
#: Letters that stand for themselves, as their scripts put no spaces between words: Thai, Lao, Burmese, Khmer, Kana, Han.
UNSPACED = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}]"


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits, letters of UNSPACED scripts one by one; a null text has none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    # Such letters take three bytes each, so a text of as many bytes as letters has none.
    spaced = F.when(F.octet_length(text) > F.char_length(text), F.regexp_replace(low, f"({UNSPACED})", " $1 ")).otherwise(low)
    return F.array_remove(F.split(spaced, r"[^\p{L}\p{N}]+"), "")


def masks_for(n: int) -> list[tuple[int, ...]]:
    """Masks of an item of n words, under VERIFY: k words may differ, and one mask at least leaves them out."""
    may_differ = next(k for k in range(n, -1, -1) if (n - k) / n >= SHARE)
    groups = may_differ + 2 if may_differ else 1
    return [tuple(p for p in range(n) if p % groups not in out) for out in combinations(range(groups), may_differ)]


def all_masks(short: list[int]) -> list[tuple[int | None, tuple[int, ...]]]:
    """(length of item or None for VERIFY words and more, mask), for items of these lengths under VERIFY."""
    return [(None, m) for m in MASKS] + [(n, m) for n in short for m in masks_for(n)]


def seeds(words: DataFrame, masks: list[tuple[int | None, tuple[int, ...]]], items: bool, *carry: str) -> DataFrame:
    """carry columns, words, at (the window's first word) and seed, for words: array column `words`.

    An item has the masks of its own length only."""
    # The words of a text are an array once made: the windows only point into it.
    size, at = F.size("words"), F.col("at")
    windows = words.select(*carry, "words", F.explode(F.when(size > 0, F.sequence(F.lit(0), size - 1))).alias("at"))
    hashes = []
    for k, (n, mask) in enumerate(masks):
        fits = at + mask[-1] < size if n is None else at + n <= size
        if n is not None and items:
            fits = fits & (size == n)
        elif items:
            fits = fits & (size >= VERIFY)
        hashes.append(F.when(fits, F.xxhash64(F.lit(k), *(F.get("words", at + p) for p in mask))))
    return windows.select(*carry, "words", "at", F.explode(F.array(*hashes)).alias("seed")).filter("seed is not null")


def around(words: Column, at: Column) -> tuple[Column, Column]:
    """(words that a stretch over the window at this place can reach, place of the window among them)."""
    off = F.least(at, F.lit(VERIFY - 1))
    return F.slice(words, at - off + 1, off + 2 * VERIFY), off


def most_equal(equal: Column, stretch: Column) -> Column:
    """The most ones in a stretch of so many places of an array of 0 and 1, in one pass: the last places are bits of a number."""
    ones = F.element_at(F.array(*(F.lit((1 << k) - 1) for k in range(1, VERIFY + 1))), stretch)

    def add(s: Column, x: Column) -> Column:
        last = F.shiftleft(s["last"], 1).bitwiseOR(x).bitwiseAND(ones)
        return F.struct(last.alias("last"), F.greatest(s["best"], F.bit_count(last)).alias("best"))

    return F.aggregate(equal, F.struct(F.lit(0).alias("last"), F.lit(0).alias("best")), add)["best"]


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, matched): each leak, matched being the largest share of equal words in a stretch.

    Null and empty texts, and texts without a letter or digit, leak nothing and are not sought; a null item_id or doc_id
    is kept as a key of its own.  Rows that repeat an id count as one document (or item): the largest share of any of
    them.  Empty tables give an empty result.  Only the named columns are read, so other columns' names cannot clash."""
    items = benchmark.select(column(item_id).alias("item_id"), words_of(column(text)).alias("words")).filter(F.size("words") > 0)
    items = items.withColumn("item", F.xxhash64("item_id", "words"))
    size = items.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("words"), F.array_sort(F.collect_set(F.when(F.size("words") < VERIFY, F.size("words")))).alias("short")).first()
    masks = all_masks(size["short"])
    near, off = around(F.col("words"), F.col("at"))
    stretch = F.least(F.size("words"), F.lit(VERIFY))
    placed = seeds(items, masks, True, "item_id").select("seed", "item_id", near.alias("p_words"), off.alias("p_off"), stretch.alias("stretch"))
    placed = materialize(placed.withColumn("passage", F.xxhash64("p_words", "p_off", "stretch")), "passages")
    passage_seeds = placed.select("seed", "passage").distinct()
    passages = placed.select("passage", "p_words", "p_off", "stretch").dropDuplicates(["passage"])
    owners = placed.select("passage", "item_id").distinct()
    source = docs.select(column(doc_id).alias("doc_id"), words_of(column(text)).alias("words"))
    if len(masks) * size["words"] <= BROADCAST_SEEDS:
        hits = seeds(source, masks, False, "doc_id").join(F.broadcast(passage_seeds), "seed")
        hits = hits.select("doc_id", "passage", near.alias("near"), off.alias("off"))
    else:
        rows = materialize(source.withColumn("row", F.monotonically_increasing_id()), "words")
        # A frequent seed is a hot key of the documents' side alone: the other holds each passage once.
        found = seeds(rows, masks, False, "row").select("row", "at", "seed").join(passage_seeds, "seed").select("row", "at", "passage").distinct()
        hits = found.join(rows, "row").select("doc_id", "passage", near.alias("near"), off.alias("off"))
    # A passage is at most 3 * VERIFY words, and there is one at most for each word of the benchmark and mask.
    hits = hits.join(F.broadcast(passages) if 3 * VERIFY * size["words"] <= BROADCAST_WORDS else passages, "passage")
    # Position p of the passage stands at p - p_off + off of the words around the hit.
    low = F.greatest(F.lit(0), F.col("p_off") - F.col("off"))
    high = F.least(F.size("p_words"), F.col("p_off") - F.col("off") + F.size("near"))
    equal = F.transform(F.sequence(low, high - 1), lambda p: (F.get("p_words", p) == F.get("near", p - F.col("p_off") + F.col("off"))).cast("int"))
    hits = hits.filter(high - low >= F.col("stretch")).select("doc_id", "passage", most_equal(equal, F.col("stretch")).alias("best"), "stretch")
    matched = hits.withColumn("matched", F.col("best") / F.col("stretch")).filter(F.col("matched") >= SHARE).groupBy("doc_id", "passage").agg(F.max("matched").alias("matched"))
    return matched.join(owners, "passage").groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"))


def judge(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, contaminated, n_items, items (ids, ascending), matched (0 without a leak)."""
    found = leaks(docs, benchmark, doc_id, item_id, text)
    found = found.groupBy(F.col("doc_id").alias("key")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("item_id")).alias("found"), F.max("matched").alias("share"))
    ids = docs.select(column(doc_id).alias("doc_id"))
    joined = ids.join(found, F.col("doc_id").eqNullSafe(F.col("key")), "left")
    return joined.select("doc_id", F.col("n").isNotNull().alias("contaminated"), F.coalesce("n", F.lit(0)).alias("n_items"), F.coalesce("found", F.array().cast(found.schema["found"].dataType)).alias("items"), F.coalesce("share", F.lit(0.0)).alias("matched"))


def remove_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """docs without the documents that leak an item; all columns stay as they are, whatever their names.

    Rows that repeat a doc_id go together, null ids too; rows without a leak stay, repeated or not."""
    key = free_name("_leaking_doc", docs.columns)
    found = leaks(docs, benchmark, doc_id, item_id, text).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(found, column(doc_id).eqNullSafe(F.col(key)), "left_anti")
