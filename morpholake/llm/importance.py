"""Importance resampling towards a target distribution, by hashed word runs.

Each task keeps a trie of word runs: a node holds how often its run occurred and the CRC state of the run's bytes, so that a
longer run's hash goes on from its prefix.  When a task ends, or its trie is full, the counts leave as totals of buckets; these
merge by sums, a row per bucket.  Scoring walks the same kind of trie with a bucket's gain attached to each node.  Draws are
the highest of (weight + Gumbel noise of the id), ranked by a range sort whose partitions only tell how many rows they hold.

Null and empty texts have no features and weight 0; repeated rows count and are drawn each for itself (rows that repeat an id
share their noise); a null id takes the noise of an empty id and comes last among equals; empty tables give empty results,
whatever further columns there are.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_of, column, map_batches, materialize, pieces, ranked

#: Words of lower-cased UTF-8: digits, a to z and all that is not ASCII.
WORD = regex.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ORDER = 1
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: A task's trie leaves as totals, and begins anew, beyond so many nodes.
MOST_NODES = 200_000

Run = tuple[bytes, ...]


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []  # of bytes, lower() changes A to Z only


def runs_of(words: list[bytes], order: int) -> Iterator[tuple[Run, int]]:
    """Every run of 1 to order consecutive words and how often it occurs."""
    for k in range(1, order + 1):
        yield from Counter(zip(*(words[j:] for j in range(k)), strict=False)).items()


class Trie:
    """Nodes of word runs by number: children, CRC state, count; the root is node 0."""

    def __init__(self) -> None:
        self.children: list[dict[bytes, int] | None] = [None]
        self.state = [0]
        self.count = [0]

    def node(self, run: Run) -> int:
        at = 0
        for word in run:
            below = self.children[at]
            if below is None:
                below = self.children[at] = {}
            found = below.get(word)
            if found is None:
                found = below[word] = len(self.state)
                self.state.append(zlib.crc32(b" " + word if at else word, self.state[at]))
                self.count.append(0)
                self.children.append(None)
            at = found
        return at

    def __len__(self) -> int:
        return len(self.state)

    def buckets(self, n: int) -> np.ndarray:
        return np.array(self.state, np.int64) % n


def bucket_totals(rows: DataFrame, text: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of the texts fall into each bucket that has any."""
    out = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])
        totals, trie = np.zeros(buckets, np.int64), Trie()
        for batch in pieces(batches):
            for raw in batch.column("text").cast(pa.binary()):
                for run, c in runs_of(words_of(raw.as_py()), order):
                    trie.count[trie.node(run)] += c
                if len(trie) > MOST_NODES:
                    np.add.at(totals, trie.buckets(buckets), np.array(trie.count, np.int64))
                    trie = Trie()
        np.add.at(totals, trie.buckets(buckets), np.array(trie.count, np.int64))
        some = np.flatnonzero(totals)
        yield batch_of(schema, bucket=some, n=totals[some])

    found = map_batches(rows.select(column(text).alias("text")), count, out)
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def _collected(totals: DataFrame, buckets: int) -> np.ndarray:
    """The totals as an array: one row per bucket, however large the corpus."""
    out = np.zeros(buckets, np.int64)
    for bucket, n in totals.collect():
        out[bucket] = n
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Of each bucket, 1000 times the logarithm of how much more frequent it is in the target, with add-one smoothing."""
    n, up, down = len(corpus), float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((float(t) + 1) * up / ((float(s) + 1) * down))) for t, s in zip(target.tolist(), corpus.tolist(), strict=True)], np.int64).reshape(n)


def noise(doc_id: object, seed: int) -> int:
    """Gumbel noise of an id, in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, text: str = "text", key: str = "doc_id", order: int = ORDER, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""
    out = T.StructType([T.StructField("doc_id", docs.schema[key].dataType), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight", "score"))])
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value.tolist()
        trie, attached = Trie(), [0]  # attached: a node's gain
        for batch in pieces(batches):
            ids = batch.column("doc_id")
            n_words, n_features, weight, total = [], [], [], []
            for doc_id, raw in zip(ids.to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                words = words_of(raw.as_py())
                features = worth = 0
                for run, c in runs_of(words, order):
                    at = trie.node(run)
                    if at >= len(attached):
                        attached.extend(gain[s % len(gain)] for s in trie.state[len(attached) :])
                    features += c
                    worth += c * attached[at]
                if len(trie) > MOST_NODES:
                    trie, attached = Trie(), [0]
                n_words.append(len(words))
                n_features.append(features)
                weight.append(worth // features if features else 0)
                total.append(weight[-1] + noise(doc_id, seed))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight, total))], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return map_batches(docs.select(column(key).alias("doc_id"), column(text).alias("text")), score, out)


def resample(
    docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", order: int = ORDER, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED
) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank: 1, 2, ... of the drawn, null of all others.

    Drawn are floor(percent * N / 100) of the N documents with least_words words at least, highest scores first, equal ones by
    ascending id.  Two scans of the texts; the rest works on a few numbers per document."""
    gain = gains(_collected(bucket_totals(target, text, order, buckets), buckets), _collected(bucket_totals(docs, text, order, buckets), buckets))
    scored = materialize(weigh(docs, gain, text, key, order, seed), "importance")
    enough = F.col("n_words") >= least_words
    draw = percent * scored.filter(enough).count() // 100
    order_by = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight"), F.col("n_features")]
    placed = ranked(scored.filter(enough), order_by, "rank").withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    rest = scored.filter(~enough).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).drop("n_words")

