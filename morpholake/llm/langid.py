"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed 1- to 3-grams per language over all labelled rows: tasks count into dense vectors, Spark adds
them up, and only languages x BUCKETS sums reach the driver.  The log-probability matrix (languages x BUCKETS floats,
its size checked) is broadcast; scoring counts a text's distinct buckets and multiplies these sparse counts by the matrix,
batch by batch in numpy, CELLS numbers at a time whatever the number of languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, handing_back, map_batches, texts

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
CHUNK_CHARS = 1_000_000
MODEL_BYTES = 256_000_000
CELLS = 4_000_000


def has_letter(x: str) -> bool:
    return any(c.isalpha() for c in x)


def chunks(docs: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about CHUNK_CHARS characters, one document at least."""
    at = size = 0
    for i, x in enumerate(docs):
        if i > at and size + len(x) > CHUNK_CHARS:
            yield at, i
            at, size = i, 0
        size += len(x)
    if docs:
        yield at, len(docs)


def grams(docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of lower-cased texts: (buckets of shape (orders, characters), first character of each text).

    Two gaps stand before and after a text, so no n-gram holds characters of two texts."""
    low = [f"{x.lower()}  " for x in docs]
    code = np.frombuffer("".join(["  ", *low]).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum([0, *(len(x) for x in low)])[:-1]
    out, h = np.empty((len(ORDERS), len(code) - 2), np.uint16), np.zeros(len(code), np.uint32)
    for k, n in enumerate(ORDERS):
        # h of the n-gram that ends here = h of the (n-1)-gram that ends one earlier, times a prime, plus this character
        h[1:] = h[:-1] * np.uint32(0x01000193)
        h += code * np.uint32(0x9E3779B1) + np.uint32(n)
        mixed = h ^ (h >> np.uint32(15))
        mixed *= np.uint32(0x85EBCA6B)
        out[k] = (mixed >> np.uint32(18))[2:]
    return out, starts


def sparse_counts(docs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, n) of every bucket that a text has, by text."""
    which, bucket, n = [], [], []
    for a, b in chunks(docs):
        rows, starts = grams(docs[a:b])
        for k, (at, to) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), rows.shape[1]], strict=True)):
            own = np.bincount(rows[:, at:to].ravel(), minlength=BUCKETS)
            found = np.flatnonzero(own)
            which.append(np.full(len(found), a + k, np.int32))
            bucket.append(found.astype(np.uint16))
            n.append(own[found].astype(np.float32))
    return np.concatenate(which), np.concatenate(bucket), np.concatenate(n)


def totals(docs: list[str], weight: np.ndarray) -> np.ndarray:
    """Sum of the log probabilities of each text's n-grams, by language."""
    out = np.zeros((len(docs), weight.shape[1]))
    if not docs:
        return out
    which, bucket, n = sparse_counts(docs)
    most = max(1, CELLS // weight.shape[1])
    for at in range(0, len(which), most):
        own = which[at : at + most]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        out[own[first]] += np.add.reduceat(weight[bucket[at : at + most]] * n[at : at + most, None], first, axis=0, dtype=np.float64)
    return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log priors, log probabilities of shape (BUCKETS, languages)) from all rows with a language and a letter."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                by: dict[str, list[str]] = {}
                for x, k in zip(texts(part), part.column("lang").to_pylist(), strict=True):
                    if has_letter(x):
                        by.setdefault(k, []).append(x)
                for k, xs in by.items():
                    own = counts.setdefault(k, np.zeros(BUCKETS + 1, np.int64))
                    own[BUCKETS] += len(xs)  # documents, for the prior
                    for a, b in chunks(xs):
                        for row in grams(xs[a:b])[0]:
                            own[:BUCKETS] += np.bincount(row, minlength=BUCKETS)
        for k, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at])], names=schema.names)

    rows = docs.select(column(text).alias("text"), column(lang).alias("lang")).filter("text is not null and lang is not null")
    sums = rows.mapInArrow(handing_back(run), schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.toArrow()
    names = sorted(set(found.column("lang").to_pylist()))
    if len(names) * BUCKETS * 4 > MODEL_BYTES:
        raise ValueError(f"{len(names)} languages are more than a broadcast matrix of {MODEL_BYTES} bytes holds")
    table = np.zeros((BUCKETS + 1, len(names)))
    place = {k: i for i, k in enumerate(names)}
    table[found.column("bucket").to_numpy(), [place[k] for k in found.column("lang").to_pylist()]] = found.column("n").to_numpy()
    smoothed = table[:BUCKETS] + 0.5
    return names, np.log((table[BUCKETS] + 1) / (table[BUCKETS].sum() + max(1, len(names)))), np.log(smoothed / smoothed.sum(axis=0)).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], keep: list[str], text: str = "text", made: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """keep columns and those that made names: the language, and its posterior (0 to 1).

    A text that is null or has no letter is `und` with score 0, and so is every text if the model has no language.
    Equal posteriors go to the first language by name.  Repeated rows each get their result, an empty table gives an empty
    one.  Other columns are not read; keep must not name a made column (ValueError)."""
    if clash := {c.lower() for c in made} & {c.lower() for c in keep}:
        raise ValueError(f"columns {sorted(clash)} are made by this operator")
    source = docs.select(*(column(c) for c in dict.fromkeys([*keep, text])))
    schema = T.StructType([*(source.schema[c] for c in keep), T.StructField(made[0], T.StringType(), False), T.StructField(made[1], T.DoubleType(), False)])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, prior, weight = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                docs_ = texts(batch, text)
                pred, score = ["und"] * len(docs_), np.zeros(len(docs_))
                known = np.array([bool(names) and has_letter(x) for x in docs_], bool)
                if known.any():
                    total = totals([x for x, k in zip(docs_, known, strict=True) if k], weight) + prior
                    total -= total.max(axis=1, keepdims=True)
                    odds = np.exp(total)
                    score[known] = odds.max(axis=1) / odds.sum(axis=1)
                    for i, k in zip(np.flatnonzero(known).tolist(), total.argmax(axis=1).tolist(), strict=True):
                        pred[i] = names[k]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(pred, pa.string()), pa.array(score)], names=schema.names)

    return map_batches(source, run, schema)
