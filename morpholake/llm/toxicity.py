"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(bias + sum of w over a text's n terms + pairs / n * sum over pairs of terms of <v_i, v_j>), pairs / n being
at most 1: the pairwise part learns what single weights cannot, such as an insult next to a mention of a group, and long
texts, which have very many pairs, do not drown in them.  Terms are hashed into BUCKETS.  No term is screened out: weights
and vectors have Gaussian priors, so a term or pair without evidence stays near zero, and a pair grows where its texts ask
for it even if neither half says anything alone.  Training takes a bounded sample of labelled rows (about SAMPLE_ROWS, by
hash of the id), whose features, not texts, reach the driver.  Scoring is a scan with the broadcast model (BUCKETS x
(RANK + 1) floats).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, handing_back, hashed_sample, map_batches, pieces, texts

BUCKETS = 1 << 17
RANK = 4
SAMPLE_ROWS = 12_000
PAIRS = 25
EPOCHS = 16
BATCH = 64
RATE = 1.0
#: Inverse variances of the priors of weights and of vectors, in texts.
PRIOR_W, PRIOR_V = 0.5, 30.0
#: A weight leaves zero by what its texts ask for beyond so many standard errors; one of size SURE pays half of that toll.
STANDARD_ERRORS, SURE = 3.0, 0.06
TERM = regex.compile(r"\p{L}+")
CACHE_TERMS = 300_000
STEMS = (4, 5)


@dataclass
class Model:
    bias: float
    w: np.ndarray
    v: np.ndarray


def term_buckets(text: str, known: dict[str, tuple[int, ...]]) -> list[int]:
    """The distinct buckets of a text's lower-cased runs of letters and of their first letters (STEMS), ascending.

    The first letters stand for a stem, so an insult is known in forms that no labelled text had."""
    if len(known) > CACHE_TERMS:
        known.clear()
    out: set[int] = set()
    for t in set(TERM.findall(text.lower())):
        b = known.get(t)
        if b is None:
            b = known[t] = tuple(zlib.crc32(x.encode()) % BUCKETS for x in (t, *(f"{t[:n]}-" for n in STEMS if len(t) >= n)))
        out.update(b)
    return sorted(out)


def pair_weight(size: np.ndarray) -> np.ndarray:
    """What a text's pairs count, by its number of terms."""
    return PAIRS / np.maximum(size, PAIRS)


def raw_scores(model: Model, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Scores before the sigmoid of texts whose buckets lie end to end in flat, size of each text."""
    out = np.full(len(size), model.bias)
    full = np.flatnonzero(size)
    if len(full):
        at = (np.cumsum(size) - size)[full]
        v = model.v[flat]
        s = np.add.reduceat(v, at)
        pairs = 0.5 * ((s * s).sum(1) - np.add.reduceat((v * v).sum(1), at))
        out[full] += np.add.reduceat(model.w[flat], at) + pair_weight(size[full]) * pairs
    return out


def fit(flat: np.ndarray, size: np.ndarray, labels: np.ndarray, seed: int = 7) -> Model:
    """Trains on texts whose buckets lie end to end in flat, by steps along the gradient over its rough curvature.

    A bucket's step is the smaller the more texts have it, so that a rare one moves no faster than its prior allows.
    Without rows of both labels, the model scores the labels' mean."""
    mean = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
    model = Model(float(np.log(mean / (1 - mean))), np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, RANK), np.float32))
    if not len(labels) or labels.min() == labels.max():
        return model
    rng = np.random.default_rng(seed)
    seen = np.bincount(flat, minlength=BUCKETS)
    # Texts of the rarer label make the curvature: about p (1 - p) of a bucket's texts.
    curve = seen * (mean * (1 - mean))
    doubt = (STANDARD_ERRORS * np.sqrt(curve)).astype(np.float32)
    step_w = (RATE / (PRIOR_W + curve)).astype(np.float32)
    step_v = (RATE / (PRIOR_V + curve)).astype(np.float32)
    decay = 1 / np.maximum(seen, 1).astype(np.float32)  # the prior's share of one occurrence
    model.v[:] = rng.normal(0, 0.1, (BUCKETS, RANK))
    model.v[seen == 0] = 0
    starts = np.cumsum(size) - size
    for epoch in range(EPOCHS):
        rate = np.float32(1 - epoch / EPOCHS)
        order = rng.permutation(len(size))
        for k in range(0, len(order), BATCH):
            some = order[k : k + BATCH]
            own = size[some]
            ids = flat[np.repeat(starts[some] - np.cumsum(own) + own, own) + np.arange(own.sum())]
            err = (1 / (1 + np.exp(-np.clip(raw_scores(model, ids, own), -30, 30))) - labels[some]).astype(np.float32)
            model.bias -= float(rate * err.sum()) / (len(labels) * mean * (1 - mean))
            if not len(ids):
                continue
            full = np.flatnonzero(own)
            v = model.v[ids]
            s = np.zeros((len(some), RANK), np.float32)
            s[full] = np.add.reduceat(v, (np.cumsum(own) - own)[full])
            each = np.repeat((err * pair_weight(own)).astype(np.float32)[:, None] * np.clip(s, -20, 20), own, axis=0) - np.repeat(err * pair_weight(own).astype(np.float32), own)[:, None] * v
            by = np.argsort(ids, kind="stable")
            sorted_ids = ids[by]
            first = np.flatnonzero(np.diff(sorted_ids, prepend=-1))
            which, times = sorted_ids[first], np.diff([*first, len(ids)]).astype(np.float32)
            dw = np.add.reduceat(np.repeat(err, own)[by], first)
            dv = np.add.reduceat(each[by], first)
            share = times * decay[which]
            w = model.w[which] - rate * step_w[which] * (dw + PRIOR_W * share * model.w[which])
            model.w[which] = np.sign(w) * np.maximum(np.abs(w) - rate * step_w[which] * share * doubt[which] / (1 + np.abs(w) / SURE), 0)
            model.v[which] -= rate * step_v[which][:, None] * (dv + PRIOR_V * share[:, None] * model.v[which])
    return model


def train(labelled: DataFrame, label: str = "toxic", text: str = "text", order: str = "doc_id") -> Model:
    """Fits on about SAMPLE_ROWS different rows with a label, chosen by a hash of their order column.

    A null text has no terms.  Rows that repeat id, text and label count once."""
    schema = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("h", T.LongType())])
    known_label = labelled.filter(column(label).isNotNull()).select(column(label).cast("int").alias("label"), column(text).alias("text"), column(order).alias("o"))
    sample = hashed_sample(known_label, SAMPLE_ROWS, ["o"]).select("label", "text", F.xxhash64("o", "text", "label").alias("h")).dropDuplicates(["h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([term_buckets(x, known) for x in texts(batch)], pa.list_(pa.int32())), batch.column("h")], names=schema.names)

    # A row is bounded by its distinct terms, the rows by the sample; each task's come to the driver by themselves.
    rows = sample.mapInArrow(handing_back(run), schema).toArrow().sort_by("h")
    flat, size = pc.list_flatten(rows.column("ids")).to_numpy(), pc.list_value_length(rows.column("ids")).to_numpy()
    return fit(flat, size.astype(np.int64), rows.column("label").to_numpy().astype(float))


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """keep columns, score (0 to 1, higher: more likely toxic) and predicted (1 from 0.5 on).

    Null, empty and term-less texts get the score of the bias.  Repeated rows each get theirs; keep must not name score or
    predicted (ValueError); other columns are not read."""
    if clash := {"score", "predicted"} & {c.lower() for c in keep}:
        raise ValueError(f"columns {sorted(clash)} are made by this operator")
    source = docs.select(*(column(c) for c in dict.fromkeys([*keep, text])))
    schema = T.StructType([*(source.schema[c] for c in keep), T.StructField("score", T.DoubleType(), False), T.StructField("predicted", T.IntegerType(), False)])
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.w, model.v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        own = Model(*shared.value)
        for batch in pieces(batches, 512):
            ids = [term_buckets(x, known) for x in texts(batch, text)]
            flat, size = np.array([b for x in ids for b in x], np.int64), np.array([len(x) for x in ids], np.int64)
            p = 1 / (1 + np.exp(-np.clip(raw_scores(own, flat, size), -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=schema.names)

    return map_batches(source, run, schema)
