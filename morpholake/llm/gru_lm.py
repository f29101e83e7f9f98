"""Gated recurrent language model in numpy, over words, with a class-factored softmax.

Spark counts every word of the training documents (tasks pre-add, the shuffle adds up).  The model knows the VOCABULARY
most frequent words, an end and a rest symbol; log p(word) = log p(class | state) + log p(word | class, state), and a word
of the rest is spread by its count: p(rest | state) * (c + 0.1) / (mass of the rest).  So every word has a probability, and
the probabilities of all words and one unseen add up to one.

The model is trained on every row, whole, by truncated backpropagation through WINDOW steps, states carried on to the end
of each text.  Texts are written once as symbols, by the round of their id's hash; in a round each task goes on from the
same network over its share of that round's, and the networks, weighted by the symbols that they learned from, are averaged
chunk by chunk for the next round.  Scoring packs the documents of a task into LANES lanes; a lane's state
runs on across windows to the document's end, so each log-likelihood is of the complete text.  Counts of the HEAD most
frequent words are broadcast; other words leave the task as (row, word, n) and meet their counts in a join, the only
shuffle that grows.  A word of over KEY_BYTES goes by its SHA-256, so that the head is bounded in bytes whatever its words.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, free_name, handing_back, map_batches, materialize, new_path

CLASSES = 32
VOCABULARY = CLASSES * CLASSES - 2
HIDDEN = 16
WINDOW = 32
LANES = 128
#: Symbols that are scored at once, so that their states stay in a core's cache.
BLOCK = 16_384
#: Bounds of the rounds among 16 shares of the rows: the first are short, so that tasks do not drift apart from the start.
ROUNDS = (0, 1, 4, 8, 16)
TRAIN_LANES = 128
CHUNK = 1024
RATE = 0.01
#: No exponent goes beyond; its exponential and their sums fit a float.
MOST = np.float32(60)
HEAD = 200_000
KEY_BYTES = 64
POOL_TOKENS = 3_000_000
#: Bytes of text that are split into words at once.
SLAB_BYTES = 4 << 20
ALPHA = 0.1


def tokens(text: str) -> list[bytes]:
    """Words between ASCII gaps, A-Z lower-cased; a long word's key stands for it.  all_tokens() gives the same, many texts at once."""
    words = text.encode().lower().split()
    if words and max(map(len, words)) > KEY_BYTES:
        words = [w if len(w) <= KEY_BYTES else b"\0" + hashlib.sha256(w).digest() for w in words]
    return words


def slabs(batches: Iterable[pa.RecordBatch], name: str, most: int = SLAB_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many bytes of text, or of one row."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(size):
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def all_tokens(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(tokens() of all texts one after another, binary; where each text's begin and, last, where all end); null is empty."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    flat = split.flatten().cast(pa.binary())
    size = pc.binary_length(flat).to_numpy(zero_copy_only=False)
    real = size > 0  # a gap at an end of a text leaves an empty word
    at = np.concatenate([[0], np.cumsum(real)])[split.offsets.to_numpy()]
    if not real.all():
        flat = flat.filter(pa.array(real))
    if (long := size[real] > KEY_BYTES).any():
        keys = [b"\0" + hashlib.sha256(w.as_py()).digest() for w in flat.filter(pa.array(long))]
        flat = pc.replace_with_mask(flat, pa.array(long), pa.array(keys, pa.binary()))
    return flat, at


def places(words: pa.Array, known: pa.Array) -> np.ndarray:
    """The place of each word among the known ones, or -1."""
    return pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False)


# ---- counts


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word binary, c): every word of all texts, without the end."""
    schema = T.StructType([T.StructField("word", T.BinaryType(), False), T.StructField("c", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slabs(batches, "text", 3 * SLAB_BYTES):
            found = pc.value_counts(all_tokens(some.column("text"))[0])
            counted = pa.RecordBatch.from_arrays([found.field(0), found.field(1)], names=schema.names)
            for at in range(0, len(counted), 50_000):
                yield counted.slice(at, 50_000)

    return docs.select(column(text).alias("text")).mapInArrow(handing_back(run), schema).groupBy("word").agg(F.sum("c").alias("c"))


# ---- the network


@dataclass
class Network:
    """x: input columns of all symbols (already times the input weights), u: state weights, wc and wo: class and word outputs.

    The last axis of every array that runs through the network is that of lanes or positions, so that gates are whole
    blocks of memory and softmax adds up whole rows."""

    x: np.ndarray
    u: np.ndarray
    wc: np.ndarray
    bc: np.ndarray
    wo: np.ndarray
    bo: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.x, self.u, self.wc, self.bc, self.wo, self.bo]


def new_network(seed: int = 7) -> Network:
    rng, n = np.random.default_rng(seed), CLASSES * CLASSES
    r = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    return Network(r(3 * HIDDEN, n), r(3 * HIDDEN, HIDDEN), r(CLASSES, HIDDEN), np.zeros((CLASSES, 1), np.float32), r(CLASSES, CLASSES, HIDDEN), np.zeros((CLASSES, CLASSES, 1), np.float32))


#: Gates are taken at half their input: sigmoid(x) = tanh(x / 2) / 2 + 1 / 2, which cannot overflow.
HALF = np.repeat(np.float32([0.5, 0.5, 1]), HIDDEN)[:, None]


def halved_columns(net: Network) -> np.ndarray:
    """The input columns as steps() takes them, a row for each symbol."""
    return np.ascontiguousarray((net.x * HALF).T)


def steps(net: Network, columns: np.ndarray, seen: np.ndarray, h: np.ndarray, end: int, gates: Iterable, parts: Iterable, cand: Iterable, states: np.ndarray) -> np.ndarray:
    """The state after the GRU has seen these symbols (steps, lanes); a state starts anew where an end was seen.

    Each step fills its item of gates (update and reset), parts (state parts of the gates, halved, and of the candidate),
    cand (candidates) and states."""
    u, two, half = net.u * HALF, 2 * HIDDEN, np.float32(0.5)
    starts = seen == end
    goes = np.logical_not(starts).astype(np.float32)
    x_in = np.ascontiguousarray(np.take(columns, seen, axis=0).transpose(0, 2, 1))
    for some, on, xg, xc, zr, a, c, new in zip(starts.any(axis=1).tolist(), goes, x_in[:, :two], x_in[:, two:], gates, parts, cand, states, strict=False):
        if some:
            h = h * on
        np.dot(u, h, out=a)
        np.add(xg, a[:two], out=zr)
        np.tanh(zr, out=zr)
        zr *= half
        zr += half
        np.multiply(zr[HIDDEN:], a[two:], out=c)
        c += xc
        np.tanh(c, out=c)
        np.subtract(c, h, out=new)
        new *= zr[:HIDDEN]
        new += h
        h = new
    return h


def log_softmax_at(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Over the first axis, of one row (at) a column; x is changed.

    No maximum is taken off: states lie between -1 and 1, and MOST bounds the rest."""
    np.minimum(x, MOST, out=x)
    own = x[at, np.arange(len(at))]
    np.exp(x, out=x)
    own -= np.log(x.sum(axis=0))
    return own


def log_probabilities(net: Network, h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log p of each target symbol given its state (a column of h): its class, then it among its class."""
    order = np.argsort(target.astype(np.int16), kind="stable")
    kind, member = np.divmod(target[order], CLASSES)
    own = np.ones((HIDDEN + 1, len(order)), np.float32)  # the row of ones stands for the biases
    np.take(h, order, axis=1, out=own[:HIDDEN], mode="clip")
    log_p = log_softmax_at(np.hstack([net.wc, net.bc]) @ own, kind)
    words = np.concatenate([net.wo, net.bo], axis=2)
    cut = np.searchsorted(kind, np.arange(CLASSES + 1)).tolist()
    for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
        if a < b:
            log_p[a:b] += log_softmax_at(words[k] @ own[:, a:b], member[a:b])
    out = np.empty_like(log_p)
    out[order] = log_p
    return out


def keep_heap() -> None:
    """Lets the C library keep what windows free: once a block of this size was freed, smaller ones stay in its heap.

    Else each window's arrays go back to the system and are faulted in again, a quarter of the training's CPU time."""
    np.empty(1 << 24, np.uint8)


def network_of(flat: np.ndarray) -> Network:
    """The network whose parts are views of a flat array."""
    out, at = [], 0
    for p in new_network().parts():
        out.append(flat[at : at + p.size].reshape(p.shape))
        at += p.size
    return Network(*out)


def new_state(seed: int = 7) -> np.ndarray:
    """What training carries on, flat: parameters, their first and second moments, and the number of steps."""
    p = np.concatenate([x.ravel() for x in new_network(seed).parts()])
    return np.concatenate([p, np.zeros(2 * len(p) + 1, np.float32)])


def windows(docs: Iterable[np.ndarray], lanes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(lanes that go on, block of steps by those lanes): where a text ends, its lane takes up the next one.

    A block has WINDOW steps, and more of them once lanes are idle, so that the end of a long text costs no more steps of
    the optimizer than any other symbols.  Every symbol of docs is in one block.  Once no text is left, -1 fills up a
    lane, and it does not go on."""
    coming = iter(docs)
    held = [np.zeros(0, np.int16)] * lanes
    while True:
        # While there are texts, every lane is filled up, several windows at once, and goes on.
        block = np.empty((lanes, WINDOW), np.int16)
        for k, x in enumerate(held):
            if len(x) < WINDOW:
                parts, n = [x], len(x)
                while n < 4 * WINDOW and (new := next(coming, None)) is not None:
                    parts.append(new)
                    n += len(new)
                held[k] = x = np.concatenate(parts)
                if n < WINDOW:
                    break
            block[k] = x[:WINDOW]
        else:
            held = [x[WINDOW:] for x in held]
            yield np.ones(lanes, bool), np.ascontiguousarray(block.T)
            continue
        break
    while True:
        live = np.array([len(x) > 0 for x in held], bool)
        held = [x for x in held if len(x)]
        if not held:
            return
        steps = min(max(map(len, held)), WINDOW * (lanes // len(held)))
        block = np.full((len(held), steps), -1, np.int16)
        for k, x in enumerate(held):
            block[k, : len(x)] = x[:steps]
            held[k] = x[steps:]
        yield live, np.ascontiguousarray(block.T)


def learn(state: np.ndarray, docs: Iterable[np.ndarray], end: int, lanes: int = TRAIN_LANES) -> int:
    """One pass of truncated backpropagation with Adam over docs (symbols of each text with its end); changes state.

    Returns the number of symbols learned from, which is that of all docs."""
    keep_heap()
    n = len(state) // 3
    p, m, v = state[:n], state[n : 2 * n], state[2 * n : 3 * n]
    g, move = np.empty_like(p), np.empty_like(p)
    net, grads = network_of(p), network_of(g)
    h, last, t, learned = np.zeros((HIDDEN, lanes), np.float32), np.full(lanes, end, np.int16), int(state[-1]), 0
    for live, block in windows(docs, lanes):
        if not live.all():
            h, last = h[:, live], last[live]
        seen = np.vstack([last[None], block[:-1]])
        last = block[-1]
        g[:] = 0
        h = _window(net, grads, seen, block, h, end)
        learned += int((block >= 0).sum())
        t += 1
        # Every symbol weighs the same, also where few lanes are left.
        g *= np.float32(16 / (WINDOW * lanes))
        np.clip(g, -1, 1, out=g)
        m *= np.float32(0.9)
        np.multiply(g, np.float32(0.1), out=move)
        m += move
        g *= g
        g *= np.float32(0.001)
        v *= np.float32(0.999)
        v += g
        np.sqrt(v, out=move)
        move += np.float32(1e-6)
        np.divide(m, move, out=move)
        move *= np.float32(RATE * (1 - 0.999**t) ** 0.5 / (1 - 0.9**t))
        p -= move
    state[-1] = t
    return learned


def _softmax(x: np.ndarray) -> np.ndarray:
    np.minimum(x, MOST, out=x)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    return x


def _window(net: Network, g: Network, seen: np.ndarray, wanted: np.ndarray, h: np.ndarray, end: int) -> np.ndarray:
    """The states after one window that begins with h; gradients of its summed loss are added to g (zeros).

    seen, wanted: (steps, lanes).  A state starts anew where an end was seen; a wanted symbol under 0 is none."""
    n, lanes = seen.shape
    goes = np.not_equal(seen, end).astype(np.float32)
    some = (seen == end).any(axis=1).tolist()
    made = lambda *rows: np.empty((n, *rows, lanes), np.float32)
    gates, parts, c, states = made(2 * HIDDEN), made(3 * HIDDEN), made(HIDDEN), made(HIDDEN)
    last = steps(net, halved_columns(net), seen, h, end, gates, parts, c, states)
    before = np.concatenate([h[None], states[:-1]])
    before *= goes[:, None]
    # Losses and their gradients, the positions in order of their symbols; a row of ones stands for the biases.
    target = wanted.reshape(-1)
    order = np.argsort(target, kind="stable")
    order = order[np.searchsorted(target[order], 0) :]
    target = target[order].astype(np.int64)
    kind, member, rows = target // CLASSES, target % CLASSES, np.arange(len(target))
    flat = np.ones((HIDDEN + 1, len(target)), np.float32)
    np.take(by_rows(states), order, axis=1, out=flat[:HIDDEN], mode="clip")
    pc = _softmax(np.hstack([net.wc, net.bc]) @ flat)
    pc[kind, rows] -= 1
    both = pc @ flat.T
    g.wc[:], g.bc[:] = both[:, :HIDDEN], both[:, HIDDEN:]
    d_flat = np.zeros((HIDDEN, len(target) + 1), np.float32)  # its last column is that of positions without a loss
    np.dot(net.wc.T, pc, out=(d_own := np.empty((HIDDEN, len(target)), np.float32)))
    words = np.concatenate([net.wo, net.bo], axis=2)
    both = np.zeros_like(words)
    cut = np.searchsorted(kind, np.arange(CLASSES + 1)).tolist()
    for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
        if a == b:
            continue
        own = flat[:, a:b]
        pw = _softmax(np.dot(words[k], own))
        pw[member[a:b], rows[: b - a]] -= 1
        np.dot(pw, own.T, out=both[k])
        d_own[:, a:b] += np.dot(net.wo[k].T, pw)
    g.wo[:], g.bo[:] = both[:, :, :HIDDEN], both[:, :, HIDDEN:]
    d_flat[:, :-1] = d_own
    place = np.full(n * lanes, len(target))
    place[order] = rows
    dh = np.take(d_flat, place, axis=1).reshape(HIDDEN, n, lanes).transpose(1, 0, 2)
    # Back through the steps.  grown: gradients of the reset gate, the candidate's state part, the update gate, the candidate.
    z, r, p = gates[:, :HIDDEN], gates[:, HIDDEN:], parts[:, 2 * HIDDEN :]
    grown, first, second = made(4, HIDDEN), made(2, HIDDEN), made(2, HIDDEN)
    stay = 1 - z
    np.multiply(c - before, z * stay, out=first[:, 0])
    np.multiply(z, 1 - c * c, out=first[:, 1])
    np.multiply(p, r * (1 - r), out=second[:, 0])
    second[:, 1] = r
    back = np.ascontiguousarray(np.roll(net.u, -HIDDEN, axis=0).T)
    carry = np.zeros((HIDDEN, lanes), np.float32)
    for k in range(n - 1, -1, -1):
        d, own = dh[k] + carry, grown[k]
        np.multiply(d, first[k], out=own[2:])
        np.multiply(own[3], second[k], out=own[:2])
        d *= stay[k]
        d += np.dot(back, own[:3].reshape(3 * HIDDEN, lanes))
        carry = d * goes[k] if some[k] else d
    laid = np.empty((4, HIDDEN, n, lanes), np.float32)  # update, reset, the candidate's state part, the candidate
    for k, at in enumerate((2, 0, 1, 3)):
        laid[k] = grown[:, at].transpose(1, 0, 2)
    laid = laid.reshape(4 * HIDDEN, -1)
    np.dot(laid[: 3 * HIDDEN], by_rows(before).T, out=g.u)
    who = seen.reshape(-1)
    order = np.argsort(who, kind="stable")
    order = order[np.searchsorted(who[order], 0) :]  # a lane that has ended sees -1
    sorted_who = who[order]
    new = np.flatnonzero(np.diff(sorted_who, prepend=-2))
    dx = np.empty((3 * HIDDEN, len(order)), np.float32)
    np.take(laid[: 2 * HIDDEN], order, axis=1, out=dx[: 2 * HIDDEN], mode="clip")
    np.take(laid[3 * HIDDEN :], order, axis=1, out=dx[2 * HIDDEN :], mode="clip")
    g.x[:, sorted_who[new]] = np.add.reduceat(dx, new, axis=1)
    return last


def by_rows(x: np.ndarray) -> np.ndarray:
    """(steps, rows, lanes) as (rows, steps by lanes)."""
    return x.transpose(1, 0, 2).reshape(x.shape[1], -1)


def score_documents(net: Network, docs: list[np.ndarray], end: int) -> np.ndarray:
    """Natural log-likelihood of each document (symbols, the end included), states carried through the whole of it.

    Documents are laid one after another into lanes, the longest first into the emptiest lane."""
    if not docs:
        return np.zeros(0)
    keep_heap()
    size = np.array([len(d) for d in docs])
    lanes = min(LANES, len(docs))
    lane_docs: list[list[int]] = [[] for _ in range(lanes)]
    heap = [(0, k) for k in range(lanes)]
    for i in np.argsort(-size, kind="stable").tolist():
        n, k = heap[0]
        lane_docs[k].append(i)
        heapq.heapreplace(heap, (n + int(size[i]), k))
    load = [int(size[own].sum()) for own in lane_docs]
    by_load = sorted(range(lanes), key=lambda k: -load[k])
    flows = [np.concatenate([docs[i] for i in lane_docs[k]]) for k in by_load]
    owner = [np.repeat(lane_docs[k], size[lane_docs[k]]) for k in by_load]
    length = np.array([len(f) for f in flows])
    out = np.zeros(len(docs))
    h, last = np.zeros((HIDDEN, lanes), np.float32), np.full(lanes, end)
    span = max(1, BLOCK // lanes)
    columns = halved_columns(net)
    for at in range(0, int(length[0]), span):
        live = int(np.searchsorted(-length, -at, side="left"))  # lanes that go on, all in front
        h, last = h[:, :live], last[:live]
        n = min(span, int(length[0]) - at)
        block, who = np.full((live, n), -1, np.int64), np.zeros((live, n), np.int64)
        for k in range(live):
            part = flows[k][at : at + n]
            block[k, : len(part)] = part
            who[k, : len(part)] = owner[k][at : at + n]
        block = np.ascontiguousarray(block.T)
        seen = np.vstack([last[None], block[:-1]])
        seen[seen < 0] = end
        last = block[-1]
        states = np.empty((n, HIDDEN, live), np.float32)
        gates, parts, cand = (repeat(np.empty((k * HIDDEN, live), np.float32)) for k in (2, 3, 1))
        h = steps(net, columns, seen, h, end, gates, parts, cand, states)
        target = block.reshape(-1)
        real = np.flatnonzero(target >= 0)
        logp = log_probabilities(net, np.take(by_rows(states), real, axis=1), target[real])
        out += np.bincount(who.T.reshape(-1)[real], logp, len(docs))
    return out


# ---- scoring on Spark


@dataclass
class Model:
    net: Network
    symbols: dict[bytes, int]  # words of the vocabulary
    end: int
    rest: int
    rest_mass: float
    head: dict[bytes, int]  # counts of frequent words
    total: int  # training tokens, ends included
    distinct: int
    ends: int
    learned: int  # symbols that the network learned from, each pass counted


def frequent(counts: DataFrame) -> DataFrame:
    """The words that occur at least so often that at most HEAD words do.

    Counts fall into steps of a sixteenth of a doubling; the steps' sizes (under a thousand rows) tell where to cut, so no
    task sorts or gathers more than the head."""
    placed = counts.withColumn("step", F.floor(F.log2("c") * 16))
    steps = placed.groupBy("step").agg(F.count("*").alias("n")).collect()
    cut, held = 1 << 30, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        held += r["n"]
        if held > HEAD:
            break
        cut = r["step"]
    return placed.filter(F.col("step") >= cut).select("word", "c")


def with_ends(symbols: np.ndarray, at: np.ndarray, rest: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols as int16, an end after each text's and -1 as the rest; where each text's end)."""
    n = len(at) - 1
    ends = at[1:] + np.arange(1, n + 1)
    out = np.empty(len(symbols) + n, np.int16)
    inner = np.ones(len(out), bool)
    inner[ends - 1] = False
    out[inner] = np.where(symbols < 0, rest, symbols)
    out[ends - 1] = end
    return out, ends


def written_symbols(docs: DataFrame, symbols: dict[bytes, int], end: int, rest: int, text: str, order: str) -> list[DataFrame]:
    """A table of the texts as symbols (int16, the end included) for each round, from one scan."""
    share = F.pmod(F.xxhash64(column(order)), F.lit(ROUNDS[-1]))
    turn = F.coalesce(*(F.when(share < high, k) for k, high in enumerate(ROUNDS[1:])))
    schema = T.StructType([T.StructField("turn", T.IntegerType(), False), T.StructField("s", T.BinaryType(), False)])
    shared = docs.sparkSession.sparkContext.broadcast(symbols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(list(shared.value), pa.binary())
        for some in slabs(batches, "text"):
            words, at = all_tokens(some.column("text"))
            coded, ends = with_ends(places(words, known), at, rest, end)
            for low in range(0, len(ends), 1024):
                own = ends[low : low + 1024]
                start = int(ends[low - 1]) if low else 0
                where = np.append(0, own - start) * coded.itemsize
                x = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(where.astype(np.int32)), pa.py_buffer(coded[start : own[-1]])])
                yield pa.RecordBatch.from_arrays([some.column("turn").slice(low, len(own)), x], names=schema.names)

    path = new_path(docs.sparkSession, "symbols")
    map_batches(docs.select(turn.alias("turn"), column(text).alias("text")), run, schema).write.partitionBy("turn").parquet(path)
    rows = docs.sparkSession.read.schema("s binary, turn int").parquet(path)
    return [rows.filter(F.col("turn") == k).select("s") for k in range(len(ROUNDS) - 1)]


def learn_round(rows: DataFrame, state: np.ndarray, end: int, lanes: int) -> tuple[np.ndarray, int]:
    """(state after learning from all rows of symbols, how many it learned from).

    Each task goes over its own rows; the sums of its chunks meet at their number, so no task gathers whole states."""
    schema = T.StructType([T.StructField("chunk", T.IntegerType(), False), T.StructField("n", T.LongType(), False), T.StructField("x", T.BinaryType(), False)])
    shared = rows.sparkSession.sparkContext.broadcast(state)

    def batch(chunks: list[int], ns: list[int], xs: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array(ns, pa.int64()), pa.array(xs, pa.binary())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.copy()

        def coming() -> Iterator[np.ndarray]:
            for some in batches:
                for x in some.column(0):
                    yield np.frombuffer(x.as_py(), np.int16)

        if n := learn(own, coming(), end, lanes):
            cuts = range(0, len(own), CHUNK)
            yield batch(list(range(len(cuts))), [n] * len(cuts), [own[at : at + CHUNK].tobytes() for at in cuts])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for some in batches:
            for k, n, x in zip(*(some.column(c).to_pylist() for c in range(3)), strict=True):
                m, held = sums.get(k, (0, 0.0))
                sums[k] = (m + n, held + n * np.frombuffer(x, np.float32).astype(np.float64))
        if sums:
            yield batch(list(sums), [n for n, _ in sums.values()], [x.tobytes() for _, x in sums.values()])

    sums = rows.mapInArrow(handing_back(run), schema).repartition("chunk").mapInArrow(add, schema).toArrow().to_pylist()
    shared.unpersist()
    out, learned = state.copy(), 0
    for r in sums:
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["x"]) / r["n"]
        learned = r["n"]
    return out, learned


def train(docs: DataFrame, text: str = "text", order: str = "doc_id", counts: DataFrame | None = None, passes: int = 1) -> tuple[Model, DataFrame]:
    """(model, counts): counts is the written table of word_counts over docs, which score() joins.

    passes: how often all texts are gone over, whatever the size of the table."""
    counts = materialize(word_counts(docs, text), "word-counts") if counts is None else counts
    n_docs = docs.count()
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = int(sums["n"]) + n_docs, int(sums["v"]) + (n_docs > 0)
    top = frequent(counts).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    words, c = top.column("word").to_pylist(), top.column("c").to_pylist()
    head = dict(zip(words, c, strict=True))
    end, rest = VOCABULARY, VOCABULARY + 1
    # Classes of like frequency: rank r of a word is its symbol, CLASSES words of neighbouring rank make a class.
    symbols = {w: k for k, w in enumerate(words[:VOCABULARY])}
    known = sum(c[:VOCABULARY]) + n_docs
    mass = (total - known) + ALPHA * (distinct - len(symbols) - (n_docs > 0) + 1)
    lanes = max(1, min(TRAIN_LANES, total // 20_000))
    state, learned = new_state(), 0
    for rows in written_symbols(docs, symbols, end, rest, text, order) * passes:
        state, n = learn_round(rows, state, end, lanes)
        learned += n
    return Model(network_of(state[: len(state) // 3].copy()), symbols, end, rest, float(mass), head, total, distinct, n_docs, learned), counts


def opened_words(words: pa.Array, row: np.ndarray, missing: np.ndarray, n: int) -> pa.Array:
    """Of each of n rows, its missing words with how often it holds them."""
    own = words.filter(pa.array(missing)).dictionary_encode()
    v = max(1, len(own.dictionary))
    pairs, times = np.unique(row[missing] * v + own.indices.to_numpy(), return_counts=True)
    ends = np.append(0, np.cumsum(np.bincount(pairs // v, minlength=n)))
    both = pa.StructArray.from_arrays([own.dictionary.take(pa.array(pairs % v)), pa.array(times, pa.int64())], names=["w", "n"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), both)


def score(docs: DataFrame, model: Model, counts: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep columns, n_tokens, n_known, train_tokens, base_score, score (both log10), one row per row of docs.

    A null text is empty: one token, the end.  Without training documents every token is unknown.  Repeated rows each get
    their scores; an empty table gives an empty result.  keep must not name a made column (ValueError); other columns are
    not read, so names cannot clash."""
    made = [T.StructField("n_tokens", T.LongType(), False), T.StructField("n_known", T.LongType(), False), T.StructField("train_tokens", T.LongType(), False), T.StructField("base_score", T.DoubleType(), False), T.StructField("score", T.DoubleType(), False)]
    if clash := {f.name for f in made} & {k.lower() for k in keep}:
        raise ValueError(f"columns {sorted(clash)} are made by this operator")
    text_name, opened_name = free_name("_text", keep), free_name("_open", keep)
    source = docs.select(*map(column, keep), column(text).alias(text_name))
    open_words = T.ArrayType(T.StructType([T.StructField("w", T.BinaryType()), T.StructField("n", T.LongType())]))
    schema = T.StructType([*(source.schema[c] for c in keep), *made, T.StructField(opened_name, open_words)])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        scale = np.log10(m.total + ALPHA * (m.distinct + 1)) if m.total else np.log10(ALPHA)
        head, known = pa.array(list(m.head), pa.binary()), len(m.symbols)
        logs = np.log10(np.array([*m.head.values(), 0.0]) + ALPHA)
        rest_log = np.log10(m.rest_mass) if m.rest_mass > 0 else 0.0
        base_end = np.log10(m.ends + ALPHA) - scale
        held: list[tuple] = []
        pool: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            logp = score_documents(m.net, pool, m.end) / np.log(10)
            at = 0
            for cols, n_tokens, n_known, base, more, opened in held:
                k = len(n_tokens)
                made = [pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(np.full(k, m.total), pa.int64()), pa.array(base), pa.array(logp[at : at + k] + more)]
                whole = pa.RecordBatch.from_arrays([*cols, *made, opened], names=schema.names)
                for low in range(0, k, 512):
                    yield whole.slice(low, 512)
                at += k
            held.clear()
            pool.clear()

        pooled = 0
        for batch in slabs(batches, text_name):
            words, at = all_tokens(batch.column(text_name))
            n = np.diff(at)
            place, row = places(words, head), np.repeat(np.arange(len(n)), n)
            # Symbols are the first ranks of the head.
            coded, ends = with_ends(np.where(place < known, place, -1), at, m.rest, m.end)
            pool += np.split(coded, ends[:-1])
            found, beyond = place >= 0, place >= known
            headed = np.bincount(row[found], minlength=len(n))
            base = np.bincount(row[found], logs[place[found]], len(n)) - scale * headed + base_end
            more = np.bincount(row[beyond], logs[place[beyond]] - rest_log, len(n))
            held.append((batch.columns[: len(keep)], n + 1, headed + (m.ends > 0), base, more, opened_words(words, row, ~found, len(n))))
            pooled += len(coded)
            if pooled > POOL_TOKENS:
                yield from flush()
                pooled = 0
        yield from flush()

    return _close(map_batches(source, run, schema), counts, model, keep, opened_name)


def _close(first: DataFrame, counts: DataFrame, model: Model, keep: list[str], opened_name: str) -> DataFrame:
    """Adds what the words beyond the head contribute, by a join on the word."""
    row, key = free_name("_row", first.columns), free_name("_key", first.columns)
    rows = materialize(first.withColumn(row, F.monotonically_increasing_id()), "scored")
    scale = float(np.log10(model.total + ALPHA * (model.distinct + 1))) if model.total else float(np.log10(ALPHA))
    rest = float(np.log10(model.rest_mass)) if model.rest_mass > 0 else 0.0
    opened = rows.select(F.col(row).alias("row"), F.explode(opened_name).alias("o")).select("row", F.col("o.w").alias("w"), F.col("o.n").alias("n"))
    joined = opened.join(counts.withColumnRenamed("word", "_word"), F.col("w") == F.col("_word"), "left")
    log = F.log10(F.coalesce("c", F.lit(0)) + F.lit(ALPHA))
    parts = [free_name(f"_more_{c}", first.columns) for c in "kbs"]
    sums = F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)), F.sum(F.col("n") * (log - scale)), F.sum(F.col("n") * (log - rest))
    more = joined.groupBy(F.col("row").alias(key)).agg(*(x.alias(p) for x, p in zip(sums, parts, strict=True)))
    done = rows.drop(opened_name).join(more, F.col(row) == F.col(key), "left")
    k, b, s = map(F.col, parts)
    zero = F.lit(0.0)
    return done.select(*map(column, keep), "n_tokens", (F.col("n_known") + F.coalesce(k, F.lit(0))).alias("n_known"), "train_tokens", (F.col("base_score") + F.coalesce(b, zero)).alias("base_score"), (F.col("score") + F.coalesce(s, zero)).alias("score"))
