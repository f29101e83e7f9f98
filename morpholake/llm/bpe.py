"""Byte-level BPE by merge replay over the distinct words of a slice of the corpus.

A task takes the texts of a slice, splits them into words (matches of the split pattern) and lays the distinct
words end to end as one array of token ids.  An inverted index leads from each pair that can merge, by the rank of
what it makes, to the positions where it stands.  Ranks are replayed in order; a merge touches only the two
neighbouring pairs at each position.  Every occurrence of a word in the slice then takes the word's ids.

The slice is the limit of the replay: words of the whole corpus would have to be joined back to every occurrence, several
times the corpus through a shuffle, and give the same ids.  So a job is a scan, Python inside the task, and the output.
Memory is bounded by the slice (SLICE_BYTES of text, one document at least) and by a cache of about CACHE_BYTES of parts
that a task has met; ids are int32 arrays from end to end.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import column, map_batches, pieces, texts

SLICE_BYTES = 4_000_000
CACHE_BYTES = 24_000_000
#: What a cached part takes beside its characters: a string, a dictionary's entry, a number.
PART_BYTES = 150
SINGLE_SPACE = regex.compile(r"(?<=\S) (?=\S)")
LONG_WORD = 400
#: Split patterns under which a single space between other characters starts a match.
GAPPED = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",)


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: a line is the token in base 64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Ranks of tokens, and for each token what it makes with a token after it and with one before it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = [b""] * (max(ranks.values()) + 1)
        left, right, made = array("i"), array("i"), array("i")
        for t, r in ranks.items():
            self.token[r] = t
            for cut in range(1, len(t)):
                if (a := ranks.get(t[:cut])) is not None and (b := ranks.get(t[cut:])) is not None:
                    left.append(a)
                    right.append(b)
                    made.append(r)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, made = (np.frombuffer(x, np.int32) for x in (left, right, made))
        self.after, self.before = self._table(left, right, made), self._table(right, left, made)
        self.bytes_make = np.full((256, 256), -1, np.int32)
        for b in range(256):
            self.bytes_make[b] = self.made(self.after, int(self.byte_id[b]), self.byte_id)

    def _table(self, by: np.ndarray, other: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((other, by))
        return np.searchsorted(by[order], np.arange(len(self.token) + 1)), other[order], made[order]

    @staticmethod
    def made(table: tuple[np.ndarray, np.ndarray, np.ndarray], r: int, others: np.ndarray) -> np.ndarray:
        """Rank of what r makes with each of the others on the table's side, -1 if nothing."""
        starts, other, makes = table
        a, b = int(starts[r]), int(starts[r + 1])
        if a == b:
            return np.full(len(others), -1, np.int32)
        at = np.minimum(np.searchsorted(other[a:b], others), b - a - 1) + a
        return np.where(other[at] == others, makes[at], np.int32(-1))

    def pair_rank(self, a: int, b: int) -> int:
        return self.ranks.get(self.token[a] + self.token[b], -1)


@lru_cache(maxsize=2)
def load_vocabulary(path: str) -> Vocabulary:
    """One for all tasks of a Python worker."""
    return Vocabulary(load_ranks(path))


def gathered(flat: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of flat (run k ends at ends[k]) that rows name, end to end, and where each of them ends there."""
    starts = np.concatenate([[0], ends])[rows]
    size = ends[rows] - starts
    out = np.cumsum(size)
    return flat[np.repeat(starts - out + size, size) + np.arange(int(out[-1]) if len(out) else 0)], out


class Replay:
    """Encodes distinct words by replaying all merges over them at once."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words end to end, where each word's ids end).

        A word that is itself a token takes that token without any merge."""
        get = self.v.ranks.get
        whole = np.array([get(w, -1) for w in words], np.int32)
        size = np.array([len(w) for w in words], np.int64)
        count = np.minimum(size, 1)  # ids of each word
        long = {k: self._long(words[k]) for k in np.flatnonzero((whole < 0) & (size > LONG_WORD)).tolist()}
        rest = np.flatnonzero((whole < 0) & (size > 0) & (size <= LONG_WORD))
        ids, ends = self._merged([words[k] for k in rest.tolist()], size[rest])
        count[rest] = np.diff(ends, prepend=0)
        for k, x in long.items():
            count[k] = len(x)
        out_ends = np.cumsum(count)
        out = np.empty(int(out_ends[-1]) if len(words) else 0, np.int32)
        single = whole >= 0
        out[out_ends[single] - 1] = whole[single]
        out[np.repeat(out_ends[rest] - ends, count[rest]) + np.arange(len(ids))] = ids
        for k, x in long.items():
            out[out_ends[k] - len(x) : out_ends[k]] = x
        return out, out_ends

    def _merged(self, words: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        v = self.v
        ends = np.cumsum(size)
        n, starts = int(ends[-1]), ends - size
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        raw = np.frombuffer(b"".join(words), np.uint8)
        ids = v.byte_id[raw]
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        nxt[ends - 1] = prv[starts] = -1
        now = np.full(n, -1, np.int32)  # rank of the pair that starts at a position
        left = np.flatnonzero(nxt >= 0).astype(np.int32)
        index: dict[int, list[np.ndarray]] = {}  # the inverted index: rank of a pair -> positions of its left parts
        heap: list[int] = []

        def enter(at: np.ndarray, rank: np.ndarray) -> None:
            now[at] = rank
            can = rank >= 0
            at, rank = at[can], rank[can]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = (np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist()
            for a, b in zip([0, *cut], [*cut, len(at)], strict=True):
                if (r := int(rank[a])) in index:
                    index[r].append(at[a:b])
                else:
                    index[r] = [at[a:b]]
                    heapq.heappush(heap, r)

        def merge(i: np.ndarray, r: int) -> None:
            """Merges the pairs that start at i, one in a word at most."""
            j = nxt[i]
            k, h = nxt[j], prv[i]
            ids[i], ids[j], now[j], now[i], nxt[i] = r, -1, -1, -1, k
            more = k >= 0
            i, k = i[more], k[more]
            prv[k] = i
            if len(i):
                enter(i, v.made(v.after, r, ids[k]))
            h = h[h >= 0]
            if len(h):
                enter(h, v.made(v.before, r, ids[h]))

        enter(left, v.bytes_make[raw[left], raw[left + 1]])
        del raw
        while heap:
            r = heapq.heappop(heap)
            todo = index.pop(r)
            at = np.unique(np.concatenate(todo)) if len(todo) > 1 else np.sort(todo[0])
            at = at[now[at] == r]
            # Of each word the first position merges; its others wait, as the merge can bring a lower rank or take a part of theirs.
            first = np.ones(len(at), bool)
            first[1:] = word[at[1:]] != word[at[:-1]]
            if not first.all():
                index[r] = [at[~first]]
                heapq.heappush(heap, r)
            if len(at):
                merge(at[first], r)
        stay = np.flatnonzero(ids >= 0)
        return ids[stay], np.searchsorted(stay, ends)

    def _long(self, w: bytes) -> list[int]:
        """The same replay over one very long word, whose positions would otherwise merge one by one."""
        rank = self.v.pair_rank
        ids, nxt, prv = self.v.byte_id[np.frombuffer(w, np.uint8)].tolist(), [*range(1, len(w)), -1], [*range(-1, len(w) - 1)]
        heap = [(r, i) for i in range(len(w) - 1) if (r := rank(ids[i], ids[i + 1])) >= 0]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or (j := nxt[i]) < 0 or rank(ids[i], ids[j]) != r:
                continue
            ids[i], ids[j] = r, -1
            nxt[i], h = nxt[j], prv[i]
            if (k := nxt[i]) >= 0:
                prv[k] = i
                if (x := rank(r, ids[k])) >= 0:
                    heapq.heappush(heap, (x, i))
            if h >= 0 and (x := rank(ids[h], r)) >= 0:
                heapq.heappush(heap, (x, h))
        return [x for x in ids if x >= 0]

    def decode(self, ids: Iterable[int]) -> bytes:
        token = self.v.token
        return b"".join([token[i] for i in ids])


class _Numbers(dict[str, int]):
    """Numbers of parts; an unknown one is noted in `new`, with what stands before it, and gets the next number.

    A part that a space more stands beside is not numbered but sets `gap`."""

    def __init__(self, new: list[str], before: str, any_part: bool = False):
        super().__init__()
        self.new, self.before, self.any_part, self.gap = new, before, any_part, False

    def __missing__(self, part: str) -> int:
        if not self.any_part and (not part or part[0].isspace() or part[-1].isspace()):
            self.gap = True
            return -1
        self[part] = n = len(self.new)
        self.new.append(self.before + part)
        return n


class Encoder:
    """Encodes texts slice by slice.

    A single space between two other characters always starts a new match of the split pattern, so a text is first
    cut there (when GAPPED says that the pattern allows it) and the pattern runs once for each distinct part."""

    def __init__(self, path: str, pattern: str):
        self.replay, self.pattern = Replay(load_vocabulary(path)), regex.compile(pattern)
        self.gapped = pattern in GAPPED
        self._forget()

    def _forget(self) -> None:
        self.parts: list[str] = []  # emptied of texts once these have ids
        self.first, self.later = _Numbers(self.parts, "", not self.gapped), _Numbers(self.parts, " ")
        # Parts at the ends of texts with other gaps: only there may white space begin or end a part.
        self.odd_first, self.odd_later = _Numbers(self.parts, "", True), _Numbers(self.parts, " ", True)
        self.flat, self.ends, self.held = np.zeros(0, np.int32), np.zeros(0, np.int64), 0

    def _numbers(self, x: str) -> list[int]:
        if not self.gapped:
            return [self.first[x]]
        first, later = self.first, self.later
        parts = x.split(" ")
        out = [first[parts[0]], *[later[p] for p in parts[1:]]]
        if first.gap or later.gap:
            first.gap = later.gap = False
            parts = SINGLE_SPACE.split(x)
            out = [self.odd_first[parts[0]], *[self.odd_later[p] for p in parts[1:]]]
        return out

    def encode(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, where each text's ids end)."""
        if self.held > CACHE_BYTES:
            self._forget()
        at = len(self.ends)
        rows = [np.array(self._numbers(x), np.int32) for x in docs]
        split = self.pattern.findall
        word: dict[str, int] = {}
        of, count = array("i"), array("i")
        for k in range(at, len(self.parts)):
            own = split(self.parts[k])
            of.extend([word.setdefault(w, len(word)) for w in own])
            count.append(len(own))
            self.held += PART_BYTES + len(self.parts[k])
            self.parts[k] = ""
        flat, ends = self.replay.encode([w.encode() for w in word])
        del word
        flat, ends = gathered(flat, ends, np.frombuffer(of, np.int32) if of else np.zeros(0, np.int32))
        of_part = np.concatenate([[0], ends])[np.cumsum(np.frombuffer(count, np.int32))] if count else np.zeros(0, np.int64)
        self.ends = np.concatenate([self.ends, of_part + len(self.flat)])
        self.flat = np.concatenate([self.flat, flat])
        size = np.array([len(r) for r in rows], np.int64)
        ids, ends = gathered(self.flat, self.ends, np.concatenate(rows) if rows else np.zeros(0, np.int32))
        return ids, np.concatenate([[0], ends])[np.cumsum(size)]


def _slices(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """Batches of about SLICE_BYTES of text, one row at least."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, side="right")))
            yield batch.slice(at, to - at)
            at = to


def encode_documents(docs: DataFrame, path: str, pattern: str, keep: list[str], text: str = "text", made: tuple[str, ...] = ("n_tokens", "ids")) -> DataFrame:
    """keep columns of docs and those asked for in made: n_tokens, ids, ids_sha256, decoded_sha256 (of the decoded bytes).

    path: the .tiktoken file, at the same place on every executor.  pattern: the split pattern (regex syntax).
    A null text counts as empty: no ids, n_tokens 0.  Repeated rows stay, each with its own result.  An empty table
    gives an empty result.  Columns of docs other than keep and text are not read, so clashing names cannot matter;
    keep must not name what made names (ValueError)."""
    kinds = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType(), False), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    if clash := set(made) & {c.lower() for c in keep}:
        raise ValueError(f"columns {sorted(clash)} are made by this operator")
    source = docs.select(*(column(c) for c in dict.fromkeys([*keep, text])))
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField(c, kinds[c], False) for c in made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        decimal = [str(i) for i in range(len(encoder.replay.v.token))] if "ids_sha256" in made else []
        digest = lambda x: hashlib.sha256(x).hexdigest()
        for batch in _slices(batches, text):
            flat, ends = encoder.encode(texts(batch, text))
            cuts = [0, *ends.tolist()]
            cols = [batch.column(c) for c in keep]
            for c in made:
                if c == "n_tokens":
                    cols.append(pa.array(np.diff(cuts), pa.int64()))
                elif c == "ids":
                    cols.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat)))
                else:
                    each = (flat[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False))
                    bytes_of = encoder.replay.decode if c == "decoded_sha256" else lambda x: ",".join([decimal[i] for i in x]).encode()
                    cols.append(pa.array([digest(bytes_of(x)) for x in each], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return map_batches(source, run, schema)


def decode_documents(encoded: DataFrame, path: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """keep columns and text: the ids' bytes as UTF-8 (undecodable bytes become U+FFFD).  Null ids give null."""
    source = encoded.select(*(column(c) for c in dict.fromkeys([*keep, ids])))
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = load_vocabulary(path).token
        for batch in pieces(batches):
            out = [None if x is None else b"".join([token[i] for i in x]).decode("utf-8", "replace") for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.string())], names=schema.names)

    return map_batches(source, run, schema)
