"""Tokens of documents, packed into sequences of a fixed size by bulk-synchronous best fit.

Only documents longer than a sequence are cut.  Pieces are packed by falling length, a class of lengths after the other:

1. pieces of the class and the gaps of open sequences are range-sorted together by size;
2. each partition sweeps its range once: a piece takes the smallest gap so far that is not yet taken (the successor of its
   length), so that gaps nest like brackets; pieces and gaps left over are numbered;
3. from the number of these in each partition alone, a plan tells which run of pieces meets which run of gaps of the ranges
   before: conflicts over a gap go by rank, and two equi-joins carry the plan out;
4. gaps shrink by what they took, and sweeps repeat while a gap can take a piece of the class; pieces without a gap open
   new sequences, filled with neighbours of the same length class by rank.

Rounds depend on the size of a sequence alone, not on the number of documents; what reaches the driver is a row per partition.
Every round is written to the shared folder, so a lost executor costs a round at most.

Null and empty texts are one end token; repeated rows are packed each for itself; an empty table gives none; any further
columns are ignored.  A text's own spelling of a special token is ordinary text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from .common import column, map_batches, materialize, pieces

SIZE = 2048
END = 0
#: Memory of a task's known words: ids and strings, about.
CACHE_BYTES = 96_000_000
#: Rows of a partition of a sweep, on average; there are as many partitions as the session's shuffles have at most.
PART_ROWS = 20_000
#: Texts whose words are looked up together.
BATCH_ROWS = 1024
#: Between words that are encoded together: a sign that is one id and stands in hardly any text.
MARK = "\x02"
BETWEEN = f" {MARK} "
WORD_END = "</w>"
SIMPLE = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch

Segment = tuple[int, int, int, int, int]


class WordIds:
    """Ids of texts by way of their distinct words.

    A text is cut at the spaces and line feeds that the tokenizer drops anyway: none of its rules reaches over one.  Words not
    met before are encoded many at once, in one text with MARK between them, whose only id then parts them again.  Words of
    lower-case Latin letters alone are what the tokenizer's rules leave as they are: they skip these, and end at a word's end."""

    def __init__(self, path: str):
        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[k for w, k in vocabulary.items() if w.endswith(WORD_END)]] = True
        (self.mark,) = self._ids(MARK)
        self._forget()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.bytes = self.size = 0
        self.flat, self.ends = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)  # ends[0] = 0: where the first word begins

    def _keep(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        n, size = len(self.known), self.size + len(ids)
        for name, need in (("flat", size), ("ends", n + len(words) + 1)):
            old = getattr(self, name)
            if need > len(old):
                setattr(self, name, np.concatenate([old, np.zeros(max(need - len(old), len(old)), old.dtype)]))
        self.flat[self.size : size] = ids
        self.ends[n + 1 : n + 1 + len(words)] = self.size + ends
        self.known.update(zip(words, range(n, n + len(words)), strict=True))
        self.size = size

    def _learn(self, words: list[str]) -> None:
        known = self.known
        fresh = [w for w in words if w not in known]
        simple = [w for w in fresh if SIMPLE(w)]
        fresh = [w for w in fresh if not SIMPLE(w)]
        for at in range(0, len(simple), 8192):
            some = simple[at : at + 8192]
            found = np.array(self.plain.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            self._keep(some, found, np.flatnonzero(self.ends_word[found]) + 1)
            self.bytes += sum(map(len, some), 150 * len(some))
        for at in range(0, len(fresh), 8192):
            some = fresh[at : at + 8192]
            joined = BETWEEN.join(some)
            if joined.count(MARK) == len(some) - 1:
                found = np.array(self._ids(joined), np.uint32)
                marks = np.flatnonzero(found == self.mark)
                self._keep(some, np.delete(found, marks), np.append(marks - np.arange(len(marks)), len(found) - len(marks)))
            else:  # a text holds the mark itself
                ids = [self._ids(w) for w in some]
                self._keep(some, np.array([i for x in ids for i in x], np.uint32), np.cumsum([len(x) for x in ids]))
            self.bytes += 150 * len(some) + len(joined)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, where each text's ids end)."""
        if self.bytes > CACHE_BYTES:
            self._forget()
        split = pc.split_pattern(self._plain(pc.fill_null(texts, "")), " ")
        ends = split.offsets.to_numpy()[1:] - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn(words)
        number = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        use = number[coded.indices.to_numpy()]
        begin = self.ends[use]
        size = self.ends[use + 1] - begin
        out = np.concatenate([[0], np.cumsum(size)])
        at = np.ones(out[-1], np.int32)  # one on from the id before, but for words' first ids
        some = size > 0
        first, last = begin[some], begin[some] + size[some] - 1
        if len(first):
            at[out[:-1][some]] = np.concatenate([first[:1], first[1:] - last[:-1]])
        return self.flat[np.cumsum(at, dtype=np.int32)], out[ends]

    @staticmethod
    def _plain(texts: pa.Array) -> pa.Array:
        """The texts with fewer different words and the same ids: A-Z lower-cased as the tokenizer does anyway, and a space
        before the points and commas that end a word, where it cuts anyway.

        Texts with combining marks stay as they are, as those join letters before these become lower case."""
        lined = pc.replace_substring(texts, "\n", " ")
        plain = pc.replace_substring_regex(pc.ascii_lower(lined), r"(\pL)([.,;:!?]+)( |$)", r"\1 \2\3")
        return pc.if_else(pc.match_substring_regex(lined, r"\pM"), lined, plain)


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One for all tasks of a Python worker."""
    return WordIds(path)


def cut(docs: DataFrame, path: str, size: int = SIZE, end: int = END, text: str = "text", key: str = "doc_id", made: tuple[str, ...] = ("ids_crc32",)) -> DataFrame:
    """(doc_id, piece, start, length and what is made) of every piece of every text's ids and the end token.

    made: ids (the piece's own) and ids_crc32 (of their little-endian 32-bit form)."""
    kinds = {"ids": T.ArrayType(T.IntegerType()), "ids_crc32": T.LongType()}
    fields = [T.StructField("doc_id", docs.schema[key].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]
    out = T.StructType(fields + [T.StructField(m, kinds[m]) for m in made])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(path)
        for batch in pieces(batches, BATCH_ROWS):
            ids, ends = encoder.encode(batch.column("text"))
            row, piece, start, length, digest, tokens = [], [], [], [], [], []
            begin = 0
            for k, stop in enumerate(ends.tolist()):
                own = np.append(ids[begin:stop], np.uint32(end)).astype("<u4", copy=False)
                begin = stop
                for n, at in enumerate(range(0, len(own), size)):
                    part = own[at : at + size]
                    row.append(k)
                    piece.append(n)
                    start.append(at)
                    length.append(len(part))
                    digest.append(zlib.crc32(part.tobytes()))
                    if "ids" in made:
                        tokens.append(part.astype(np.int32))
            values = {"ids": tokens, "ids_crc32": digest}
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64())]
            columns += [pa.array(values[m], pa.list_(pa.int32()) if m == "ids" else pa.int64()) for m in made]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", *made])

    return map_batches(docs.select(column(key).alias("doc_id"), column(text).alias("text")), encode, out)


def classes(size: int) -> list[tuple[int, int]]:
    """(above, up to): as long as a sequence holds few pieces of a class, classes of equal number; then quarters."""
    bounds = [size]
    for k in range(2, 9):
        bounds.append(min(size // k, bounds[-1]))
    while bounds[-1] > 16:
        bounds.append(bounds[-1] // 4)
    bounds = sorted({*bounds, 0}, reverse=True)
    return list(zip(bounds[1:], bounds[:-1], strict=True))


SWEPT = "id long, is_gap boolean, left long, seq long, units long, at long, run long"


def sweep(rows: DataFrame) -> DataFrame:
    """Matches pieces with gaps inside each partition of rows (id, is_gap, left, units), sorted by falling size.

    A piece leaves with the sequence it took, or without: then at is its number among those of the partition and run their
    total length before it.  A gap leaves with the room and units left, and at, the units of those before it.  One row more, with
    is_gap null, sums a partition up: units free, at (lone pieces), left (most room of a gap), seq (pieces placed), run (length of
    the shortest lone piece)."""
    schema = pa.schema([("id", pa.int64()), ("is_gap", pa.bool_()), ("left", pa.int64()), ("seq", pa.int64()), ("units", pa.int64()), ("at", pa.int64()), ("run", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_gaps, closed = [], []  # [id, room, units]
        alone = length_alone = matched = 0
        shortest = None
        for batch in batches:
            made = []
            for key, is_gap, left, units in zip(*(batch.column(c).to_pylist() for c in ("id", "is_gap", "left", "units")), strict=True):
                if is_gap:
                    open_gaps.append([key, left, units])
                elif open_gaps:
                    top = open_gaps[-1]
                    top[1] -= left
                    top[2] -= 1
                    matched += 1
                    made.append((key, False, left, top[0], 0, None, None))
                    if not top[2]:
                        closed.append(open_gaps.pop())
                else:
                    made.append((key, False, left, None, 0, alone, length_alone))
                    alone += 1
                    length_alone += left
                    shortest = left  # they come by falling length
            yield _rows(made, schema)
        made, units = [(k, True, room, k, 0, None, None) for k, room, _ in closed], 0
        for k, room, n in open_gaps:
            made.append((k, True, room, k, n, units, None))
            units += n
        most = max((room for _, room, _ in closed + open_gaps), default=0)
        yield _rows([*made, (None, None, most, matched, units, alone, shortest)], schema)

    return rows.mapInArrow(run, T.StructType.fromDDL(SWEPT))  # a few numbers per row: no memory to hand back


def _rows(made: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    found = list(zip(*made, strict=True)) if made else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found, schema, strict=True)], schema=schema)


def plan_runs(counts: list[tuple[int, int, int]]) -> tuple[list[Segment], dict[int, int]]:
    """Which runs of lone pieces meet which units of the gaps before them, from (partition, lone pieces, free units) in order.

    A segment (p, first, stop, q, top): piece number r of p, first <= r < stop, takes unit top - (r - first) of q.  Also: how many
    pieces of each partition are met.  The last gap left open is the smallest, so units are taken from the end."""
    stack: list[list[int]] = []
    segments, met = [], {}
    for p, alone, units in counts:
        done = 0
        while done < alone and stack:
            q, free = stack[-1]
            n = min(alone - done, free)
            segments.append((p, done, done + n, q, free - 1))
            done += n
            if n == free:
                stack.pop()
            else:
                stack[-1][1] -= n
        met[p] = done
        if units:
            stack.append([p, units])
    return segments, met


class _Packer:
    """The state between rounds: open gaps, pieces placed (both read from what rounds wrote), the next sequence's number."""

    def __init__(self, items: DataFrame, size: int):
        self.spark, self.size, self.items = items.sparkSession, size, items
        self.next, self.placed = 0, []
        self.gaps = self.spark.createDataFrame([], "seq long, room long")
        self.lengths = dict(items.groupBy("length").count().collect())  # a row per length: one sequence's size at most
        self.parts = min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), sum(self.lengths.values()) // PART_ROWS + 1)

    def _met(self, swept: DataFrame, lone: Column, segments: list[Segment]) -> None:
        """Carries a plan out: pieces and units of gaps meet by the numbers that the plan gives them."""
        gaps = swept.filter("is_gap").select("part", "seq", F.col("left").alias("room"), "units", "at")
        if segments:
            plan = F.broadcast(self.spark.createDataFrame(segments, "p int, first long, stop long, q int, top long"))
            lowest: dict[int, int] = {}
            for _, first, stop, q, top in segments:
                lowest[q] = min(lowest.get(q, top), top - (stop - first) + 1)
            used = F.broadcast(self.spark.createDataFrame(list(lowest.items()), "q int, low long"))
            takers = swept.filter(lone).join(plan, (F.col("part") == F.col("p")) & (F.col("at") >= F.col("first")) & (F.col("at") < F.col("stop")))
            takers = takers.select(F.col("id").alias("taker"), F.col("left").alias("length"), "q", (F.col("top") - F.col("at") + F.col("first")).alias("unit"))
            offered = gaps.filter("units > 0").join(used, F.col("part") == F.col("q")).filter(F.col("at") + F.col("units") > F.col("low"))
            offered = offered.select("q", "seq", F.explode(F.sequence(F.greatest("at", "low"), F.col("at") + F.col("units") - 1)).alias("unit"))
            crossed = materialize(takers.join(offered, ["q", "unit"]).select(F.col("taker").alias("id"), "seq", "length"), "crossed")
            self.placed.append(crossed)
            gaps = gaps.join(crossed.groupBy("seq").agg(F.sum("length").alias("took")), "seq", "left").withColumn("room", F.col("room") - F.coalesce("took", F.lit(0)))
        self.gaps = gaps.filter("room > 0").select("seq", "room")

    def _round(self, waiting: DataFrame, low: int, high: int) -> tuple[DataFrame, list[tuple[int, int, int]], bool]:
        """(pieces without a gap, (partition, how many of them, its first one's number), whether another sweep could place some)."""
        rows = waiting.select("id", F.lit(False).alias("is_gap"), F.col("length").alias("left"), F.lit(1).cast("long").alias("units"))
        units = F.when(F.col("room") > low, F.greatest(F.lit(1), F.floor(F.col("room") / high))).otherwise(0)
        rows = rows.unionByName(self.gaps.select(F.col("seq").alias("id"), F.lit(True).alias("is_gap"), F.col("room").alias("left"), units.alias("units")))
        rank = [F.least("left", F.lit(high)).desc(), F.col("is_gap").desc(), F.col("left").desc(), F.col("id")]
        swept = materialize(sweep(rows.repartitionByRange(self.parts, *rank).sortWithinPartitions(*rank)).withColumn("part", F.spark_partition_id()), "swept")
        lone = (~F.col("is_gap")) & F.col("seq").isNull()
        taken = ~F.col("is_gap") & F.col("seq").isNotNull()
        found = swept.filter("is_gap is null").select("part", "at", "units", "left", "seq", "run").collect()  # a row per partition
        counts = sorted((p, n, u) for p, n, u, *_ in found)
        segments, met = plan_runs(counts)
        self.placed.append(swept.filter(taken).select("id", "seq", F.col("left").alias("length")))
        self._met(swept, lone, segments)
        rest = [(p, n - met[p], met[p]) for p, n, _ in counts]
        missed = F.broadcast(self.spark.createDataFrame([(p, first) for p, _, first in rest] or [(0, 0)], "p int, met long"))
        alone = swept.filter(lone).join(missed, F.col("part") == F.col("p")).filter("at >= met").select("id", F.col("left").alias("length"), "part", "at", "run")
        # only a gap that has taken a piece and is still as wide as the shortest one left over can take one more
        shortest = min((r[5] for r, (_, n, _) in zip(sorted(found), rest, strict=True) if n), default=None)
        return alone, rest, shortest is not None and sum(r[4] for r in found) + sum(met.values()) > 0 and max(r[3] for r in found) >= shortest

    def _open(self, alone: DataFrame, rest: list[tuple[int, int, int]], low: int, high: int) -> DataFrame | None:
        """New sequences for the class's pieces that fit nowhere, by their rank: neighbours share one.

        Where sequences hold many of the class, only as many are opened as all tokens fill; what they cannot take is returned, to
        be swept into their gaps."""
        each, most = self.size // high, None
        if (each + 1) * (low + 1) > self.size:  # no sequence holds more of them: by number
            starts, n = [], 0
            for p, count, first in rest:
                starts.append((p, n - first))
                n += count
            by, step = F.col("at"), each
        else:  # by tokens: a piece that begins in a stretch of this many ends within the sequence
            starts, n = [], 0
            for p, total, first in sorted(alone.groupBy("part").agg(F.sum("length"), F.min("run")).collect()):
                starts.append((p, n - first))
                n += total
            by, step = F.col("run"), self.size - high + 1
            most = max(1, n // self.size)
        where = F.broadcast(self.spark.createDataFrame(starts, "p int, shift long"))
        turned = alone.join(where, F.col("part") == F.col("p")).select("id", "length", F.floor((by + F.col("shift")) / step).alias("turn"))
        opened = materialize(turned.select("id", "length", "turn", (F.col("turn") + self.next).cast("long").alias("seq")), "opened")
        now = opened if most is None else opened.filter(F.col("turn") < most)
        self.placed.append(now.select("id", "seq", "length"))
        self.next += -(-n // step) if most is None else most
        fresh = now.groupBy("seq").agg((self.size - F.sum("length")).alias("room"))
        self.gaps = self.gaps.unionByName(fresh.filter("room > 0"))
        return None if most is None or most * step >= n else opened.filter(F.col("turn") >= most).select("id", "length")

    def run(self) -> DataFrame:
        """(id, seq, length) of all items shorter than a sequence."""
        for low, high in classes(self.size):
            if not any(low < n <= high and n < self.size for n in self.lengths):
                continue
            waiting = self.items.filter((F.col("length") > low) & (F.col("length") <= high) & (F.col("length") < self.size))
            while waiting is not None:
                waiting, rest, more = self._round(waiting, low, high)
                if not any(n for _, n, _ in rest):
                    break
                if not more:
                    waiting = self._open(waiting, rest, low, high)
        out = self.spark.createDataFrame([], "id long, seq long, length long")
        for part in self.placed:
            out = out.unionByName(part)
        return out


def pack(pieces_cut: DataFrame, size: int = SIZE) -> DataFrame:
    """The pieces with sequence_id and offset: each sequence holds at most size tokens, without gaps from its start.

    Pieces need a length of 1 to size; they are written once, everything else works on a number and a length per piece."""
    numbered = materialize(pieces_cut.withColumn("_id", F.monotonically_increasing_id()), "pieces")
    placed = _Packer(numbered.select(F.col("_id").alias("id"), F.col("length").cast("long").alias("length")), size).run()
    in_turn = Window.partitionBy("seq").orderBy(F.col("length").desc(), "id")  # one sequence: size rows at most
    offset = F.coalesce(F.sum("length").over(in_turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.select("id", F.col("seq").alias("sequence_id"), offset.alias("offset"))
    full = numbered.filter(F.col("length") == size).select("*", (-1 - F.col("_id")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = numbered.filter(F.col("length") < size).join(placed, F.col("_id") == F.col("id"))
    return full.unionByName(rest.drop("id")).drop("_id")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the tokens of every sequence, from pieces packed with their ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
