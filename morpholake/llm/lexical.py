"""Ranked lexical search: variable-block-max WAND over shards of an inverted index.

index() reads the texts once.  A shard is a stretch of a task's documents (SHARD_BYTES of text, one document at least); its
row holds the posting lists of all its terms.  N, L and the df of the queried terms are sums over shards.  search() takes
queries in blocks of bounded size; a task goes through its shards and keeps, for each query, the best documents so far:

1. dynamic programming cuts each queried list into blocks so that the error of the blocks' maxima, and a price per block, is
   least (blocks of MOST_BLOCK postings at most; lists of similar length run through it side by side);
2. block maxima bound each stretch of documents between block borders; stretches that cannot reach the least score kept are
   skipped, the most promising ones are searched first, which raises that score;
3. the pivot rule in bulk: lists come by falling maxima; a document stays a candidate while what it has and the maxima of the
   lists to come reach that score, and only blocks with a candidate in them are opened.

Skipping never changes a result: scores are whole numbers and a bound equal to the least score is searched.  Tasks return
a query's best documents alone, and these are ranked again.

Null and empty texts hold no terms and are found by nobody.  Rows that repeat an id are documents of their own; a null id comes
last among equals.  Rows of queries that repeat an item_id are one item.  Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_of, column, map_batches, materialize, pieces

#: Terms of lower-cased UTF-8: digits, a to z and all that is not ASCII.
TERM = regex.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SHARD_BYTES = 12_000_000
MOST = 50
#: Weight of the length in a score, of 100.
LENGTH_SHARE = 50
MOST_BLOCK = 64
#: Price of a block, in mean scores of its list.
BLOCK_PRICE = 8
#: A block of queries holds about so many characters.
BLOCK_CHARS = 2_000_000
#: First stretches searched of a shard hold so many documents for each that is wanted.
FIRST_DOCS = 8

Cut = tuple[np.ndarray, np.ndarray]  # first postings of blocks, and the end; maxima of blocks


def terms_of(text: bytes | None) -> list[bytes]:
    return TERM.findall(text.lower()) if text else []  # of bytes, lower() changes A to Z only


def index(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per shard: its documents' ids and lengths, its terms, and for each term the documents that hold it and how often.

    Arrays are packed: ids as a list, terms end to end with line feeds, ends (of lists) as int64, docs and tfs as int32."""
    kind = docs.schema[key].dataType
    binary = [T.StructField(c, T.BinaryType()) for c in ("lengths", "terms", "ends", "docs", "tfs")]
    out = T.StructType([T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("n_docs", T.LongType()), T.StructField("n_terms", T.LongType()), *binary])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in pieces(batches):
            ids = batch.column("doc_id")
            for k, raw in enumerate(batch.column("text").cast(pa.binary())):
                text = raw.as_py()
                shard = shard or _Shard(ids.type)
                shard.add(ids[k].as_py(), text)
                if shard.size >= SHARD_BYTES:
                    yield shard.row()
                    shard = None
        if shard:
            yield shard.row()

    return map_batches(docs.select(column(key).alias("doc_id"), column(text).alias("text")), build, out)


class _Shard:
    """Collects documents, and lays out their postings by term."""

    def __init__(self, kind: pa.DataType):
        self.kind, self.size = kind, 0
        self.ids, self.lengths, self.held = [], [], []  # held: how many terms a document holds
        self.number: dict[bytes, int] = {}
        self.terms, self.tfs = [], []

    def add(self, doc_id: object, text: bytes | None) -> None:
        words = terms_of(text)
        self.size += len(text or b"")
        if words:
            found, number = Counter(words), self.number
            self.terms.extend([number.setdefault(w, len(number)) for w in found])
            self.tfs.extend(found.values())
            self.ids.append(doc_id)
            self.lengths.append(len(words))
            self.held.append(len(found))

    def row(self) -> pa.RecordBatch:
        term, tf = np.array(self.terms, np.int32), np.array(self.tfs, np.int32)
        doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.held)
        order = np.argsort(term, kind="stable")
        ends = np.cumsum(np.bincount(term, minlength=len(self.number)))
        packed = [np.array(self.lengths, np.int32), b"\n".join(self.number), ends.astype(np.int64), doc[order], tf[order]]
        values = [[self.ids], [len(self.ids)], [sum(self.lengths)], *([x if isinstance(x, bytes) else x.tobytes()] for x in packed)]
        kinds = [pa.list_(self.kind), pa.int64(), pa.int64(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=["doc_ids", "n_docs", "n_terms", "lengths", "terms", "ends", "docs", "tfs"])


def _lists(row_terms: bytes, ends: np.ndarray, wanted: dict[bytes, int]) -> Iterator[tuple[int, int, int]]:
    """(number of the wanted term, begin and end of its list) of those that the shard holds."""
    for k, term in enumerate(row_terms.split(b"\n") if len(ends) else ()):
        if (at := wanted.get(term)) is not None:
            yield at, int(ends[k - 1]) if k else 0, int(ends[k])


def document_counts(shards: DataFrame, wanted: dict[bytes, int]) -> dict[int, int]:
    """How many documents hold each wanted term; a row per term reaches the driver."""
    shared = shards.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for batch in batches:
            for terms, ends in zip(batch.column("terms"), batch.column("ends"), strict=True):
                for at, a, b in _lists(terms.as_py(), np.frombuffer(ends.as_py(), np.int64), shared.value):
                    total[at] += b - a
        yield batch_of(pa.schema([("term", pa.int32()), ("df", pa.int64())]), term=list(total), df=list(total.values()))

    return dict(map_batches(shards.select("terms", "ends"), count, T.StructType.fromDDL("term int, df long")).groupBy("term").agg(F.sum("df")).collect())


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def cut_lists(lists: list[np.ndarray]) -> list[Cut]:
    """The cheapest blocks of each list: sum of (maximum * length) and of BLOCK_PRICE mean scores per block, by dynamic programming.

    Lists are put together by the power of two of their lengths; a step of the program handles one posting of each."""
    out: list[Cut] = [(np.array([0, len(x)]), x.max(initial=0, keepdims=True)) for x in lists]
    groups: dict[int, list[int]] = {}
    for k, x in enumerate(lists):
        if len(x) > 1:
            groups.setdefault(len(x).bit_length(), []).append(k)
    for members in groups.values():
        size = np.array([len(lists[k]) for k in members])
        longest, rows = int(size.max()), np.arange(len(members))
        score = np.zeros((len(members), longest))
        for r, k in enumerate(members):
            score[r, : len(lists[k])] = lists[k]
        price = BLOCK_PRICE * score.sum(1) / size
        cost = np.zeros((len(members), longest + 1))
        length = np.zeros((len(members), longest + 1), np.int16)  # of the last block
        for i in range(longest):
            low = max(0, i + 1 - MOST_BLOCK)
            top = np.maximum.accumulate(score[:, low : i + 1][:, ::-1], axis=1)
            top *= np.arange(1, i + 2 - low)
            top += cost[:, low : i + 1][:, ::-1]
            best = top.argmin(1)
            cost[:, i + 1] = top[rows, best] + price
            length[:, i + 1] = best + 1
        for r, k in enumerate(members):
            at, borders, steps = int(size[r]), [int(size[r])], length[r].tolist()
            while at:
                at -= steps[at]
                borders.append(at)
            cuts = np.array(borders[::-1])
            out[k] = cuts, np.maximum.reduceat(lists[k], cuts[:-1])
    return out


class Searcher:
    """The queried lists of one shard."""

    def __init__(self, n_docs: int, lists: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.n = n_docs
        self.numbers = list(lists)
        self.docs = {k: d for k, (d, _) in lists.items()}
        self.scores = {k: s for k, (_, s) in lists.items()}
        self.cuts = dict(zip(self.numbers, cut_lists([self.scores[k] for k in self.numbers]), strict=True))
        self.opened = 0  # postings looked at, for tests

    def _bounds(self, terms: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """(borders of stretches of documents, bound of each stretch)."""
        at, change = [np.array([0, self.n])], [np.zeros(2, np.int64)]
        for k, w in terms:
            cuts, top = self.cuts[k]
            at += [self.docs[k][cuts[:-1]], self.docs[k][cuts[1:] - 1] + 1]
            change += [w * top, -w * top]
        at, change = np.concatenate(at), np.concatenate(change)
        order = np.argsort(at, kind="stable")
        at, total = at[order], np.cumsum(change[order])
        last = np.append(at[1:] != at[:-1], True)
        return at[last], total[last][:-1]

    def _score(self, alive: np.ndarray, terms: list[tuple[int, int]], least: int) -> np.ndarray:
        """Scores of the documents that are alive and can reach the least score (0 of others)."""
        score = np.zeros(self.n, np.int64)
        tops = [w * int(self.cuts[k][1].max()) for k, w in terms]
        order = sorted(range(len(terms)), key=lambda t: -tops[t])
        rest = sum(tops)
        for t in order:
            alive = alive & (score + rest >= least)  # what the lists to come can add does not suffice for the others
            if not alive.any():
                break
            rest -= tops[t]
            k, w = terms[t]
            cuts, docs = self.cuts[k][0], self.docs[k]
            before = np.concatenate([[0], np.cumsum(alive)])
            live = before[docs[cuts[1:] - 1] + 1] > before[docs[cuts[:-1]]]
            size = np.diff(cuts)[live]
            ends = np.cumsum(size)
            if not len(ends):
                continue
            at = np.repeat(cuts[:-1][live] - ends + size, size) + np.arange(ends[-1])
            at = at[alive[docs[at]]]
            self.opened += len(at)
            score[docs[at]] += w * self.scores[k][at]
        return np.where(alive, score, 0)

    def search(self, terms: list[tuple[int, int]], least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of at least this score, among them the best `most` of the shard."""
        terms = [(k, w) for k, w in terms if k in self.docs and w > 0]
        if not terms:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        borders, bound = self._bounds(terms)
        size, found = np.diff(borders), np.zeros(0, np.int64)
        order = np.argsort(-bound, kind="stable")
        seen = np.cumsum(size[order])
        done, want = 0, most * FIRST_DOCS
        docs, scores = [], []
        while done < len(order) and bound[order[done]] >= max(least, 1):
            stop = int(np.searchsorted(seen, want)) + 1
            some = order[done:stop]
            some = some[bound[some] >= max(least, 1)]
            change = np.zeros(self.n + 1, np.int64)
            np.add.at(change, borders[some], 1)
            np.add.at(change, borders[some + 1], -1)
            score = self._score(np.cumsum(change[:-1]) > 0, terms, least)
            at = np.flatnonzero(score >= max(least, 1))
            docs.append(at)
            scores.append(score[at])
            found = np.concatenate([found, score[at]])
            if len(found) > most:
                found = np.partition(found, len(found) - most)[-most:]
            if len(found) == most:
                least = max(least, int(found.min()))
            done, want = stop, want * 4
        if not docs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        docs, scores = np.concatenate(docs), np.concatenate(scores)
        keep = scores >= max(least, 1)
        return docs[keep], scores[keep]


def _search_block(shards: DataFrame, queries: list[tuple[int, list[tuple[int, int]]]], wanted: dict[bytes, int], n: int, total: int, most: int, kind: T.DataType) -> DataFrame:
    """(query, doc_id, score): of each task, the best of each query."""
    shared = shards.sparkSession.sparkContext.broadcast((queries, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, wanted = shared.value
        best: dict[int, list[tuple[int, bool, object]]] = {q: [] for q, _ in queries}  # (-score, no id, id), sorted
        id_type = None
        for batch in pieces(batches, 1):
            row = {c: batch.column(c)[0] for c in batch.schema.names}
            id_type = row["doc_ids"].values.type if id_type is None else id_type
            packed = {c: np.frombuffer(row[c].as_py(), np.int32) for c in ("lengths", "docs", "tfs")}
            m = 100 - LENGTH_SHARE + (LENGTH_SHARE * packed["lengths"].astype(np.int64) * n) // total
            lists = {}
            for at, a, b in _lists(row["terms"].as_py(), np.frombuffer(row["ends"].as_py(), np.int64), wanted):
                docs, tf = packed["docs"][a:b].astype(np.int64), packed["tfs"][a:b].astype(np.int64)
                lists[at] = docs, (1_000_000_000 * tf) // (1000 * tf + 20 * m[docs])
            searcher = Searcher(len(m), lists)
            for q, terms in queries:
                kept = best[q]
                docs, scores = searcher.search(terms, -kept[-1][0] if len(kept) == most else 0, most)
                if len(docs):
                    ids = row["doc_ids"].values.take(pa.array(docs)).to_pylist()
                    best[q] = sorted([*kept, *((-s, i is None, i) for s, i in zip(scores.tolist(), ids, strict=True))], key=_rank)[:most]
        rows = [(q, i, -s) for q, kept in best.items() for s, _, i in kept]
        if rows:
            q, ids, scores = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(ids, id_type), pa.array(scores, pa.int64())], names=["query", "doc_id", "score"])

    out = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("doc_id", kind), T.StructField("score", T.LongType())])
    return map_batches(shards, run, out)


def _rank(entry: tuple[int, bool, object]) -> tuple:
    return entry if not entry[1] else entry[:2]


def search(docs: DataFrame, items: DataFrame, most: int = MOST, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Each item's `most` highest-scoring documents with a score above 0: item_id, rank, doc_id, score."""
    spark, kind = docs.sparkSession, docs.schema[key].dataType
    shards = materialize(index(docs, text, key), "shards")
    n, total = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    asked = items.select(column(item).alias("item_id"), F.coalesce(column(item_text), F.lit("")).alias("text"))
    chars = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = chars // BLOCK_CHARS + 1
    item_kind = items.schema[item].dataType
    ranked = spark.createDataFrame([], T.StructType([T.StructField("item_id", item_kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", kind), T.StructField("score", T.LongType())]))
    for k in range(blocks if n else 0):
        rows = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()  # about BLOCK_CHARS of text
        terms: dict[object, set[bytes]] = {}
        for name, words in rows:
            terms.setdefault(name, set()).update(terms_of(words.encode()))
        wanted = {w: at for at, w in enumerate(sorted(set().union(*terms.values())))}
        weights = {at: weight(n, df) for at, df in document_counts(shards, wanted).items()}
        names = list(terms)
        queries = [(q, sorted((at, weights[at]) for w in terms[name] if (at := wanted[w]) in weights)) for q, name in enumerate(names)]
        found = _search_block(shards, queries, wanted, n, total, most, kind)
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        best = found.withColumn("place", F.row_number().over(Window.partitionBy("query", F.pmod(F.xxhash64("doc_id"), F.lit(64))).orderBy(*order))).filter(F.col("place") <= most)
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= most)
        called = spark.createDataFrame([(q, name) for q, name in enumerate(names)], T.StructType([T.StructField("number", T.IntegerType()), T.StructField("item_id", item_kind)]))
        ranked = ranked.unionByName(best.join(F.broadcast(called), F.col("query") == F.col("number")).select("item_id", "rank", "doc_id", "score"))
    return ranked
