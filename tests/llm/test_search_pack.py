"""Lexical search, importance resampling and packing against plain versions."""

import hashlib
import math
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from morpholake.llm import importance, lexical, packing
from morpholake.llm.queries import WORD_FILE, queries

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ITEMS = [(1, "The same row, twice"), (1, "no id"), (2, "word"), (3, None), (4, "nowhere found")]


def terms(text):
    return [t.translate(ASCII_LOWER) for t in TERM.findall(text or "")]


def ranking(docs, items, most=50):
    counts = [Counter(terms(text)) for _, text in docs]
    sizes = [sum(c.values()) for c in counts]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for c in counts for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item].update(terms(text))
    out = []
    for item, words in asked.items():
        found = []
        for (doc_id, _), c, size in zip(docs, counts, sizes, strict=True):
            m = 100 - 50 + (50 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 20 * m)) for w in words if w in c)
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        out += [(item, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(found)[:most])]
    return sorted(out, key=str)


def found(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def read(spark, sf, name):
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return [tuple(r) for r in df.select(df.columns[0], "text").collect()]


def test_search_equals_a_full_scan(spark, sf, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_BYTES", 60_000)
    assert found(queries()["op11_lexical"](spark, sf)) == ranking(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


def test_search_in_blocks_of_queries(spark, odd, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_CHARS", 8)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found(lexical.search(odd, items)) == ranking(docs, ITEMS)
    assert found(lexical.search(odd, items, most=1)) == ranking(docs, ITEMS, 1)


def test_search_of_nothing(spark, odd, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(empty, items).collect() == [] == lexical.search(odd, items.limit(0)).collect()


@pytest.mark.parametrize("seed", range(6))
def test_blocks_are_the_cheapest(seed):
    random = np.random.default_rng(seed)
    scores = random.integers(1, 50, int(random.integers(1, 60))) ** 2
    (cuts, tops), price = lexical.cut_lists([scores])[0], lexical.BLOCK_PRICE * scores.mean()
    best = [0.0]
    for i in range(1, len(scores) + 1):
        best.append(min(best[j] + scores[j:i].max() * (i - j) + price for j in range(max(0, i - lexical.MOST_BLOCK), i)))
    assert cuts[0] == 0 and cuts[-1] == len(scores) and tops.tolist() == [scores[a:b].max() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    assert math.isclose(sum(tops * np.diff(cuts)) + price * len(tops), best[-1]) or len(scores) == 1


def test_search_skips_blocks():
    random = np.random.default_rng(5)
    n, lists = 4000, {}
    for k, share in enumerate((0.9, 0.5, 0.02, 0.01)):
        docs = np.flatnonzero(random.random(n) < share)
        lists[k] = docs, random.integers(100, 1000, len(docs)) * np.where(docs < 200, 20, 1)
    searcher = lexical.Searcher(n, lists)
    asked = [(0, 1), (1, 3), (2, 40), (3, 90)]
    docs, scores = searcher.search(asked, 0, 10)
    whole = np.zeros(n, np.int64)
    for k, w in asked:
        whole[lists[k][0]] += w * lists[k][1]
    best = sorted(zip(-whole, range(n), strict=True))[:10]
    assert sorted(zip(-scores, docs.tolist(), strict=True))[:10] == best
    assert searcher.opened < sum(len(d) for d, _ in lists.values()) / 2


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def resampled(docs, target, order=1, buckets=10000, least=20, percent=10):
    def features(text):
        words = WORD.findall((text or "").translate(ASCII_LOWER))
        return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, order + 1) for i in range(len(words) - k + 1)]

    all_of, wanted = Counter(f for _, text in docs for f in features(text)[1]), Counter(f for text in target for f in features(text)[1])
    big, small = sum(all_of.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (big + buckets) / ((all_of[b] + 1) * (small + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        n, found = features(text)
        weight = sum(gain[f] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    enough = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = len(enough) * percent // 100
    out = [(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(enough)] + [(*r[:4], None) for r in rows if not r[4]]
    return sorted(out, key=str)


def drawn(df):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()), key=str)


def test_resampling_query(spark, sf):
    assert drawn(queries()["op12_importance"](spark, sf)) == resampled(read(spark, sf, "documents"), [t for _, t in read(spark, sf, "benchmark")])


@pytest.mark.parametrize("order", [1, 3])
def test_resampling_of_odd_rows(spark, odd, order, monkeypatch):
    monkeypatch.setattr(importance, "MOST_NODES", 4)
    target = spark.createDataFrame([("Same Row, same words",), (None,)], "text string")
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = importance.resample(odd, target, order=order, buckets=97, percent=60, least_words=2)
    assert drawn(got) == resampled(docs, ["Same Row, same words", None], order, 97, 2, 60)


def test_resampling_of_nothing(spark, odd, empty):
    assert importance.resample(empty, odd).collect() == []
    assert importance.resample(odd, empty).count() == odd.count()


def plain_pieces(docs, size=2048):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(WORD_FILE))
    tokenizer.encode_special_tokens = True
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), size)):
            yield doc_id, n, at, ids[at : at + size]


def checksum(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def best_fit_decreasing(lengths, size):
    gaps, n = [], 0
    for length in sorted(lengths, reverse=True):
        k = bisect_left(gaps, length)
        n += k == len(gaps)
        insort(gaps, (size if k == len(gaps) else gaps.pop(k)) - length)
    return n


def check_packed(rows, size):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by_sequence)


def test_packing_query(spark, sf):
    rows = queries()["op13_packing"](spark, sf).collect()
    want = list(plain_pieces(read(spark, sf, "documents")))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted((d, n, at, len(ids), checksum(ids)) for d, n, at, ids in want)
    lengths = [len(ids) for *_, ids in want]
    assert check_packed(rows, 2048) <= best_fit_decreasing(lengths, 2048) + 2


@pytest.mark.parametrize("shape", ["wide", "small", "equal"])
def test_packing_is_near_best_fit(spark, shape, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 50)  # so that pieces meet gaps of other partitions
    random = np.random.default_rng(3)
    lengths = {"wide": random.integers(1, 101, 700), "small": random.integers(1, 12, 900), "equal": np.full(300, 34)}[shape].tolist()
    cut = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "doc_id long, length long")
    rows = packing.pack(cut, 100).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(lengths)))
    assert check_packed(rows, 100) <= best_fit_decreasing(lengths, 100) * 1.04 + 1


def test_packing_of_odd_rows(spark, odd, empty):
    path = public_tokenizers.path(WORD_FILE)
    hard = odd.unionByName(odd.limit(1).withColumn("text", F.lit("<|endoftext|> ÉCOLE école x y ΣΟΦΟΣ it's İ 12\t3")))
    packed = packing.pack(packing.cut(hard, path, made=("ids", "ids_crc32")))
    rows = packed.collect()
    want = list(plain_pieces([(r["doc_id"], r["text"]) for r in hard.collect()]))
    assert sorted(((r["doc_id"], r["piece"], r["ids"]) for r in rows), key=str) == sorted(((d, n, ids) for d, n, _, ids in want), key=str)
    joined = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for r in rows:
        assert joined[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"] and checksum(r["ids"]) == r["ids_crc32"]
    assert packing.pack(packing.cut(empty, path)).collect() == []


def test_plan_takes_the_last_open_gap():
    segments, met = packing.plan_runs([(0, 1, 3), (1, 2, 0), (2, 0, 2), (3, 4, 1)])
    assert segments == [(1, 0, 2, 0, 2), (3, 0, 2, 2, 1), (3, 2, 3, 0, 0)] and met == {0: 0, 1: 2, 2: 0, 3: 3}
