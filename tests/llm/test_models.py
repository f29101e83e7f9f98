"""Held-out accuracy and odd rows of the learned operators."""

import math
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from morpholake.llm import gru_lm, langid, toxicity

BIG = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    from morpholake.llm.queries import op7_langid

    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{BIG}/documents.parquet").collect()}
    rows = [r for r in op7_langid(spark, BIG).collect()]
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(odd, empty):
    model = langid.train(odd)
    rows = {r.doc_id: r for r in langid.predict(odd, model, ["doc_id", "at"]).collect()}
    assert [rows[k].lang_pred for k in (1, 2, 3, 6)] == ["und"] * 4
    assert rows[4].lang_pred == "en" and rows[None].lang_pred == "de"
    none = langid.train(empty)
    assert {r.lang_pred for r in langid.predict(odd, none, ["doc_id"]).collect()} == {"und"}
    assert langid.predict(empty, model, ["doc_id"]).count() == 0


def test_grams_do_not_cross_texts():
    both, starts = langid.grams(["abc", "xyz"])
    one, _ = langid.grams(["xyz"])
    assert (both[:, starts[1] :] == one).all()


def plain_buckets(text):
    """The bucket of every 1- to 3-gram of the text with two gaps before and after, one by one."""
    code, full = [ord(c) for c in f"  {text.lower()}  "], (1 << 32) - 1
    out = []
    for n in (1, 2, 3):
        for i in range(2, len(code)):
            h = 0
            for k in range(n):
                h = (h * 0x01000193 + code[i - n + 1 + k] * 0x9E3779B1 + k + 1) & full
            h = ((h ^ (h >> 15)) * 0x85EBCA6B) & full
            out.append(h >> 18)
    return out


def test_language_equals_brute_force(spark, sf, monkeypatch):
    """Counts, probabilities and posteriors by plain loops; also with blocks so small that they cut texts."""
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").filter("n_chars < 600").collect()]
    assert len(rows) > 20
    counts, docs = {}, Counter()
    for _, text, lang in rows:
        if lang and text and any(c.isalpha() for c in text):
            counts.setdefault(lang, Counter()).update(plain_buckets(text))
            docs[lang] += 1
    names = sorted(counts)
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(table)
    assert model[0] == names
    size = {k: sum(counts[k].values()) + 0.5 * langid.BUCKETS for k in names}
    want = {}
    for i, text, _ in rows:
        if not text or not any(c.isalpha() for c in text):
            want[i] = ("und", 0.0)
            continue
        total = [math.log((docs[k] + 1) / (sum(docs.values()) + len(names))) + sum(math.log((counts[k][b] + 0.5) / size[k]) for b in plain_buckets(text)) for k in names]
        odds = [math.exp(t - max(total)) for t in total]
        want[i] = (names[total.index(max(total))], max(odds) / sum(odds))
    for cells in (langid.CELLS, 5_000):
        monkeypatch.setattr(langid, "CELLS", cells)
        for r in langid.predict(table, model, ["doc_id"]).collect():
            assert r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-3


def test_toxicity_held_out(spark):
    from morpholake.llm.queries import op5_toxicity

    many = "/root/testdata/sf0.1"  # smaller tables label some forty toxic documents only
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{many}/labels.parquet").collect()}
    rows = op5_toxicity(spark, many).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.score, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    good, bad = [s for s, t in held if t], [s for s, t in held if not t]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.95  # some of its labels show in no word
    assert np.mean([s >= 0.5 for s in bad]) < 0.01 and np.mean([s >= 0.5 for s in good]) > 0.8
    assert all(r.predicted == (r.score >= 0.5) for r in rows)


@pytest.mark.parametrize(("rows", "noise", "terms"), [(4000, 60, 3), (4000, 5000, 30)])
def test_toxicity_neutral_pairs_are_learned(rows, noise, terms):
    """Toxic is exactly one of two terms: neither says anything alone, and no sum of single weights can say so."""
    rng = np.random.default_rng(0)
    texts, labels = [], []
    for _ in range(rows):
        a, b = rng.random(2) < 0.5
        texts.append(np.unique(rng.integers(10, noise, terms).tolist() + [1] * int(a) + [2] * int(b)))
        labels.append(float(a != b))
    model = toxicity.fit(np.concatenate(texts).astype(np.int32), np.array([len(x) for x in texts]), np.array(labels))
    neither, one, other, both = toxicity.raw_scores(model, np.array([1, 2, 1, 2]), np.array([0, 1, 1, 2]))
    assert both < neither - 0.5 and both < min(one, other) - 1


def plain_toxicity(model, text):
    """The machine's formula over all pairs of a text's terms."""
    ids = toxicity.term_buckets(text or "", {})
    pairs = sum(float(model.v[a] @ model.v[b]) for k, a in enumerate(ids) for b in ids[:k])
    raw = model.bias + sum(float(model.w[i]) for i in ids) + min(1, toxicity.PAIRS / max(len(ids), 1)) * pairs
    return 1 / (1 + math.exp(-raw))


def test_toxicity_scores_equal_brute_force(spark, sf):
    rng = np.random.default_rng(4)
    model = toxicity.Model(-0.3, rng.normal(0, 0.1, toxicity.BUCKETS).astype(np.float32), rng.normal(0, 0.1, (toxicity.BUCKETS, toxicity.RANK)).astype(np.float32))
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("n_chars < 2000").select("doc_id", "text").limit(50)
    docs = spark.createDataFrame([(r.doc_id, r.text) for r in docs.collect()] + [(-1, None), (-2, ""), (-3, "12 !")], "doc_id long, text string")
    want = {r.doc_id: plain_toxicity(model, r.text) for r in docs.collect()}
    for r in toxicity.score(docs, model, ["doc_id"]).collect():
        assert abs(r.score - want[r.doc_id]) < 1e-4 and r.predicted == (r.score >= 0.5)


def test_toxicity_odd_rows(spark, odd, empty):
    model = toxicity.fit(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0))
    rows = toxicity.score(odd.drop("score"), model, ["doc_id", "words"]).collect()
    assert {round(r.score, 6) for r in rows} == {0.5} and len(rows) == odd.count()
    labelled = odd.withColumnRenamed("n_chars", "toxic")
    assert toxicity.score(empty, toxicity.train(labelled.filter("toxic is null")), ["doc_id"]).count() == 0


def test_network_is_a_distribution():
    net = gru_lm.new_network()
    h = np.random.default_rng(0).normal(size=(gru_lm.HIDDEN, 1)).astype(np.float32)
    n = gru_lm.CLASSES**2
    p = np.exp(gru_lm.log_probabilities(net, np.repeat(h, n, 1), np.arange(n)))
    assert abs(p.sum() - 1) < 1e-4


def plain_log_likelihood(parts, doc, end):
    """Symbol by symbol, in double precision, from the equations."""
    x, u, wc, bc, wo, bo = (p.astype(float) for p in parts)
    n, h, last, total = gru_lm.HIDDEN, np.zeros(gru_lm.HIDDEN), end, 0.0
    soft = lambda v: v - v.max() - np.log(np.exp(v - v.max()).sum())
    for s in doc:
        if last == end:
            h = np.zeros(n)
        i, a = x[:, last], u @ h
        z, r = 1 / (1 + np.exp(-(i + a)[:n])), 1 / (1 + np.exp(-(i + a)[n : 2 * n]))
        h = h + z * (np.tanh(i[2 * n :] + r * a[2 * n :]) - h)
        k, m = divmod(int(s), gru_lm.CLASSES)
        total += soft(wc @ h + bc[:, 0])[k] + soft(wo[k] @ h + bo[k, :, 0])[m]
        last = s
    return total


def rough_network(seed):
    rng, net = np.random.default_rng(seed), gru_lm.new_network()
    for p in net.parts():
        p += rng.normal(0, 0.3, p.shape).astype(np.float32)
    return rng, net


def test_scores_equal_the_equations():
    rng, net = rough_network(2)
    end = gru_lm.VOCABULARY
    docs = [np.append(rng.integers(0, end, n), end) for n in (0, 1, 90, 300)]
    assert np.allclose(gru_lm.score_documents(net, docs, end), [plain_log_likelihood(net.parts(), d, end) for d in docs], rtol=1e-4)


def test_gradients_equal_differences():
    """Along random directions, one part of the network at a time; the window holds an end and two lanes of unequal length."""
    rng, net = rough_network(3)
    end = gru_lm.VOCABULARY
    lanes = [np.concatenate([rng.integers(0, end, 9), [end], rng.integers(0, end, 10)]), rng.integers(0, end, 13)]
    wanted = np.full((20, 2), -1, np.int16)
    for k, x in enumerate(lanes):
        wanted[: len(x), k] = x
    seen = np.vstack([np.full((1, 2), end, np.int16), wanted[:-1]])
    grads = gru_lm.network_of(np.zeros(sum(p.size for p in net.parts()), np.float32))
    gru_lm._window(net, grads, seen, wanted, np.zeros((gru_lm.HIDDEN, 2), np.float32), end)
    loss = lambda parts: -sum(plain_log_likelihood(parts, x, end) for x in lanes)
    parts = [p.astype(float) for p in net.parts()]
    for k, g in enumerate(grads.parts()):
        way = rng.normal(size=g.shape)
        up, down = ([p + s * 1e-4 * way if i == k else p for i, p in enumerate(parts)] for s in (1, -1))
        assert np.isclose((g * way).sum(), (loss(up) - loss(down)) / 2e-4, rtol=2e-3, atol=2e-3), k


def test_long_words_have_keys():
    long = "w" * 65
    a, b, c = gru_lm.tokens(f"{long} {long}x {'W' * 64}")
    assert len({a, b, c}) == 3 and len(a) == len(b) == 33 and c == b"w" * 64 and gru_lm.tokens(long) == [a]


def test_all_tokens_equal_tokens(monkeypatch):
    """Texts of a batch are split at once, also in slabs of a few bytes."""
    long = "Ab" * 40
    docs = [None, "", " ", "a", "  B a\t\ta\n", f"{long} x {long}y \u00c4\u0130 {long}", "a\u00a0b\x1cc\x85d \x0b\x0ce\r", "z " * 50, None]
    batch = pa.RecordBatch.from_arrays([pa.array(["cut", *docs, "off"])], names=["text"]).slice(1, len(docs))
    for most in (1, 9, 1 << 20):
        rows = []
        for some in gru_lm.slabs([batch], "text", most):
            words, at = gru_lm.all_tokens(some.column("text"))
            rows += [words.to_pylist()[a:b] for a, b in zip(at, at[1:], strict=False)]
        assert rows == [gru_lm.tokens(x or "") for x in docs]
    words = pa.array([b"b", b"no", b"a", b"no", b"no"])
    assert gru_lm.places(words, pa.array([b"a", b"b"])).tolist() == [1, -1, 0, -1, -1]
    coded, ends = gru_lm.with_ends(np.array([1, -1, 0, -1, -1]), np.array([0, 0, 3, 3, 5]), 8, 9)
    assert [x.tolist() for x in np.split(coded, ends[:-1])] == [[9], [1, 8, 0, 9], [9], [8, 8, 9]]
    opened = gru_lm.opened_words(words, np.array([1, 1, 1, 3, 3]), np.array([False, True, False, True, True]), 4)
    assert opened.to_pylist() == [[], [{"w": b"no", "n": 1}], [], [{"w": b"no", "n": 2}]]


def test_windows_are_not_faulted_in_again():
    """Memory that a window frees serves the next one; a fresh process, as the heap of this one has grown already."""
    code = """if True:
        import resource
        import numpy as np
        from morpholake.llm import gru_lm
        docs = np.random.default_rng(0).integers(0, gru_lm.VOCABULARY, (128, 32 * 60)).astype(np.int16)
        before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
        assert gru_lm.learn(gru_lm.new_state(), docs, gru_lm.VOCABULARY) == docs.size
        print(resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before)
    """
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(gru_lm.__file__).parents[2])
    assert int(done.stdout) < 60 * 200  # some 1,500 a window where the heap is not kept


def test_lanes_and_windows_do_not_matter(monkeypatch):
    (rng, net), end = rough_network(1), gru_lm.VOCABULARY
    docs = [np.append(rng.integers(0, end, n), end) for n in (0, 3, 700, 41, 5)]
    whole = gru_lm.score_documents(net, docs, end)
    alone = [gru_lm.score_documents(net, [d], end)[0] for d in docs]
    monkeypatch.setattr(gru_lm, "LANES", 2)
    assert np.allclose(whole, alone, rtol=1e-4) and np.allclose(whole, gru_lm.score_documents(net, docs, end), rtol=1e-4)


def plain_base(train, docs):
    split = lambda t: (t or "").encode().lower().split()
    c = Counter(w for t in train for w in split(t))
    ends, n, v = len(train), sum(c.values()) + len(train), len(c) + (len(train) > 0)
    scale = math.log10(n + 0.1 * (v + 1)) if n else math.log10(0.1)
    for t in docs:
        ws = split(t)
        yield len(ws) + 1, sum(c[w] > 0 for w in ws) + (ends > 0), n, sum(math.log10(c[w] + 0.1) - scale for w in ws) + math.log10(ends + 0.1) - scale


@pytest.mark.parametrize("head", [200_000, 40])
def test_language_model_base_and_gain(spark, sf, monkeypatch, head):
    """With a small head, most words take the way through the join."""
    from morpholake.llm.queries import op9_gru_lm

    monkeypatch.setattr(gru_lm, "HEAD", head)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    want = dict(zip(docs, plain_base([t for i, t in docs.items() if not held[i]], docs.values()), strict=True))
    rows = op9_gru_lm(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, held[r.doc_id])
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        assert r.score < 0
    if head > gru_lm.VOCABULARY:  # else the vocabulary is as small as the head
        assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_language_model_odd_rows(odd, empty):
    model, counts = gru_lm.train(odd)
    rows = {r.doc_id: r for r in gru_lm.score(odd.drop("score"), model, counts, ["doc_id", "a"]).collect()}
    assert rows[1].n_tokens == rows[2].n_tokens == rows[3].n_tokens == 1 and rows[4].n_tokens == 40_001
    names = {"_row": "row", "_text": "own text", "_open": "open", "_key": "key", "_more_k": "more", "word": "w", "c": "c", "w": "w", "row": "r", "a.b": "dot"}
    clashing = odd.drop("score", "_row", "key").withColumns({k: F.lit(v) for k, v in names.items() if k != "a.b"}).withColumn("a.b", F.lit("dot"))
    for r in gru_lm.score(clashing, model, counts, clashing.columns).collect():
        assert {k: r[k] for k in names} == names and r["words"] == "clash"
    with pytest.raises(ValueError, match="n_tokens"):
        gru_lm.score(odd.drop("score").withColumnRenamed("a", "N_TOKENS"), model, counts, ["N_TOKENS"])
    model, counts = gru_lm.train(empty)
    rows = gru_lm.score(odd.drop("score"), model, counts, ["doc_id"]).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in rows)
    assert gru_lm.score(empty, model, counts, ["doc_id"]).count() == 0


def test_network_learns_from_whole_long_texts(spark):
    """All training rows are one long text: only a network that has read it foresees its words."""
    long = spark.createDataFrame([(1, "left right " * 6_000)], "doc_id long, text string")
    model, counts = gru_lm.train(long, passes=2)
    (row,) = gru_lm.score(long, model, counts, ["doc_id"]).collect()
    assert model.learned == 2 * model.total == 2 * 12_001  # a small table is gone over twice
    assert row.score > row.base_score / 2


def test_windows_hold_every_symbol_once():
    rng = np.random.default_rng(0)
    docs = [np.append(rng.integers(0, 9, n), 9).astype(np.int16) for n in (0, 700, 3, 16, 15, 41, 2_000)]
    held: list[list[int]] = [[] for _ in range(3)]
    done = []
    for live, block in gru_lm.windows(docs, 3):
        done += [x for x, goes_on in zip(held, live, strict=True) if not goes_on]
        held = [x for x, goes_on in zip(held, live, strict=True) if goes_on]
        for x, lane in zip(held, block.T, strict=True):
            x += lane[lane >= 0].tolist()
    split = lambda lanes: sorted(part for lane in lanes for part in "".join(map(str, lane)).split("9"))
    assert split(done + held) == sorted([*("".join(map(str, d[:-1])) for d in docs), *[""] * 3])
