"""The operators that run on DataFrame functions only."""

import itertools
import math
import random
import re
from collections import Counter

import pytest

from morpholake.llm import decontaminate, quality, url_filter
from morpholake.llm.queries import page_is_bad

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima mike november oscar papa quebec romeo sierra tango".split()


def test_substituted_copies_are_found(spark):
    item = " ".join(WORDS)
    changed = WORDS.copy()
    changed[3], changed[9], changed[15] = "x", "y", "z"
    docs = [(1, f"intro text {item} and more"), (2, "Before. " + " ".join(changed).upper() + "!"), (3, " ".join(reversed(WORDS))), (4, " ".join(WORDS[:6])), (5, "so short an item it is"), (6, "an other item short so")]
    bench = [(10, item), (11, "short an item"), (12, "an"), (13, None)]
    rows = {r.doc_id: r for r in decontaminate.judge(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert [rows[k].items for k in range(1, 7)] == [[10], [10], [], [], [11, 12], [12]]
    assert rows[1].matched == 1.0 and 0.8 <= rows[2].matched < 1.0


def plain_leaks(docs, items):
    """Every alignment of every item with every document."""
    words = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    out = {}
    for d, t in docs:
        dw = words(t)
        for i, u in items:
            iw = words(u)
            n = min(len(iw), decontaminate.VERIFY)
            if not n:
                continue
            for shift in range(-len(iw), len(dw)):
                same = [0 <= p + shift < len(dw) and dw[p + shift] == iw[p] for p in range(len(iw))]
                inside = [0 <= p + shift < len(dw) for p in range(len(iw))]
                for k in range(len(iw) - n + 1):
                    if all(inside[k : k + n]) and sum(same[k : k + n]) >= decontaminate.SHARE * n:
                        out.setdefault(d, set()).add(i)
    return out


def test_leaks_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("n_chars < 3000").limit(60)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    copies = bench.selectExpr("item_id + 100000 as doc_id", "concat('Some words first. ', text) as text").limit(8)
    both = docs.select("doc_id", "text").unionByName(copies)
    want = plain_leaks([(r.doc_id, r.text) for r in both.collect()], [(r.item_id, r.text) for r in bench.collect()])
    got = {r.doc_id: set(r["items"]) for r in decontaminate.judge(both, bench).collect() if r.contaminated}
    assert got == want and len(want) >= 8


def test_masks_miss_no_substitution():
    """Any words of which SHARE stay equal keep the positions of one mask, for every length of item."""
    for n in range(1, decontaminate.VERIFY + 1):
        k = max(k for k in range(n) if (n - k) / n >= decontaminate.SHARE)
        masks = [(m, 0) for m in decontaminate.masks_for(n)] if n < decontaminate.VERIFY else [(m, o) for m in decontaminate.MASKS for o in range(n - m[-1])]
        for gone in itertools.combinations(range(n), k):
            assert any(not {p + o for p in m} & set(gone) for m, o in masks), (n, gone)


def changed_copies(rng, n, k):
    """An item of n words of its own, and a text that holds it with k words changed."""
    item = [f"w{rng.randrange(10**6)}" for _ in range(n)]
    copy = item.copy()
    for p in rng.sample(range(n), k):
        copy[p] = f"other{p}"
    return " ".join(item), " ".join(["before", *copy, "after", "that"])


@pytest.mark.parametrize("broadcast", [True, False])
def test_short_and_long_items_are_found(spark, monkeypatch, broadcast):
    """Items of 1 to 40 words with as many substitutions as SHARE allows and with one more; both ways of joining agree."""
    if not broadcast:
        monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
        monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", 0)
    rng, docs, items = random.Random(8), [], []
    for n in [*range(1, 16), 40]:
        k = max(k for k in range(n) if (min(n, 13) - k) / min(n, 13) >= decontaminate.SHARE)
        for extra in (0, 1):
            if n > 13 and extra:
                continue
            item, copy = changed_copies(rng, n, min(n, k + extra))
            items.append((100 * n + extra, item))
            docs += [(100 * n + extra, copy), (10_000 + 100 * n + extra, item)]
    shared = "choose the best answer to each of the following questions and explain why you chose it"
    items += [(9_000 + k, f"{shared} {k}") for k in range(5)]
    docs += [(90_000, f"so {shared} says"), (90_001, " ".join(f"v{k % 3000}" for k in range(20_000)) + " " + shared), (90_002, "word " * 500), (90_003, "今日は天気がいいですね。")]
    items += [(9_100, "word " * 30), (9_200, "天気がいいです")]
    want = plain_leaks([(i, t) for i, t in docs if i != 90_001], items)
    want[90_001] = want[90_000]
    assert 90_003 not in want  # the plain version knows no unspaced scripts
    got = {r.doc_id: set(r["items"]) for r in decontaminate.judge(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect() if r.contaminated}
    assert got.pop(90_003) == {9_200}
    assert got == want and all(10_000 + 100 * n in got for n in range(1, 16))
    assert all(100 * n in got for n in range(3, 16)) and not any(100 * n + 1 in got for n in range(3, 14))


def test_leaks_of_odd_rows(odd, empty, spark):
    bench = spark.createDataFrame([(1, "same row twice"), (2, "word word word word word word word word word word word word word word")], "item_id long, text string")
    found = decontaminate.judge(odd, bench).collect()
    assert len(found) == odd.count()
    assert {(r.doc_id, tuple(r["items"])) for r in found if r.contaminated} == {(5, (1,)), (4, (2,))}
    assert decontaminate.judge(empty, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.judge(odd, empty.selectExpr("doc_id as item_id", "text")).collect())
    kept = decontaminate.remove_leaks(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3


@pytest.fixture()
def pages(spark):
    bad, good = "<p>" + "#$%" * 200, "<p>plain words " * 20
    rows = [(k, f"https://Spam.Example.net/fr/{k}?q#f", bad) for k in range(60)] + [(100 + k, f"http://ok.example.org/en/{k}", good) for k in range(60)]
    rows += [(300, "https://x.spam.example.net/de/8a", good), (301, "https://example.com/en/71", bad), (302, "https://a.b.com/en/", None), (303, None, None), (304, "no scheme", good), (305, "http://HOST?x://y/z", None), (306, "http://ok.example.org/es/1#/x", good), (300, "https://x.spam.example.net/de/8a", good)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_urls(pages, spark):
    rows = {r.page_id: r for r in url_filter.judge(pages.withColumn("host", page_is_bad()), page_is_bad()).collect()}
    assert rows[0].host == "spam.example.net" and rows[0].path == "/fr/0" and rows[0].verdict == "block" and rows[0].rule is None
    assert rows[100].verdict == "allow"
    assert (rows[300].rule, rows[300].verdict) == ("example.net/de/8", "block")
    assert (rows[301].rule, rows[301].verdict) == ("example.com/en/7", "allow")
    assert (rows[302].rule, rows[302].verdict) == ("com/en/", "block")
    assert rows[303].host == rows[304].host == "" and rows[303].path == ""
    assert (rows[305].host, rows[305].path) == ("host", "")
    assert rows[306].rule == "org/es/" and rows[306].path == "/es/1"
    assert url_filter.judge(pages, page_is_bad()).count() == pages.count()
    assert url_filter.judge(pages.limit(0), page_is_bad()).count() == 0


def test_shrinkage(spark):
    """One bad page does not block a host; many do; a new host leans on its domain."""
    rows = [("bad.x.net", True)] * 80 + [("good.y.org", False)] * 80 + [("once.y.org", True), ("new.x.net", None)] + [("mid.y.org", k % 4 == 0) for k in range(40)]
    found = {r.host: r for r in url_filter.reputation(spark.createDataFrame(rows, "host string, bad boolean")).collect()}
    assert found["bad.x.net"].low > url_filter.LIMIT > found["once.y.org"].low
    assert found["new.x.net"].mean > found["once.y.org"].mean > found["good.y.org"].mean


def plain_measures(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = Counter(windows)
    covered = {p for i, w in enumerate(windows) if twice[w] > 1 for p in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measures(spark, sf):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += [(9001, "a b c d e f g h " * 3), (9002, "x\n\nx\n x\nx\r\n"), (9003, None), (9004, "é🙂 #*\u00a0|"), (9005, "a b c d e f g h i a b c d e f g h"), (9006, "w " * 50), (9007, "\n\n \n")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for r in quality.measures(docs, ["doc_id"]).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_measures(dict(texts)[r.doc_id]), r.doc_id


def near_quantile(values, p):
    """What percentile_approx gives where its sketch is exact."""
    v = sorted(values)
    return v[max(0, math.ceil(p * len(v)) - 1)]


def plain_shrunk(groups, own, parent_of_all):
    """own thresholds of (lang, source) -> rows, shrunk level by level."""
    def level(rows, parent):
        n, mine = own(rows)
        return [(n * m + quality.PRIOR * p) / (n + quality.PRIOR) for m, p in zip(mine, parent, strict=True)] if n else parent

    every = [r for rows in groups.values() for r in rows]
    top, out = level(every, parent_of_all(every)), {}
    for lang in {k[0] for k in groups}:
        middle = level([r for k, rows in groups.items() if k[0] == lang for r in rows], top)
        out |= {k: level(rows, middle) for k, rows in groups.items() if k[0] == lang}
    return out


def plain_kept(docs):
    """doc_id -> kept, row by row; docs: (doc_id, text, lang, source)."""
    groups, measured = {}, {}
    for i, text, lang, source in docs:
        n, chars, symbols, dups, repeats = plain_measures(text)
        lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (text or "").split("\n"))
        measured[i] = r = {"n": n, "length": chars / n if n else None, "shares": [(symbols, n, 1), (dups, lines, 1), (repeats, n, 2 * quality.WINDOW)], "failed": n < 20 or 100 * repeats > 30 * n, "group": (lang, source)}
        groups.setdefault((lang, source), []).append(r)

    def lengths(rows):
        v = [r["length"] for r in rows if not r["failed"]]
        if not v:
            return 0, [0, 0]
        a, b = near_quantile(v, 0.25), near_quantile(v, 0.75)
        return len(v), [a - quality.FENCE * (b - a), b + quality.FENCE * (b - a)]

    middle = lambda rows: near_quantile([r["length"] for r in rows if not r["failed"]], 0.5)
    fences = plain_shrunk(groups, lengths, lambda rows: [middle(rows) / 2, middle(rows) * 2])
    for r in measured.values():
        low, high = fences[r["group"]]
        r["inside"] = not r["failed"] and low <= r["length"] <= high

    def shares(rows):
        rows = [r for r in rows if r["inside"]]
        if not rows:
            return 0, [0, 0, 0]
        return len(rows), [max(near_quantile([r["shares"][k][0] / r["shares"][k][1] for r in rows], quality.LEVEL), rows[0]["shares"][k][2] / near_quantile([r["shares"][k][1] for r in rows], 0.5)) for k in range(3)]

    most = plain_shrunk(groups, shares, lambda rows: [1.0] * 3)
    return {i: r["inside"] and all(k <= n * f + quality.Z * math.sqrt(e * n * f) for (k, n, e), f in zip(r["shares"], most[r["group"]], strict=True)) for i, r in measured.items()}


def test_kept_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs += [(9001, None, "en", None), (9002, "few words", None, "s"), (9003, " ".join(WORDS * 2), None, None)]
    want = plain_kept(docs)
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()}
    assert got == want and 0 < sum(got.values()) < len(got)


def plain_text(k, words=60):
    return " ".join(f"{WORDS[(7 * k + j) % 20]}{10_000 + k * 31 + j}" for j in range(words))


def test_each_threshold_drops_a_text(spark):
    rows = [(k, "\n".join(plain_text(k + 250 * j, 30) for j in range(4)), "en", "s") for k in range(900)]
    lines = "\n".join(f"{plain_text(j, 9)}\nsame line" for j in range(60))
    long = plain_text(4, 3000).split()
    junk = [plain_text(1) + " ###" * 10, lines, " ".join(f"{w}{'x' * 12}" for w in plain_text(3).split()), " ".join(long[:400] + long)]
    found = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows + [(9000 + k, x, "en", "s") for k, x in enumerate(junk)], "doc_id long, text string, lang string, source string")).collect()}
    assert all(found[k].kept for k in range(900))
    assert not any(found[9000 + k].base_failed or found[9000 + k].kept for k in range(4))


def test_sources_differ_in_what_they_allow(spark):
    """The same text is usual in one source and junk in another."""
    odd = f"{plain_text(7)} x < 7 & y | z #t $u" + " & *" * 4
    rows = [(k, f"{plain_text(k)} x < {k} & y | z #t $u" + " & *" * (k % 5), "en", "code") for k in range(600)] + [(1000 + k, plain_text(k), "en", "prose") for k in range(600)]
    found = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame([*rows, (5000, odd, "en", "code"), (5001, odd, "en", "prose")], "doc_id long, text string, lang string, source string")).collect()}
    assert found[5000] and not found[5001]
    assert all(found[k] for k in range(1000, 1600))


def test_quality_odd_rows(odd, empty):
    rows = quality.judge(odd).collect()
    assert len(rows) == odd.count() and all(r.base_failed and not r.kept for r in rows)
    assert quality.judge(empty).count() == 0


def test_quality_query(spark, sf):
    from morpholake.llm.queries import op10_quality

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op10_quality(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, chars, symbols, lines, repeats = plain_measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert r.base_failed == (n < 20 or 100 * repeats > 30 * n) and not (r.kept and r.base_failed)


def test_levels_of_hosts(spark):
    hosts = spark.createDataFrame([("a.co.uk",), ("x.b.co.uk:8080",), ("me@www.c.org",), ("co.uk",), ("",), ("plain",)], "host string")
    suffixes = spark.createDataFrame([("uk",), ("co.uk",), ("org",)], "suffix string")
    got = {r["host"]: (r["domain"], r["suffix"]) for r in url_filter.with_levels(hosts, suffixes).collect()}
    assert got == {"a.co.uk": ("a.co.uk", "co.uk"), "x.b.co.uk:8080": ("b.co.uk", "co.uk"), "me@www.c.org": ("c.org", "org"), "co.uk": ("co.uk", "co.uk"), "": ("", ""), "plain": ("plain", "plain")}
    alone = {r["host"]: (r["domain"], r["suffix"]) for r in url_filter.with_levels(hosts).collect()}
    assert alone["x.b.co.uk:8080"] == ("co.uk", "uk") and alone["me@www.c.org"] == ("c.org", "org")


def test_quality_of_a_dotted_id(spark):
    docs = spark.createDataFrame([(1, "word " * 30, "en", "s")], "`my.id` long, text string, lang string, source string")
    assert quality.judge(docs, doc_id="my.id").first()["doc_id"] == 1
