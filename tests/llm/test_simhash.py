import numpy as np
import xxhash

from morpholake.llm import simhash


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(items, bits):
    """items: (id, fingerprint)."""
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if bin(items[i][1] ^ items[j][1]).count("1") <= bits:
                root[find(i)] = find(j)
    low = {}
    for k, (i, _) in enumerate(items):
        r = find(k)
        ids = [x for x in (low.get(r), i) if x is not None]
        low[r] = min(ids) if ids else None
    return [low[find(k)] for k in range(len(items))]


def test_fingerprints_equal_the_definition():
    for text in ("", " \n", "One", "a b c d", "a b c d e a b c d e", "ÄÖ Ünï\x1cx words HERE and there", "x " * 999):
        assert simhash.fingerprint_of(text) == plain_fingerprint(text), text


def test_index_finds_every_link():
    rng = np.random.default_rng(5)
    for trial in range(30):
        n = int(rng.integers(1, 300))
        codes = rng.integers(0, 2**63, max(1, n // 10), dtype=np.uint64)[rng.integers(0, max(1, n // 10), n)]
        for _ in range(trial % 6):
            codes = codes ^ (np.uint64(1) << rng.integers(0, (64, 10)[trial % 2], n).astype(np.uint64))
        codes = np.unique(codes)
        group = rng.integers(0, (1, 4)[trial % 2], len(codes))
        order = np.lexsort((simhash.gray_rank(codes), group))
        codes, group = codes[order], group[order]
        label = simhash.link_labels(codes, group, 4)
        for g in set(group.tolist()):
            mine = np.flatnonzero(group == g)
            assert plain_components([(int(i), int(codes[i])) for i in mine], 4) == label[mine].tolist()


def test_orders_cover_all_differences():
    for blocks in (5, 6, 8):
        orders = simhash.block_orders(blocks, 4)
        rng = np.random.default_rng(blocks)
        for _ in range(200):
            bits = rng.choice(64, 4, replace=False)
            x = np.array([0, sum(1 << int(b) for b in bits)], np.uint64)
            assert any((c := simhash.reorder(x, o))[0] >> np.uint64(64 - w) == c[1] >> np.uint64(64 - w) for o, w in orders)


def test_groups_are_cut_without_losing_links(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**62, 4)
    codes = sorted({int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 20, (60, 2))} | {int(x) for x in rng.integers(0, 2**62, 50)})
    monkeypatch.setattr(simhash, "GROUP_ROWS", 16)
    edges = simhash.links(spark.createDataFrame([(c,) for c in codes], "fp long"))
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    parts = plain_components([(k, c) for k, c in enumerate(codes)], 4)
    by_root, by_part = {}, {}
    for k, c in enumerate(codes):
        by_root.setdefault(found.get(c, c), set()).add(k)
        by_part.setdefault(parts[k], set()).add(k)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_part.values()))


def test_query(spark, sf):
    from morpholake.llm.queries import op3_simhash

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = [(r.doc_id, plain_fingerprint(r.text or "")) for r in docs]
    want = {i: (f"{fp:016x}", c) for (i, fp), c in zip(items, plain_components(items, 4), strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op3_simhash(spark, sf).collect()}
    assert got == want


def test_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    of = {r.doc_id: r.component_id for r in rows}
    assert of[1] == of[2] == of[3] == 1 and of[5] == 5
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(odd.drop("_row"))
    assert kept.columns == odd.drop("_row").columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted([(False, 1), (False, 4), (False, 5), (False, 6), (True, 0)])
