"""SimHash near-duplicates: fingerprints, links within a few bits, connected components.

Links are found in a Gray-order hierarchical index.  Differences of at most d bits leave at least b - d of b blocks of
a fingerprint equal, so the index exists in C(b, d) block orders, each led by another choice of b - d blocks; the top
level of an order, where no difference is allowed, is how Spark deals fingerprints to tasks.  b grows with the number
of distinct fingerprints (lead_blocks), which keeps the groups under a top node small at any size without losing a link.
Inside a task, the rows of a group are sorted by Gray rank; nodes over runs of neighbours hold the mask of the bits all
their members share and the shared pattern; two nodes are compared by accumulated differences of what both share and
pruned as groups.  Nodes that are as a whole in one component are pruned too, so a dense group costs no pairs.

A top group of over GROUP_ROWS fingerprints is cut into slices; each pair of slices is a group of its own, so no task
holds more than two slices and no link is lost.  A task emits at most one link per fingerprint it holds (a spanning
forest).  Components come from rounds of min-label contraction on the links, each written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, discard, free_name, handing_back, map_batches, materialize, pieces, texts

BITS = 64
GROUP_ROWS = 16_384
FANOUT = 8
PAIRS_AT_ONCE = 1_000_000


# ---- fingerprints


def fingerprint_of(text: str, words: int = 4) -> int:
    """The SimHash of a text: shingles of so many words (a shorter text: the whole), repeats included; 0 without words."""
    tokens = text.encode().lower().split()  # bytes: A-Z only, and exactly the six ASCII gaps
    if not tokens:
        return 0
    joined, n = b" ".join(tokens), max(1, len(tokens) - words + 1)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    stops = (ends[len(tokens) - n :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 65_536):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + 65_536], stops[at : at + 65_536], strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", words: int = 4) -> DataFrame:
    """keep columns of docs and fp (bigint, the fingerprint's bits as a signed number); a null text has no words."""
    source = docs.select(*(column(c) for c in dict.fromkeys([*keep, text])))
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField("fp", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            fp = np.array([fingerprint_of(x, words) for x in texts(batch, text)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fp)], names=schema.names)

    return map_batches(source, run, schema)


# ---- the index


def lead_blocks(fingerprints: int, differences: int) -> int:
    """Blocks so that a top group of random fingerprints has about 64 members or fewer."""
    for blocks in range(differences + 1, differences + 5):
        if fingerprints >> (BITS * (blocks - differences) // blocks) <= 64:
            return blocks
    return differences + 5


def block_orders(blocks: int, differences: int) -> list[tuple[list[tuple[int, int]], int]]:
    """For each choice of leading blocks: the (lowest bit, width) of all blocks in order, and the leading width."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    cut = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    out = []
    for lead in combinations(range(blocks), blocks - differences):
        first = [cut[k] for k in lead]
        out.append((first + [cut[k] for k in range(blocks) if k not in lead], sum(w for _, w in first)))
    return out


def reorder(fp: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    """The fingerprints with their blocks in this order, the first one highest."""
    out = np.zeros_like(fp)
    for low, width in order:
        out = (out << np.uint64(width)) | ((fp >> np.uint64(low)) & np.uint64((1 << width) - 1))
    return out


def gray_rank(code: np.ndarray) -> np.ndarray:
    """The place of a code in the Gray sequence: the prefix parity of its bits."""
    out = code.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


def _roots(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of a and b in label, where label[i] <= i is the smallest member's place."""
    while len(a):
        x, y = label[a], label[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        open_ = low != high
        if not open_.any():
            return
        a, b = a[open_], b[open_]
        np.minimum.at(label, high[open_], low[open_])
        while not np.array_equal(label, new := label[label]):
            label[:] = new


def link_labels(codes: np.ndarray, group: np.ndarray, differences: int) -> np.ndarray:
    """For codes sorted by (group, Gray rank): the place of the first member of each one's component, where members of one
    group link at so many differing bits at most."""
    n = len(codes)
    label = np.arange(n)
    if n < 2:
        return label
    # Neighbours in a few Gray orders first: linear work that makes most of a dense group one component.
    for turn in range(0, BITS, 8):
        turned = codes if not turn else (codes << np.uint64(turn)) | (codes >> np.uint64(BITS - turn))
        at = np.arange(n) if not turn else np.lexsort((gray_rank(turned), group))
        for off in (1, 2):
            x, y = at[:-off], at[off:]
            near = (group[x] == group[y]) & (np.bitwise_count(codes[x] ^ codes[y]) <= differences)
            _roots(label, x[near], y[near])
    # Levels of nodes, the leaves first: (first leaf, last leaf + 1, mask of shared bits, pattern under it, first child).
    new = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    first, size = np.arange(n), np.ones(n, np.int64)
    mask, owner = np.full(n, ~np.uint64(0)), np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]).astype(np.int64)]))
    both = codes.copy()
    levels = []
    while True:
        levels.append((first, size, mask, both, owner))
        if len(first) == len(new):
            break
        begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        place = np.arange(len(first)) - np.repeat(begins, np.diff([*begins, len(first)]))
        heads = np.flatnonzero(place % FANOUT == 0)
        ones = np.bitwise_and.reduceat(both | ~mask, heads)
        zeros = np.bitwise_and.reduceat(~both | ~mask, heads)
        shared = np.bitwise_and.reduceat(mask, heads) & (ones | zeros)
        levels[-1] = (*levels[-1], heads)
        first, size, owner = first[heads], np.add.reduceat(size, heads), owner[heads]
        mask, both = shared, ones & shared
    stack = [(len(levels) - 1, k, k) for k in np.array_split(np.arange(len(levels[-1][0])), max(1, len(levels[-1][0]) // PAIRS_AT_ONCE))]
    while stack:
        depth, a, b = stack.pop()
        if len(a) > PAIRS_AT_ONCE:
            half = len(a) // 2
            stack += [(depth, a[:half], b[:half]), (depth, a[half:], b[half:])]
            continue
        first, size, mask, both, _ = levels[depth][:5]
        common = mask[a] & mask[b]
        apart = np.bitwise_count((both[a] ^ both[b]) & common)
        keep = apart <= differences
        a, b, common, apart = a[keep], b[keep], common[keep], apart[keep]
        # Whole nodes: all within reach of one another join at once; all in one component already have nothing to add.
        sure = apart + np.bitwise_count(~common) <= differences
        if depth:
            low = np.minimum.reduceat(label, first)
            uniform = low == np.maximum.reduceat(label, first)
            done = uniform[a] & uniform[b] & (low[a] == low[b])
        else:
            done = a == b
        if sure.any():
            x, y = a[sure & ~done], b[sure & ~done]
            _roots(label, first[x], first[y])
            if depth:
                for s, e in {(int(first[k]), int(first[k] + size[k])) for k in np.unique(np.concatenate([x, y]))}:
                    _roots(label, np.full(e - s - 1, s), np.arange(s + 1, e))
        if not depth:
            continue
        a, b = a[~sure & ~done], b[~sure & ~done]
        if not len(a):
            continue
        heads = levels[depth - 1][5]
        kids = np.diff([*heads, len(levels[depth - 1][0])])
        na, nb = kids[a], kids[b]
        total = na * nb
        of = np.repeat(np.arange(len(a)), total)
        k = np.arange(int(total.sum())) - np.repeat(np.cumsum(total) - total, total)
        x, y = heads[a[of]] + k // nb[of], heads[b[of]] + k % nb[of]
        ordered = x <= y
        x, y = x[ordered], y[ordered]
        m = len(x) // PAIRS_AT_ONCE + 1
        stack += [(depth - 1, p, q) for p, q in zip(np.array_split(x, m), np.array_split(y, m), strict=True)]
    return label


def links(distinct: DataFrame, differences: int = 4, count: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints fp that connect exactly what links within so many bits connect."""
    blocks = lead_blocks(distinct.count() if count is None else count, differences)
    orders = block_orders(blocks, differences)

    def lead(order: list[tuple[int, int]], width: int) -> F.Column:
        out = F.lit(0).cast("long")
        for low, w in order:
            if width <= 0:
                break
            out = F.shiftleft(out, w).bitwiseOR(F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << w) - 1)))
            width -= w
        return out

    keyed = distinct.select("fp", F.posexplode(F.array(*(lead(*o) for o in orders))).alias("o", "top"))
    big = keyed.groupBy("o", "top").count().filter(F.col("count") > GROUP_ROWS).select("o", "top", F.ceil(F.col("count") / (GROUP_ROWS // 2)).cast("int").alias("cuts"))
    own = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    dealt = (
        keyed.join(big, ["o", "top"], "left")
        .withColumn("own", F.coalesce(own, F.lit(0)))
        .withColumn("other", F.explode(F.when(F.col("cuts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("cuts") - 1))))
        .select("o", "top", F.least("own", "other").alias("s1"), F.greatest("own", "other").alias("s2"), "fp")
    )
    key = ["o", "top", "s1", "s2"]
    schema = T.StructType([T.StructField("a", T.LongType(), False), T.StructField("b", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; whole groups are taken together, those of several batches too."""
        held: list[np.ndarray] = []
        rows = 0

        def find(x: np.ndarray) -> pa.RecordBatch:
            fp = np.ascontiguousarray(x[:, 4]).view(np.uint64)
            change = np.any(x[1:, :4] != x[:-1, :4], axis=1)
            group = np.concatenate([[0], np.cumsum(change)])
            code = np.zeros_like(fp)
            for o in np.unique(x[:, 0]).tolist():
                mine = x[:, 0] == o
                code[mine] = reorder(fp[mine], orders[o][0])
            at = np.lexsort((gray_rank(code), group))
            label = link_labels(code[at], group[at], differences)
            fp = fp[at].view(np.int64)
            far = label != np.arange(len(label))
            return pa.RecordBatch.from_arrays([pa.array(fp[label[far]]), pa.array(fp[far])], names=schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1))
            rows += batch.num_rows
            if rows < 4 * GROUP_ROWS:
                continue
            x = np.concatenate(held)
            last = np.flatnonzero(np.any(x[1:, :4] != x[:-1, :4], axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield find(x[:cut])
            held, rows = [x[cut:]], len(x) - cut
        if rows:
            yield find(np.concatenate(held))

    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(handing_back(run), schema)


# ---- components


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with a link: root is the same for connected nodes (their smallest).

    Each round takes every root to the smallest root it has a link to and drops links inside one root; links are
    regrouped by root, so a hub's links shrink by partial aggregation before the shuffle.  Rounds stop when no link is
    left; each round is written to the shared folder, so a lost executor costs one round at most."""
    left = materialize(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").distinct(), "links")
    node = materialize(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "roots")
    while not left.isEmpty():
        best = left.select("a", "b").union(left.select("b", "a")).groupBy("a").agg(F.min("b").alias("m")).filter("m < a")
        best = materialize(best.select("a", "m"), "best")
        # Two hops at once: the target of the target, where it has one.
        far = best.alias("x").join(best.alias("y"), F.col("x.m") == F.col("y.a"), "left").select(F.col("x.a").alias("k"), F.coalesce("y.m", "x.m").alias("to"))
        step = materialize(far, "step")
        new_node = materialize(node.join(step, node["root"] == step["k"], "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        s1, s2 = step.select(F.col("k").alias("k1"), F.col("to").alias("t1")), step.select(F.col("k").alias("k2"), F.col("to").alias("t2"))
        moved = left.join(s1, left["a"] == s1["k1"], "left").select(F.coalesce("t1", "a").alias("a"), "b")
        moved = moved.join(s2, moved["b"] == s2["k2"], "left").select("a", F.coalesce("t2", "b").alias("b"))
        new_left = materialize(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "links")
        for old in (left, node, best, step):
            discard(old)
        left, node = new_left, new_node
    discard(left)
    return node


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, differences: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id: the smallest doc_id reachable over links.

    One row per input row.  Null or wordless texts have fingerprint zero and link like any other.  Rows that repeat a
    doc_id stay, each by its own text.  A null doc_id gets a component like any row but is never the smallest id, so
    component_id is null only where all ids of a component are.  An empty table gives an empty result.  Other columns
    are not read, so their names cannot clash."""
    fps = materialize(fingerprints(docs.select(column(doc_id).alias("doc_id"), column(text).alias("text")), ["doc_id"], words=words), "fingerprints")
    groups = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "groups")
    node = components(links(groups.select("fp"), differences, groups.count()))
    joined = groups.join(node, groups["fp"] == node["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    final = joined.select("fp", "root").join(lows, "root").select(F.col("fp").alias("key"), "component_id")
    return fps.join(final, fps["fp"] == final["key"]).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 4, differences: int = 4) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the smallest doc_id, null ids last, of equal ids one.

    All columns stay, whatever their names.  Rows get a number of their own in a written table, so rows that repeat an id
    cannot both stay.  Null and wordless texts are one group; an empty table stays empty."""
    row, gone_row = free_name("_row", docs.columns), free_name("_gone", docs.columns)
    staged = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "staged")
    key = F.struct(column(doc_id).isNull().alias("last"), column(doc_id).alias("id"), F.col(row).alias("row"))
    found = near_duplicates(staged.select(key.alias("doc_id"), column(text).alias("text")), words=words, differences=differences)
    gone = found.filter(F.col("doc_id.row") != F.col("component_id.row")).select(F.col("doc_id.row").alias(gone_row))
    return staged.join(gone, F.col(row) == F.col(gone_row), "left_anti").drop(row)
