"""Small fixtures with stated results."""

import math

import numpy as np

import pytest
from pyspark.sql import functions as F

from morpholake.functions import numeric, scalars
from morpholake.operators import aggregates, filters, graph, joins, ordered, sets, voxels

ATOMS = [("C", "CA", "A", "A", 12, 12), ("N", "N", "B", "B", 12, 12), ("C", "CA", "A", "A", 30, 30)]


@pytest.fixture()
def atoms(spark):
    return spark.createDataFrame([(k, *a) for k, a in enumerate(ATOMS)], "i int, type_symbol string, label_atom_id string, label_asym_id string, auth_asym_id string, label_seq_id int, auth_seq_id int")


@pytest.mark.parametrize(("text", "want"), [("chain B", [1]), ("resi 20:10", [0, 1]), ("chain B or chain A and resi 30", [1, 2]), ("not (chain A and resi 30)", [0, 1]), ("CHAIN A AND atom CA and element C", [0, 2]), ("chain a", []), ("resi -5:12", [0, 1]), ("(chain A)", [0, 2]), ("not not chain B", [1])])
def test_residue_text(atoms, text, want):
    assert sorted(r.i for r in atoms.filter(filters.residue_filter(text)).collect()) == want


@pytest.mark.parametrize("text", ["", "  ", "chain", "chain and resi 3", "resi x", "resi 1:", "colour red", "resi 1:2:3"])
def test_bad_residue_text(text):
    with pytest.raises(ValueError):
        filters.residue_filter(text)


@pytest.mark.parametrize("text", ["chain A and", "and chain A", "(chain A", "chain A resi 3", "chain A)"])
def test_bad_residue_grammar(atoms, text):
    from pyspark.errors import ParseException

    with pytest.raises((ParseException, ValueError)):
        atoms.filter(filters.residue_filter(text)).collect()


def test_missing_residue_fields_do_not_match(spark):
    df = spark.createDataFrame([(None, None)], "label_asym_id string, auth_asym_id string")
    assert df.filter(filters.chain("A")).count() == 0 and df.filter(~filters.chain("A")).count() == 1


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_numbers(spark):
    r = one(spark, a=numeric.half_up(F.lit(-2.5)), b=numeric.half_up(F.lit(2.5)), c=numeric.integer_prefix(F.lit("12x")), d=numeric.integer_prefix(F.lit("x")), e=numeric.between(F.lit(float("nan")), 0, 9), f=numeric.number_prefix(F.lit("1.5e2abc")), g=numeric.percent_or_infinite(F.lit(0.0), F.lit(1.0)))
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == (-2.0, 3.0, 12, None, False, 150.0, math.inf)


def test_strings(spark):
    r = one(
        spark, a=scalars.base_label(F.lit("Nodule 1 — FU")), b=scalars.locus(F.lit("chr1:1,000-2,000")), c=scalars.locus(F.lit("chr1")), d=scalars.date_text(F.lit("20240131")), e=scalars.date_text(F.lit("x")), f=scalars.time_text(F.lit("101530.5")),
        g=scalars.attributes(F.lit("ID=a;Name=x%20y;ID=b+c")), h=scalars.attributes(F.lit('gene_id "G"; transcript_id "T";'), "gtf"), i=scalars.fnv1a(F.lit("hello")), j=scalars.bytes_text(F.lit(1536)), k=scalars.tag_key(F.lit(16), F.lit(0x1030)), l=scalars.escape_html(F.lit("<a href='x'>&\"")),
    )
    assert r.a == "Nodule 1" and tuple(r.b) == ("chr1", 999, 2000) and r.c is None and r.d == "2024-01-31" and r.e == "x" and r.f == "10:15:30"
    assert r.g == {"Name": "x y", "ID": "b+c"} and r.h == {"gene_id": "G", "transcript_id": "T"}
    assert r.i == "4f9f2cab" and r.j == "1.5 KB" and r.k == "00101030" and r.l == "&lt;a href=&#39;x&#39;&gt;&amp;&quot;"


def test_scales(spark):
    r = one(spark, a=scalars.window_level(F.lit(50.0), 400.0, 40.0), b=scalars.slope_intercept(F.lit(0xFFF), 12, True, 2, 1), c=scalars.doubling_time(F.lit(1.0), F.lit(2.0), F.lit(30.0)), d=scalars.doubling_time(F.lit(2.0), F.lit(1.0), F.lit(30.0)), e=scalars.ramp([(0, 0), (10, 1)], F.lit(2.5)), f=scalars.ramp([], F.lit(1)))
    assert (r.a, r.b, round(r.c, 9), r.d, r.e, r.f) == (255 * 210 / 400, -1.0, 30.0, math.inf, 0.25, None)
    assert scalars.compose_affine([1.0, 0, 0, 1, 0, 1.0, 0, 2, 0, 0, 1.0, 3], [1.0, 0, 0, 4, 0, 1.0, 0, 5, 0, 0, 1.0, 6])[3::4] == [5.0, 7.0, 9.0]


def test_lesion_delta(spark):
    schema = "row_no int, kind string, label string, value double, unit string"
    base = spark.createDataFrame([(1, "length", "Nodule 1", 20.0, "mm"), (2, "length", "Nodule 2", 10.0, "mm"), (3, "length", "Nodule 1", 99.0, "mm"), (4, "angle", "Other", 1.0, "mm")], schema)
    fu = spark.createDataFrame([(1, "length", "Nodule 1 — FU", 25.0, "mm"), (2, "roi", "Nodule 3", 5.0, "mm")], schema)
    rows = {r.label: (r.baseline, r.followup, r.delta, r.pct_change) for r in joins.lesion_delta(base, fu).collect()}
    assert rows == {"Nodule 1": (20.0, 25.0, 5.0, 25.0), "Nodule 2": (10.0, None, None, None), "Nodule 3": (None, 5.0, None, None)}


def test_registries(spark):
    doses = spark.createDataFrame([("a", 1.0), ("b", float("nan")), ("c", -1.0), ("d", None)], "series string, x double")
    assert aggregates.null_rates(doses, ["x"]).first().x == 0.75
    assert aggregates.null_rates(doses.limit(0), ["x"]).first().x == 1.0
    uids = spark.createDataFrame([("1.2.840.10008.1.2.4.50",), (None,), ("1.2.840.10008.1.2",)], "u string")
    assert aggregates.compression_audit(uids, "u").first()[0] == 0.667
    cards = spark.createDataFrame([("a", 0.0, 1, 0, 0), ("b", 0.5, 0, 0, 0), ("c", 0.0, 0, 2, 0)], "series string, burned double, replace int, remove int, keep int")
    assert [r.ready for r in aggregates.deid_card(cards).orderBy("series").collect()] == [True, False, False]
    with pytest.raises(Exception, match="deid-bad-fraction"):
        aggregates.deid_card(cards.withColumn("burned", F.lit(2.0))).collect()


def test_phantom(spark):
    rows = [("q", "s2", "2024-02-01", 2.0, 2), ("q", "s1", "2024-01-01", 0.0, 1), ("q", "s3", "2024-03-01", 8.0, 3)]
    df = spark.createDataFrame(rows, "site string, series string, date string, mean_hu double, row_no int").withColumn("expected_hu", F.lit(0.0)).withColumn("tolerance_hu", F.lit(5.0))
    assert [(r["pass"], r.drift_hu) for r in ordered.phantom_trend(df, ["site"]).orderBy("date").collect()] == [(True, 0.0), (True, 2.0), (False, 8.0)]


def test_cells(spark):
    tile = [(0, x, y, 100.0) for x in (1, 2) for y in (1, 2)] + [(0, 3, 3, 50.0)] + [(1, x, 0, 9.0) for x in range(4)]
    cells = {(r.tile, r.first): r for r in graph.label_cells(spark.createDataFrame(tile, "tile int, x int, y int, v double"), 6, 1.0).collect()}
    block, bar = cells[0, 7], cells[1, 0]
    assert (block.area, block["mean"], block.perimeter, block.extent) == (4, 100.0, 8, 1.0) and abs(block.form_factor - math.pi / 4) < 1e-9
    assert (bar.perimeter, bar.aspect) == (10, 4.0) and cells[0, 21].area == 1


def test_components_of_a_path_and_a_cycle(spark):
    nodes = spark.range(60).withColumnRenamed("id", "node")
    pairs = [(k, k + 1) for k in range(0, 39)] + [(40, 41), (41, 42), (42, 40)]
    out = {r.node: r.component for r in graph.components(nodes, spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(out[k] == 0 for k in range(40)) and all(out[k] == 40 for k in (40, 41, 42)) and all(out[k] == k for k in range(43, 60))


def test_ancestors_of_a_deep_chain(spark):
    rows = graph.ancestors(spark.createDataFrame([(k, k + 1) for k in range(35)], "node int, parent int")).collect()
    assert {(r.node, r.ancestor): r.depth for r in rows} == {(a, b): b - a for a in range(36) for b in range(a, 36)}


def test_ancestors_stop_at_cycles(spark):
    rows = graph.ancestors(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", None)], "node string, parent string")).collect()
    assert sorted((r.ancestor, r.depth) for r in rows if r.node == "a") == [("a", 0), ("b", 1), ("c", 2)] and len([r for r in rows if r.node == "d"]) == 1


def test_border_distance_has_no_bound(spark):
    line = spark.range(135).selectExpr("0 AS series", "cast(id AS int) AS x")
    out = {r.x: r.distance for r in graph.border_distance(line, ("x",)).collect()}
    assert out == {x: min(x + 1, 135 - x) for x in range(135)}  # 68 in the middle


def test_morphology_properties(spark):
    import random

    rng, dims = random.Random(1), (6, 5, 4)
    cube = [(0, x, y, z) for x in range(6) for y in range(5) for z in range(4) if rng.random() < 0.8]
    mask = spark.createDataFrame(cube, "series int, x int, y int, z int")
    get = lambda df: {(r.x, r.y, r.z) for r in df.collect()}
    m, e, d = get(mask), get(voxels.erode(mask)), get(voxels.dilate(mask, dims))
    assert e <= m <= d and get(voxels.morph_open(mask, dims)) <= m and get(voxels.outline(mask)) == m - e
    opened = voxels.morph_open(mask, dims)
    assert get(voxels.morph_open(opened, dims)) == get(opened)


def test_sets_and_order(spark):
    a, b = spark.createDataFrame([(1,), (1,), (3,)], "k int"), spark.createDataFrame([(1,), (2,)], "k int")
    assert sorted(r.k for r in sets.intersect_keeping(a, b, ["k"]).collect()) == [1, 1]
    assert [r.k for r in sets.ordered_union(a, b, "k").collect()] == [1, 2, 3]
    with pytest.raises(Exception, match="label out of range"):
        sets.overlay(spark.createDataFrame([(0, 300)], "x int, label int"), ["x"]).collect()
    rows, rest = ordered.limit_with_rest(a, 2, "k")
    assert rows.count() == 2 and rest == 1
    assert [r.k for r in ordered.seeded_order(spark.range(9).withColumnRenamed("id", "k"), "k", 3).collect()] == [r.k for r in ordered.seeded_order(spark.range(9).repartition(3).withColumnRenamed("id", "k"), "k", 3).collect()]


def test_transforms(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", float("nan")), (None, 100.0)], "k string, v double")
    keep = lambda *s: sorted(str(r.k) for r in filters.apply_transforms(df, list(s)).collect())
    assert keep(filters.Keep("v", in_range=(0, 10))) == ["a"] and keep(filters.Keep("v", in_range=(0, 10), negate=True)) == ["None", "b"]
    assert keep(filters.Keep("k", one_of=("a",), negate=True)) == ["None", "b"] and keep(filters.Keep("k", in_range=(0, 1))) == []


def test_bins_equal_the_plain_interval_join(spark):
    import random

    rng = random.Random(2)
    v = [(k, f"c{rng.randint(0, 1)}", rng.randint(1, 300)) for k in range(200)]
    e = [(k, f"c{rng.randint(0, 1)}", s := rng.randint(1, 300), s + rng.choice([0, 2, 200]), "A", 10 * k, rng.choice([1, -1])) for k in range(60)]
    got = {r.variant_id: r.res_seq for r in joins.link_variants(spark.createDataFrame(v, "variant_id int, chrom string, pos long"), spark.createDataFrame(e, "entry_no int, chrom string, start long, end long, chain string, res_start long, strand int"), 16).collect()}
    for k, c, p in v:
        hit = next((x for x in e if x[1] == c and x[2] <= p <= x[3]), None)
        assert got[k] == (None if hit is None else hit[5] + (0 if hit[2] == hit[3] else hit[6] * (p - hit[2])))


def test_holes_take_the_label_around_them(spark):
    ring = lambda z, label: [("s", z, x, y, label(x, y)) for x in range(5) for y in range(5) if max(abs(x - 2), abs(y - 2)) == 1]
    mask = spark.createDataFrame(ring(0, lambda x, y: 2 if y > 1 else 7) + ring(1, lambda x, y: 4), "series string, z int, x int, y int, label int")
    rows = lambda **how: sorted(tuple(r) for r in graph.fill_holes(mask, 5, 5, **how).select("z", "x", "y", "label").collect())
    assert rows(label=9) == [(0, 2, 2, 9), (1, 2, 2, 9)]
    assert rows(label=0) == [(0, 2, 2, 2), (1, 2, 2, 4)]
    assert rows(label=0, locked=(2,)) == [(1, 2, 2, 4)] and rows(label=9, locked=(9,)) == []


def test_running_values_of_one_large_group(spark):
    """One group holds most of the rows; its rows spread over partitions and results stay those of a plain fold."""
    import random as plain

    rng = plain.Random(3)
    rows = [("hot" if rng.random() < 0.8 else f"k{rng.randrange(5)}", i, rng.randrange(400) / 10, rng.choice(["open", "finish", "sign", "unlock", "other"])) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, row_no long, at double, action string").repartition(4)
    want, clusters = {}, {}
    for g in {r[0] for r in rows}:
        anchor, k, phase = None, -1, 0
        for _, i, at, _ in sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1])):
            if anchor is None or at - anchor >= 0.35:
                anchor, k, phase = at, k + 1, 0
            else:
                phase += 1
            clusters[i] = (k, phase)
        state = "unread"
        for r in (r for r in rows if r[0] == g):
            state = ordered.MOVES[state].get(r[3], state)
        want[g] = (sum(r[0] == g for r in rows), state)
    got = ordered.anchored_clusters(df, ["g"], "at", 0.35).collect()
    assert {r.row_no: (r.cluster, r.phase) for r in got} == clusters and len(got) == len(rows)
    assert {r.g: (r.n_events, r.state) for r in ordered.read_states(df, "g", "action", ["row_no"]).collect()} == want
    from morpholake.operators import running

    for g, low, mid in running.percentile(df, ["g"], "at", low=0.1, mid=0.5).collect():
        values = [r[2] for r in rows if r[0] == g]
        assert abs(low - np.percentile(values, 10)) < 1e-9 and abs(mid - np.percentile(values, 50)) < 1e-9


def test_entries_on_one_interval_are_one_before_they_meet_variants(spark):
    entries = spark.createDataFrame([(k, "c", 5, 70, "A" if k == 3 else "B", k * 100, 1) for k in range(9, 2, -1)] + [(1, "c", 60, 61, "C", 7, -1)], "entry_no long, chrom string, start long, end long, chain string, res_start long, strand int")
    variants = spark.createDataFrame([(1, "c", 5), (2, "c", 5), (3, "c", 60), (4, "c", 61), (5, "c", 71), (6, None, 6)], "variant_id long, chrom string, pos long")
    linked = joins.link_variants(variants, entries)
    assert {r.variant_id: (r.chain, r.res_seq) for r in linked.collect()} == {1: ("A", 300), 2: ("A", 300), 3: ("C", 7), 4: ("C", 6), 5: (None, None), 6: (None, None)}
    plan = linked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Aggregate [chrom") > plan.index("Generate explode")


def test_neighbours_of_copies_without_broadcasts(spark):
    at = [(0, 0, 0), (0, 0, 0), (1, 0, 0), (1, 0, 0), (9, 9, 9), (3, 0, 0), (None, 0, 0), (None, 0, 0)]
    points = spark.createDataFrame([(k, 1, *(None if c is None else float(c) for c in p)) for k, p in enumerate(at)], "point_id long, block int, x double, y double, z double")
    pairs = joins.neighbours(points, 2.0, block="block")
    assert sorted((r.a, r.b, r.distance) for r in pairs.collect()) == [(0, 1, 0.0), (0, 2, 1.0), (0, 3, 1.0), (1, 2, 1.0), (1, 3, 1.0), (2, 3, 0.0), (2, 5, 2.0), (3, 5, 2.0)]
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_pockets_by_places_equal_those_of_pairs(spark):
    from random import Random

    random = Random(4)
    rows = [(k, random.randrange(2), *(float(random.randrange(5)) for _ in "xyz")) for k in range(150)] + [(150, 0, None, 0.0, 0.0), (151, 0, None, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "point_id long, block int, x double, y double, z double")
    for buried, least in ((6, 1), (9, 3)):
        want = graph.pockets(points.selectExpr("point_id as node"), joins.neighbours(points, 1.0, block="block"), buried, least)
        got = joins.pockets_near(points, 1.0, buried, least, block="block")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 3


def test_byte_texts_take_halves_to_the_even_digit(spark):
    n = [1023, 1280, 1792, 1281, 1024**2 * 5 // 4, 1024**2 * 7 // 4, 1024**3 * 9 // 4, None]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(n)], "k long, n long").select("k", scalars.bytes_text(F.col("n")).alias("t")).orderBy("k")
    assert [r.t for r in rows.collect()] == ["1023 B", "1.2 KB", "1.8 KB", "1.3 KB", "1.2 MB", "1.8 MB", "2.2 GB", "—"]


def test_rasterized_contours_hold_no_pixels(spark):
    """Two overlapping boxes, even-odd: no pixel twice, without an aggregate over pixels, and over all tasks of a shuffle."""
    box = lambda roi, k, a, b: [(roi, 0, k, i, float(x), float(y)) for i, (x, y) in enumerate(((a, a), (b, a), (b, b), (a, b)))]
    contours = spark.createDataFrame([*box(1, 0, 1, 5), *box(1, 1, 3, 7), *box(2, 0, 0, 2)], "roi int, z int, contour int, order int, px double, py double").coalesce(1)
    mask = voxels.rasterize(contours, 6)
    one = {(x, y) for x in range(6) for y in range(8) if (1 <= x < 5 and 1 <= y < 5) != (3 <= x < 7 and 3 <= y < 7)}
    assert sorted((r.roi, r.x, r.y) for r in mask.collect()) == sorted([(1, *p) for p in one] + [(2, x, y) for x in range(2) for y in range(2)])
    assert "Aggregate" not in mask._jdf.queryExecution().executedPlan().toString() and mask.rdd.getNumPartitions() >= 4


def test_overlapping_equals_brute_force_in_lists(spark):
    """Copies of an interval, an id given twice, intervals over several bins, turned round, below zero or with nulls."""
    rows = [(100 * k, "chr1", 7, 150) for k in range(7)] + [(k, "chr1", 149, 151) for k in (5, 5, 900)] + [(11, "chr1", 150, 160), (12, "chr2", 7, 150), (1300, "chr1", 200, 60), (14, "chr1", 50, 260), (1500, "chr1", -70, 8), (None, "chr1", 7, 150), (1600, None, 7, 150), (1700, "chr1", None, 150), (1800, "chr1", 7, None)]
    f = spark.createDataFrame(rows, "feature_id long, chrom string, start long, end_ long")
    whole = [r for r in rows if None not in r]
    want = sorted((a[0], b[0]) for a in whole for b in whole if a[0] % 100 == 0 and a[0] != b[0] and a[1] == b[1] and a[2] < b[3] and b[2] < a[3])
    for options in ({}, {"chunk": 2, "shares": 3}, {"width": 1000}):
        assert sorted(map(tuple, joins.overlapping(f.filter("feature_id % 100 = 0"), f, **options).collect())) == want


def _shuffled_rows(spark):
    """Written to shuffles by the session's stages so far."""
    sc, jvm = spark.sparkContext, spark._jvm
    stages = sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_overlapping_shuffles_lists_of_features(spark, tmp_path):
    """2,000 features on one locus of 51 bins: a bin gets lists of them, once as none is crowded, and pairs are made after the shuffle."""
    spark.range(2000).selectExpr("id AS feature_id", "'chr1' AS chrom", "7L AS start", "3207L AS end_").write.parquet(f"{tmp_path}/f")
    f = spark.read.parquet(f"{tmp_path}/f")
    before = _shuffled_rows(spark)
    assert joins.overlapping(f, f).count() == 2000 * 1999
    assert _shuffled_rows(spark) - before < 10_000
