"""The engine's queries: one for each operator, over the domain tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric, scalars
from ..operators import aggregates, filters, graph, joins, ordered, quality, sets, voxels
from .registry import query
from .tables import base, domain

S, D = SparkSession, DataFrame


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def entries_of(spark: S, d: str) -> D:
    return domain(spark, d, "codon_entries").withColumnRenamed("end_", "end")


# ---- selections


@query("""SELECT label_asym_id, label_seq_id, count(*) AS n_atoms FROM atoms WHERE (label_asym_id = 'A' OR auth_asym_id = 'A') AND (label_seq_id BETWEEN 10 AND 20 OR auth_seq_id BETWEEN 10 AND 20) AND type_symbol = 'C' GROUP BY ALL""", "atoms")
def residues_and(spark: S, d: str) -> D:
    return filters.residues_of(domain(spark, d, "atoms"), filters.residue_filter("chain A and resi 20:10 and element C"))


@query("""SELECT label_asym_id, label_seq_id, count(*) AS n_atoms FROM atoms WHERE ((label_asym_id = 'A' OR auth_asym_id = 'A') AND ((label_seq_id BETWEEN 10 AND 20 OR auth_seq_id BETWEEN 10 AND 20) OR (label_seq_id = 30 OR auth_seq_id = 30))
  AND NOT type_symbol = 'O') OR ((label_asym_id = 'B' OR auth_asym_id = 'B') AND label_atom_id = 'CA') GROUP BY ALL""", "atoms")
def residues_bool(spark: S, d: str) -> D:
    return filters.residues_of(domain(spark, d, "atoms"), filters.residue_filter("chain A and (resi 10:20 or resi 30) and not element O or chain B and atom CA"))


@query("""SELECT label_asym_id, label_seq_id, count(*) AS n_atoms FROM atoms WHERE NOT ((label_asym_id = 'C' OR auth_asym_id = 'C') AND (label_seq_id BETWEEN 0 AND 30 OR auth_seq_id BETWEEN 0 AND 30)) GROUP BY ALL""", "atoms")
def residues_columns(spark: S, d: str) -> D:
    return filters.residues_of(domain(spark, d, "atoms"), ~(filters.chain("C") & filters.resi(30, 0)))


@query("""SELECT a.label_asym_id, a.label_seq_id, count(*) AS n_atoms FROM atoms a WHERE EXISTS (SELECT 1 FROM points p WHERE p.asym = a.label_asym_id AND p.point_id % 60 = a.label_seq_id AND p.y > 45) GROUP BY ALL""", "atoms", "points")
def residue_semi_join(spark: S, d: str) -> D:
    wanted = domain(spark, d, "points").filter("y > 45").select(F.col("asym").alias("label_asym_id"), (F.col("point_id") % 60).cast("int").alias("label_seq_id"))
    return filters.residues_of(domain(spark, d, "atoms").join(wanted, ["label_asym_id", "label_seq_id"], "left_semi"), F.lit(True))


@query("""SELECT key, modality, series_description, voxels, has_seg, source FROM worklist WHERE contains(lower(concat_ws(' ', key, modality, series_description)), 'src1') AND modality IN ('EN', 'DE') AND source = 'local'""", "worklist")
def worklist_filter(spark: S, d: str) -> D:
    return filters.order_worklist(filters.filter_worklist(domain(spark, d, "worklist"), "SRC1", ("EN", "DE"), "local"), "voxels", True)


@query("""SELECT modality, count(*) AS n FROM worklist GROUP BY modality""", "worklist")
def modality_facets(spark: S, d: str) -> D:
    return aggregates.facets(domain(spark, d, "worklist"), "modality")


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_name), 'ct') OR contains(lower(p_name), 'lung') OR contains(lower(p_name), 'covid') THEN 'CT' WHEN contains(lower(p_name), 'mr') OR contains(lower(p_name), 'flair') OR contains(lower(p_name), 'prostate') OR contains(lower(p_name), 'cardiac') THEN 'MR'
  WHEN contains(lower(p_name), 'skull') THEN 'CT' ELSE 'OT' END AS modality FROM part""")
def modality_guess(spark: S, d: str) -> D:
    return base(spark, d, "part").select("p_partkey", filters.guess_modality(F.col("p_name"), F.lit("")).alias("modality"))


@query("""SELECT concept, name FROM terms WHERE contains(lower(name), '1') OR contains(lower(concept), '1') ORDER BY concept LIMIT 25""", "terms")
def term_search(spark: S, d: str) -> D:
    t = domain(spark, d, "terms")
    return t.filter(F.lower("name").contains("1") | F.lower("concept").contains("1")).select("concept", "name").orderBy("concept").limit(25)


def _term_members(spark: S, d: str) -> D:
    members = base(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list(F.col("s_suppkey").cast("string"))).alias("members"))
    return domain(spark, d, "terms").join(members, "n_nationkey")


@query("""SELECT t.concept, t.name FROM terms t JOIN supplier s ON s.s_nationkey = t.n_nationkey WHERE s.s_suppkey = 7""", "terms")
def terms_with_member(spark: S, d: str) -> D:
    holders = base(spark, d, "supplier").filter("s_suppkey = 7").select(F.col("s_nationkey").alias("n_nationkey"))
    return domain(spark, d, "terms").join(holders, "n_nationkey", "left_semi").select("concept", "name").orderBy("concept")


@query("""SELECT concept, n_members FROM (SELECT t.concept, count(*) AS n_members, sum((s.s_suppkey = 7)::INT) AS has FROM terms t JOIN supplier s ON s.s_nationkey = t.n_nationkey GROUP BY 1) WHERE has > 0 ORDER BY n_members, concept LIMIT 10""", "terms")
def concepts_of_member(spark: S, d: str) -> D:
    return joins.concepts_of(_term_members(spark, d), "7", "FMA0").select("concept", F.col("n_members").cast("bigint").alias("n_members"))


@query("""SELECT a.feature_id, b.feature_id AS other FROM features a JOIN features b ON a.chrom = b.chrom AND a.start < b.end_ AND b.start < a.end_ WHERE a.feature_id <> b.feature_id""", "features")
def locus_overlap(spark: S, d: str) -> D:
    f = domain(spark, d, "features")
    return joins.overlapping(f, f)


@query("""SELECT feature_id FROM features WHERE chrom = 'chr1' AND start < 2000 AND 999 < end_""", "features")
def in_locus(spark: S, d: str) -> D:
    at = scalars.locus(F.lit("chr1:1,000-2,000"))
    return domain(spark, d, "features").filter(scalars.loci_overlap(F.col("chrom"), F.col("start"), F.col("end_"), at["chrom"], at["start"], at["end"])).select("feature_id")


@query("""SELECT feature_id, round(log10(end_), 6) AS log_end, concat(chrom, ':', CAST(start AS STRING)) AS at FROM features WHERE chrom IN ('chr1', 'chr2') AND NOT (start BETWEEN 100 AND 4000)""", "features")
def track_transforms(spark: S, d: str) -> D:
    steps = [filters.Keep("chrom", one_of=("chr1", "chr2")), filters.Keep("start", in_range=(100, 4000), negate=True), filters.Log("end_", new_field="log_end"), filters.Concat(("chrom", "start"), "at", ":")]
    return filters.apply_transforms(domain(spark, d, "features"), steps).select("feature_id", r6("log_end").alias("log_end"), "at")


@query("""SELECT series, x, y, z, CASE WHEN v BETWEEN 10 AND 30 THEN 1 ELSE 0 END AS mask FROM voxels""", "voxels")
def threshold_mask(spark: S, d: str) -> D:
    return domain(spark, d, "voxels").select("series", "x", "y", "z", numeric.between(F.col("v"), 10, 30).cast("int").alias("mask"))


@query("""SELECT point_id FROM points WHERE x BETWEEN 5 AND 30 AND y BETWEEN 0 AND 40 AND z BETWEEN 2 AND 25 AND x + z >= 20""", "points")
def clip_filter(spark: S, d: str) -> D:
    return domain(spark, d, "points").filter(filters.inside_box(F.col("x"), F.col("y"), F.col("z"), ((5, 30), (0, 40), (2, 25)), (1, 0, 1, 20))).select("point_id")


@query("""SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(?i)lung|chest|thorax|covid') THEN 'ct-lung' WHEN regexp_matches(p_name, '(?i)bone|skull|spine|pelvis|fracture') THEN 'ct-bone' WHEN regexp_matches(p_name, '(?i)angio|aaa|vessel|cardiac') THEN 'ct-angio' ELSE 'ct-default' END AS protocol FROM part""")
def hanging_protocols(spark: S, d: str) -> D:
    return base(spark, d, "part").select("p_partkey", filters.hanging_protocol(F.lit("ct"), F.col("p_name"))["protocol"].alias("protocol"))


@query("""SELECT event_id, tag, CASE WHEN tag IN ('0020000d', '7fe00010') THEN 'pass' WHEN tag IN ('00080020') THEN 'remove' WHEN tag IN ('00100030', '00100010') THEN 'replace' WHEN tag = '00191080' THEN 'keep' WHEN tag LIKE '0019%' THEN 'remove' ELSE 'pass' END AS action
  FROM (SELECT event_id, ['00100010', '00080020', '00100030', '00191080', '0019100c', '0020000d', '7fe00010', '00280010'][CAST(event_id % 8 AS INT) + 1] AS tag FROM events)""")
def deid_actions(spark: S, d: str) -> D:
    tags = F.array(*(F.lit(t) for t in ("00100010", "00080020", "00100030", "00191080", "0019100c", "0020000d", "7fe00010", "00280010")))
    tagged = base(spark, d, "events").select("event_id", F.get(tags, (F.col("event_id") % 8).cast("int")).alias("tag"))
    return tagged.withColumn("action", filters.deid_action(F.col("tag"), retain_safe_private=True))


@query("""SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN '4X' WHEN p_partkey % 9 >= 6 THEN '4B' WHEN p_size % 12 >= 8 THEN '4A' WHEN p_size % 12 >= 6 OR p_size >= 30 THEN '3' WHEN p_size % 12 >= 4 OR p_partkey % 9 >= 4 OR p_size >= 20 THEN '2' ELSE '1' END AS lung,
  CASE WHEN p_size % 2 = 0 AND (p_size % 3 = 0 OR p_size % 5 = 0) THEN '5' WHEN p_size % 2 = 0 OR p_size % 3 = 0 THEN '4C' WHEN p_size % 7 = 0 OR p_size % 5 = 0 THEN '4A' ELSE '2' END AS breast FROM part""")
def category_ladders(spark: S, d: str) -> D:
    s, k = F.col("p_size"), F.col("p_partkey")
    return base(spark, d, "part").select("p_partkey", filters.lung_rads(s % 12, k % 9, s, s % 10 == 0).alias("lung"), filters.bi_rads(s % 7 == 0, s % 2 == 0, s % 3 == 0, s % 5 == 0).alias("breast"))


@query("""SELECT c, b, nadir, u, CASE WHEN (CASE WHEN nadir > 0 THEN (u - nadir) / nadir * 100 WHEN u > 0 THEN 1e300 ELSE 0 END) >= 20 AND u - nadir >= 5 THEN 'PD' WHEN u = 0 THEN 'CR' WHEN (CASE WHEN b > 0 THEN (u - b) / b * 100 WHEN u > 0 THEN 1e300 ELSE 0 END) <= -30 THEN 'PR' ELSE 'SD' END AS category
  FROM (SELECT o_custkey AS c, sum(CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 40 + o_orderkey % 7 ELSE 0 END)::DOUBLE AS b, sum(CASE WHEN o_orderkey % 3 = 1 THEN o_custkey % 40 ELSE 0 END)::DOUBLE AS nadir, sum(CASE WHEN o_orderkey % 3 = 2 THEN o_custkey % 40 ELSE 0 END)::DOUBLE AS u FROM orders GROUP BY 1)""")
def recist_categories(spark: S, d: str) -> D:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    part = lambda n, v: F.sum(F.when(k % 3 == n, v).otherwise(0)).cast("double")
    sums = base(spark, d, "orders").groupBy(c.alias("c")).agg(part(0, c % 40 + k % 7).alias("b"), part(1, c % 40).alias("nadir"), part(2, c % 40).alias("u"))
    return sums.withColumn("category", filters.recist(F.col("b"), F.col("nadir"), F.col("u"), F.lit(False)))


@query("""SELECT series, CASE series % 5 WHEN 0 THEN 'none: implicit VR little endian' WHEN 1 THEN 'lossy: JPEG baseline' WHEN 2 THEN 'lossless: JPEG or JPEG-LS' WHEN 3 THEN 'unknown: no transfer syntax' ELSE 'unknown: 1.2.840.10008.1.2.9' END AS verdict FROM doses""", "doses")
def compression_verdicts(spark: S, d: str) -> D:
    return domain(spark, d, "doses").select("series", filters.compression_verdict(F.col("uid")).alias("verdict"))


@query("""SELECT p_partkey, CASE WHEN p_size - 5 <= 0 THEN concat('bad dims[0]: ', CAST(p_size - 5 AS STRING)) WHEN p_size % 4 <= 0 THEN concat('bad dims[2]: ', CAST(p_size % 4 AS STRING)) WHEN p_size % 4 < 2 THEN concat('only ', CAST(p_size % 4 AS STRING), ' axial slice(s)') ELSE '' END AS problem FROM part""")
def orientation_problems(spark: S, d: str) -> D:
    s = F.col("p_size")
    return base(spark, d, "part").select("p_partkey", filters.orientation_problem([s - 5, F.lit(3), s % 4], [F.lit(1.0), F.lit(1.0), F.lit(2.0)]).alias("problem"))


# ---- joins


@query("""SELECT variant_id, chain, res_seq FROM (SELECT v.variant_id, e.chain, CASE WHEN e.start = e.end_ THEN e.res_start ELSE e.res_start + e.strand * (v.pos - e.start) END AS res_seq, row_number() OVER (PARTITION BY v.variant_id ORDER BY e.entry_no) AS k
  FROM variants v LEFT JOIN codon_entries e ON v.chrom = e.chrom AND v.pos BETWEEN e.start AND e.end_) WHERE k = 1""", "variants", "codon_entries")
def variant_link(spark: S, d: str) -> D:
    return joins.link_variants(domain(spark, d, "variants").select("variant_id", "chrom", "pos"), entries_of(spark, d))


@query("""SELECT label, baseline, followup, unit, round(followup - baseline, 6) AS delta, round(CASE WHEN baseline <> 0 THEN (followup - baseline) / baseline * 100 END, 6) AS pct_change FROM (SELECT coalesce(b.k, f.k) AS label, b.v AS baseline, f.v AS followup, coalesce(b.u, f.u) AS unit FROM
  (SELECT replace(label, ' (FU) x', '') AS k, arg_min(value, row_no) AS v, arg_min(unit, row_no) AS u FROM measurements WHERE NOT later AND kind <> 'angle' GROUP BY 1) b FULL JOIN
  (SELECT replace(label, ' (FU) x', '') AS k, arg_min(value, row_no) AS v, arg_min(unit, row_no) AS u FROM measurements WHERE later AND kind <> 'angle' GROUP BY 1) f ON b.k = f.k)""", "measurements")
def lesion_delta(spark: S, d: str) -> D:
    m = domain(spark, d, "measurements")
    return joins.lesion_delta(m.filter("not later"), m.filter("later")).withColumns({"delta": r6("delta"), "pct_change": r6("pct_change")})


@query("""SELECT l.p_partkey AS id, f.p_name AS matched FROM (SELECT p_partkey, upper(p_name) AS file_id FROM part WHERE p_size > 20) l LEFT JOIN (SELECT lower(p_name) AS leaf, arg_max(p_name, p_partkey) AS p_name FROM part WHERE p_size <= 25 GROUP BY 1) f ON lower(l.file_id) = f.leaf""")
def resolve_files(spark: S, d: str) -> D:
    p = base(spark, d, "part")
    listed = p.filter("p_size > 20").select(F.col("p_partkey").alias("id"), F.concat(F.lit("DIR/"), F.upper("p_name")).alias("file_id"))
    return joins.resolve_files(listed, p.filter("p_size <= 25").select(F.concat(F.lit(""), "p_name").alias("name"), F.col("p_partkey").alias("row_no"))).select("id", "matched")


@query("""SELECT a.point_id AS a, b.point_id AS b, round(sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2), 6) AS distance FROM points a JOIN points b ON a.block = b.block AND a.point_id < b.point_id AND (a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2 <= 9""", "points")
def contact_pairs(spark: S, d: str) -> D:
    return joins.neighbours(domain(spark, d, "points"), 3.0, block="block").select("a", "b", r6("distance").alias("distance"))


MATRIX = [0.0, -1.0, 0.0, 5.0, 1.0, 0.0, 0.0, 2.0, 0.0, 0.0, 1.0, -3.0]


@query("""SELECT c.copy_no, p.asym, p.point_id, CASE c.op WHEN 'one' THEN p.x ELSE 5 - p.y END AS tx, CASE c.op WHEN 'one' THEN p.y ELSE p.x + 2 END AS ty, CASE c.op WHEN 'one' THEN p.z ELSE p.z - 3 END AS tz
  FROM points p JOIN (SELECT * FROM (VALUES ('A', 0, 'one'), ('A', 1, 'turn'), ('B', 0, 'one'), ('C', 1, 'turn')) t(asym, copy_no, op)) c ON p.asym = c.asym""", "points")
def assembly_copies(spark: S, d: str) -> D:
    copies = spark.createDataFrame([("A", 0, "one"), ("A", 1, "turn"), ("B", 0, "one"), ("C", 1, "turn")], "asym string, copy_no int, op string")
    ops = spark.createDataFrame([("one", [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]), ("turn", MATRIX)], "op string, m array<double>")
    return joins.place_copies(domain(spark, d, "points").select("asym", "point_id", "x", "y", "z"), F.broadcast(copies), F.broadcast(ops))


@query("""SELECT series, round(avg(abs(v - w)), 6) AS mean_abs, round(max(abs(v - w)), 6) AS max_abs, round(avg((abs(v - w) > 0.1)::INT), 6) AS changed FROM (SELECT a.vec_id AS series, unnest(a.embedding)::DOUBLE AS v, unnest(b.embedding)::DOUBLE AS w FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) GROUP BY 1""")
def frame_diff(spark: S, d: str) -> D:
    e = base(spark, d, "embeddings")
    long_ = lambda key: e.select(key.alias("series"), F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    out = joins.compare_frames(long_(F.col("vec_id")), long_(F.col("vec_id") - 1), 0.1)
    return out.select("series", *(r6(c).alias(c) for c in ("mean_abs", "max_abs", "changed")))


@query("""SELECT label, round(sum((a > 0 AND b > 0)::INT) * 1.0 / sum((a > 0 OR b > 0)::INT), 6) AS jaccard FROM (SELECT label, unnest(embedding[1:32]) AS a, unnest(embedding[33:64]) AS b FROM embeddings) GROUP BY 1""")
def jaccard(spark: S, d: str) -> D:
    halves = base(spark, d, "embeddings").select("label", F.explode(F.arrays_zip(F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))).alias("p"))
    return halves.select("label", (F.col("p.a") > 0).alias("a"), (F.col("p.b") > 0).alias("b")).groupBy("label").agg(r6(joins.jaccard(halves)).alias("jaccard"))


@query("""SELECT c.c_custkey, n.n_name, r.r_name FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""")
def glossary_cards(spark: S, d: str) -> D:
    c, n, r = (base(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left").select("c_custkey", "n_name", "r_name")


@query("""SELECT c_mktsegment AS cohort, count(DISTINCT CASE WHEN o_orderkey IS NOT NULL THEN c_custkey END) AS done, count(DISTINCT c_custkey) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1""")
def cohort_progress(spark: S, d: str) -> D:
    done = base(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.lit(1).alias("is_done")).distinct()
    return base(spark, d, "customer").join(done, "c_custkey", "left").groupBy(F.col("c_mktsegment").alias("cohort")).agg(F.count("is_done").alias("done"), F.count("*").alias("total"))


@query("""SELECT value, coalesce(n.n_name, concat('Segment ', CAST(value AS STRING))) AS label, voxels, voxels * 1.5 AS volume FROM (SELECT l_linenumber AS value, count(*) AS voxels FROM lineitem WHERE l_linenumber <> 0 GROUP BY 1) LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 4) n ON n.n_nationkey = value""")
def segments_table(spark: S, d: str) -> D:
    names = base(spark, d, "nation").filter("n_nationkey < 4").select(F.col("n_nationkey").alias("value"), F.col("n_name").alias("name"))
    return voxels.segments_table(base(spark, d, "lineitem").select(F.col("l_linenumber").alias("label")), 1.5, names)


@query("""SELECT block, point_id, place, plane FROM (SELECT p.block, p.point_id, p.x + p.y / 100 AS place, CAST(a.plane AS DOUBLE) AS plane, row_number() OVER (PARTITION BY p.point_id ORDER BY abs(p.x + p.y / 100 - a.plane), a.plane) AS k FROM points p JOIN (SELECT * FROM (VALUES (3.0), (11.0), (12.5), (29.0)) t(plane)) a ON true) WHERE k = 1""", "points")
def nearest_slice(spark: S, d: str) -> D:
    p = domain(spark, d, "points").select("block", "point_id", (F.col("x") + F.col("y") / 100).alias("position"))
    anchors = p.select("block").distinct().select("block", F.explode(F.array(*(F.lit(x) for x in (3.0, 11.0, 12.5, 29.0)))).alias("at"))
    return joins.nearest_rank(p, anchors, "block").withColumnsRenamed({"position": "place", "at": "plane"})


# ---- aggregations


@query("""SELECT series, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean FROM voxels GROUP BY 1""", "voxels")
def volume_stats(spark: S, d: str) -> D:
    return aggregates.volume_stats(domain(spark, d, "voxels"), ["series"]).withColumn("mean", r6("mean"))


@query("""SELECT channel, least(255, CAST(floor((v - lo) / (CASE WHEN hi > lo THEN hi - lo ELSE 1 END) * 256) AS INT)) AS bin, count(*) AS n FROM channels JOIN (SELECT channel, min(v) AS lo, max(v) AS hi FROM channels GROUP BY 1) USING (channel) GROUP BY 1, 2""", "channels")
def histogram256(spark: S, d: str) -> D:
    return aggregates.histogram(domain(spark, d, "channels"), ["channel"]).select("channel", "bin", "n")


@query("""SELECT chrom, least(9, CAST(floor(depth / 60 * 10) AS INT)) AS bin, count(*) AS n FROM variants WHERE depth IS NOT NULL GROUP BY 1, 2""", "variants")
def depth_histogram(spark: S, d: str) -> D:
    return aggregates.depth_histogram(domain(spark, d, "variants"), ["chrom"], "depth", 10, 60.0)


@query("""SELECT a.channel, a.min, a.max, round(a.mean, 6) AS mean, round((SELECT sqrt(sum((c.v - a.mean) ** 2) / count(*)) FROM channels c WHERE c.channel = a.channel AND c.v <> 0), 6) AS sd, q.l[least(n - 1, CAST(floor(0.5 * n) AS INT)) + 1] AS median, q.l[least(n - 1, CAST(floor(0.25 * n) AS INT)) + 1] AS q1, q.l[least(n - 1, CAST(floor(0.75 * n) AS INT)) + 1] AS q3,
  q.l[least(n - 1, CAST(floor(0.0005 * n) AS INT)) + 1] AS low, q.l[least(n - 1, CAST(floor(0.9995 * n) AS INT)) + 1] AS high FROM (SELECT channel, min(v) AS min, max(v) AS max, avg(v) AS mean FROM channels GROUP BY 1) a JOIN (SELECT channel, list_sort(list(v)) AS l, CAST(count(*) AS INT) AS n FROM channels WHERE v <> 0 GROUP BY 1) q USING (channel)""", "channels")
def channel_stats(spark: S, d: str) -> D:
    out = aggregates.channel_stats(domain(spark, d, "channels"), "channel")
    return out.select("channel", "min", "max", r6("mean").alias("mean"), r6("sd").alias("sd"), "median", "q1", "q3", "low", "high")


@query("""SELECT series, count(*) AS n, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd FROM voxels WHERE z = 3 AND x BETWEEN 2 AND 15 AND y BETWEEN 4 AND 12 GROUP BY 1""", "voxels")
def roi_rectangle(spark: S, d: str) -> D:
    out = aggregates.region_stats(domain(spark, d, "voxels"), ["series"], (F.col("z") == 3) & aggregates.in_rectangle(F.col("x"), F.col("y"), 15, 12, 2, 4))
    return out.withColumns({"mean": r6("mean"), "sd": r6("sd")})


@query("""SELECT series, count(*) AS n, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd FROM voxels WHERE y = 5 AND ((x - 10) / 6.0) ** 2 + ((z - 8) / 4.0) ** 2 <= 1 GROUP BY 1""", "voxels")
def roi_ellipse(spark: S, d: str) -> D:
    out = aggregates.region_stats(domain(spark, d, "voxels"), ["series"], (F.col("y") == 5) & aggregates.in_ellipse(F.col("x"), F.col("z"), 10, 8, 6.0, 4.0))
    return out.withColumns({"mean": r6("mean"), "sd": r6("sd")})


@query("""SELECT channel, i, round(CASE WHEN b > a THEN (least(greatest(v, a), b) - a) / (b - a) * 255 END, 6) AS scaled FROM channels JOIN (SELECT channel, quantile_cont(v, 0.05) AS a, quantile_cont(v, 0.95) AS b FROM channels GROUP BY 1) USING (channel)""", "channels")
def rescale_percentile(spark: S, d: str) -> D:
    return aggregates.rescale(domain(spark, d, "channels"), "channel", high=255.0, p_low=0.05, p_high=0.95).select("channel", "i", r6("scaled").alias("scaled"))


@query("""SELECT channel, i, round((v - m) / CASE WHEN s > 0 THEN s END, 6) AS z FROM channels JOIN (SELECT channel, avg(v) AS m, stddev_pop(v) AS s FROM channels WHERE v > 0 GROUP BY 1) USING (channel)""", "channels")
def z_normalize(spark: S, d: str) -> D:
    return aggregates.z_normalize(domain(spark, d, "channels"), "channel", mask=F.col("v") > 0).select("channel", "i", r6("z").alias("z"))


@query("""SELECT channel, i, least(greatest(v, 950), hi) AS clamped FROM channels JOIN (SELECT channel, max(v) AS hi FROM channels GROUP BY 1) USING (channel)""", "channels")
def clamp(spark: S, d: str) -> D:
    return aggregates.clamp(domain(spark, d, "channels"), "channel", low=950.0).select("channel", "i", "clamped")


HIST = """hist AS (SELECT channel, lo, hi, least(255, CAST(floor((v - lo) / (CASE WHEN hi > lo THEN hi - lo ELSE 1 END) * 256) AS INT)) AS bin, count(*) AS n FROM channels JOIN (SELECT channel, min(v) AS lo, max(v) AS hi FROM channels GROUP BY 1) USING (channel) GROUP BY ALL)"""


@query(f""", {HIST}, cut AS (SELECT *, sum(n) OVER o AS wb, sum(bin * n) OVER o AS sb, sum(n) OVER g AS w, sum(bin * n) OVER g AS s FROM hist WINDOW o AS (PARTITION BY channel ORDER BY bin), g AS (PARTITION BY channel)),
  b AS (SELECT *, (wb * 1.0) * (w - wb) * (sb * 1.0 / wb - (s - sb) * 1.0 / (w - wb)) ** 2 AS v FROM cut WHERE w > wb)
  SELECT channel, round(lo + (bin + 0.5) / 256 * (CASE WHEN hi > lo THEN hi - lo ELSE 1 END), 6) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY round(v, 3) DESC, bin) AS k FROM b) WHERE k = 1""", "channels")
def otsu_threshold(spark: S, d: str) -> D:
    return aggregates.otsu(aggregates.histogram(domain(spark, d, "channels"), ["channel"]), ["channel"]).select("channel", r6("threshold").alias("threshold"))


def _percentile_sql(q: float) -> str:
    return f"""(SELECT channel, lo, hi, min(bin) AS bin FROM (SELECT *, sum(n) OVER (PARTITION BY channel ORDER BY bin) AS c, sum(n) OVER (PARTITION BY channel) AS t FROM kept) WHERE c / t >= {q} GROUP BY 1, 2, 3)"""


CENTRE = "lo + (bin + 0.5) / 256 * (CASE WHEN hi > lo THEN hi - lo ELSE 1 END)"


@query(f""", {HIST}, sized AS (SELECT *, sum(n) OVER (PARTITION BY channel) AS a, sum(CASE WHEN bin = 0 THEN n ELSE 0 END) OVER (PARTITION BY channel) AS f FROM hist), kept AS (SELECT * FROM sized WHERE NOT (bin = 0 AND f > a * 0.2 AND f < a)),
  l AS (SELECT channel, {CENTRE} AS p FROM {_percentile_sql(0.02)}), h AS (SELECT channel, {CENTRE} AS q FROM {_percentile_sql(0.98)})
  SELECT channel, round(greatest(1, q - p), 6) AS width, round((p + q) / 2, 6) AS center FROM l JOIN h USING (channel)""", "channels")
def auto_window(spark: S, d: str) -> D:
    return aggregates.auto_window(domain(spark, d, "channels"), ["channel"]).select("channel", r6("width").alias("width"), r6("center").alias("center"))


@query(f""", {HIST}, kept AS (SELECT * FROM hist) SELECT channel, round({CENTRE}, 6) AS p90 FROM {_percentile_sql(0.9)}""", "channels")
def percentile90(spark: S, d: str) -> D:
    return aggregates.histogram_quantile(aggregates.histogram(domain(spark, d, "channels"), ["channel"]), ["channel"], 0.9, "p90").select("channel", r6("p90").alias("p90"))


@query("""SELECT round(avg((ctdivol IS NULL OR ctdivol < 0)::INT), 6) AS ctdivol, round(avg((dlp IS NULL OR dlp < 0)::INT), 6) AS dlp, round(avg((kvp IS NULL OR kvp < 0)::INT), 6) AS kvp FROM doses""", "doses")
def dose_null_rates(spark: S, d: str) -> D:
    return aggregates.null_rates(domain(spark, d, "doses"), ["ctdivol", "dlp", "kvp"]).select(*(r6(c).alias(c) for c in ("ctdivol", "dlp", "kvp")))


@query("""SELECT floor(avg((series % 5 IN (1, 3, 4))::INT) * 1000 + 0.5) / 1000 AS unvalidated_rate FROM doses""", "doses")
def compression_audit(spark: S, d: str) -> D:
    return aggregates.compression_audit(domain(spark, d, "doses"), "uid")


@query("""SELECT series, n % 100 / 50000.0 AS burned, n % 100 / 50000.0 >= 0.001 AS burned_flag, n % 100 / 50000.0 < 0.001 AND r = 0 AS ready FROM (SELECT o_custkey AS series, count(*) * 7 AS n, sum((o_orderstatus = 'P')::INT) AS r FROM orders GROUP BY 1)""")
def deid_card(spark: S, d: str) -> D:
    rows = base(spark, d, "orders").groupBy(F.col("o_custkey").alias("series")).agg((F.count("*") * 7 % 100 / 50000.0).alias("burned"), F.sum((F.col("o_orderstatus") == "P").cast("int")).alias("remove"), F.lit(0).alias("replace"), F.lit(0).alias("keep"))
    return aggregates.deid_card(rows).select("series", "burned", "burned_flag", "ready")


@query("""SELECT tile, round(avg((v >= 99)::INT), 6) AS fraction, avg((v >= 99)::INT) >= 0.001 AS flagged FROM pixels GROUP BY 1""", "pixels")
def burned_pixels(spark: S, d: str) -> D:
    return aggregates.burned_fraction(domain(spark, d, "pixels"), ["tile"], 99).withColumn("fraction", r6("fraction"))


@query("""SELECT series, label, first, n, round(total, 4) AS total, row_number() OVER (PARTITION BY series ORDER BY first) AS group_no FROM (SELECT series, label, min(row_no) AS first, count(*) AS n, sum(value) AS total FROM measurements GROUP BY 1, 2)""", "measurements")
def measurement_groups(spark: S, d: str) -> D:
    return aggregates.measurement_groups(domain(spark, d, "measurements")).withColumn("total", F.round("total", 4))


@query("""SELECT tile, CAST(floor(x / 8.0) AS BIGINT) AS block_x, CAST(floor(y / 8.0) AS BIGINT) AS block_y, round(avg(v), 6) AS v FROM pixels GROUP BY ALL""", "pixels")
def block_means(spark: S, d: str) -> D:
    return aggregates.block_means(domain(spark, d, "pixels"), ["tile"], 8).withColumn("v", r6("v"))


@query("""SELECT tile, quantile_cont(v, 0.5) AS background FROM pixels WHERE x < 2 OR y < 2 OR x >= 46 OR y >= 38 GROUP BY 1""", "pixels")
def border_background(spark: S, d: str) -> D:
    return aggregates.border_median(domain(spark, d, "pixels"), ["tile"], 48, 40)


@query("""SELECT asym, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n, min(point_id) AS first, round(2 * cbrt(count(*)), 6) AS radius FROM points GROUP BY 1""", "points")
def beads(spark: S, d: str) -> D:
    return aggregates.beads(domain(spark, d, "points"), ["asym"], 2.0).select("asym", r6("x").alias("x"), r6("y").alias("y"), r6("z").alias("z"), "n", "first", r6("radius").alias("radius"))


@query("""SELECT label_asym_id AS chain, label_seq_id AS residue, CAST(grouping(label_seq_id) AS INT) AS level, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM atoms GROUP BY GROUPING SETS ((label_asym_id, label_seq_id), (label_asym_id))""", "atoms")
def assembly_rollup(spark: S, d: str) -> D:
    a = domain(spark, d, "atoms").select(F.col("label_asym_id").alias("chain"), F.col("label_seq_id").alias("residue"), "x", "y", "z")
    return aggregates.assembly_rollup(a).withColumns({c: r6(c) for c in "xyz"})


@query("""SELECT block, round(sqrt(sum((dx - mx) ** 2 + (dy - my) ** 2) / count(*)), 6) AS rmsd FROM (SELECT block, y - x AS dx, z - y AS dy FROM points) JOIN (SELECT block, avg(y - x) AS mx, avg(z - y) AS my FROM points GROUP BY 1) USING (block) GROUP BY 1""", "points")
def centroid_rmsd(spark: S, d: str) -> D:
    p = domain(spark, d, "points").select("block", F.col("x").alias("ax"), F.col("y").alias("ay"), F.lit(0.0).alias("az"), F.col("y").alias("bx"), F.col("z").alias("by"), F.lit(0.0).alias("bz"))
    return aggregates.rmsd(p, ["block"]).withColumn("rmsd", r6("rmsd"))


@query("""SELECT series, x, y, max(v) AS v FROM voxels WHERE abs(z - 8) <= 3 GROUP BY ALL""", "voxels")
def slab_max(spark: S, d: str) -> D:
    return voxels.slab(domain(spark, d, "voxels"), "axial", 8, 6)


@query("""SELECT series, x, z, round(avg(v), 6) AS v FROM voxels GROUP BY ALL""", "voxels")
def mean_projection(spark: S, d: str) -> D:
    return voxels.slab(domain(spark, d, "voxels"), "coronal", 10, 1e9, "mean").withColumn("v", r6("v"))


@query("""SELECT series, brick_x, brick_y, brick_z, min(v) AS min, max(v) AS max, false AS has_nan FROM (SELECT DISTINCT series, x, y, z, v, CAST(floor((x + dx) / 8.0) AS BIGINT) AS brick_x, CAST(floor((y + dy) / 8.0) AS BIGINT) AS brick_y, CAST(floor((z + dz) / 8.0) AS BIGINT) AS brick_z FROM voxels, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy), (VALUES (-1), (0), (1)) c(dz)) WHERE brick_x >= 0 AND brick_y >= 0 AND brick_z >= 0 GROUP BY ALL""", "voxels")
def brick_ranges(spark: S, d: str) -> D:
    return voxels.brick_ranges(domain(spark, d, "voxels"))


@query("""SELECT series, count(*) AS voxels, count(*) * 1.5 AS volume, round(avg(v), 6) AS mean FROM voxels WHERE v > 20 GROUP BY 1""", "voxels")
def mask_stats(spark: S, d: str) -> D:
    return voxels.mask_stats(domain(spark, d, "voxels").filter("v > 20"), ["series"], (0.5, 1.0, 3.0)).withColumn("mean", r6("mean"))


@query("""SELECT asym, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM points GROUP BY 1""", "points")
def point_bounds(spark: S, d: str) -> D:
    return aggregates.bounds(domain(spark, d, "points"), ["asym"])


@query("""SELECT series, max(x) + 1 AS size_t, max(y) + 1 AS size_c, max(z) + 1 AS size_z FROM voxels GROUP BY 1""", "voxels")
def plane_extents(spark: S, d: str) -> D:
    return aggregates.extents(domain(spark, d, "voxels").select("series", F.col("x").alias("t"), F.col("y").alias("c"), "z"), ["series"])


@query("""SELECT series, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, arg_max(i, v * 100000 - i) AS hot FROM (SELECT series, v, z * 24 * 20 + y * 24 + x AS i FROM voxels) GROUP BY 1""", "voxels")
def dose_stats(spark: S, d: str) -> D:
    v = domain(spark, d, "voxels").withColumn("i", voxels.linear_index(24, 20))
    return aggregates.dose_stats(v, ["series"], "i").withColumn("mean", r6("mean"))


@query("""SELECT bin, round(avg(a.v * (1 - f + floor(f)) + coalesce(b.v, 0) * (f - floor(f))), 3) AS v FROM (SELECT line_id, CAST(bin AS BIGINT) AS bin, bin * (n - 1) / 31.0 AS f FROM (SELECT o_custkey AS line_id, count(*) AS n FROM orders GROUP BY 1) l, (SELECT unnest(range(0, 32)) AS bin) WHERE n >= 2) s
  JOIN (SELECT o_custkey AS line_id, round(o_totalprice * 100) AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders) a ON a.line_id = s.line_id AND a.k = floor(f) LEFT JOIN (SELECT o_custkey AS line_id, round(o_totalprice * 100) AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders) b ON b.line_id = s.line_id AND b.k = floor(f) + 1 GROUP BY 1""")
def tract_profile(spark: S, d: str) -> D:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    pts = base(spark, d, "orders").select(F.col("o_custkey").alias("line_id"), place.alias("k"), F.round(F.col("o_totalprice") * 100).alias("v"))
    return aggregates.profile_means(pts).withColumn("v", F.round("v", 3))


# ---- ordered


@query("""SELECT row_no, abs(mean_hu - expected_hu) <= tolerance_hu AS pass, floor((mean_hu - b) * 1000 + 0.5) / 1000 AS drift_hu FROM phantom JOIN (SELECT series, arg_min(mean_hu, date || lpad(CAST(row_no AS STRING), 12, '0')) AS b FROM phantom GROUP BY 1) USING (series)""", "phantom")
def phantom_trend(spark: S, d: str) -> D:
    return ordered.phantom_trend(domain(spark, d, "phantom"), ["series"]).select("row_no", "pass", "drift_hu")


@query("""SELECT label_asym_id, min(i) AS low, max(i) AS high FROM (SELECT label_asym_id, i, i - row_number() OVER (PARTITION BY label_asym_id ORDER BY i) AS g FROM (SELECT DISTINCT label_asym_id, label_seq_id AS i FROM atoms WHERE label_seq_id % 7 <> 0)) GROUP BY label_asym_id, g""", "atoms")
def residue_ranges(spark: S, d: str) -> D:
    return ordered.integer_ranges(domain(spark, d, "atoms").filter("label_seq_id % 7 <> 0").withColumnRenamed("label_seq_id", "i"), ["label_asym_id"])


@query("""SELECT block, count(*) + 1 AS slices, round(min(g), 6) AS min_gap, round(max(g), 6) AS max_gap, round(list_sort(list(g))[CAST(floor(count(*) / 2.0) AS INT) + 1], 6) AS median_gap FROM (SELECT block, p - lag(p) OVER (PARTITION BY block ORDER BY p) AS g FROM (SELECT DISTINCT block, x + y / 100 AS p FROM points)) WHERE g IS NOT NULL GROUP BY 1""", "points")
def stack_gaps(spark: S, d: str) -> D:
    s = domain(spark, d, "points").select("block", (F.col("x") + F.col("y") / 100).alias("at")).distinct()
    return ordered.stack_gaps(s, ["block"]).withColumns({c: r6(c) for c in ("min_gap", "max_gap", "median_gap")})


@query("""WITH RECURSIVE s AS (SELECT block, point_id AS row_no, x + y / 100 AS p, row_number() OVER (PARTITION BY block ORDER BY x + y / 100, point_id) AS k FROM (SELECT p_partkey AS point_id, CAST(p_partkey % 40 AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y, CAST(p_partkey % 8 AS INT) AS block FROM part)),
  f AS (SELECT block, row_no, k, p AS anchor, 0 AS cluster, 0 AS phase FROM s WHERE k = 1 UNION ALL SELECT s.block, s.row_no, s.k, CASE WHEN s.p - f.anchor >= 0.05 THEN s.p ELSE f.anchor END, CASE WHEN s.p - f.anchor >= 0.05 THEN f.cluster + 1 ELSE f.cluster END, CASE WHEN s.p - f.anchor >= 0.05 THEN 0 ELSE f.phase + 1 END
  FROM f JOIN s ON s.block = f.block AND s.k = f.k + 1) SELECT block, row_no, cluster, phase FROM f""")
def anchored_clusters(spark: S, d: str) -> D:
    s = domain(spark, d, "points").select("block", F.col("point_id").alias("row_no"), (F.col("x") + F.col("y") / 100).alias("at"))
    return ordered.anchored_clusters(s, ["block"], "at", 0.05)


@query("""SELECT point_id, round(sum(s) OVER (PARTITION BY block ORDER BY point_id), 6) AS cumulative FROM (SELECT block, point_id, coalesce(sqrt((x - lag(x) OVER w) ** 2 + ((y - lag(y) OVER w) * 2) ** 2 + (z - lag(z) OVER w) ** 2), 0) AS s FROM points WINDOW w AS (PARTITION BY block ORDER BY point_id))""", "points")
def arc_length(spark: S, d: str) -> D:
    return ordered.arc_length(domain(spark, d, "points"), ["block"], "point_id", spacing=(1.0, 2.0, 1.0)).select("point_id", r6("cumulative").alias("cumulative"))


@query("""SELECT v.variant_id, max(e.start) AS segment FROM variants v LEFT JOIN codon_entries e ON e.chrom = v.chrom AND e.start <= v.pos GROUP BY 1""", "variants", "codon_entries")
def segment_of(spark: S, d: str) -> D:
    v = domain(spark, d, "variants").select("variant_id", "chrom", "pos")
    starts = entries_of(spark, d).select("chrom", "start").distinct()
    return ordered.segment_starts(v, ["chrom"], "pos", starts, "start").select("variant_id", "segment")


@query("""WITH RECURSIVE log AS (SELECT user_id AS series, CASE event_type WHEN 'view' THEN 'open' WHEN 'click' THEN 'finish' WHEN 'purchase' THEN 'sign' WHEN 'error' THEN 'unlock' ELSE 'other' END AS action, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
  f AS (SELECT series, k, n, CASE WHEN action = 'open' THEN 'reading' ELSE 'unread' END AS state FROM log WHERE k = 1 UNION ALL SELECT l.series, l.k, l.n, CASE WHEN f.state = 'unread' AND action = 'open' THEN 'reading' WHEN f.state = 'reading' AND action = 'finish' THEN 'read' WHEN f.state = 'read' AND action = 'sign' THEN 'signed' WHEN f.state = 'read' AND action = 'open' THEN 'reading'
  WHEN f.state = 'signed' AND action = 'unlock' THEN 'read' ELSE f.state END FROM f JOIN log l ON l.series = f.series AND l.k = f.k + 1) SELECT series, n AS n_events, state FROM f WHERE k = n""")
def read_states(spark: S, d: str) -> D:
    return ordered.read_states(domain(spark, d, "log"), "series", "action", ["ts", "event_id"])


@query("""SELECT series, event_id FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts DESC, event_id DESC) AS k FROM log) WHERE k <= 5""", "log")
def newest_events(spark: S, d: str) -> D:
    return ordered.newest(domain(spark, d, "log"), ["series"], ["ts", "event_id"], 5).select("series", "event_id")


@query("""SELECT chrom, depth, n, row_number() OVER (PARTITION BY chrom ORDER BY n DESC, depth) AS sibling FROM (SELECT chrom, depth, count(*) AS n FROM variants WHERE depth IS NOT NULL GROUP BY 1, 2)""", "variants")
def sibling_numbers(spark: S, d: str) -> D:
    groups = domain(spark, d, "variants").filter("depth is not null").groupBy("chrom", "depth").agg(F.count("*").alias("n"))
    return ordered.sibling_numbers(groups, ["chrom"], "n", "depth")


@query("""SELECT block, coalesce(max(CASE WHEN y >= 40 THEN point_id END), 0) AS level FROM points GROUP BY 1""", "points")
def pyramid_level(spark: S, d: str) -> D:
    return ordered.pyramid_level(domain(spark, d, "points").select("block", F.col("point_id").alias("level"), F.col("y").alias("width")), ["block"], 40)


@query("""SELECT series, x, y, z, distance FROM (SELECT series, x, y, z, abs(x - 5) + abs(y - 30) + abs(z - 2) AS distance, row_number() OVER (PARTITION BY series ORDER BY abs(x - 5) + abs(y - 30) + abs(z - 2), x, y, z) AS k FROM voxels) WHERE k = 1""", "voxels")
def nearest_plane(spark: S, d: str) -> D:
    return ordered.nearest_plane(domain(spark, d, "voxels"), ["series"], {"x": 5, "y": 30, "z": 2})


@query("""SELECT conv_id, turn, n, before FROM (SELECT conv_id, turn, length(text) AS n, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE n < before""")
def unordered_steps(spark: S, d: str) -> D:
    c = base(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("n"))
    return ordered.unordered_steps(c, ["conv_id"], "turn", "n")


# ---- sets


@query("""SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 45 UNION SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000""")
def ordered_union(spark: S, d: str) -> D:
    a = base(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_suppkey").alias("k"))
    return sets.ordered_union(a, base(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("k")), "k")


@query("""SELECT l_suppkey AS k, l_quantity AS q FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)""")
def intersect_keeping(spark: S, d: str) -> D:
    a = base(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("q"))
    return sets.intersect_keeping(a, base(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("k")), ["k"])


@query("""SELECT p_partkey, unnest(range(least(p_size, 10), greatest(p_size, 10) + 1)) AS i FROM part""")
def expand_ranges(spark: S, d: str) -> D:
    return base(spark, d, "part").select("p_partkey", F.explode(sets.expand(F.col("p_size"), F.lit(10))).alias("i"))


@query("""SELECT name, list_no, id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY list_no, id) AS k FROM (SELECT lower(p_type) AS name, 0 AS list_no, p_partkey AS id FROM part WHERE p_size > 40 UNION ALL SELECT lower(p_type), 1, p_partkey FROM part)) WHERE k = 1""")
def merge_collections(spark: S, d: str) -> D:
    p = base(spark, d, "part").select(F.lower("p_type").alias("name"), F.col("p_partkey").alias("id"), "p_size")
    return sets.merge_keeping_first([p.filter("p_size > 40").drop("p_size"), p.drop("p_size")], ["name"], "id").select("name", "list_no", "id")


@query("""SELECT l_partkey % 50 AS x, l_suppkey % 20 AS y, min(l_linenumber) AS label FROM lineitem GROUP BY 1, 2""")
def label_overlay(spark: S, d: str) -> D:
    m = base(spark, d, "lineitem").select((F.col("l_partkey") % 50).alias("x"), (F.col("l_suppkey") % 20).alias("y"), F.col("l_linenumber").alias("label"))
    return sets.overlay(m, ["x", "y"])


MASK_SQL = "m AS (SELECT series, x, y, z FROM voxels WHERE v > 12)"
VOTES_SQL = "SELECT a.series, a.x, a.y, a.z FROM m a JOIN m b ON a.series = b.series AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1 GROUP BY ALL HAVING count(*) = 6"


def _mask(spark: S, d: str) -> D:
    return domain(spark, d, "voxels").filter("v > 12").select("series", "x", "y", "z")


@query(f""", {MASK_SQL} {VOTES_SQL}""", "voxels")
def erode(spark: S, d: str) -> D:
    return voxels.erode(_mask(spark, d))


@query(f""", {MASK_SQL}, s(dx, dy, dz) AS (VALUES (0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) SELECT DISTINCT series, x + dx AS x, y + dy AS y, z + dz AS z FROM m, s WHERE x + dx BETWEEN 0 AND 23 AND y + dy BETWEEN 0 AND 19 AND z + dz BETWEEN 0 AND 15""", "voxels")
def dilate(spark: S, d: str) -> D:
    return voxels.dilate(_mask(spark, d), (24, 20, 16))


@query(f""", {MASK_SQL} SELECT * FROM m EXCEPT ({VOTES_SQL})""", "voxels")
def outline(spark: S, d: str) -> D:
    return voxels.outline(_mask(spark, d))


@query("""SELECT p_partkey, unnest(range(0, p_size * 10, 64)) AS y0, least(64, p_size * 10 - unnest(range(0, p_size * 10, 64))) AS rows FROM part""")
def row_bands(spark: S, d: str) -> D:
    return voxels.row_bands(base(spark, d, "part").select("p_partkey", (F.col("p_size") * 10).alias("height"))).select("p_partkey", "y0", "rows")


# ---- graphs


@query("""WITH RECURSIVE isa AS (SELECT concat('c', CAST(c_custkey AS STRING)) AS node, concat('n', CAST(c_nationkey AS STRING)) AS parent FROM customer UNION ALL SELECT concat('n', CAST(n_nationkey AS STRING)), concat('r', CAST(n_regionkey AS STRING)) FROM nation UNION ALL SELECT concat('r', CAST(r_regionkey AS STRING)), 'root' FROM region),
  up AS (SELECT node, node AS ancestor, 0 AS depth FROM (SELECT node FROM isa UNION SELECT parent FROM isa) UNION ALL SELECT up.node, isa.parent, up.depth + 1 FROM up JOIN isa ON isa.node = up.ancestor) SELECT node, ancestor, depth FROM up""")
def ancestors(spark: S, d: str) -> D:
    return graph.ancestors(domain(spark, d, "isa"))


@query("""SELECT node FROM isa WHERE parent = 'r1'""", "isa")
def children(spark: S, d: str) -> D:
    return graph.children(domain(spark, d, "isa"), F.lit("r1"))


CELLS_SQL = """WITH RECURSIVE p AS (SELECT tile, y * 48 + x AS i, x, y, v FROM (SELECT CAST(o_custkey % 6 AS INT) AS tile, CAST(o_orderkey % 48 AS INT) AS x, CAST(o_custkey % 40 AS INT) AS y, max(CAST((o_orderkey * 7 + o_custkey) % 100 AS DOUBLE)) AS v FROM orders GROUP BY 1, 2, 3) WHERE v > 60),
  e AS (SELECT a.tile, a.i AS a, b.i AS b FROM p a JOIN p b ON a.tile = b.tile AND abs(a.x - b.x) + abs(a.y - b.y) = 1), r AS (SELECT tile, i, i AS c FROM p UNION SELECT r.tile, e.b, r.c FROM r JOIN e ON e.tile = r.tile AND e.a = r.i), g AS (SELECT tile, i, min(c) AS first FROM r GROUP BY 1, 2)
  SELECT g.tile, first, count(*) AS area, round(sum(x * v) / sum(v), 6) AS cx, round(avg(v), 6) AS mean, 4 * count(*) - CAST((SELECT count(*) FROM e JOIN g h ON h.tile = e.tile AND h.i = e.a WHERE h.tile = g.tile AND h.first = g.first) AS BIGINT) AS perimeter FROM g JOIN p USING (tile, i) GROUP BY 1, 2 HAVING count(*) >= 2"""


@query(CELLS_SQL)
def label_cells(spark: S, d: str) -> D:
    return graph.label_cells(domain(spark, d, "pixels"), 48, 60, 2).select("tile", "first", "area", r6("cx").alias("cx"), r6("mean").alias("mean"), "perimeter")


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS id, CAST(p_partkey % 40 AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y, CAST((p_partkey * 7) % 30 AS DOUBLE) AS z, CAST(p_partkey % 8 AS INT) AS block FROM part),
  c AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.block = b.block AND a.id <> b.id AND (a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2 <= 9), deg AS (SELECT id, count(c.b) AS degree FROM p LEFT JOIN c ON c.a = p.id GROUP BY 1), x AS (SELECT * FROM deg WHERE degree < 3),
  e AS (SELECT a, b FROM c WHERE a IN (SELECT id FROM x) AND b IN (SELECT id FROM x)), r AS (SELECT id, id AS c FROM x UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id), g AS (SELECT id, min(c) AS component FROM r GROUP BY 1)
  SELECT component, count(*) AS n, round(avg(degree), 6) AS mean_degree FROM g JOIN x USING (id) GROUP BY 1 HAVING count(*) >= 3""")
def pockets(spark: S, d: str) -> D:
    return joins.pockets_near(domain(spark, d, "points"), 3.0, 3, 3, block="block").withColumn("mean_degree", r6("mean_degree"))


@query("""WITH RECURSIVE p AS (SELECT CAST(l_linenumber % 4 AS INT) AS series, CAST(l_partkey % 24 AS INT) AS x, CAST(l_suppkey % 20 AS INT) AS y, CAST(l_orderkey % 16 AS INT) AS z, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3, 4), w AS (SELECT series, x, y, z FROM p WHERE v BETWEEN 5 AND 25),
  r AS (SELECT series, x, y, z FROM w WHERE x = 0 UNION SELECT w.series, w.x, w.y, w.z FROM r JOIN w ON w.series = r.series AND abs(w.x - r.x) + abs(w.y - r.y) + abs(w.z - r.z) = 1) SELECT series, x, y, z FROM r""")
def region_grow(spark: S, d: str) -> D:
    cells = domain(spark, d, "voxels").withColumn("node", F.struct("series", "x", "y", "z"))
    within = F.col("v").between(5, 25)
    edges = graph.grid_edges(cells.filter(within), "node", ("x", "y", "z"), ("series",))
    return graph.region_grow(cells, "node", edges, cells.filter("x = 0"), within).select("node.*")


# ---- scalars


@query("""SELECT label, replace(label, ' (FU) x', '') AS base FROM measurements""", "measurements")
def base_labels(spark: S, d: str) -> D:
    return domain(spark, d, "measurements").select("label", scalars.base_label(F.col("label")).alias("base"))


@query("""SELECT feature_id, chrom || ':' || CAST(start + 1 AS STRING) || '-' || CAST(end_ AS STRING) AS text, start AS back FROM features""", "features")
def locus_texts(spark: S, d: str) -> D:
    f = domain(spark, d, "features").withColumn("text", scalars.locus_text(F.col("chrom"), F.col("start"), F.col("end_")))
    return f.select("feature_id", "text", scalars.locus(F.col("text"))["start"].alias("back"))


@query("""SELECT feature_id, round((end_ - start) / 40.0, 6) AS per_pixel, CAST(floor(start + 10 * (end_ - start) / 40.0) AS BIGINT) AS base FROM features""", "features")
def pixel_scale(spark: S, d: str) -> D:
    per = scalars.bases_per_pixel(F.col("start"), F.col("end_"), F.lit(40))
    return domain(spark, d, "features").select("feature_id", r6(per).alias("per_pixel"), scalars.to_base(F.lit(10), F.col("start"), per).alias("base"))


@query("""SELECT p_partkey, round(greatest(0, least(255, (p_retailprice - 900) / 400 * 255)), 6) AS shade FROM part""")
def window_levels(spark: S, d: str) -> D:
    return base(spark, d, "part").select("p_partkey", r6(scalars.window_level(F.col("p_retailprice"), 400.0, 1100.0)).alias("shade"))


@query("""SELECT p_partkey, (CASE WHEN p_partkey % 256 >= 128 THEN p_partkey % 256 - 256 ELSE p_partkey % 256 END) * 1.5 - 10 AS v FROM part""")
def slope_intercept(spark: S, d: str) -> D:
    return base(spark, d, "part").select("p_partkey", scalars.slope_intercept(F.col("p_partkey"), 8, True, 1.5, -10.0).alias("v"))


@query(f"""SELECT point_id, round(sqrt((x - 3) ** 2 + ((y - 4) * 2) ** 2 + (z * 0.5) ** 2), 6) AS length, round(CASE WHEN x * x + y * y > 0 THEN degrees(acos(greatest(-1, least(1, x / sqrt(x * x + y * y))))) END, 6) AS angle, round({math.pi} * x * 2 * y * 0.5, 6) AS area FROM points""", "points")
def measures(spark: S, d: str) -> D:
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return domain(spark, d, "points").select("point_id", r6(scalars.segment_length(x, y, z, F.lit(3.0), F.lit(4.0), F.lit(0.0), (1.0, 2.0, 0.5))).alias("length"), r6(scalars.angle_degrees(x, y, F.lit(1.0), F.lit(0.0))).alias("angle"), r6(scalars.ellipse_area(x, y, 2.0, 0.5)).alias("area"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'none' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders""")
def date_texts(spark: S, d: str) -> D:
    raw = F.when(F.col("o_orderkey") % 3 == 0, "none").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return base(spark, d, "orders").select("o_orderkey", scalars.date_text(raw).alias("date"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM pages""")
def escape_html(spark: S, d: str) -> D:
    return base(spark, d, "pages").select("page_id", scalars.escape_html(F.col("html")).alias("escaped"))


@query("""SELECT p_partkey, lpad(lower(to_hex(list_reduce(list_prepend(2166136261::UBIGINT, [ord(c)::UBIGINT FOR c IN string_split(p_name, '') IF c <> '']), lambda a, b: ((xor(a, b)::UBIGINT::UHUGEINT * 16777619) % 4294967296)::UBIGINT))), 8, '0') AS h FROM part""")
def name_fingerprints(spark: S, d: str) -> D:
    return base(spark, d, "part").select("p_partkey", scalars.fnv1a(F.col("p_name")).alias("h"))


@query("""SELECT s_suppkey, lower(lpad(to_hex(s_nationkey), 4, '0') || lpad(to_hex(s_suppkey), 4, '0')) AS tag FROM supplier""")
def tag_keys(spark: S, d: str) -> D:
    return base(spark, d, "supplier").select("s_suppkey", scalars.tag_key(F.col("s_nationkey"), F.col("s_suppkey")).alias("tag"))


@query("""SELECT p_partkey, round(CASE WHEN p_size <= 10 THEN 0 WHEN p_size < 30 THEN (p_size - 10) / 20.0 WHEN p_size < 50 THEN 1 + (p_size - 30) / 20.0 * 4 ELSE 5 END, 6) AS opacity, CAST(least(2, floor(p_size / 50.0 * 3)) AS BIGINT) AS third FROM part""")
def transfer_ramp(spark: S, d: str) -> D:
    return base(spark, d, "part").select("p_partkey", r6(scalars.ramp([(10, 0), (30, 1), (50, 5)], F.col("p_size"))).alias("opacity"), scalars.tercile(F.col("p_size") / 50.0).alias("third"))


@query("""SELECT p_partkey, round(CASE WHEN p_size + 5 <= p_partkey % 60 + 1 THEN 30.0 * ln(2) / ln((p_partkey % 60 + 1.0) / (p_size + 5.0)) END, 6) AS days FROM part WHERE p_size + 5 < p_partkey % 60 + 1""")
def doubling_times(spark: S, d: str) -> D:
    a, b = (F.col("p_size") + 5).cast("double"), (F.col("p_partkey") % 60 + 1).cast("double")
    return base(spark, d, "part").filter(a < b).select("p_partkey", r6(scalars.doubling_time(a, b, F.lit(30.0))).alias("days"))


# ---- checks and further stencils


@query("""SELECT p_partkey, c.level AS level, c.code AS code FROM (SELECT p_partkey, unnest([{'level': 'error', 'code': 'bad-dims', 'is': p_size <= 3}, {'level': 'error', 'code': 'bad-spacing', 'is': p_partkey % 7 = 0}, {'level': 'error', 'code': 'length-mismatch', 'is': p_size > 3 AND p_partkey % 5 <> (p_size - 3) * 2},
  {'level': 'warn', 'code': 'anisotropic', 'is': p_partkey % 7 > 5}, {'level': 'error', 'code': 'all-nonfinite', 'is': p_partkey % 5 > 0 AND p_partkey % 3 >= p_partkey % 5}, {'level': 'warn', 'code': 'some-nonfinite', 'is': p_partkey % 3 > 0 AND p_partkey % 3 < p_partkey % 5}]) AS c FROM part) WHERE c.is""")
def volume_problems(spark: S, d: str) -> D:
    k, s = F.col("p_partkey"), F.col("p_size")
    v = base(spark, d, "part").select("p_partkey", (s - 3).alias("nx"), F.lit(2).alias("ny"), F.lit(1).alias("nz"), F.lit(1.0).alias("sx"), (k % 7).cast("double").alias("sy"), F.lit(2.0).alias("sz"), (k % 5).alias("n_values"), F.least(k % 3, k % 5).alias("n_nonfinite"))
    return quality.volume_problems(v, "p_partkey")


@query("""SELECT series, f.finding AS finding, f.ok AS ok FROM (SELECT series, unnest([{'finding': 'unique', 'ok': n = u}, {'finding': 'complete', 'ok': u = a}, {'finding': 'one_size', 'ok': s = 1}]) AS f FROM (SELECT series, count(*) AS n, count(DISTINCT (x, y, z)) AS u, (max(x) + 1) * (max(y) + 1) * (max(z) + 1) AS a, count(DISTINCT (width, height)) AS s FROM (SELECT *, 512 AS width, 512 + CAST(series / 3 AS INT) * (x % 2) AS height FROM voxels) GROUP BY 1))""", "voxels")
def axis_findings(spark: S, d: str) -> D:
    v = domain(spark, d, "voxels").select("series", F.col("x").alias("t"), F.col("y").alias("c"), "z", F.lit(512).alias("width"), (F.lit(512) + F.floor(F.col("series") / 3 + 0.5) * (F.col("x") % 2)).alias("height"))
    return quality.axis_findings(v, "series")


@query("""SELECT c_custkey, CASE WHEN least(c_nationkey * 20 - 50 + 64, 256) > greatest(c_nationkey * 20 - 50, 0) AND least(c_custkey % 300 + 64, 256) > c_custkey % 300 THEN greatest(c_nationkey * 20 - 50, 0) END AS x, CASE WHEN least(c_nationkey * 20 - 50 + 64, 256) > greatest(c_nationkey * 20 - 50, 0) AND least(c_custkey % 300 + 64, 256) > c_custkey % 300 THEN least(c_custkey % 300 + 64, 256) - c_custkey % 300 END AS h FROM customer""")
def clipped_rectangles(spark: S, d: str) -> D:
    r = quality.clip_rectangle(F.col("c_nationkey") * 20 - 50, F.col("c_custkey") % 300, F.lit(64), F.lit(64), F.lit(256), F.lit(256))
    return base(spark, d, "customer").select("c_custkey", r["x"].alias("x"), r["h"].alias("h"))


@query("""SELECT o_orderkey, unnest(list_filter([CASE WHEN o_orderkey % 11 = 0 THEN 'o_totalprice' END, CASE WHEN o_orderkey % 13 = 0 THEN 'o_orderstatus' END], lambda x: x IS NOT NULL)) AS field FROM orders""")
def differing_fields(spark: S, d: str) -> D:
    a = base(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    b = a.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 11 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderstatus")))
    return quality.differing_fields(a, b, "o_orderkey")


GRID = "g AS (SELECT tile, x, y, coalesce(v, 0) AS v FROM (SELECT * FROM (SELECT DISTINCT tile FROM pixels) t, (SELECT unnest(range(0, 48)) AS x) a, (SELECT unnest(range(0, 40)) AS y) b) q LEFT JOIN pixels p USING (tile, x, y))"


def _grid(spark: S, d: str) -> D:
    p = domain(spark, d, "pixels")
    full = p.select("tile").distinct().withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(47)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(39))))
    return full.join(p, ["tile", "x", "y"], "left").select("tile", "x", "y", F.coalesce("v", F.lit(0.0)).alias("v"))


@query(f""", {GRID}, n AS (SELECT a.tile, a.x, a.y, dx, dy, b.v FROM g a, (VALUES (-1), (0), (1)) i(dx), (VALUES (-1), (0), (1)) j(dy), g b WHERE b.tile = a.tile AND b.x = least(47, greatest(0, a.x + dx)) AND b.y = least(39, greatest(0, a.y + dy)))
  SELECT tile, x, y, round(sqrt(sum(dx * (2 - abs(dy)) * v) ** 2 + sum(dy * (2 - abs(dx)) * v) ** 2), 6) AS gradient FROM n GROUP BY 1, 2, 3""", "pixels")
def slice_gradient(spark: S, d: str) -> D:
    return voxels.sobel(_grid(spark, d), 48, 40).withColumn("gradient", r6("gradient"))


@query("""WITH RECURSIVE m AS (SELECT CAST(l_linenumber % 4 AS INT) AS series, CAST(l_partkey % 24 AS INT) AS x, CAST(l_suppkey % 20 AS INT) AS y, CAST(l_orderkey % 16 AS INT) AS z, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3, 4), k AS (SELECT series, x, y, z FROM m WHERE v > 3),
  g AS (SELECT s.series, s.z, x, y FROM (SELECT DISTINCT series, z FROM k) s, (SELECT unnest(range(0, 24)) AS x) a, (SELECT unnest(range(0, 20)) AS y) b), e AS (SELECT series, z, x, y FROM g EXCEPT SELECT series, z, x, y FROM k),
  r AS (SELECT series, z, x, y FROM e WHERE x IN (0, 23) OR y IN (0, 19) UNION SELECT e.series, e.z, e.x, e.y FROM r JOIN e ON e.series = r.series AND e.z = r.z AND abs(e.x - r.x) + abs(e.y - r.y) = 1) SELECT * FROM e EXCEPT SELECT * FROM r""")
def fill_holes(spark: S, d: str) -> D:
    return graph.fill_holes(domain(spark, d, "voxels").filter("v > 3").select("series", "z", "x", "y"), 24, 20).select("series", "z", "x", "y")


@query(""", k AS (SELECT series, x, y, z FROM solids WHERE v > 20), o AS (SELECT s.series, g.* FROM (SELECT DISTINCT series FROM k) s, (SELECT * FROM (SELECT unnest(range(-1, 13)) AS x) a, (SELECT unnest(range(-1, 12)) AS y) b, (SELECT unnest(range(-1, 10)) AS z) c) g EXCEPT SELECT series, x, y, z FROM k)
  SELECT k.series, k.x, k.y, k.z, CAST(min(abs(k.x - o.x) + abs(k.y - o.y) + abs(k.z - o.z)) AS INT) AS distance FROM k JOIN o USING (series) GROUP BY 1, 2, 3, 4""", "solids")
def border_distance(spark: S, d: str) -> D:
    return graph.border_distance(domain(spark, d, "solids").filter("v > 20").select("series", "x", "y", "z"))


@query("""SELECT channel, lo, hi FROM (SELECT channel, lo, list_sort(list(v))[CAST(ceil(count(*) * 0.99) AS INT)] AS hi FROM (SELECT *, avg((v <= lo + (top - lo) / 256)::INT) OVER (PARTITION BY channel) AS share FROM (SELECT *, min(v) OVER (PARTITION BY channel) AS lo, max(v) OVER (PARTITION BY channel) AS top FROM channels)) WHERE NOT (v <= lo + (top - lo) / 256 AND share > 0.2) GROUP BY 1, 2)""", "channels")
def transfer_domain(spark: S, d: str) -> D:
    return voxels.tf_domain(domain(spark, d, "channels"), ["channel"])


@query("""WITH voxels AS (SELECT series, x, y, z, v FROM (SELECT CAST(l_linenumber % 4 AS INT) AS series, CAST(l_partkey % 24 AS INT) AS x, CAST(l_suppkey % 20 AS INT) AS y, CAST(l_orderkey % 16 AS INT) AS z, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3, 4)),
  p AS (SELECT p_partkey AS id, CAST(p_partkey % 4 AS INT) AS series, (p_partkey % 90) / 4.0 AS px, (p_size % 36) / 2.0 AS py, CAST(p_size % 15 AS DOUBLE) AS pz FROM part),
  s AS (SELECT id, series, CAST(floor(px) AS INT) + dx AS x, CAST(floor(py) AS INT) + dy AS y, CAST(pz AS INT) AS z, (CASE dx WHEN 1 THEN px - floor(px) ELSE 1 - px + floor(px) END) * (CASE dy WHEN 1 THEN py - floor(py) ELSE 1 - py + floor(py) END) AS w FROM p, (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy))
  SELECT series, id AS point_id, round(CASE WHEN count(v) = count(*) THEN sum(w * v) END, 6) AS v FROM s LEFT JOIN voxels USING (series, x, y, z) WHERE w > 0 GROUP BY 1, 2""")
def trilinear_samples(spark: S, d: str) -> D:
    k, s = F.col("p_partkey"), F.col("p_size")
    p = base(spark, d, "part").select(k.alias("point_id"), (k % 4).cast("int").alias("series"), (k % 90 / 4.0).alias("px"), (s % 36 / 2.0).alias("py"), (s % 15).cast("double").alias("pz"))
    return voxels.sample_trilinear(p, domain(spark, d, "voxels")).withColumn("v", r6("v"))


@query("""SELECT s.series, r.ray_id, coalesce(max(v), 0) AS v FROM (SELECT DISTINCT series FROM voxels) s JOIN (SELECT unnest(range(0, 24)) AS ray_id) r ON true LEFT JOIN voxels q ON q.series = s.series AND q.x = r.ray_id AND q.y = q.z AND q.z < 10 GROUP BY 1, 2""", "voxels")
def diagonal_projection(spark: S, d: str) -> D:
    v = domain(spark, d, "voxels")
    rays = v.select("series").distinct().withColumn("ray_id", F.explode(F.sequence(F.lit(0), F.lit(23))))
    rays = rays.select("series", "ray_id", F.col("ray_id").cast("double").alias("ox"), F.lit(0.0).alias("oy"), F.lit(0.0).alias("oz"), F.lit(0.0).alias("dx"), F.lit(1.0).alias("dy"), F.lit(1.0).alias("dz"))
    return voxels.oblique_projection(rays, v, 10)


@query("""SELECT p_partkey AS roi, CAST(0 AS INT) AS z, x, y FROM part, (SELECT unnest(range(0, 64)) AS x) a, (SELECT unnest(range(0, 64)) AS y) b WHERE x >= p_size / 2.0 AND x < p_size / 2.0 + 10.5 AND y >= p_partkey % 30 AND y < p_partkey % 30 + 7 AND NOT (x >= p_size / 2.0 + 2 AND x < p_size / 2.0 + 5 AND y >= p_partkey % 30 + 2 AND y < p_partkey % 30 + 4)""")
def contour_masks(spark: S, d: str) -> D:
    x, y = F.col("p_size") / 2.0, (F.col("p_partkey") % 30).cast("double")
    box = lambda k, x0, y0, x1, y1: [F.struct(F.lit(k).alias("contour"), F.lit(i).alias("order"), px.alias("px"), py.alias("py")) for i, (px, py) in enumerate(((x0, y0), (x1, y0), (x1, y1), (x0, y1)))]
    corners = F.array(*box(0, x, y, x + 10.5, y + 7), *box(1, x + 2, y + 2, x + 5, y + 4))
    contours = base(spark, d, "part").select(F.col("p_partkey").alias("roi"), F.lit(0).alias("z"), F.explode(corners).alias("c")).select("roi", "z", "c.*")
    return voxels.rasterize(contours, 64)


@query("""SELECT user_id, min(event_id) AS start, count(*) AS length, any_value(event_type) AS value FROM (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS n FROM events)) GROUP BY user_id, g""")
def run_lengths(spark: S, d: str) -> D:
    return voxels.run_lengths(base(spark, d, "events"), ["user_id"], "event_id", "event_type")


@query("""SELECT p_type AS key, t.tier, t.arrival FROM (SELECT p_type, min(p_size % 4) AS tier FROM part GROUP BY 1) a JOIN (SELECT p_type AS k, p_size % 4 AS tier, min(p_partkey) AS arrival FROM part GROUP BY 1, 2) t ON t.k = a.p_type AND t.tier = a.tier""")
def work_queue(spark: S, d: str) -> D:
    p = base(spark, d, "part").select(F.col("p_type").alias("key"), (F.col("p_size") % 4).alias("tier"), F.col("p_partkey").alias("arrival"))
    return ordered.work_queue(p, "key", "tier", "arrival")


@query("""SELECT s_suppkey AS element, s_name AS name, CAST(5 AS INT) AS rule FROM supplier WHERE contains(lower(s_name), '00001')""")
def find_structures(spark: S, d: str) -> D:
    parts = base(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("element"), F.col("s_name").alias("name"), F.lit("FMA").alias("concept"))
    out = filters.find_structures(parts, _term_members(spark, d), "00001")
    return out.select(F.col("element").cast("bigint").alias("element"), "name", "rule")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'nifti' WHEN 1 THEN 'ome-tiff' WHEN 2 THEN 'tiff' ELSE 'unknown' END AS format FROM part""")
def formats_by_name(spark: S, d: str) -> D:
    ends = F.array(*(F.lit(e) for e in (".NII.gz", ".ome.tif", ".TIF", ".x")))
    return base(spark, d, "part").select("p_partkey", filters.format_by_name(F.concat("p_name", F.get(ends, (F.col("p_partkey") % 4).cast("int")))).alias("format"))


@query("""SELECT s_suppkey, CAST(i AS STRING) || '.' || x AS op FROM supplier, (SELECT unnest(range(1, 4)) AS i) a, (VALUES ('P'), ('X0')) b(x) WHERE i <= 1 + s_suppkey % 3""")
def operator_products(spark: S, d: str) -> D:
    text = F.format_string("(1-%d)(P,X0)", 1 + F.col("s_suppkey") % 3)
    return base(spark, d, "supplier").select("s_suppkey", F.explode(joins.operator_products(text)).alias("c")).select("s_suppkey", F.array_join("c", ".").alias("op"))
