"""Queries over files: tables are written in a format to the shared folder and read back by the format's source."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import graph, ordered, quality, sets, stacks, voxels
from ..sources import sinks, text
from .registry import query
from .tables import base, domain

S, D = SparkSession, DataFrame


def written(lines: D, ending: str) -> str:
    """The path of a text table in the shared folder that holds these lines (column value)."""
    path = f"{graph._shared(lines.sparkSession)}/files-{uuid.uuid4().hex}.{ending}"
    lines.write.text(path)
    return path


def tabbed(*columns: Column | str) -> Column:
    return F.concat_ws("\t", *(F.lit(c) if isinstance(c, str) else c.cast("string") for c in columns)).alias("value")


@query("""SELECT concat('o', o_orderkey) AS id, concat('ACGT', upper(o_orderstatus), o_custkey) AS seq FROM orders""")
def fasta_records(spark: S, d: str) -> D:
    o = base(spark, d, "orders")
    lines = o.select(F.concat(F.lit(">o"), F.col("o_orderkey"), F.lit(" an order\nACGT \n"), F.upper("o_orderstatus"), F.col("o_custkey")).alias("value"))
    return text.fasta(spark, written(lines, "fa"))


@query("""SELECT chrom, pos, 'A' AS ref, 'G,T' AS alt FROM variants""", "variants")
def vcf_records(spark: S, d: str) -> D:
    v = domain(spark, d, "variants")
    return text.vcf(spark, written(v.select(tabbed(F.col("chrom"), F.col("pos"), ".", "A", "G,T", ".", "PASS", "X=1")), "vcf"))


@query("""SELECT chrom, pos, 'A' AS ref, 'G' AS alt, CASE WHEN depth IS NOT NULL THEN CAST(depth AS INT) WHEN pos % 3 > 0 THEN CAST(pos % 50 + pos % 20 AS INT) END AS depth, CASE WHEN pos % 3 > 0 AND pos % 50 + pos % 20 > 0 THEN (pos % 20) * 1.0 / (pos % 50 + pos % 20) END AS alt_frac FROM variants""", "variants")
def vcf_depths(spark: S, d: str) -> D:
    v = domain(spark, d, "variants")
    info = F.when(F.col("depth").isNotNull(), F.concat(F.lit("AC=1;DP="), F.col("depth").cast("int"))).otherwise(F.lit("AC=1"))
    ad = F.when(F.col("pos") % 3 > 0, F.concat_ws(",", F.col("pos") % 50, F.col("pos") % 20)).otherwise(F.lit("."))
    sample = F.concat(F.lit("0/1:"), ad)
    return text.vcf_depth(spark, written(v.select(tabbed(F.col("chrom"), F.col("pos"), ".", "A", "G", ".", "PASS", info, "GT:AD", sample)), "vcf"))


@query("""SELECT chrom, start, end_ AS "end", concat('f', feature_id) AS name, CAST(feature_id % 1000 AS DOUBLE) AS score, CASE WHEN feature_id % 2 = 0 THEN '+' ELSE '-' END AS strand FROM features""", "features")
def bed_records(spark: S, d: str) -> D:
    f = domain(spark, d, "features")
    lines = f.select(tabbed(F.col("chrom"), F.col("start"), F.col("end_"), F.concat(F.lit("f"), F.col("feature_id")), F.col("feature_id") % 1000, F.when(F.col("feature_id") % 2 == 0, "+").otherwise("-")))
    return text.bed(spark, written(lines, "bed"))


@query("""SELECT chrom AS seqid, 'gene' AS type, start + 1 AS start, end_ AS "end", CASE WHEN feature_id % 2 = 0 THEN '+' END AS strand, concat('g', feature_id) AS id, 'a=b; c' AS note FROM features""", "features")
def gff_records(spark: S, d: str) -> D:
    f = domain(spark, d, "features")
    lines = f.select(tabbed(F.col("chrom"), "own", "gene", F.col("start") + 1, F.col("end_"), ".", F.when(F.col("feature_id") % 2 == 0, "+").otherwise("."), ".", F.concat(F.lit("ID=g"), F.col("feature_id"), F.lit(";Note=a%3Db%3B c"))))
    g = text.gff(spark, written(lines, "gff3"))
    return g.select("seqid", "type", "start", "end", "strand", F.col("attributes")["ID"].alias("id"), F.col("attributes")["Note"].alias("note"))


@query("""SELECT p_partkey % 90000 AS serial, 'CA' AS atom_name, 'GLY' AS res_name, substr('ABCD', CAST(1 + p_partkey % 4 AS INT), 1) AS chain, CAST(p_partkey % 900 AS INT) AS res_seq, CAST(p_size AS DOUBLE) AS x, -CAST(p_size AS DOUBLE) / 2 AS y, CAST(p_partkey % 100 AS DOUBLE) / 8 AS z, CAST(p_size AS DOUBLE) AS bfactor, 'C' AS element FROM part""")
def pdb_atoms(spark: S, d: str) -> D:
    p = base(spark, d, "part")
    chain = F.substring(F.lit("ABCD"), (1 + F.col("p_partkey") % 4).cast("int"), F.lit(1))
    number = lambda c: F.lpad(F.format_string("%.3f", c), 8, " ")
    size = F.col("p_size").cast("double")
    line = F.concat(F.lit("ATOM  "), F.format_string("%5d", F.col("p_partkey") % 90000), F.lit("  CA  GLY "), chain, F.format_string("%4d", F.col("p_partkey") % 900), F.lit("    "), number(size), number(-size / 2), number((F.col("p_partkey") % 100).cast("double") / 8), F.lit("  1.00"), F.lpad(F.format_string("%.2f", size), 6, " "), F.lit("          "), F.lit(" C"))
    return text.pdb(spark, written(p.select(line.alias("value")), "pdb"))


@query("""SELECT chain, res_seq, arg_min(res_name, serial) AS res_name, min(serial) AS first FROM (SELECT p_partkey AS serial, CASE p_partkey % 3 WHEN 0 THEN 'GLY' ELSE 'ALA' END AS res_name, substr('ABCD', CAST(1 + p_partkey % 4 AS INT), 1) AS chain, p_size AS res_seq FROM part) GROUP BY 1, 2""")
def residue_rows(spark: S, d: str) -> D:
    chain = F.substring(F.lit("ABCD"), (1 + F.col("p_partkey") % 4).cast("int"), F.lit(1))
    p = base(spark, d, "part").select(F.col("p_partkey").alias("serial"), F.when(F.col("p_partkey") % 3 == 0, "GLY").otherwise("ALA").alias("res_name"), chain.alias("chain"), F.col("p_size").alias("res_seq"))
    return text.residues(p)


@query("""SELECT s_name AS label, f AS feature, CASE f WHEN 'a' THEN s_acctbal ELSE s_acctbal / 4 END AS value FROM supplier, (VALUES ('a'), ('b')) v(f)""")
def radiomics_rows(spark: S, d: str) -> D:
    s = base(spark, d, "supplier")
    path = f"{graph._shared(spark)}/files-{uuid.uuid4().hex}.csv"
    sinks.write_csv(s.select(F.col("s_name").alias("label"), F.col("s_acctbal").alias("a"), (F.col("s_acctbal") / 4).alias("b")), path)
    return text.radiomics_long(spark.read.schema("label string, a double, b double").option("header", True).csv(path), "label", ["a", "b"])


@query("""SELECT row_no, kind, label, value FROM measurements""", "measurements")
def measurements_json(spark: S, d: str) -> D:
    path = f"{graph._shared(spark)}/files-{uuid.uuid4().hex}.json"
    sinks.write_json(domain(spark, d, "measurements").select("row_no", "kind", "label", "value"), path)
    return sinks.read_measurements(spark, path)


@query("""SELECT concat('"a, ', n_name, '",roi,', n_nationkey, '.5,mm') AS value FROM nation""")
def measurement_lines(spark: S, d: str) -> D:
    n = base(spark, d, "nation").select(F.concat(F.lit("a, "), F.col("n_name")).alias("label"), F.lit("roi").alias("kind"), (F.col("n_nationkey") + 0.5).alias("value"), F.lit("mm").alias("unit"))
    return sinks.measurement_lines(n)


# ---- operators that had no query


@query("""SELECT concat('s', c_nationkey, '|512x', 256 + c_custkey % 2, '|1.000,0.000,0.000,0.000,1.000,0.000|0.500,0.500') AS geometry, count(*) AS n FROM customer GROUP BY 1""")
def geometry_keys(spark: S, d: str) -> D:
    c = base(spark, d, "customer").select(F.concat(F.lit("s"), F.col("c_nationkey")).alias("series_uid"), F.lit(512).alias("cols"), (256 + F.col("c_custkey") % 2).cast("int").alias("rows"), F.array(*(F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0))).alias("iop"), F.array(F.lit(0.5), F.lit(0.50001)).alias("pixel_spacing"))
    return c.select(stacks.geometry_key().alias("geometry")).groupBy("geometry").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'v' || p_size END AS k, 'two' AS j FROM part""")
def attribute_maps(spark: S, d: str) -> D:
    p = base(spark, d, "part")
    line = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("k=v"), F.col("p_size"), F.lit(";"))).otherwise(F.lit("")), F.lit("j=one;j=two"))
    m = p.select("p_partkey", scalars.attributes(line).alias("m"))
    return m.select("p_partkey", F.col("m")["k"].alias("k"), F.col("m")["j"].alias("j"))


@query("""SELECT series, CASE WHEN ctdivol > 0 THEN 'ANON' END AS patient_name, CAST(NULL AS STRING) AS study_date, count(*) OVER (PARTITION BY study) AS same_study FROM (SELECT series, ctdivol, series % 10 AS study FROM doses)""", "doses")
def anonymous_records(spark: S, d: str) -> D:
    r = domain(spark, d, "doses").select("series", F.when(F.col("ctdivol") > 0, F.concat(F.lit("P"), F.col("series"))).alias("patient_name"), F.concat(F.lit("1.2."), F.col("series") % 10).alias("study_uid"), F.lit("20240101").alias("study_date"))
    out = quality.anonymize(r)
    n = out.groupBy("study_uid").agg(F.count("*").alias("same_study"))
    return out.join(n, "study_uid").select("series", "patient_name", "study_date", "same_study")


@query("""SELECT series, uid, CASE WHEN uid IN ('1.2.840.10008.1.2.1', '1.2.840.10008.1.2.4.50', '1.2.840.10008.1.2.4.70') THEN NULL ELSE 'transfer-syntax' END AS refusal FROM doses""", "doses")
def readable_syntaxes(spark: S, d: str) -> D:
    uid = F.col("uid")
    return domain(spark, d, "doses").select("series", "uid", F.when(~quality.readable_syntax(uid), "transfer-syntax").alias("refusal"))


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'rt_plan' WHEN 1 THEN 'rt_dose' WHEN 2 THEN 'us' ELSE 'other' END AS family FROM nation""")
def storage_families(spark: S, d: str) -> D:
    uids = F.array(*(F.lit(x) for x in ("1.2.840.10008.5.1.4.1.1.481.5", "1.2.840.10008.5.1.4.1.1.481.2", "1.2.840.10008.5.1.4.1.1.6.1", "1.2.3")))
    return base(spark, d, "nation").select("n_nationkey", quality.sop_family(F.get(uids, (F.col("n_nationkey") % 4).cast("int"))).alias("family"))


@query("""SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def top_orders(spark: S, d: str) -> D:
    o = base(spark, d, "orders").select("o_orderkey", (-F.col("o_totalprice")).alias("by"))
    return ordered.limit_with_rest(o, 25, "by", "o_orderkey")[0].select("o_orderkey")


@query("""SELECT o_orderkey AS node, o_custkey AS component FROM orders WHERE o_custkey = (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY count(*) DESC, o_custkey LIMIT 1)""")
def largest_component(spark: S, d: str) -> D:
    return graph.largest_component(base(spark, d, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_custkey").alias("component")))


@query("""SELECT o_orderkey AS node, o_custkey AS component FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 12)""")
def components_without_small(spark: S, d: str) -> D:
    return graph.without_small(base(spark, d, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_custkey").alias("component")), 12)


@query("""SELECT series, x, y, z, CASE WHEN v > 40 THEN 2 WHEN v > 20 THEN 9 ELSE 1 END AS label FROM voxels""", "voxels")
def labels_replaced(spark: S, d: str) -> D:
    v = domain(spark, d, "voxels")
    labels = v.select("series", "x", "y", "z", F.when(F.col("v") > 40, 2).when(F.col("v") > 20, 3).otherwise(1).alias("label"))
    return sets.replace_label(labels, 3, 9)


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN 'UNVERIFIED' END AS license FROM supplier WHERE s_suppkey % 3 < 2""")
def unlicensed_rows(spark: S, d: str) -> D:
    k = F.col("s_suppkey") % 3
    return quality.unlicensed(base(spark, d, "supplier").select("s_suppkey", F.when(k == 1, "UNVERIFIED").when(k == 2, "CC0-1.0").alias("license")))


@query("""SELECT CASE WHEN n_nationkey % 5 = 0 THEN 'F' || n_nationkey ELSE 'FMA' || n_nationkey END AS term, CASE WHEN n_nationkey % 5 = 0 THEN 'term-id' WHEN n_nationkey % 7 = 1 THEN 'name' WHEN n_nationkey % 3 = 0 THEN 'parent' ELSE 'members' END AS reason FROM nation WHERE n_nationkey % 5 = 0 OR n_nationkey % 7 = 1 OR n_nationkey % 3 = 0 OR n_nationkey % 4 = 1""")
def bad_term_rows(spark: S, d: str) -> D:
    k = F.col("n_nationkey")
    terms = base(spark, d, "nation").select(F.concat(F.when(k % 5 == 0, "F").otherwise("FMA"), k).alias("term"), F.when(k % 7 == 1, "").otherwise(F.col("n_name")).alias("name"), F.when(k % 3 == 0, "").alias("parent"), F.when(k % 4 == 1, F.array(F.lit("m"), F.lit(""))).otherwise(F.array(F.lit("m"))).alias("members"))
    return quality.bad_terms(terms)


@query(""", l AS (SELECT s_suppkey AS line_id, CAST(s_suppkey % 4 AS INT) AS series, CAST(s_suppkey % 24 AS DOUBLE) AS ax, 0.0 AS ay, 0.0 AS az, 20.0 AS bx, CAST(s_nationkey AS DOUBLE) AS by_, 15.0 AS bz FROM supplier),
  p AS (SELECT line_id, series, k, CAST(floor(ax + (bx - ax) * (k / 15.0) + 0.5) AS INT) AS x, CAST(floor(ay + (by_ - ay) * (k / 15.0) + 0.5) AS INT) AS y, CAST(floor(az + (bz - az) * (k / 15.0) + 0.5) AS INT) AS z FROM l, (SELECT CAST(unnest(range(0, 16)) AS INT) AS k)) SELECT p.line_id, p.k, v.v FROM p LEFT JOIN voxels v ON v.series = p.series AND v.x = p.x AND v.y = p.y AND v.z = p.z""", "voxels")
def line_profiles(spark: S, d: str) -> D:
    k = F.col("s_suppkey")
    lines = base(spark, d, "supplier").select(k.alias("line_id"), (k % 4).cast("int").alias("series"), (k % 24).cast("double").alias("ax"), F.lit(0.0).alias("ay"), F.lit(0.0).alias("az"), F.lit(20.0).alias("bx"), F.col("s_nationkey").cast("double").alias("by_"), F.lit(15.0).alias("bz"))
    return voxels.profile_lines(lines, domain(spark, d, "voxels"), 16)


@query("""SELECT series, bin, round((SELECT count(*) FROM voxels w WHERE w.series = t.series AND floor(w.v / t.top * 20) >= bin) * 1.0 / n, 9) AS share FROM (SELECT series, max(v) AS top, count(*) AS n FROM voxels GROUP BY 1) t, (SELECT CAST(unnest(range(0, 21)) AS INT) AS bin)""", "voxels")
def dose_volume(spark: S, d: str) -> D:
    return voxels.cumulative_dose(domain(spark, d, "voxels"), "series", bins=20).select("series", "bin", F.round("share", 9).alias("share"))


@query("""SELECT block AS line_id, asym, count(*) AS n_points FROM points GROUP BY ALL HAVING max(((x - 10) * (x - 10) + (y - 20) * (y - 20) + (z - 10) * (z - 10) <= 64)::INT) = 1 AND max((x * x + y * y + z * z <= 9)::INT) = 0""", "points")
def lines_through_spheres(spark: S, d: str) -> D:
    p = domain(spark, d, "points").withColumn("line", F.struct("block", "asym"))
    out = voxels.through_spheres(p, [(10.0, 20.0, 10.0, 8.0)], [(0.0, 0.0, 0.0, 3.0)], "line")
    return out.select(F.col("line.block").alias("line_id"), F.col("line.asym").alias("asym"), "n_points")
