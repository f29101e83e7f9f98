"""Queries over readouts, keys, records, regions and plates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import readouts
from ..sources import dicom_objects, files, zarr
from .file_queries import SEQ, E, _suppliers
from .registry import query
from .tables import base, domain

S, D = SparkSession, DataFrame


@query(""", p AS (SELECT p_partkey AS point_id, CAST(p_partkey % 100 AS BIGINT) AS series, (p_partkey % 30) / 2.0 - 1 AS px, p_size / 4.0 AS py, (p_partkey % 19) / 2.0 AS pz FROM part)
  SELECT point_id, round(v, 6) AS v FROM p LEFT JOIN solids s ON s.series = p.series AND s.x = floor(px + 0.5) AND s.y = floor(py + 0.5) AND s.z = floor(pz + 0.5)""", "solids")
def probed_points(spark: S, d: str) -> D:
    k, s = F.col("p_partkey"), F.col("p_size")
    p = base(spark, d, "part").select(k.alias("point_id"), (k % 100).cast("bigint").alias("series"), (k % 30 / 2.0 - 1).alias("px"), (s / 4.0).alias("py"), (k % 19 / 2.0).alias("pz"))
    return readouts.probe(p, domain(spark, d, "solids")).select("point_id", F.round("v", 6).alias("v"))


NEAR = "CASE WHEN n = 1 THEN sqrt((u - a) ** 2 + (v - b) ** 2) <= 3 ELSE sqrt((a + least(1, greatest(0, ((u - a) * 6 + (v - b) * 8) / 100)) * 6 - u) ** 2 + (b + least(1, greatest(0, ((u - a) * 6 + (v - b) * 8) / 100)) * 8 - v) ** 2) <= 3 END"


@query(f"SELECT p_partkey, p_partkey % 7 > 0 AND p_partkey % 5 > 0 AND {NEAR} AS near FROM (SELECT p_partkey, p_size % 2 + 1 AS n, CAST(p_partkey % 11 AS DOUBLE) AS a, CAST(p_size AS DOUBLE) AS b, CAST(p_partkey % 13 AS DOUBLE) AS u, CAST(p_size + p_partkey % 9 AS DOUBLE) AS v FROM part)")
def near_annotations(spark: S, d: str) -> D:
    k, s = F.col("p_partkey"), F.col("p_size")
    a, b = (k % 11).cast("double"), s.cast("double")
    one = F.struct(a.alias("u"), b.alias("v"))
    points = F.when(s % 2 == 0, F.array(one)).otherwise(F.array(one, F.struct((a + 6).alias("u"), (b + 8).alias("v"))))
    rows = base(spark, d, "part").select("p_partkey", points.alias("points"), (k % 13).cast("double").alias("u"), (s + k % 9).cast("double").alias("v"), (k % 7 == 0).alias("locked"), (k % 5 > 0).alias("visible"))
    return rows.select("p_partkey", readouts.near_annotation(3.0).alias("near"))


@query("SELECT label, count(*) AS n FROM (SELECT CAST(floor(v / 20) AS INT) AS label FROM solids WHERE v >= 0) WHERE label <> 0 GROUP BY 1", "solids")
def labels_of_masks(spark: S, d: str) -> D:
    labels = domain(spark, d, "solids").filter("v >= 0").select("series", "x", "y", "z", F.floor(F.col("v") / 20).cast("int").alias("label"))
    return readouts.label_masks(labels).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT event_id, action FROM log WHERE series = (SELECT max(series) FROM log)", "log")
def audit_of_one(spark: S, d: str) -> D:
    log = domain(spark, d, "log")
    return readouts.audit_for(log, log.agg(F.max("series")).first()[0]).select("event_id", "action")


@query("SELECT o_custkey AS cohort, min(o_orderkey % 3 + 1) AS low, max(o_orderkey % 3 + 1) AS high FROM orders GROUP BY 1")
def difficulty_ranges(spark: S, d: str) -> D:
    cohorts = base(spark, d, "orders").groupBy(F.col("o_custkey").alias("cohort")).agg(F.collect_list(F.struct((F.col("o_orderkey") % 3 + 1).alias("difficulty"))).alias("cases"))
    return cohorts.select("cohort", readouts.difficulty_range(F.col("cases")).alias("r")).select("cohort", "r.low", "r.high")


@query(""", m AS (SELECT block, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM points GROUP BY 1), t AS (SELECT point_id, mx, my, mz, (x - mx) * cos(0.4) + (z - mz) * sin(0.4) AS x1, y - my AS y0, (z - mz) * cos(0.4) - (x - mx) * sin(0.4) AS z1 FROM points JOIN m USING (block))
  SELECT point_id, round(x1 + mx, 6) AS x, round(y0 * cos(0.3) - z1 * sin(0.3) + my, 6) AS y, round(y0 * sin(0.3) + z1 * cos(0.3) + mz, 6) AS z FROM t""", "points")
def turned_points(spark: S, d: str) -> D:
    out = readouts.rotate_points(domain(spark, d, "points"), 0.4, 0.3, ["block"])
    return out.select("point_id", *(F.round(c, 6).alias(c) for c in "xyz"))


@query("SELECT o_orderkey, 'T' || o_custkey || '|1.' || o_orderkey || '|' || coalesce(CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 9 END AS STRING), '') || '||' || o_custkey % 512 || 'x0' AS key FROM orders")
def series_keys(spark: S, d: str) -> D:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    none = F.lit(None).cast("string")
    return base(spark, d, "orders").select("o_orderkey", scalars.series_key(F.concat(F.lit("T"), c), F.concat(F.lit("1."), k), F.when(k % 2 == 0, k % 9), none, c % 512, none).alias("key"))


@query("SELECT p_partkey, p_brand || '|axial|' || p_size || '|W' || CASE WHEN p_partkey % 6 = 0 THEN 'nan' WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS STRING) ELSE p_partkey || '.5' END || 'C' || p_size || '|' || CASE WHEN p_size % 2 = 0 THEN 'inv' ELSE 'nrm' END || '|t' || CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size END AS key FROM part")
def view_keys(spark: S, d: str) -> D:
    k, s = F.col("p_partkey"), F.col("p_size")
    width = F.when(k % 6 == 0, float("nan")).when(k % 2 == 0, k.cast("double")).otherwise(k + 0.5)
    return base(spark, d, "part").select("p_partkey", scalars.view_key(F.col("p_brand"), F.lit("axial"), s, width, s.cast("double"), s % 2 == 0, F.when(s % 3 > 0, s)).alias("key"))


LUMA = "CAST(floor(0.299 * floor(least(255, greatest(0, y - 179.456 + 1.402 * r))) + 0.587 * floor(least(255, greatest(0, y + 135.459 - 0.344 * b - 0.714 * r))) + 0.114 * floor(least(255, greatest(0, y - 226.816 + 1.772 * b)))) AS INT)"


@query(f"SELECT p_partkey, {LUMA} AS luma FROM (SELECT p_partkey, CAST(p_partkey % 256 AS DOUBLE) AS y, CAST(p_size * 5 % 256 AS DOUBLE) AS b, CAST(p_partkey * 3 % 256 AS DOUBLE) AS r FROM part)")
def luma_values(spark: S, d: str) -> D:
    k, s = F.col("p_partkey"), F.col("p_size")
    return base(spark, d, "part").select("p_partkey", scalars.luma_of_ybr((k % 256).cast("double"), (s * 5 % 256).cast("double"), (k * 3 % 256).cast("double")).alias("luma"))


@query("""SELECT i, CAST(least(255, floor(sum(k * r / 255.0) * 255 + 0.5)) AS INT) AS r, CAST(least(255, floor(sum(k * g / 255.0) * 255 + 0.5)) AS INT) AS g, CAST(least(255, floor(sum(k * b / 255.0) * 255 + 0.5)) AS INT) AS b FROM (SELECT p_partkey % 500 AS i, p_size % 3 AS channel, least(1, greatest(0, (p_retailprice - 900) / (CASE p_size % 3 WHEN 0 THEN 100 WHEN 1 THEN 700 ELSE 0.0005 END))) AS k FROM part) JOIN (VALUES (0, 255, 0, 0), (1, 10, 200, 0), (2, 0, 3, 4)) l(channel, r, g, b) USING (channel) GROUP BY 1""")
def composited_channels(spark: S, d: str) -> D:
    limits = spark.createDataFrame([(0, 900.0, 1000.0, 255, 0, 0), (1, 900.0, 1600.0, 10, 200, 0), (2, 900.0, 900.0, 0, 3, 4)], "channel bigint, low double, high double, r int, g int, b int")
    rows = base(spark, d, "part").select((F.col("p_partkey") % 500).alias("i"), (F.col("p_size") % 3).cast("bigint").alias("channel"), F.col("p_retailprice").cast("double").alias("v"))
    return readouts.composite(rows, limits, ["i"])


@query("SELECT o_custkey, o_orderkey, floor(avg(CAST(o_totalprice AS DOUBLE)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 0.5) AS mean FROM orders")
def means_of_passes(spark: S, d: str) -> D:
    o = base(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("double").alias("v"))
    return readouts.pass_means(o, ["o_custkey"], "o_orderkey", "v").select("o_custkey", "o_orderkey", "mean")


@query("SELECT CASE s_suppkey % 4 WHEN 0 THEN 'rt_plan' WHEN 1 THEN 'rt_dose' WHEN 2 THEN 'us' ELSE 'other' END AS route, s_suppkey FROM supplier")
def routed_files(spark: S, d: str) -> D:
    uids = F.array(*(F.lit(x) for x in ("1.2.840.10008.5.1.4.1.1.481.5", "1.2.840.10008.5.1.4.1.1.481.2", "1.2.840.10008.5.1.4.1.1.6.1", "1.2.3")))
    rows = base(spark, d, "supplier").select("s_suppkey", F.get(uids, (F.col("s_suppkey") % 4).cast("int")).alias("sop_class"))
    parts = [df.select(F.lit(kind).alias("route"), "s_suppkey") for kind, df in readouts.routed(rows).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT 'k' || s_suppkey AS key, s_suppkey % 2 + s_suppkey % 3 AS n_files, s_suppkey % 3 > 0 AS has_seg, CASE WHEN s_suppkey % 2 = 1 THEN 'dicom' ELSE 'nifti' END AS source, CASE WHEN s_suppkey % 5 > 0 THEN s_name END AS patient_name, CASE WHEN s_suppkey % 5 > 0 THEN CAST(s_nationkey AS BIGINT) * 4 * 5 END AS voxels FROM supplier")
def worklist_records(spark: S, d: str) -> D:
    k = F.col("s_suppkey")
    s = base(spark, d, "supplier").withColumn("key", F.concat(F.lit("k"), k))
    few = lambda n: F.when(n > 0, F.array_repeat(F.lit("f"), n.cast("int")))
    entries = s.select("key", F.lit(None).cast("array<string>").alias("img"), few(k % 3).alias("seg"), few(k % 2).alias("dicom"))
    headers = s.filter(k % 5 > 0).select("key", F.col("s_name").alias("patient_name"), F.array(F.col("s_nationkey").cast("int"), F.lit(4), F.lit(5)).alias("dims"))
    return readouts.records(entries, headers).select("key", F.size("files").alias("n_files"), "has_seg", "source", "patient_name", "voxels")


@query("SELECT s_suppkey AS k, (s_suppkey % 10 + 1) / 10.0 * 10 AS row_mm, (s_nationkey + 1) / 8.0 * 10 AS col_mm FROM supplier WHERE s_suppkey % 3 > 0")
def region_spacings(spark: S, d: str) -> D:
    def content(r: dict) -> bytes:
        region = lambda kind, unit, x, y: E(0x18, 0x6012, "US", kind) + E(0x18, 0x6024, "US", unit) + E(0x18, 0x6026, "US", unit) + E(0x18, 0x602C, "FD", x) + E(0x18, 0x602E, "FD", y)
        unit = 3 if r["k"] % 3 else 4
        return files.dicom_file(SEQ(0x18, 0x6011, region(2, 3, 1.0, 1.0), region(1, unit, (r["n"] + 1) / 8, (r["k"] % 10 + 1) / 10), region(1, unit, 9.0, 9.0)))

    rows = dicom_objects.region_spacing(dicom_objects.rows(spark, files.write(_suppliers(spark, d), "file", content, "regions"), "regions"))
    return rows.select(F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("bigint").alias("k"), "row_mm", "col_mm")


@query("SELECT CASE WHEN s_suppkey > 0 THEN CAST(s_suppkey AS INT) END AS total_cols, CAST(s_nationkey + 1 AS INT) AS total_rows, CAST(s_suppkey % 4 AS INT) AS tiles FROM supplier")
def slide_grids(spark: S, d: str) -> D:
    content = lambda r: files.dicom_file(E(8, 0x16, "UI", dicom_objects.SLIDE_CLASS), E(0x48, 6, "UL", r["k"]), E(0x48, 7, "UL", r["n"] + 1), SEQ(0x48, 0x21A, *(E(0x48, 0x21E, "UL", k) for k in range(r["k"] % 4))))
    return dicom_objects.rows(spark, files.write(_suppliers(spark, d), "file", content, "slides"), "slides").select("total_cols", "total_rows", "tiles")


@query("SELECT 'Report ' || s_suppkey AS title, 'application/pdf' AS mime, CAST(2 * (s_nationkey + 1) AS INT) AS size FROM supplier")
def embedded_documents(spark: S, d: str) -> D:
    content = lambda r: files.dicom_file(E(8, 0x16, "UI", dicom_objects.DOCUMENT_CLASSES[0]), E(0x42, 0x10, "ST", f"Report {r['k']}"), E(0x42, 0x11, "OB", b"xy" * (r["n"] + 1)), E(0x42, 0x12, "LO", "application/pdf"))
    return dicom_objects.rows(spark, files.write(_suppliers(spark, d), "file", content, "embedded"), "documents").drop("path")


@query("SELECT s_name AS plate, 'A/' || c AS path, CAST(0 AS INT) AS row, CAST(c AS INT) AS \"column\", 'A0' || c AS label FROM supplier, range(0, 3) AS a(c)")
def plate_wells(spark: S, d: str) -> D:
    names = lambda *n: F.array(*(F.struct(F.lit(x).alias("name")) for x in n))
    wells = F.array(*(F.struct(F.lit(f"A/{c}").alias("path"), F.lit(0).alias("rowIndex"), F.lit(c).alias("columnIndex")) for c in range(3)))
    docs = base(spark, d, "supplier").select(F.to_json(F.struct(F.struct(F.col("s_name").alias("name"), names("A").alias("rows"), names("00", "01", "02").alias("columns"), wells.alias("wells")).alias("plate"))).alias("attrs"))
    return zarr.plate_wells(docs)
