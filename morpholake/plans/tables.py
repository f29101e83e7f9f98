"""Domain tables as projections of the star-schema tables: the same expressions on Spark and, for the oracle, in SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import dealt

#: Valid in Spark SQL and DuckDB alike: substr, concat, %, casts and CASE only.
SQL_OF = {
    "atoms": """SELECT substr('ABCD', CAST(1 + l_suppkey % 4 AS INT), 1) AS label_asym_id, substr('ABCD', CAST(1 + l_partkey % 4 AS INT), 1) AS auth_asym_id,
      CAST(l_partkey % 60 AS INT) AS label_seq_id, CAST(l_linenumber * 10 AS INT) AS auth_seq_id, CASE l_returnflag WHEN 'A' THEN 'C' WHEN 'N' THEN 'N' ELSE 'O' END AS type_symbol,
      CASE l_linestatus WHEN 'F' THEN 'CA' ELSE 'CB' END AS label_atom_id, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z, l_extendedprice AS b_iso FROM lineitem""",
    "points": """SELECT p_partkey AS point_id, substr('ABCD', CAST(1 + p_partkey % 4 AS INT), 1) AS asym, CAST(p_partkey % 40 AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y, CAST((p_partkey * 7) % 30 AS DOUBLE) AS z,
      CAST(p_partkey % 8 AS INT) AS block FROM part""",
    "variants": """SELECT o_orderkey AS variant_id, concat('chr', CAST(o_custkey % 5 AS STRING)) AS chrom, o_orderkey % 5000 + 1 AS pos, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_custkey % 90 AS DOUBLE) END AS depth FROM orders""",
    "codon_entries": """SELECT p_partkey AS entry_no, concat('chr', CAST(p_partkey % 5 AS STRING)) AS chrom, p_partkey * 17 % 5000 + 1 AS start, p_partkey * 17 % 5000 + 1 + p_size % 9 AS end_, substr('ABCD', CAST(1 + p_partkey % 4 AS INT), 1) AS chain,
      p_partkey AS res_start, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END AS strand FROM part""",
    "features": """SELECT o_orderkey AS feature_id, concat('chr', CAST(o_custkey % 5 AS STRING)) AS chrom, o_orderkey % 5000 AS start, o_orderkey % 5000 + 1 + o_custkey % 50 AS end_ FROM orders""",
    "measurements": """SELECT o_orderkey AS row_no, CASE o_orderstatus WHEN 'F' THEN 'length' WHEN 'O' THEN 'roi' ELSE 'angle' END AS kind, o_orderkey % 2 = 1 AS later,
      concat('Lesion ', CAST(o_custkey AS STRING), CASE WHEN o_orderkey % 2 = 1 THEN ' (FU) x' ELSE '' END) AS label, o_totalprice AS value, 'mm' AS unit, o_custkey % 11 AS series FROM orders""",
    "worklist": """SELECT CAST(d.doc_id AS STRING) AS key, upper(d.lang) AS modality, d.source AS series_description, CASE WHEN d.n_chars % 3 = 0 THEN NULL ELSE d.n_chars END AS voxels, l.doc_id IS NOT NULL AS has_seg, CASE WHEN d.doc_id % 2 = 0 THEN 'local' ELSE 'remote' END AS source
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "voxels": """SELECT CAST(l_linenumber % 4 AS INT) AS series, CAST(l_partkey % 24 AS INT) AS x, CAST(l_suppkey % 20 AS INT) AS y, CAST(l_orderkey % 16 AS INT) AS z, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3, 4""",
    "solids": """SELECT s_suppkey AS series, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS INT) AS z, CAST(40 + s_nationkey AS DOUBLE) - (x - CAST(5.25 AS DOUBLE)) * (x - CAST(5.25 AS DOUBLE)) * 2 - (y - CAST(4.75 AS DOUBLE)) * (y - CAST(4.75 AS DOUBLE)) * 3 - (z - CAST(3.6 AS DOUBLE)) * (z - CAST(3.6 AS DOUBLE)) * 1 AS v
      FROM supplier, range(0, 12) AS a(x), range(0, 11) AS b(y), range(0, 9) AS c(z)""",
    "triangles": """SELECT s_suppkey AS tri, CAST(s_suppkey % 4 AS INT) AS series, CAST(s_suppkey % 37 AS DOUBLE) AS ax, CAST(s_nationkey AS DOUBLE) AS ay, CAST(s_suppkey % 11 AS DOUBLE) AS az, CAST(s_suppkey % 37 + 5 AS DOUBLE) AS bx, CAST(s_nationkey + 1 AS DOUBLE) AS by, CAST(s_suppkey % 7 AS DOUBLE) AS bz,
      CAST(s_suppkey % 41 AS DOUBLE) AS cx, CAST(s_nationkey + 6 AS DOUBLE) AS cy, CAST(s_suppkey % 5 + 2 AS DOUBLE) AS cz FROM supplier""",
    "spots": """SELECT p_partkey AS point_id, CAST(p_partkey % 4 AS INT) AS series, CAST(p_partkey % 43 AS DOUBLE) + CAST(0.125 AS DOUBLE) AS px, CAST(p_size % 32 AS DOUBLE) AS py, CAST(p_partkey % 17 AS DOUBLE) / 2 AS pz FROM part""",
    "pixels": """SELECT CAST(o_custkey % 6 AS INT) AS tile, CAST(o_orderkey % 48 AS INT) AS x, CAST(o_custkey % 40 AS INT) AS y, max(CAST((o_orderkey * 7 + o_custkey) % 100 AS DOUBLE)) AS v FROM orders GROUP BY 1, 2, 3""",
    "channels": """SELECT p_brand AS channel, p_partkey AS i, CASE WHEN p_size % 10 = 0 THEN CAST(0 AS DOUBLE) ELSE p_retailprice END AS v FROM part""",
    "isa": """SELECT concat('c', CAST(c_custkey AS STRING)) AS node, concat('n', CAST(c_nationkey AS STRING)) AS parent FROM customer UNION ALL SELECT concat('n', CAST(n_nationkey AS STRING)), concat('r', CAST(n_regionkey AS STRING)) FROM nation
      UNION ALL SELECT concat('r', CAST(r_regionkey AS STRING)), 'root' FROM region""",
    "terms": """SELECT concat('FMA', CAST(n_nationkey + 1000 AS STRING)) AS concept, n_name AS name, n_nationkey FROM nation""",
    "log": """SELECT event_id, ts, user_id AS series, CASE event_type WHEN 'view' THEN 'open' WHEN 'click' THEN 'finish' WHEN 'purchase' THEN 'sign' WHEN 'error' THEN 'unlock' ELSE 'other' END AS action, value FROM events""",
    "phantom": """SELECT o_orderkey AS row_no, o_custkey % 50 AS series, substr(CAST(o_orderdate AS STRING), 1, 10) AS date, o_totalprice / 1000 AS mean_hu, CAST(100 AS DOUBLE) AS expected_hu, CAST(60 AS DOUBLE) AS tolerance_hu FROM orders""",
    "frames": """SELECT vec_id, label, embedding FROM embeddings""",
    "doses": """SELECT s_suppkey AS series, s_acctbal AS ctdivol, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal * 2 END AS dlp, CAST(s_nationkey * 10 AS DOUBLE) AS kvp,
      CASE s_suppkey % 5 WHEN 0 THEN '1.2.840.10008.1.2.1' WHEN 1 THEN '1.2.840.10008.1.2.4.50' WHEN 2 THEN '1.2.840.10008.1.2.4.70' WHEN 3 THEN NULL ELSE '1.2.840.10008.1.2.9' END AS uid FROM supplier""",
}
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domain(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table.  Base tables are bound as arguments of the query, so nothing is registered in the session."""
    text = SQL_OF[name]
    used = {t: base(spark, sf_dir, t) for t in BASE if f" {t}" in text}
    if name == "solids":  # a supplier becomes 1,188 voxels: not all in the one task that reads a small file
        used["supplier"] = dealt(used["supplier"].select("s_suppkey", "s_nationkey"))
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **used)
