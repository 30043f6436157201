"""Domain tables made from the test tables by integer arithmetic, as SQL that reads the same in Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_addr": """
SELECT CAST(p_partkey AS BIGINT) AS row_id,
  CASE p_partkey % 4 WHEN 0 THEN 'way:' WHEN 1 THEN 'relation:' WHEN 2 THEN 'node:' ELSE 'x:' END || CAST(p_partkey AS STRING) AS addr_id,
  CASE WHEN p_partkey % 23 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN upper(p_name) WHEN p_partkey % 7 = 0 THEN p_name || ' (alias)'
    WHEN p_partkey % 5 = 0 THEN replace(p_name, 'a', 'ă') WHEN p_partkey % 13 = 0 THEN 'bulevardul ' || p_name ELSE p_name END AS addr_street,
  CASE p_partkey % 9 WHEN 0 THEN CAST(p_size AS STRING) || 'A' WHEN 1 THEN CAST(p_size AS STRING) || '-' || CAST(p_size + 4 AS STRING)
    WHEN 2 THEN CAST(p_size AS STRING) || '–' || CAST(p_size + 3 AS STRING) WHEN 3 THEN CAST(p_size AS STRING) || '/1' WHEN 4 THEN 'A' || CAST(p_size AS STRING)
    WHEN 5 THEN CASE WHEN p_partkey % 2 = 0 THEN 'bis' ELSE NULL END ELSE ' ' || CAST(p_size AS STRING) || ' ' END AS addr_housenumber
FROM part""",
    "v_rsv": """
SELECT CAST(p_partkey AS BIGINT) AS row_id, CASE p_partkey % 3 WHEN 0 THEN 'B' WHEN 1 THEN ' CJ ' ELSE 'IF' END AS judet, p_brand AS uat,
  CASE WHEN p_partkey % 30 < 3 THEN CASE WHEN p_partkey % 210 = 0 THEN '1.5' ELSE ' ' || CAST(CAST((p_partkey - p_partkey % 30) / 30 AS BIGINT) + 1 AS STRING) END WHEN p_partkey % 30 = 20 THEN 'x' ELSE NULL END AS nr_sv,
  ' ' || p_type || ' ' AS sediu_sv, p_brand AS adresa_sv, CASE WHEN p_partkey % 2 = 0 THEN '  ' ELSE p_type END AS adresa_sv_descriptiva, NULLIF(p_brand, 'Brand#11') AS localitate_sat,
  CASE p_partkey % 4 WHEN 0 THEN CAST(p_partkey AS STRING) WHEN 1 THEN ' ' || CAST(p_partkey AS STRING) || ' ' WHEN 2 THEN '12.0' ELSE NULL END AS cod_artera,
  CASE WHEN p_partkey % 30 < 3 THEN NULL WHEN p_partkey % 30 = 9 THEN ' ' WHEN p_partkey % 30 = 11 THEN 'Domiciliul pe raza ' || p_name WHEN p_partkey % 17 = 0 THEN '(' || p_name || ')'
    WHEN p_partkey % 19 = 0 THEN substr(p_name, 3, 7) ELSE upper(p_name) || ' (fost)' END AS artera,
  CASE WHEN p_partkey % 30 < 3 THEN 'nr. -#' ELSE CASE p_partkey % 14 WHEN 0 THEN 'integral#' WHEN 1 THEN 'numere impare nr. ' || CAST(p_size AS STRING) || ' -' || CAST(p_size + 20 AS STRING) || '#'
    WHEN 2 THEN 'numere impare nr. 1 -19# numere pare nr. ' || CAST(p_size AS STRING) || ' -72#' WHEN 3 THEN 'numere impare nr. 21 -299 BIS# nr. 30 -49# nr. 19 B#' WHEN 4 THEN 'numere pare#' WHEN 5 THEN 'bloc A#'
    WHEN 6 THEN 'nr. 5, nr. ' || CAST(p_size AS STRING) || '#' WHEN 7 THEN 'nr. 5 nr. 7#' WHEN 8 THEN 'nr. 21 -299 nr. 301#' WHEN 9 THEN 'nr. 2 BIS -10# NR. 7A# Nr. ' || CAST(p_size AS STRING) || '#'
    WHEN 10 THEN 'Integral #nr. 3#' WHEN 11 THEN NULL WHEN 12 THEN 'nr. 9 - 2, nr. 4#' ELSE 'numere impare nr. -# numere impare#' END END AS numar_imobil
FROM part""",
    "v_pt": """
SELECT CAST(c_custkey AS BIGINT) AS pt_id, CAST(c_custkey % 5 AS BIGINT) AS key, CAST(c_custkey % 5 AS BIGINT) AS line_id,
  CAST((c_custkey * 7919) % 1000 AS DOUBLE) AS x, CAST((c_custkey * 104729) % 400 AS DOUBLE) AS y
FROM customer""",
    "v_sv": """
SELECT CAST(s_suppkey AS BIGINT) AS pt_id, CAST(s_suppkey % 5 AS BIGINT) AS key, CAST(s_suppkey % 5 AS BIGINT) AS line_id,
  CAST((s_suppkey * 7919) % 1000 AS DOUBLE) AS x, CAST((s_suppkey * 104729) % 400 AS DOUBLE) AS y
FROM supplier""",
    "v_bld": """
SELECT CAST(p_partkey AS BIGINT) AS bld_id, CAST((p_partkey * 7907) % 980 AS DOUBLE) AS x0, CAST((p_partkey * 6101) % 380 AS DOUBLE) AS y0,
  CAST((p_partkey * 7907) % 980 + 4 + p_partkey % 13 AS DOUBLE) AS x1, CAST((p_partkey * 6101) % 380 + 4 + p_partkey % 9 AS DOUBLE) AS y1
FROM part""",
    "v_bedge": """
SELECT bld_id, CASE e WHEN 0 THEN x0 WHEN 1 THEN x1 - 2 WHEN 2 THEN x1 ELSE x0 + 1 END AS x0, CASE e WHEN 0 THEN y0 + 1 WHEN 1 THEN y0 WHEN 2 THEN y1 - 2 ELSE y1 END AS y0,
  CASE e WHEN 0 THEN x1 - 2 WHEN 1 THEN x1 WHEN 2 THEN x0 + 1 ELSE x0 END AS x1, CASE e WHEN 0 THEN y0 WHEN 1 THEN y1 - 2 WHEN 2 THEN y1 ELSE y0 + 1 END AS y1
FROM (SELECT CAST(p_partkey AS BIGINT) AS bld_id, CAST((p_partkey * 7907) % 980 AS DOUBLE) AS x0, CAST((p_partkey * 6101) % 380 AS DOUBLE) AS y0,
    CAST((p_partkey * 7907) % 980 + 4 + p_partkey % 13 AS DOUBLE) AS x1, CAST((p_partkey * 6101) % 380 + 4 + p_partkey % 9 AS DOUBLE) AS y1 FROM part) b
  CROSS JOIN (SELECT 0 AS e UNION ALL SELECT 1 AS e UNION ALL SELECT 2 AS e UNION ALL SELECT 3 AS e) m""",
    "v_vert": """
SELECT CAST(n_regionkey AS BIGINT) AS line_id, CAST(n_nationkey AS BIGINT) AS seq, CAST(n_nationkey * 40 AS DOUBLE) AS x, CAST(40 + (n_nationkey * 53) % 320 AS DOUBLE) AS y
FROM nation""",
    "v_edge": """
SELECT CAST(k AS BIGINT) AS poly_id, CASE e WHEN 0 THEN a WHEN 1 THEN a + 150 WHEN 2 THEN a + 180 ELSE a + 20 END AS x0, CASE e WHEN 0 THEN b WHEN 1 THEN b + 10 WHEN 2 THEN b + 160 ELSE b + 140 END AS y0,
  CASE e WHEN 0 THEN a + 150 WHEN 1 THEN a + 180 WHEN 2 THEN a + 20 ELSE a END AS x1, CASE e WHEN 0 THEN b + 10 WHEN 1 THEN b + 160 WHEN 2 THEN b + 140 ELSE b END AS y1
FROM (SELECT n_nationkey AS k, CAST((n_nationkey * 173) % 800 AS DOUBLE) AS a, CAST((n_nationkey * 97) % 240 AS DOUBLE) AS b FROM nation) n
  CROSS JOIN (SELECT 0 AS e UNION ALL SELECT 1 AS e UNION ALL SELECT 2 AS e UNION ALL SELECT 3 AS e) m""",
    "v_edge_raw": """
SELECT CAST(o_orderkey AS BIGINT) AS osmid, CASE o_orderkey % 4 WHEN 0 THEN 'node' WHEN 1 THEN 'way' WHEN 2 THEN 'relation' ELSE NULL END AS etype,
  CASE WHEN o_orderkey % 7 = 0 THEN 'bad' ELSE CAST(o_custkey AS STRING) || '.5' END AS length
FROM orders""",
    "v_layers": """
SELECT CAST(n_nationkey AS BIGINT) AS ord, CASE n_nationkey WHEN 3 THEN 'Streets' WHEN 7 THEN 'streets' WHEN 9 THEN 'roads' WHEN 12 THEN 'City_Boundary' WHEN 15 THEN 'boundary_old' WHEN 18 THEN 'main_roads' ELSE lower(n_name) END AS name,
  CASE n_nationkey % 3 WHEN 0 THEN 'MultiPolygon' WHEN 1 THEN 'LineString' ELSE 'Point' END AS geom_type, CASE WHEN n_nationkey IN (7, 12) THEN NULL ELSE 'EPSG:' || CAST(3800 + n_nationkey AS STRING) END AS crs
FROM nation""",
    "v_road": """
SELECT CAST(floor(c_custkey / 40) AS BIGINT) AS line_id, CAST(c_custkey % 40 AS BIGINT) AS seq,
  CAST((floor(c_custkey / 40) * 137) % 900 + (c_custkey % 40) * 3 AS DOUBLE) AS x, CAST((floor(c_custkey / 40) * 61) % 360 + (c_custkey * 7) % 23 AS DOUBLE) AS y
FROM customer""",
    "v_long": """
SELECT CAST(c_custkey % 5 AS BIGINT) AS line_id, CAST(floor(c_custkey / 5) AS BIGINT) AS seq,
  CAST(floor(c_custkey / 5) * 0.5e0 AS DOUBLE) AS x, CAST((c_custkey % 5) * 80 + (floor(c_custkey / 5) * 37) % 50 AS DOUBLE) AS y
FROM customer""",
    "v_bow": """
SELECT k AS ring, CASE e WHEN 0 THEN x WHEN 1 THEN x + w WHEN 2 THEN x + w ELSE x END AS x0, CASE e WHEN 0 THEN y WHEN 1 THEN y + 10 - h WHEN 2 THEN y ELSE y + h END AS y0,
  CASE e WHEN 0 THEN x + w WHEN 1 THEN x + w WHEN 2 THEN x ELSE x END AS x1, CASE e WHEN 0 THEN y + 10 - h WHEN 1 THEN y WHEN 2 THEN y + h ELSE y END AS y1
FROM (SELECT CAST(p_partkey AS BIGINT) AS k, CAST((p_partkey * 7907) % 980 AS DOUBLE) AS x, CAST((p_partkey * 6101) % 380 AS DOUBLE) AS y, CAST(4 + p_partkey % 13 AS DOUBLE) AS w, CAST(6 + p_partkey % 3 AS DOUBLE) AS h FROM part) p
  CROSS JOIN (SELECT 0 AS e UNION ALL SELECT 1 AS e UNION ALL SELECT 2 AS e UNION ALL SELECT 3 AS e) m""",
    "v_piece": """
SELECT CAST(floor(o_orderkey / 3) AS BIGINT) AS osmid, CAST(o_orderkey % 3 AS INT) AS pos, CAST(o_orderkey AS BIGINT) AS u, CAST(o_orderkey + 1 AS BIGINT) AS v,
  CASE floor(o_orderkey / 36) % 4 WHEN 0 THEN 'yes' WHEN 1 THEN '-1' WHEN 2 THEN 'no' ELSE NULL END AS oneway, CAST(1 + o_orderkey % 90 AS DOUBLE) AS length
FROM orders WHERE o_orderkey % 97 <> 0
UNION ALL SELECT CAST(1000000000 + o_orderkey AS BIGINT) AS osmid, 0 AS pos, CAST(o_orderkey AS BIGINT) AS u, CAST(o_orderkey + 97 AS BIGINT) AS v, CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE NULL END AS oneway, CAST(200 + o_orderkey % 7 AS DOUBLE) AS length
FROM orders WHERE o_orderkey % 29 = 3
UNION ALL SELECT CAST(2000000000 + o_orderkey AS BIGINT) AS osmid, 0 AS pos, CAST(o_orderkey AS BIGINT) AS u, CAST(o_orderkey + 1 AS BIGINT) AS v, NULL AS oneway, 77e0 AS length
FROM orders WHERE o_orderkey % 113 = 5""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table over the Parquet tables of a folder."""
    text = VIEWS[name].replace("{", "{{").replace("}", "}}")
    used = [t for t in TABLES if re.search(rf"FROM {t}\b", text)]
    for t in used:
        text = re.sub(rf"FROM {t}\b", f"FROM {{{t}}}", text)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def with_views(*names: str) -> str:
    """WITH clauses of domain tables, for DuckDB; more clauses may follow."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
