"""The driver's tables as name trees. Each query runs unchanged in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathlens.operators import tree

FX1 = """
SELECT CAST(0 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_id, '/' AS name, TRUE AS is_dir, '/' AS path, 0 AS depth,
       CAST(NULL AS BIGINT) AS size_bytes, CAST(NULL AS TIMESTAMP) AS mtime
UNION ALL SELECT CAST(1 + r_regionkey AS BIGINT), CAST(0 AS BIGINT), r_name, TRUE, concat('/', r_name), 1, NULL, NULL FROM region
UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), CAST(1 + n_regionkey AS BIGINT), n_name, TRUE,
       concat('/', r_name, '/', n_name), 2, NULL, NULL FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 1000 + c_custkey, CAST(100 + c_nationkey AS BIGINT), c_name, TRUE,
       concat('/', r_name, '/', n_name, '/', c_name), 3, NULL, NULL
       FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 10000000 + o_orderkey, 1000 + o_custkey, concat('Order-', CAST(o_orderkey AS STRING), '.', o_orderstatus), FALSE,
       concat('/', r_name, '/', n_name, '/', c_name, '/Order-', CAST(o_orderkey AS STRING), '.', o_orderstatus), 4,
       CAST(round(o_totalprice * 100) AS BIGINT), o_orderdate
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""
FX2 = """
SELECT page_id AS id, url, regexp_replace(regexp_replace(regexp_replace(url, '^https?://', '/'), '[?#].*$', ''), '/$', '') AS path,
       FALSE AS is_dir FROM pages
"""
FX3 = """
SELECT doc_id AS id, lang = 'fr' AS hidden,
       concat(CASE lang WHEN 'fr' THEN 'ÉTÉ' WHEN 'de' THEN 'Größe' WHEN 'es' THEN 'AÑO' ELSE 'Doc' END, '-', CAST(doc_id AS STRING), '.txt') AS name,
       concat('/', source, '/', CASE WHEN lang = 'fr' THEN '.fr' ELSE upper(lang) END, '/',
              CASE lang WHEN 'fr' THEN 'ÉTÉ' WHEN 'de' THEN 'Größe' WHEN 'es' THEN 'AÑO' ELSE 'Doc' END, '-', CAST(doc_id AS STRING), '.txt') AS path,
       FALSE AS is_dir, n_chars AS size_bytes FROM documents
"""
FX4 = """
SELECT event_id AS seq, ts, concat('/u', CAST(user_id AS STRING)) AS dir, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
       CASE WHEN event_type = 'error' THEN 'delete' ELSE 'create' END AS op,
       (event_type = 'signup' OR (event_type = 'error' AND CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 10 = 0)) AS is_dir
FROM events
"""
FX5 = """
SELECT n_nationkey, concat('/', r_name, '/', n_name) AS dir, (n_nationkey % 3 <> 0) AS listable
FROM nation JOIN region ON n_regionkey = r_regionkey
"""
FX6 = """
SELECT concat('/ASIA/', n_name) AS path, TRUE AS is_dir, (n_nationkey % 3 = 0) AS incomplete
       FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'
UNION ALL SELECT concat('/ASIA/', n_name, '/', c_name), TRUE, FALSE
       FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
       WHERE r_name = 'ASIA' AND c_custkey % 7 <> 0
UNION ALL SELECT concat('/ASIA/', n_name, '/new-', CAST(n_nationkey AS STRING), '.txt'), FALSE, FALSE
       FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'
"""
TABLES = {"fx1": "region nation customer orders", "fx2": "pages", "fx3": "documents", "fx4": "events", "fx5": "nation region", "fx6": "nation region customer"}
SQL = {"fx1": FX1, "fx2": FX2, "fx3": FX3, "fx4": FX4, "fx5": FX5, "fx6": FX6}


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for t in TABLES[name].split():
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(SQL[name])


def entries(spark: SparkSession, sf_dir: str, name: str, part_ord: int = 0) -> DataFrame:
    """A fixture with the stored columns that searches use."""
    df = raw(spark, sf_dir, name)
    if "name" not in df.columns:
        from pathlens.functions import text

        df = df.withColumn("name", text.base_name("path"))
    return tree.derived(df, part_ord)
