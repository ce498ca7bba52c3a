"""The registered query of each operator, with production parameters over its whole table, and SQL where it can be said."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlens.llm import best_fit, decontaminate, hilbert_ann, html_extract, pii, quality_gbdt, simhash_vptree, token_pack, toxicity_pu, url_filter
from pathlens.llm.runtime import read_table

QUALITY_CUT, TOXIC_CUT = 0.3, 0.5


def op1_tag_path_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


def scored(rows: DataFrame, cut: float) -> DataFrame:
    return rows.select("doc_id", F.coalesce(quality_gbdt.held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op2_quality_gbdt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = quality_gbdt.train(docs, read_table(spark, sf_dir, "labels"))
    return scored(quality_gbdt.score(docs, forest), QUALITY_CUT)


def op3_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_vptree.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.summary(decontaminate.hits(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))


def op5_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.analyse(read_table(spark, sf_dir, "documents")))


def op6_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_pack.round_trip(read_table(spark, sf_dir, "documents"))


#: A dated block list over the hosts and paths of the pages table.
ENTRIES = [
    ("malware", "host", "example.org", "add", "2024-02-01"),
    ("malware", "host", "example.org", "remove", "2024-04-15"),
    ("malware", "host", "example.org", "add", "2024-09-01"),
    ("malware", "prefix", "blog.tionsh.example.com/en", "add", "2024-03-10"),
    ("spam", "host", "example.net", "add", "2024-01-15"),
    ("spam", "host", "example.net", "remove", "2024-01-20"),
    ("spam", "host", "example.net", "add", "2024-06-01"),
    ("spam", "host", "example.net", "remove", "2024-06-01"),
    ("spam", "host", "blog.tionsh.example.com", "add", "2024-05-05"),
    ("spam", "host", "blog.tionsh.example.com", "remove", "2024-11-30"),
    ("adult", "prefix", "www.therre.example.org/de", "add", "2023-06-01"),
    ("adult", "prefix", "ththan.example.com/fr", "add", "2024-07-01"),
    ("adult", "host", "ththan.example.com", "add", "2024-12-20"),
    ("adult", "host", "tionble.example.org", "remove", "2024-01-01"),
    ("adult", "prefix", "Therhe.Example.ORG/en", "add", "2024-02-01"),
    ("adult", "prefix", "therhe.example.org/EN", "add", "2024-02-01"),
    ("adult", "prefix", "tiontion.example.net/En/", "add", "2024-02-01"),
    ("spam", "host", "Spam-Farm.Example.com", "add", "2024-01-02"),
    *(("history", "host", "example.com", action, f"2024-{month:02}-{day:02}") for month in range(1, 13) for action, day in (("add", 3), ("remove", 17))),
    ("far", "host", "example.org", "remove", "9999-01-01"),
]
ENTRY_DDL = "list_id string, kind string, pattern string, action string, dated string"


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as a capture; its fetch time is a day of 2024 and a time of day that follow from page_id."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    second = F.lit(1704067200) + (F.col("page_id") * 37 % 366) * 86400 + F.col("page_id") * 7919 % 86400
    return pages.withColumn("fetched_at", F.timestamp_seconds(second))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ENTRIES, and for every host of the pages an add and, 45 days later, a remove, by the host's length."""
    day = F.length("pattern") * 7 % 300
    hosts = read_table(spark, sf_dir, "pages").select(url_filter.host_of("url").alias("pattern")).filter("pattern <> ''").distinct()
    dated = [hosts.select(F.lit("own").alias("list_id"), F.lit("host").alias("kind"), "pattern", F.lit(a).alias("action"), F.date_add(F.lit("2024-01-01").cast("date"), day + k).cast("string").alias("dated")) for a, k in (("add", 0), ("remove", 45))]
    return spark.createDataFrame(ENTRIES, ENTRY_DDL).union(dated[0]).union(dated[1])


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = url_filter.flag(captures(spark, sf_dir), entries(spark, sf_dir))
    return flagged.select("page_id", "url", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched"), F.concat_ws(",", "matches").alias("matches"), (F.size("matches") > 0).alias("blocked"))


ENTRY_ROWS = ", ".join(str(e) for e in ENTRIES)
OP7_SQL = rf"""
WITH h AS (SELECT DISTINCT regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.+$', '') AS pattern FROM pages),
w AS (SELECT * FROM (VALUES {ENTRY_ROWS}) t(list_id, kind, pattern, action, dated)
      UNION ALL SELECT 'own', 'host', pattern, a, strftime(DATE '2024-01-01' + CAST(length(pattern) * 7 % 300 + k AS INTEGER), '%Y-%m-%d') FROM h, (VALUES ('add', 0), ('remove', 45)) t(a, k) WHERE pattern <> ''),
e AS (SELECT list_id, kind, regexp_replace(CASE WHEN kind = 'prefix' THEN lower(regexp_extract(pattern, '^[^/]*')) || regexp_replace(pattern, '^[^/]*', '') ELSE lower(pattern) END, '[./]+$', '') AS pattern, action, dated FROM w),
v AS (SELECT list_id, kind, pattern, action, CAST(dated AS TIMESTAMP) AS f,
      lead(CAST(dated AS TIMESTAMP)) OVER (PARTITION BY list_id, kind, pattern ORDER BY dated) AS t
      FROM (SELECT list_id, kind, pattern, dated, max(action) AS action FROM e GROUP BY ALL)),
c AS (SELECT page_id, url, make_timestamp(CAST((1704067200 + (page_id * 37 % 366) * 86400 + page_id * 7919 % 86400) * 1000000 AS BIGINT)) AS ts,
      regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.+$', '') AS host,
      regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM pages),
m AS (SELECT DISTINCT page_id, url, ts, list_id || ':' || pattern AS x FROM c JOIN v ON action = 'add' AND ts >= f AND (t IS NULL OR ts < t) AND
      (kind = 'host' AND (host = pattern OR ends_with(host, '.' || pattern)) OR kind = 'prefix' AND (host || path = pattern OR starts_with(host || path, pattern || '/')))),
g AS (SELECT page_id, url, ts, string_agg(x, ',' ORDER BY x) AS matches FROM m GROUP BY ALL)
SELECT c.page_id, c.url, strftime(c.ts, '%Y-%m-%d %H:%M:%S') AS fetched, coalesce(matches, '') AS matches, matches IS NOT NULL AS blocked
FROM c LEFT JOIN g ON c.page_id = g.page_id AND c.url = g.url AND c.ts = g.ts
"""


def op8_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_pu.train(docs, read_table(spark, sf_dir, "labels"))
    return scored(toxicity_pu.score(docs, model), TOXIC_CUT)


def op9_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_ann.search(read_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_documents(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = [op1_tag_path_extract, op2_quality_gbdt, op3_simhash_vptree, op4_decontaminate, op5_pii_disclosure, op6_token_blocks, op7_url_filter, op8_toxicity_pu, op9_hilbert_ann, op10_best_fit, pipeline]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op7_url_filter": OP7_SQL}
