"""The registered queries and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pathlens.functions import text
from pathlens.operators import access, catalog, changes, exec_plan, graft, ngram, search, tree
from pathlens.operators.model import SearchOptions, clamp_limit
from pathlens.operators.staging import checkpoint_folder
from pathlens.plans.fixtures import SQL, entries, raw
from pathlens.sources import config, framing, store
from pathlens.streaming import feed as stream

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, *fixtures: str):
    """Registers a query with the SQL that says the same over the named fixtures."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            head = ", ".join(f"{n} AS ({SQL[n]})" for n in fixtures)
            _SQL[f.__name__] = (f"WITH {head} " if head else "") + sql if not sql.startswith(",") else f"WITH {head}{sql}"
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _search(name: str, fixture: str, needle: str, options: SearchOptions, where: str) -> None:
    """All hits of a search; pages with a limit have queries of their own."""

    def run(spark, sf_dir):
        return search.hits(entries(spark, sf_dir, fixture), needle, options).select("id", "path")

    run.__name__, run.__doc__ = name, f"{needle!r} over {fixture}"
    query(f"SELECT id, path FROM {fixture} WHERE {where}", fixture)(run)


O = SearchOptions
_NAME3 = "regexp_extract(path, '[^/]*$')"
_search("name_search", "fx1", "customer#00000001", O(), "contains(lower(name), 'customer#00000001')")
_search("name_search_case", "fx1", "Order-1", O(match_case=True), "contains(name, 'Order-1')")
_search("short_needle", "fx1", "-7", O(), "contains(lower(name), '-7')")
_search("path_search", "fx1", "asia/NATION_1", O(), "contains(lower(path), 'asia/nation_1')")
_search("inside_folder", "fx1", "/europe/nation_13/", O(), "contains(lower(path), '/europe/nation_13/')")
_search("path_mode_no_slash", "fx1", "nation_24", O(in_path=True), "contains(lower(path), 'nation_24')")
_search("multi_term", "fx1", "europe ORDER- 77", O(), "contains(lower(path), 'europe') AND contains(lower(path), 'order-') AND contains(lower(path), '77')")
_search("multi_term_phrase", "fx1", '"customer#00000012" order .o', O(), "contains(lower(path), 'customer#00000012') AND contains(lower(path), 'order') AND contains(lower(path), '.o')")
_search("files_only", "fx1", "r-1", O(kind="files"), "contains(lower(name), 'r-1') AND NOT is_dir")
_search("folders_only", "fx1", "n_1", O(kind="folders"), "contains(lower(name), 'n_1') AND is_dir")
_search("no_hidden", "fx3", "-1", O(hide_hidden=True), "contains(lower(name), '-1') AND NOT hidden")
_search("no_hidden_path", "fx3", "src1 .txt", O(hide_hidden=True), "contains(lower(path), 'src1') AND contains(lower(path), '.txt') AND NOT hidden")
_search("regex_name", "fx1", r"^order-[0-9]*7\.[of]$", O(regex=True), r"regexp_matches(name, '(?i)^order-[0-9]*7\.[of]$')")
_search("regex_path", "fx2", r"/[a-z]+\.example\.(com|org)/.*5$", O(regex=True), r"regexp_matches(path, '(?i)/[a-z]+\.example\.(com|org)/.*5$')")
_search("regex_posix", "fx1", r"^[[:alpha:]]+-[[:digit:]]*77\.[^[:digit:]p-z]$", O(regex=True), r"regexp_matches(name, '(?i)^[[:alpha:]]+-[[:digit:]]*77\.[^[:digit:]p-z]$')")
_search("regex_class_signs", "fx1", r"[]*+$7][*+.][of]$", O(regex=True), r"regexp_matches(name, '(?i)[]*+$7][*+.][of]$')")
_search("regex_named_group", "fx1", r"(?P<stem>7{2})\.(?P<kind>o|f)$", O(regex=True), r"regexp_matches(name, '(?i)(?P<stem>7{2})\.(?P<kind>o|f)$')")
_search("unicode_fold", "fx3", "ÉTÉ-1", O(), "contains(lower(name), 'été-1')")


@query("SELECT id, path, depth, path LIKE '%/.%' AS hidden FROM fx1", "fx1")
def path_rebuild(spark, sf_dir):
    links = raw(spark, sf_dir, "fx1").select("id", "parent_id", "name", "is_dir")
    return tree.with_paths(links).select("id", "path", "depth", "hidden")


@query("SELECT part_ord, id, path FROM (SELECT 0 AS part_ord, id, path FROM fx1 WHERE contains(lower(name), '-2') UNION ALL SELECT 1, id, path FROM fx3 WHERE contains(lower(name), '-2')) ORDER BY part_ord, id LIMIT 400", "fx1", "fx3")
def limited_page(spark, sf_dir):
    parts = [entries(spark, sf_dir, "fx1", 0), entries(spark, sf_dir, "fx3", 1)]
    return catalog.search(parts, "-2", limit=400).select("part_ord", "id", "path")


@query("SELECT id, name FROM (SELECT id, concat('x', chr(10), name, chr(10), 'y.', lang) AS name FROM (SELECT doc_id AS id, lang, concat(source, '-', CAST(doc_id AS STRING), '.txt') AS name FROM documents)) WHERE regexp_matches(name, '(?im)^src[0-9]+-[0-9]*7\\.txt$')")
def regex_lines(spark, sf_dir):
    """Anchors at lines' ends, in names that hold line breaks."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = F.concat(F.lit("x\n"), "source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt\ny."), "lang")
    rows = docs.select(F.col("doc_id").alias("id"), name.alias("name"), F.concat(F.lit("/"), name).alias("path"), F.lit(False).alias("is_dir"))
    return search.hits(tree.derived(rows), r"(?m)^src[0-9]+-[0-9]*7\.txt$", O(regex=True)).select("id", "name")


@query(", u AS (SELECT 0 AS part_ord, id, path FROM fx2 WHERE contains(url, '?') UNION ALL SELECT 1, id, path FROM fx2), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY part_ord, id) AS n FROM u WHERE contains(lower(path), 'example')) SELECT part_ord, id, path FROM r WHERE n = 1", "fx2")
def merged_parts(spark, sf_dir):
    parts = [entries(spark, sf_dir, "fx2", 0).filter("contains(url, '?')"), entries(spark, sf_dir, "fx2", 1)]
    return catalog.merged([search.hits(p, "example", O(in_path=True)) for p in parts]).select("part_ord", "id", "path")


_RANK = "CASE WHEN lower(name) = q THEN 1.0 WHEN starts_with(lower(name), q) THEN 0.9 WHEN contains(lower(name), q) THEN 0.7 ELSE 0.4 END"


@query(f"SELECT id, path, CAST({_RANK} AS DOUBLE) AS relevance, CASE WHEN {_RANK} >= 0.9 THEN 100 ELSE 30 END AS type FROM (SELECT *, 'nation_1' AS q FROM fx1 WHERE contains(lower(name), 'nation_1') ORDER BY id LIMIT 30)", "fx1")
def ranked_launcher(spark, sf_dir):
    return search.ranked(entries(spark, sf_dir, "fx1"), "Nation_1").select("id", "path", "relevance", "type")


@query("SELECT id, path, coalesce(size_bytes, -1) AS sort_size FROM fx1 WHERE contains(lower(path), 'asia') ORDER BY sort_size DESC, path LIMIT 300", "fx1")
def sorted_by_size(spark, sf_dir):
    e = entries(spark, sf_dir, "fx1")
    found = search.with_stat(search.hits(e, "asia", O(in_path=True)), e)
    return search.sorted_by(found, "size", True, 300).select("id", "path", "sort_size")


@query("SELECT id, path, coalesce(CAST(epoch(mtime) AS BIGINT), -1) AS sort_mtime FROM fx1 WHERE contains(lower(path), 'asia') ORDER BY sort_mtime, path LIMIT 300", "fx1")
def sorted_by_mtime(spark, sf_dir):
    e = entries(spark, sf_dir, "fx1")
    found = search.with_stat(search.hits(e, "asia", O(in_path=True)), e)
    return search.sorted_by(found, "mtime", limit=300).select("id", "path", "sort_mtime")


_SIZE = "CASE WHEN is_dir THEN '' WHEN size_bytes IS NULL THEN '?' WHEN size_bytes < 1024 THEN concat(size_bytes, ' B') WHEN size_bytes < 1048576 THEN printf('%.1f KB', size_bytes / 1024.0) WHEN size_bytes < 1073741824 THEN printf('%.1f MB', size_bytes / 1048576.0) ELSE printf('%.1f GB', size_bytes / 1073741824.0) END"


@query(
    f"SELECT id, regexp_extract(path, '[^/]*$') AS shown_name, CASE WHEN regexp_replace(path, '/[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END AS parent, {_SIZE} AS size, coalesce(strftime(mtime, '%Y-%m-%d %H:%M'), '?') AS modified, 'text-x-generic' AS icon, concat('file://', replace(url_encode(path), '%2F', '/')) AS uri FROM fx1 WHERE contains(lower(path), 'nation_17')",
    "fx1",
)
def presented_rows(spark, sf_dir):
    return search.presented(search.hits(entries(spark, sf_dir, "fx1"), "nation_17", O(in_path=True)))


_PARENT = "CASE WHEN regexp_replace(path, '/[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END"


_SHUT = f"SELECT id, path FROM (SELECT *, {_PARENT} AS up FROM fx1) e WHERE contains(lower(name), 'r') AND NOT EXISTS (SELECT 1 FROM fx5 a WHERE NOT listable AND (e.up = a.dir OR starts_with(e.up, a.dir || '/')))"


def _rules(spark, sf_dir):
    return raw(spark, sf_dir, "fx5").select("dir", F.col("listable").alias("can_list"), F.col("listable").alias("can_pass"))


@query(_SHUT + " ORDER BY id LIMIT 4000", "fx1", "fx5")
def visible_page(spark, sf_dir):
    """Rules for every folder: those of nations as given, the others open."""
    folders = raw(spark, sf_dir, "fx1").filter("is_dir").select(F.col("path").alias("dir"))
    acl = folders.join(_rules(spark, sf_dir), "dir", "left").na.fill(True, ["can_list", "can_pass"])
    return search.page(access.visible(search.hits(entries(spark, sf_dir, "fx1"), "r"), acl), 4000).select("id", "path")


@query(_SHUT, "fx1", "fx5")
def visible_unlisted_open(spark, sf_dir):
    return access.visible(search.hits(entries(spark, sf_dir, "fx1"), "r"), _rules(spark, sf_dir), unlisted="allow").select("id", "path")


@query(f"SELECT e.id, e.path FROM (SELECT *, {_PARENT} AS up FROM fx1) e LEFT JOIN fx5 a ON e.up = a.dir WHERE depth <= 2 OR (depth = 3 AND listable)", "fx1", "fx5")
def visible_unlisted_shut(spark, sf_dir):
    """Customers' folders have no rule, so nothing in them is visible."""
    upper = raw(spark, sf_dir, "fx1").filter("depth < 2").select(F.col("path").alias("dir"), F.lit(True).alias("can_list"), F.lit(True).alias("can_pass"))
    return access.visible(entries(spark, sf_dir, "fx1"), upper.union(_rules(spark, sf_dir))).select("id", "path")


_MODES = "SELECT id, parent_id, path, id % 3 AS uid, id % 4 AS gid, CASE WHEN depth < 2 THEN 493 WHEN id % 5 = 0 THEN 511 WHEN id % 5 = 1 THEN 488 WHEN id % 5 = 2 THEN 448 WHEN id % 5 = 3 THEN 457 ELSE 493 END AS mode FROM fx1 WHERE is_dir"


@query(
    f", m AS (SELECT *, CASE WHEN uid = 1 THEN mode // 64 WHEN gid IN (2) THEN (mode // 8) % 8 ELSE mode % 8 END AS bits FROM ({_MODES})), a AS (SELECT *, bits % 2 = 1 AS pass, bits >= 4 AND bits % 2 = 1 AS list FROM m), "
    "l AS (SELECT a.id FROM a LEFT JOIN a b ON a.parent_id = b.id LEFT JOIN a c ON b.parent_id = c.id LEFT JOIN a d ON c.parent_id = d.id WHERE a.list AND coalesce(b.pass, TRUE) AND coalesce(c.pass, TRUE) AND coalesce(d.pass, TRUE)) "
    "SELECT id, path FROM fx1 WHERE coalesce(parent_id, 0) IN (SELECT id FROM l)",
    "fx1",
)
def visible_by_mode(spark, sf_dir):
    """What user 1 of group 2 sees, from owners, groups and mode bits of folders."""
    raw(spark, sf_dir, "fx1").createOrReplaceTempView("fx1")
    acl = access.rules(spark.sql(_MODES), uid=1, groups=[2])
    return access.visible(entries(spark, sf_dir, "fx1"), acl).select("id", "path")


@query("SELECT id, concat('/home/.cfg', path) AS path, contains(path, '/.') AS hidden FROM fx3", "fx3")
def hidden_below_root(spark, sf_dir):
    rows = raw(spark, sf_dir, "fx3").withColumn("path", F.concat(F.lit("/home/.cfg"), "path")).drop("hidden")
    return tree.derived(rows, root="/home/.cfg").select("id", "path", "hidden")


@query("SELECT id, path FROM fx1 WHERE NOT is_dir AND NOT starts_with(path, '/ASIA/') AND NOT starts_with(path, '/EUROPE/NATION_3/')", "fx1")
def excluded_listing(spark, sf_dir):
    """Files alone: the excluded folders have no rows of their own."""
    out = spark.createDataFrame([("/ASIA",), ("/EUROPE/NATION_3",)], "path string")
    return tree.without_excluded(entries(spark, sf_dir, "fx1").filter("not is_dir"), out).select("id", "path")


@query("SELECT event_type, median(value) AS median, min(value) AS least, max(value) AS most, count(value) AS runs FROM events GROUP BY event_type")
def median_by_kind(spark, sf_dir):
    return catalog.medians(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", "event_type")


@query("SELECT id, path, CASE WHEN depth >= 2 THEN concat('/', split_part(path, '/', 2), '/', split_part(path, '/', 3)) ELSE path END AS root FROM fx1", "fx1", "fx5")
def mount_of(spark, sf_dir):
    """The longest mount point that holds each path; mounts lie within each other."""
    e = raw(spark, sf_dir, "fx1")
    mounts = e.filter("depth < 2").select(F.col("path").alias("root")).union(raw(spark, sf_dir, "fx5").select("dir"))
    return catalog.part_of(e.select("id", "path"), mounts).select("id", "path", "root")


@query("SELECT id, path FROM fx1 WHERE NOT (path = '/ASIA' OR starts_with(path, '/ASIA/') OR path = '/EUROPE/NATION_3' OR starts_with(path, '/EUROPE/NATION_3/'))", "fx1")
def excluded_tree(spark, sf_dir):
    out = spark.createDataFrame([("/ASIA",), ("/EUROPE/NATION_3",), ("/EURO",)], "path string")
    return tree.without_excluded(entries(spark, sf_dir, "fx1"), out).select("id", "path")


_ALL = "(SELECT 'orders' AS part, is_dir, is_dir OR id % 7 <> 0 AS alive FROM fx1 UNION ALL SELECT 'pages', is_dir, TRUE FROM fx2 UNION ALL SELECT 'docs', is_dir, TRUE FROM fx3)"


def _parts(spark, sf_dir):
    one = raw(spark, sf_dir, "fx1").select(F.lit("orders").alias("part"), "is_dir", F.expr("is_dir OR id % 7 <> 0").alias("alive"))
    rest = [raw(spark, sf_dir, f).select(F.lit(n).alias("part"), "is_dir", F.lit(True).alias("alive")) for f, n in (("fx2", "pages"), ("fx3", "docs"))]
    return one.union(rest[0]).union(rest[1])


@query(f"SELECT part, count(*) FILTER (alive) AS live, count(*) AS slots, count(*) FILTER (alive AND NOT is_dir) AS files, count(*) FILTER (alive AND is_dir) AS folders FROM {_ALL} GROUP BY part", "fx1", "fx2", "fx3")
def stats_by_part(spark, sf_dir):
    return catalog.stats(_parts(spark, sf_dir), "part")


@query(f"SELECT count(*) FILTER (alive) AS live, count(*) AS slots, count(*) FILTER (alive AND NOT is_dir) AS files, count(*) FILTER (alive AND is_dir) AS folders FROM {_ALL}", "fx1", "fx2", "fx3")
def scan_stats(spark, sf_dir):
    return catalog.stats(_parts(spark, sf_dir))


_GRAMS = ", g AS (SELECT DISTINCT id, substr(lower(name), i, 3) AS key FROM (SELECT id, name, unnest(generate_series(1, CAST(length(name) AS BIGINT) - 2)) AS i FROM fx1 WHERE length(name) >= 3)) "


@query(_GRAMS + "SELECT count(DISTINCT key) AS distinct_keys, count(*) AS postings FROM g", "fx1")
def ngram_stats(spark, sf_dir):
    return ngram.stats(ngram.build(entries(spark, sf_dir, "fx1")))


@query(_GRAMS + "SELECT key, count(*) AS df FROM g GROUP BY key", "fx1")
def ngram_df(spark, sf_dir):
    return ngram.frequency(ngram.build(entries(spark, sf_dir, "fx1"))).select(F.decode("key", "utf-8").alias("key"), "df")


@query("SELECT id, path FROM fx1 WHERE contains(lower(name), 'order-12')", "fx1")
def ngram_search(spark, sf_dir):
    e = entries(spark, sf_dir, "fx1")
    return ngram.search(e, ngram.build(e), "Order-12").select("id", "path")


_FEED = """, w AS (SELECT *, max(CASE WHEN is_dir AND op = 'create' THEN seq END) OVER p AS fc, max(CASE WHEN is_dir AND op = 'delete' THEN seq END) OVER p AS fd
  FROM fx4 WINDOW p AS (PARTITION BY dir ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, fc IS NOT NULL AND fc > coalesce(fd, -1) AS ok FROM w WHERE NOT is_dir AND op = 'create'),
d AS (SELECT dir, max(CASE WHEN op = 'create' THEN seq END) AS fc, max(CASE WHEN op = 'delete' THEN seq END) AS fd FROM fx4 WHERE is_dir GROUP BY dir),
f AS (SELECT dir, k, max(seq) AS made FROM c WHERE ok GROUP BY dir, k),
x AS (SELECT dir, k, max(seq) AS gone FROM fx4 WHERE NOT is_dir AND op = 'delete' GROUP BY dir, k) """


def feed(spark, sf_dir):
    path = F.when(F.col("is_dir"), F.col("dir")).otherwise(F.concat("dir", F.lit("/k"), F.col("k").cast("string")))
    return raw(spark, sf_dir, "fx4").select("seq", "op", path.alias("path"), "is_dir")


@query(
    _FEED + "SELECT dir AS path, TRUE AS is_dir FROM d WHERE fc > coalesce(fd, -1) UNION ALL SELECT concat(f.dir, '/k', CAST(f.k AS STRING)), FALSE FROM f LEFT JOIN x ON f.dir = x.dir AND f.k = x.k LEFT JOIN d ON f.dir = d.dir WHERE made > coalesce(gone, -1) AND made > coalesce(d.fd, -1)",
    "fx4",
)
def change_feed_alive(spark, sf_dir):
    return changes.apply(feed(spark, sf_dir)).alive.select("path", "is_dir")


@query(_FEED + "SELECT seq, concat(dir, '/k', CAST(k AS STRING)) AS path FROM c WHERE NOT ok", "fx4")
def change_feed_dropped(spark, sf_dir):
    return changes.apply(feed(spark, sf_dir)).dropped


_GRAFT = """, o AS (SELECT path, is_dir FROM fx1 WHERE starts_with(path, '/ASIA/') AND is_dir),
m AS (SELECT o.path, o.is_dir, coalesce(arg_max(a.incomplete, length(a.path)), FALSE) AS keep FROM o LEFT JOIN fx6 a ON a.is_dir AND starts_with(o.path, a.path || '/')
      WHERE o.path NOT IN (SELECT path FROM fx6) GROUP BY ALL),
r AS (SELECT path, is_dir, CASE WHEN path IN (SELECT path FROM o) THEN 'unchanged' ELSE 'added' END AS status FROM fx6
      UNION ALL SELECT path, is_dir, CASE WHEN keep THEN 'kept' ELSE 'removed' END FROM m) """


def _graft(spark, sf_dir):
    before = raw(spark, sf_dir, "fx1").filter("startswith(path, '/ASIA/') AND is_dir")
    return graft.merge(before, raw(spark, sf_dir, "fx6"), "/ASIA")


@query(_GRAFT + "SELECT path, is_dir, status FROM r", "fx1", "fx6")
def graft_merge(spark, sf_dir):
    return _graft(spark, sf_dir)


@query(_GRAFT + "SELECT count(*) FILTER (status <> 'removed') AS total, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'kept') AS kept FROM r", "fx1", "fx6")
def graft_stats(spark, sf_dir):
    return graft.stats(_graft(spark, sf_dir))


@query(", r AS (SELECT id, parent_id, path, row_number() OVER (ORDER BY id) - 1 AS n FROM fx1 WHERE is_dir OR id % 7 <> 0) SELECT r.n AS id, p.n AS parent_id, r.path FROM r LEFT JOIN r p ON r.parent_id = p.id", "fx1")
def compacted(spark, sf_dir):
    return changes.compacted(entries(spark, sf_dir, "fx1").withColumn("alive", F.expr("is_dir OR id % 7 <> 0"))).select("id", "parent_id", "path")


@query("SELECT id, concat('cp|', path, '|/backup', path, '.bak') AS command FROM fx1 WHERE contains(lower(name), 'order-10')", "fx1")
def exec_commands(spark, sf_dir):
    _, command = exec_plan.split_clause(["query", "order-10", "-exec", "cp", "{}", "/backup{}.bak", ";"])
    found = search.hits(entries(spark, sf_dir, "fx1"), "order-10")
    return exec_plan.each(found, command).select("id", F.array_join("argv", "|").alias("command"))


@query("SELECT id, path FROM (SELECT id, CASE WHEN id % 5 = 0 THEN concat(path, chr(10), 'x') ELSE path END AS path FROM fx2) WHERE NOT contains(path, chr(10)) AND NOT contains(path, chr(13))", "fx2")
def line_framed(spark, sf_dir):
    rows = raw(spark, sf_dir, "fx2").select("id", F.expr("CASE WHEN id % 5 = 0 THEN concat(path, '\n', 'x') ELSE path END").alias("path"))
    return framing.line_safe(rows)


@query("SELECT id, concat('file://', replace(url_encode(concat('/', url, ' ~ü')), '%2F', '/')) AS uri FROM fx2", "fx2")
def file_uris(spark, sf_dir):
    rows = raw(spark, sf_dir, "fx2").withColumn("p", F.concat(F.lit("/"), "url", F.lit(" ~ü")))
    return rows.select("id", text.file_uri("p").alias("uri"))


@query("SELECT CAST(ord AS INTEGER) AS ord, root, kept, note FROM (VALUES (0, '/data', TRUE, ''), (1, '/data/sub', FALSE, 'nested'), (2, '/data', FALSE, 'repeated'), (3, '/data/disk', TRUE, ''), (4, '/srv', TRUE, '')) t(ord, root, kept, note)")
def config_roots(spark, sf_dir):
    return catalog.checked_roots(spark, [("/data/", 1), ("/data/sub", 1), ("//data", 1), ("/data/./disk", 2), ("/srv", 1)])


@query("SELECT id, path, regexp_extract(path, '^/[^/]*') AS root FROM fx1 WHERE NOT is_dir", "fx1")
def innermost_part(spark, sf_dir):
    e = raw(spark, sf_dir, "fx1")
    roots = e.filter("depth = 1").select(F.col("path").alias("root")).union(spark.createDataFrame([("/",)], "root string"))
    return catalog.part_of(e.filter("not is_dir").select("id", "path"), roots).select("id", "path", "root")


@query("SELECT id, path FROM fx1 WHERE starts_with(path, '/AMERICA/') OR starts_with(path, '/EUROPE/NATION_3/')", "fx1")
def subtree_join(spark, sf_dir):
    folders = spark.createDataFrame([("/AMERICA",), ("/AMERICA/NATION_1",), ("/EUROPE/NATION_3",)], "path string")
    return tree.below(entries(spark, sf_dir, "fx1"), folders).select("id", "path")


@query("SELECT id, path FROM fx1 WHERE FALSE", "fx1")
def empty_pattern(spark, sf_dir):
    return search.search(entries(spark, sf_dir, "fx1"), '""').select("id", "path")


for _column in ("name", "path"):

    def _sorted(spark, sf_dir, column=_column):
        e = entries(spark, sf_dir, "fx1")
        found = search.with_stat(search.hits(e, "nation_1", O(in_path=True)), e)
        return search.sorted_by(found, column, limit=300).select("id", "path")

    _sorted.__name__ = f"sorted_by_{_column}"
    query(f"SELECT id, path FROM fx1 WHERE contains(lower(path), 'nation_1') ORDER BY lower({_column}), path LIMIT 300", "fx1")(_sorted)


@query(
    "SELECT id, name AS shown, octet_length(encode(name)) = length(name) AS plain, format('{:,}', size_bytes) AS digits, concat(path, '⏎') AS one_line, path AS clean, starts_with(path, concat('/', split_part(path, '/', 2), '/DE/')) AS inside FROM fx3",
    "fx3",
)
def text_columns(spark, sf_dir):
    rows = entries(spark, sf_dir, "fx3")
    source = F.concat(F.lit("/"), F.element_at(F.split("path", "/"), 2), F.lit("/DE"))
    return rows.select(
        "id",
        text.display(F.col("name").cast("binary")).alias("shown"),
        text.is_ascii("name").alias("plain"),
        text.group_digits("size_bytes").alias("digits"),
        text.one_line(F.concat("path", F.lit("\n"))).alias("one_line"),
        text.normalised(F.concat(F.lit("/./"), "path", F.lit("//."))).alias("clean"),
        text.is_within("path", source).alias("inside"),
    )


@query("SELECT id, concat('/', url, ' ~ü') AS path FROM fx2", "fx2")
def uri_paths(spark, sf_dir):
    rows = raw(spark, sf_dir, "fx2").withColumn("uri", text.file_uri(F.concat(F.lit("/"), "url", F.lit(" ~ü"))))
    return rows.select("id", text.uri_path(F.col("uri")).cast("string").alias("path"))


_MASKED = "SELECT seq, CASE op WHEN 'create' THEN CASE WHEN seq % 2 = 0 THEN 256 ELSE 128 END ELSE CASE WHEN seq % 2 = 0 THEN 512 ELSE 64 END END + CASE WHEN is_dir THEN 1073741824 ELSE 0 END AS mask, seq % 5 AS parent_ino, dir AS parent_path, concat('k', CAST(k AS STRING)) AS name FROM fx4"


@query(f", v AS ({_MASKED}) SELECT e.seq, e.op, e.is_dir, concat(CASE WHEN e.seq % 5 IN (1, 2) THEN concat('/ino', CAST(e.seq % 5 AS STRING)) ELSE e.dir END, '/k', CAST(e.k AS STRING)) AS path FROM fx4 e JOIN v ON e.seq = v.seq", "fx4")
def classified_events(spark, sf_dir):
    raw(spark, sf_dir, "fx4").createOrReplaceTempView("fx4")
    folders = spark.createDataFrame([(0, "/never"), (1, "/ino1"), (2, "/ino2")], "ino long, path string")
    events = spark.sql(_MASKED).withColumn("mask", F.col("mask").cast("long"))
    return changes.with_paths(changes.classified(events), folders).select("seq", "op", "is_dir", "path")


@query(
    _FEED + "SELECT dir AS path, TRUE AS is_dir FROM d WHERE fc > coalesce(fd, -1) UNION ALL SELECT concat(f.dir, '/k', CAST(f.k AS STRING)), FALSE FROM f LEFT JOIN x ON f.dir = x.dir AND f.k = x.k LEFT JOIN d ON f.dir = d.dir WHERE made > coalesce(gone, -1) AND made > coalesce(d.fd, -1)",
    "fx4",
)
def reconciled_feed(spark, sf_dir):
    """A tree rebuilt up to some event, with the events captured since replayed, is the tree of the whole feed."""
    events = feed(spark, sf_dir)
    started = events.agg(F.floor(F.avg("seq"))).first()[0]
    rebuilt = changes.apply(events.filter(F.col("seq") <= started)).alive.select("path", "is_dir")
    return changes.reconciled(rebuilt, events, started).alive.select("path", "is_dir")


_NEW_PATHS = "SELECT DISTINCT CASE WHEN id % 2 = 0 THEN path ELSE concat(path, '/none') END AS path FROM fx1"


@query(f", w AS ({_NEW_PATHS}) SELECT w.path, fx1.id FROM w LEFT JOIN fx1 ON w.path = fx1.path", "fx1")
def resolved_paths(spark, sf_dir):
    e = entries(spark, sf_dir, "fx1")
    wanted = e.select(F.expr("CASE WHEN id % 2 = 0 THEN path ELSE concat(path, '/none') END").alias("path")).distinct()
    return tree.resolve(e, wanted)


@query("SELECT w.parent_id, w.name, w.id AS event, c.id FROM (SELECT id, parent_id, CASE WHEN id % 3 = 0 THEN concat(name, '~') ELSE name END AS name FROM fx1 WHERE parent_id IS NOT NULL) w LEFT JOIN fx1 c ON c.parent_id = w.parent_id AND c.name = w.name AND (c.is_dir OR c.id % 7 <> 0)", "fx1")
def child_lookup(spark, sf_dir):
    e = entries(spark, sf_dir, "fx1").withColumn("alive", F.expr("is_dir OR id % 7 <> 0"))
    wanted = e.filter("parent_id IS NOT NULL").select("parent_id", F.expr("CASE WHEN id % 3 = 0 THEN concat(name, '~') ELSE name END").alias("name"), F.col("id").alias("event"))
    return tree.children(e, wanted)


@query("SELECT substr(path, 7) AS relative, is_dir FROM fx1 WHERE starts_with(path, '/ASIA/') AND (is_dir OR id % 7 <> 0)", "fx1")
def subtree_listing(spark, sf_dir):
    e = entries(spark, sf_dir, "fx1").withColumn("alive", F.expr("is_dir OR id % 7 <> 0"))
    return graft.listing(e, "/ASIA")


@query("SELECT 0 AS part, CAST((n - 1) // 4 AS BIGINT) AS batch, CAST(count(*) AS INTEGER) AS paths, min(path) AS first_path FROM (SELECT path, row_number() OVER (ORDER BY path) AS n FROM (SELECT DISTINCT concat('/m/', lpad(CAST(id AS STRING), 12, '0')) AS path FROM fx2 ORDER BY path LIMIT 100000)) GROUP BY 2", "fx2")
def exec_batches(spark, sf_dir):
    """Batches of one page, which the hard cap bounds. Every path is 15 bytes and costs 16, the command 3: four fit in 70."""
    _, command = exec_plan.split_clause(["query", "x", "-exec", "rm", "{}", "+"])
    paths = raw(spark, sf_dir, "fx2").select(F.concat(F.lit("/m/"), F.lpad(F.col("id").cast("string"), 12, "0")).alias("path")).distinct()
    planned = exec_plan.batches(paths.orderBy("path").limit(clamp_limit(100_000)).coalesce(1), command, 70)
    return planned.select("part", "batch", (F.size("argv") - 1).alias("paths"), F.get("argv", F.lit(1)).alias("first_path"))


# --- stored trees, streams and what stands around them


def _folder(spark, name: str) -> str:
    return f"{checkpoint_folder(spark)}/pathlens/{name}-{uuid.uuid4().hex}"


@query("SELECT id, parent_id, path, is_dir FROM fx1", "fx1")
def stored_tree(spark, sf_dir):
    """Saved as a snapshot with parts, one part replaced by itself, and loaded with its checks."""
    tree_ = raw(spark, sf_dir, "fx1").select("id", "parent_id", "path", "is_dir").withColumn("part", F.lit("all"))
    snapshots = store.Store(spark, _folder(spark, "tree"))
    snapshots.save(tree_, parts=["all"])
    snapshots.save(snapshots.load(), parts=["all"])
    return snapshots.load().select("id", "parent_id", "path", "is_dir")


@query(
    _FEED + "SELECT dir AS path, TRUE AS is_dir FROM d WHERE fc > coalesce(fd, -1) UNION ALL SELECT concat(f.dir, '/k', CAST(f.k AS STRING)), FALSE FROM f LEFT JOIN x ON f.dir = x.dir AND f.k = x.k LEFT JOIN d ON f.dir = d.dir WHERE made > coalesce(gone, -1) AND made > coalesce(d.fd, -1)",
    "fx4",
)
def feed_in_batches(spark, sf_dir):
    """The feed in two batches, each replacing the parts it names, is the tree of the whole feed."""
    events = feed(spark, sf_dir)
    cut = events.agg(F.floor(F.avg("seq"))).first()[0]
    snapshots = store.Store(spark, _folder(spark, "feed"))
    for n, batch in enumerate((F.col("seq") <= cut, F.col("seq") > cut)):
        stream.apply_batch(snapshots, events.filter(batch), n)
    return stream.state(snapshots).select("path", "is_dir")


@query("SELECT concat('/', n_name) AS path, TRUE AS is_dir FROM nation UNION ALL SELECT concat('/', n_name, '/', c_name), TRUE FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT concat('/', n_name, '/', c_name, '/', CAST(o_orderkey AS STRING)), FALSE FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def moved_in(spark, sf_dir):
    """Nations' folders move in one after the other; a walk found their customers and orders."""
    for t in ("nation", "customer", "orders"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    events = spark.sql("SELECT CAST(n_nationkey AS BIGINT) + 1 AS seq, 'create' AS op, concat('/', n_name) AS path, TRUE AS is_dir, TRUE AS moved_in FROM nation")
    found = spark.sql("SELECT CAST(n_nationkey AS BIGINT) + 1 AS seq, concat('/', n_name, '/', c_name) AS path, TRUE AS is_dir FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT CAST(n_nationkey AS BIGINT) + 1, concat('/', n_name, '/', c_name, '/', CAST(o_orderkey AS STRING)), FALSE FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
    return changes.apply(changes.with_listings(events, found)).alive.select("path", "is_dir")


@query(_GRAFT + "SELECT path, is_dir FROM r WHERE status <> 'removed' UNION ALL SELECT path, is_dir FROM fx1 WHERE is_dir AND path <> '/' AND NOT starts_with(path, '/ASIA/')", "fx1", "fx6")
def rescanned(spark, sf_dir):
    """A rescan of one mount merged into a stored tree; the rest of the tree stays."""
    snapshots = store.Store(spark, _folder(spark, "rescan"))
    base = raw(spark, sf_dir, "fx1").filter("is_dir and path <> '/'").select("path", "is_dir").withColumn("part", stream.part_of("path"))
    snapshots.save(base, parts=[str(i) for i in range(stream.PARTS)])
    stream.rescan(snapshots, raw(spark, sf_dir, "fx6"), "/ASIA")
    return stream.state(snapshots).select("path", "is_dir")


@query("SELECT id, path FROM fx1 WHERE contains(lower(name), 'order-12')", "fx1")
def ngram_appended(spark, sf_dir):
    """An index stored over the folders, the files appended later."""
    e, path = entries(spark, sf_dir, "fx1"), _folder(spark, "ngrams")
    ngram.store(ngram.build(e.filter("is_dir")), path, 2)
    ngram.append(e.filter("not is_dir"), path, 4)
    return ngram.search(e, spark.read.parquet(path), "Order-12").select("id", "path")


@query("SELECT id, path, (SELECT count(*) > 50 FROM fx1 WHERE contains(lower(name), 'customer')) AS more FROM fx1 WHERE contains(lower(name), 'customer') ORDER BY id LIMIT 50", "fx1")
def page_with_notice(spark, sf_dir):
    found, more = search.page_with_notice(search.hits(entries(spark, sf_dir, "fx1"), "customer"), 50)
    return found.select("id", "path").withColumn("more", F.lit(more))


@query("SELECT count(DISTINCT path) FILTER (NOT is_dir) AS files, count(DISTINCT path) FILTER (is_dir) AS folders, count(DISTINCT path) FILTER (incomplete) AS errors FROM fx6", "fx6")
def walk_report(spark, sf_dir):
    return catalog.scan_report(raw(spark, sf_dir, "fx6").withColumn("error", F.when(F.col("incomplete"), "denied")))


@query("SELECT id, path FROM fx3 WHERE contains(name, 'ÉTÉ-1') OR contains(name, 'été-1')", "fx3")
def raw_names(spark, sf_dir):
    """Names in Latin-1 bytes, which aren't UTF-8, found by their bytes."""
    rows = entries(spark, sf_dir, "fx3").withColumn("path_raw", F.encode("path", "ISO-8859-1"))
    return search.hits_raw(rows, "ÉTÉ-1".encode("latin-1")).select("id", "path")


@query("SELECT id, path FROM (SELECT id, concat(path, CASE WHEN id % 5 = 0 THEN concat(chr(10), 'x') ELSE '' END) AS path FROM fx2)", "fx2")
def nul_framed(spark, sf_dir):
    """Written with NUL after each path and read back, line breaks and all; ids ride in front."""
    rows = raw(spark, sf_dir, "fx2").select(F.concat(F.col("id").cast("string"), F.lit(" "), "path", F.when(F.col("id") % 5 == 0, "\nx").otherwise("")).alias("path"))
    at = _folder(spark, "nul")
    framing.write_nul(rows, at)
    back = spark.read.option("lineSep", "\0").text(at)
    return back.select(F.substring_index("value", " ", 1).cast("long").alias("id"), F.expr("substring(value, instr(value, ' ') + 1)").alias("path"))


@query("SELECT * FROM (VALUES ('root', '/data'), ('root', '/srv/x'), ('exclude', '/data/tmp'), ('rescan', '/srv/x'), ('rescan_interval', '60')) t(key, value)")
def settings(spark, sf_dir):
    text_ = "# settings\nroot = /data/\nroot=/srv//x\n exclude = /data/./tmp\nrescan = /srv/x\nrescan_interval = 60\n"
    clean = config.Config.parse(text_).checked().to_text()
    return spark.createDataFrame([tuple(x.strip() for x in line.split("=")) for line in clean.splitlines()], "key string, value string")


@query("SELECT * FROM (VALUES ('rc', 'cr', 'match case · regex'), ('zfd', 'd', 'folders only'), ('hpf', 'pfh', 'path · files only · no hidden'), ('-', '-', '')) t(flags, canonical, badges)")
def search_flags(spark, sf_dir):
    made = [(f, o.to_flags(), o.badges()) for f in ("rc", "zfd", "hpf", "-") for o in [O.from_flags(f)]]
    return spark.createDataFrame(made, "flags string, canonical string, badges string")


@query("""SELECT * FROM (VALUES (0, 0, 'a'), (0, 1, 'b c'), (0, 2, 'de f'), (0, 3, 'open end'), (1, 0, 'x')) t(query, ord, word)""")
def query_words(spark, sf_dir):
    made = [(n, k, w) for n, q in enumerate((' a "b c" d"e f" "open end', 'x ""', '""')) for k, w in enumerate(text.bounded_terms(text.split_terms(q)))]
    return spark.createDataFrame(made, "query int, ord int, word string")
