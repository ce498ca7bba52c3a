"""The tree engine against brute force, literal traps, stores, walks and streams."""

import os
import random

import pytest
from pyspark.sql import functions as F

from pathlens.functions import text
from pathlens.operators import access, catalog, changes, exec_plan, graft, ngram, search, tree
from pathlens.operators.model import SearchOptions, clamp_limit, page_size
from pathlens.sources import config, framing, store, walker
from pathlens.streaming import feed

O = SearchOptions

NAMES = ["report", "Report Final.PDF", ".cache", "été", "ÉTÉ-b.txt", "σοφίας", "ΣΟΦΊΑΣ", "a", "ab", "x y", "src", "Straße", "line\nbreak", "report-7"]


def forest(seed=1, n=300, root="/home"):
    rng = random.Random(seed)
    rows, folders = [(0, None, root, True)], [0]
    for i in range(1, n):
        is_dir = rng.random() < 0.3
        rows.append((i, rng.choice(folders), rng.choice(NAMES) + ("" if rng.random() < 0.3 else str(i)), is_dir))
        if is_dir:
            folders.append(i)
    return rows


def brute_tree(rows):
    paths, hidden, depth = {}, {}, {}
    for i, up, name, _ in rows:
        paths[i] = name if up is None else (paths[up] if paths[up].endswith("/") else paths[up] + "/") + name
        hidden[i] = up is not None and (hidden[up] or name.startswith("."))
        depth[i] = 0 if up is None else depth[up] + 1
    return paths, hidden, depth


@pytest.fixture(scope="module")
def woods(spark):
    rows = forest()
    df = spark.createDataFrame(rows, "id long, parent_id long, name string, is_dir boolean")
    return rows, tree.derived(tree.with_paths(df)).cache()


def test_paths_by_doubling_and_by_recursion(spark, woods):
    rows, _ = woods
    for root in ("/home", "/"):
        rows = forest(2, 200, root)
        chain = [(1000 + i, 999 + i if i else 0, f"d{i}", True) for i in range(120)]
        df = spark.createDataFrame(rows + chain, "id long, parent_id long, name string, is_dir boolean")
        paths, hidden, depth = brute_tree(rows + chain)
        want = {i: (paths[i], depth[i], hidden[i]) for i in paths}
        assert {r.id: (r.path, r.depth, r.hidden) for r in tree.with_paths(df).collect()} == want
        df.createOrReplaceTempView("woods")
        assert {r.id: (r.path, r.depth, r.hidden) for r in tree.with_paths_sql(spark, "woods").collect()} == want


def test_broken_links_are_errors(spark):
    ddl = "id long, parent_id long, name string, is_dir boolean"
    with pytest.raises(Exception, match="no folder with id 9"):
        tree.with_paths(spark.createDataFrame([(0, None, "/", True), (1, 9, "a", True)], ddl)).collect()
    for up in (9, 2):  # missing, or a file
        with pytest.raises(Exception, match=f"no folder with id {up}"):
            tree.with_paths(spark.createDataFrame([(0, None, "/", True), (1, up, "a", False), (2, 0, "f", False)], ddl)).collect()
    with pytest.raises(ValueError, match="loop"):
        tree.with_paths(spark.createDataFrame([(0, None, "/", True), (1, 2, "a", True), (2, 1, "b", True)], ddl)).collect()


QUERIES = ["report", "REPORT", "été", "ΣΟΦΊΑ", "σοφίας", "a", "y", "/", "home", "src/", "/.cache/", "report src", '"x y" report', '"x y', "straße", "strasse", "", "   ", '""', "zz", "a a a", "/home/"]


@pytest.mark.parametrize("options", [O(), O(match_case=True), O(in_path=True), O(kind="files"), O(kind="folders", hide_hidden=True), O(hide_hidden=True)])
def test_searches_by_brute_force(woods, options):
    rows, df = woods
    paths, hidden, _ = brute_tree(rows)
    fold = (lambda x: x) if options.match_case else (lambda x: "".join(c.lower() for c in x))
    for q in QUERIES:
        terms = text.split_terms(q)
        in_path = options.in_path or len(terms) > 1 or any("/" in t for t in terms)
        want = [i for i, _, name, d in rows if terms and all(fold(t) in fold(paths[i] if in_path else name) for t in terms) and (options.kind == "all" or d == (options.kind == "folders")) and not (options.hide_hidden and hidden[i])]
        assert [r.id for r in search.search(df, q, options, 1000).collect()] == want, q
        assert [r.id for r in search.search(df, q, options, 3).collect()] == want[:3], q
    assert search.search(df, "report", options, 0).count() == 0


def test_ngram_plan_agrees_with_the_scan(woods):
    _, df = woods
    index = ngram.build(df)
    for q in ("report", "été", "ort1", "ab", "σοφ", "zzz"):
        assert {r.id for r in ngram.search(df, index, q).collect()} == {r.id for r in search.hits(df, q).collect()} if "/" not in q else True


def test_ngrams_are_appended_to_a_stored_index(spark, woods, tmp_path):
    _, df = woods
    path = f"file://{tmp_path}/ngrams"
    ngram.store(ngram.build(df.filter("id < 200")), path, 3)
    before = {f for f in os.listdir(f"{tmp_path}/ngrams") if f.endswith(".parquet")}
    ngram.append(df.filter("id >= 200"), path, 2)
    assert before <= set(os.listdir(f"{tmp_path}/ngrams"))
    index = spark.read.parquet(path)
    assert sorted(map(tuple, index.collect())) == sorted(map(tuple, ngram.build(df).collect()))
    assert {r.id for r in ngram.search(df, index, "report").collect()} == {r.id for r in search.hits(df, "report").collect()}


def test_regular_expressions(spark):
    df = tree.derived(spark.createDataFrame([(0, "a.txt", "/d/a.txt"), (1, "b\n", "/d/b\n"), (2, "ΣΟΦΙΑ7", "/ΣΟΦΙΑ7"), (3, "Σοφια٣", "/x/Σοφια٣")], "id long, name string, path string").withColumn("is_dir", F.lit(False)))
    ids = lambda q, o=O(regex=True): [r.id for r in search.search(df, q, o).collect()]
    assert ids(r"^A\.TXT$") == [0] and ids(r"^A\.TXT$", O(regex=True, match_case=True)) == []
    assert ids(r"b$") == [] and ids(r"^/d/") == [0, 1] and ids(r"^σοφια\d$") == [2, 3] and ids(r"[$a]\.t") == [0]
    for bad in ("(", ")", r"(?=x)", r"(?<!x)a", r"(a)\1", "a++", r"\Z", "[a", "[z-a]", "[[:nope:]]", r"\q", "(?U)a", "(?<n>a", "a{2"):
        with pytest.raises(ValueError, match="^invalid regex: [^\n]+$"):
            search.search(df, bad, O(regex=True))


@pytest.mark.parametrize(
    "pattern, yes, no",
    [
        (r"[[:digit:]]", ["a7"], ["dig", ":"]),
        (r"^[[:^alpha:]_]+$", ["12_"], ["1a"]),
        (r"^[[:punct:]]+$", [r"!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~", "\\"], ["a", " "]),
        (r"^[*+]$", ["*", "+"], ["**"]),
        (r"^[]a]+$", ["]a"], ["b"]),
        (r"^[^]a]$", ["b"], ["]", "a"]),
        (r"^[a-]$|^[-b]$", ["a", "-", "b"], ["c"]),
        (r"^[a-z&&[^aeiou]]+$", ["xyz"], ["axe"]),
        (r"^[a-z--[aeiou]]+$", ["xyz"], ["axe"]),
        (r"^[a-f~~d-i]+$", ["abcghi"], ["d"]),
        (r"^[^a-z&&[b]]$", ["a", "1"], ["b"]),
        (r"^[[a-c][x-z]]+$", ["abxz"], ["m"]),
        (r"^[&~a&b]+$", ["&~ab"], ["c"]),
        (r"(?P<n>7)(?<other_1>8)", ["x78"], ["87"]),
        (r"(?m)7$", ["a7\nb"], ["a8\nb"]),
        (r"7$", ["a7"], ["a7\nb", "a7\n"]),
        (r"(?m)^b", ["a\nb"], ["ab"]),
        (r"(?m:^b)|^c$", ["a\nb", "c"], ["a\nc"]),
        (r"(?s)a.b", ["a\nb"], ["ab"]),
        (r"a.b", ["a b", "a\rb"], ["a\nb"]),
        (r"(?-i)A", ["A"], ["a"]),
        ("(?x) a  b # c (d\n ( e )", ["abe"], ["ab e"]),
        (r"\<ab\>", ["x ab y", "ab"], ["xab", "aby"]),
        (r"\x41\x{e9}\u00E9", ["aÉé"], ["a"]),
        (r"^\p{Greek}+\pN$", ["σοφ٣"], ["abc1"]),
        (r"^\p{Uppercase_Letter}\P{L}$", ["A1"], ["Ab"]),
        (r"a{2}\.{1,}[.]$", ["aa..."], ["a..."]),
        (r"a]b}", ["a]b}"], ["ab"]),
        (r"\v", ["\x0b"], ["\n", "v"]),
        (r"^\[\]\^\$\.\|\?\*\+\(\)\{\}\-\&\~\#$", ["[]^$.|?*+(){}-&~#"], ["x"]),
    ],
)
def test_dialect(spark, pattern, yes, no):
    java = spark.sparkContext._jvm.java.util.regex.Pattern.compile(text.checked_regex(spark, pattern))
    assert [t for t in yes if not java.matcher(t).find()] == [] and [t for t in no if java.matcher(t).find()] == []


def test_words_flags_and_limits():
    assert text.split_terms(' a "b c" d"e f" "open end') == ["a", "b c", "de f", "open end"]
    with pytest.warns(UserWarning):
        assert len(text.bounded_terms(["x"] * 65)) == 64
    for o in (O(), O(True, True, True, "files", True), O(kind="folders")):
        assert O.from_flags(o.to_flags()) == o
    assert O().to_flags() == "-" and O.from_flags("zfd?") == O(kind="folders") and "regex" in O(regex=True).badges()
    assert (clamp_limit(None), clamp_limit(10**9), clamp_limit(-1), page_size(None), page_size(1)) == (100, 100_000, 0, 500, 100)


def test_text_expressions(spark):
    df = spark.createDataFrame([("ΣΟΦΙΑΣ", 1280), ("İ", 0), ("abc", 1023), ("ß", 5 * 1024**4), ("a%b c~é", None)], "s string, n long")
    got = df.select(text.fold("s").alias("f"), text.format_size("n").alias("z"), text.file_uri(F.concat(F.lit("/"), "s")).alias("u"), text.is_ascii("s").alias("a")).collect()
    assert [r.f for r in got] == ["σοφιασ", "i̇", "abc", "ß", "a%b c~é"]
    assert [r.z for r in got] == ["1.2 KB", "0 B", "1023 B", "5.0 TB", "?"]
    assert got[4].u == "file:///a%25b%20c~%C3%A9" and [r.a for r in got] == [False, False, True, False, False]
    for r, uri in zip(df.collect(), got):
        assert text.path_from_uri(uri.u) == ("/" + r.s).encode()
    for bad in (None, "", "http://x", "file://host/x", "file:///a%2", "file:///a%zz"):
        assert text.path_from_uri(bad) is None
    uris = spark.createDataFrame([("file:///caf%E9",), ("file:///a+b",), ("x",)], "u string").select(text.uri_path("u").alias("p")).collect()
    assert [r.p and bytes(r.p) for r in uris] == [b"/caf\xe9", b"/a+b", None]
    names = spark.createDataFrame([(0, "report", "/home/.cfg/report"), (1, ".x", "/home/.cfg/.x"), (2, "/home/.cfg", "/home/.cfg"), (3, "y", "/home/.cfg/.x/y")], "id long, name string, path string").withColumn("is_dir", F.lit(False))
    assert [r.hidden for r in tree.derived(names, root="/home/.cfg").orderBy("id").collect()] == [False, True, False, True]
    assert text.fold_bytes(b"CAF\xe9-\xc3\x89") == b"caf\xe9-\xc3\xa9"
    assert spark.createDataFrame([(bytearray(b"caf\xe9"),)], "r binary").select(text.display("r").alias("d")).first().d == "caf�"
    grams = spark.createDataFrame([("ab",), ("abcab",), ("é1",), ("",)], "s string").select(text.ngrams("s").alias("g")).collect()
    assert [[bytes(x) for x in r.g] for r in grams] == [[], [b"abc", b"bca", b"cab"], ["é1".encode()], []]


def test_path_expressions(spark):
    df = spark.createDataFrame([("/a/b/c.TXT",), ("/a",), ("/",), ("plain",), ("/a\n/b",)], "p string")
    got = df.select(text.parent_dir("p").alias("d"), text.base_name("p").alias("b"), text.ancestors("p").alias("u"), text.one_line("p").alias("o"), text.is_within("p", "/a").alias("w"), text.icon("p").alias("i")).collect()
    assert [r.d for r in got] == ["/a/b", "/", "/", "/", "/a\n"] and [r.b for r in got] == ["c.TXT", "a", "", "plain", "b"]
    assert got[0].u == ["/", "/a", "/a/b"] and got[1].u == ["/"] and got[2].u == [] and got[4].o == "/a⏎/b"
    assert [r.w for r in got] == [True, True, False, False, False] and got[0].i == "text-x-generic"
    assert text.normalise_path("//a/./b/") == "/a/b" and df.limit(1).select(text.normalised("p").alias("n")).first().n == "/a/b/c.TXT"
    for bad in ("a", "/a/../b", "/a\nb"):
        with pytest.raises(ValueError):
            text.normalise_path(bad)
    rel = spark.createDataFrame([("Order",), ("order-1",), ("my order",), ("x",), ("ОРДЕР",)], "n string").select(text.relevance("n", "ORDER").alias("r"), text.relevance("n", "ордер", True).alias("u")).collect()
    assert [r.r for r in rel] == [1.0, 0.9, 0.7, 0.4, 0.4] and rel[4].u == 1.0
    assert spark.range(1).select(text.group_digits(F.lit(1234567)).alias("x")).first().x == "1,234,567"


def test_catalogue_limits_after_removing_repeats(spark):
    part = lambda o, rows: tree.derived(spark.createDataFrame(rows, "id long, path string").withColumns({"name": text.base_name("path"), "is_dir": F.lit(False)}), o)
    parts = [part(0, [(5, "/d/x1"), (6, "/d/x2")]), part(1, [(0, "/d/x1"), (1, "/d/x2"), (2, "/d/x3")])]
    got = [(r.part_ord, r.path) for r in catalog.search(parts, "x", limit=3).collect()]
    assert got == [(0, "/d/x1"), (0, "/d/x2"), (1, "/d/x3")]
    page, more = search.page_with_notice(catalog.merged(parts), 2)
    assert page.count() == 2 and more


def test_visibility_comes_before_the_limit(spark):
    rows = [(i, f"/shut/f{i}") for i in range(50)] + [(60, "/open/f"), (61, "/open/in/f"), (62, "/shut"), (63, "/seen/pass/f"), (64, "/seen/f")]
    df = tree.derived(spark.createDataFrame(rows, "id long, path string").withColumns({"name": text.base_name("path"), "is_dir": F.lit(False)}))
    acl = spark.createDataFrame([("/shut", False, False), ("/seen", False, True)], "dir string, can_list boolean, can_pass boolean")
    assert [r.id for r in search.page(access.visible(df, acl, "allow"), 5).collect()] == [60, 61, 62, 63]
    assert access.visible(df, acl).count() == 0 and access.visible(df, acl.limit(0)).count() == 0 and access.visible(df, acl.limit(0), "allow").count() == 55
    rest = spark.createDataFrame([("/", True, True), ("/open", True, True), ("/open/in", None, True), ("/seen/pass", True, True)], acl.schema)
    assert [r.id for r in search.page(access.visible(df, acl.union(rest)), 5).collect()] == [60, 62, 63]


def test_modes_of_folders(spark):
    rows = [("/a", 5, 9, 0o700), ("/b", 6, 9, 0o750), ("/c", 6, 8, 0o705), ("/d", 6, 8, 0o711), ("/e", 5, 9, 0o077), ("/f", 6, 8, 0o744), ("/g", None, 8, 0o777)]
    dirs = spark.createDataFrame(rows, "path string, uid int, gid int, mode int")
    got = {r.dir: (r.can_list, r.can_pass) for r in access.rules(dirs, 5, [9]).collect()}
    assert got == {"/a": (True, True), "/b": (True, True), "/c": (True, True), "/d": (False, True), "/e": (False, False), "/f": (False, False), "/g": (False, False)}
    assert all(r.can_list and r.can_pass for r in access.rules(dirs, 0).collect())
    assert not any(r.can_list for r in access.rules(dirs, 7).filter("dir not in ('/c', '/e')").collect())


def brute_feed(events, base=()):
    alive, dropped = {p: d for p, d in base} | {"/": True}, []
    for seq, op, path, is_dir in sorted(events):
        up = path.rsplit("/", 1)[0] or "/"
        if op == "create":
            if not alive.get(up, False):
                dropped.append((seq, path))
            elif path not in alive:
                alive[path] = is_dir
        else:
            for p in [p for p in alive if p == path or p.startswith(path + "/")]:
                del alive[p]
    alive.pop("/")
    return alive, sorted(dropped)


def random_events(seed, n=400):
    rng = random.Random(seed)
    paths = ["/a", "/b", "/a/x", "/a/y", "/b/x", "/a/x/1", "/a/x/2", "/b/x/1", "/a/y/1", "/a/x/1/k"]
    out = []
    for i in range(n):
        p = rng.choice(paths)
        out.append((i, rng.choice(["create", "create", "delete"]), p, p.count("/") < 3 or p == "/a/x/1"))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_feed_by_simulation(spark, seed):
    events = random_events(seed, 150)
    base = [("/a", True), ("/a/x", True), ("/a/x/2", False)] if seed > 1 else []
    want, dropped = brute_feed(events, base)
    got = changes.apply(spark.createDataFrame(events, "seq long, op string, path string, is_dir boolean"), spark.createDataFrame(base, "path string, is_dir boolean") if base else None)
    assert {r.path: r.is_dir for r in got.alive.collect()} == want
    assert sorted((r.seq, r.path) for r in got.dropped.collect()) == dropped


def test_stream_equals_batch_and_happens_once(spark, tmp_path):
    events = random_events(7, 60)
    ddl = "seq long, op string, path string, is_dir boolean"
    snapshots = store.Store(spark, f"file://{tmp_path}/tree")
    for k in range(2):
        spark.createDataFrame(events[30 * k : 30 * k + 30], ddl).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(ddl).parquet(f"file://{tmp_path}/in")
        feed.start(feed.counters(stream), snapshots, f"file://{tmp_path}/cp").awaitTermination()
    want, _ = brute_feed(events)
    assert {r.path: r.is_dir for r in snapshots.load().collect()} == want and snapshots.batch("feed") == 1
    assert all(r.part == r.p for r in snapshots.load().withColumn("p", feed.part_of("path")).collect())
    assert not feed.apply_batch(snapshots, spark.createDataFrame(events, ddl), 1)
    with pytest.raises(RuntimeError, match="overflow"):
        feed.apply_batch(snapshots, spark.createDataFrame([(99, "overflow", "/", True)], ddl), 2)
    assert feed.retry_interval(900) == 60


def test_batches_rewrite_the_parts_they_name(spark, tmp_path):
    ddl = "seq long, op string, path string, is_dir boolean"
    snapshots = store.Store(spark, f"file://{tmp_path}/tree")
    tops = [f"/t{i}" for i in range(30)]
    first = [(i, "create", t, True) for i, t in enumerate(tops)] + [(100 + i, "create", f"{t}/f", False) for i, t in enumerate(tops)]
    feed.apply_batch(snapshots, spark.createDataFrame(first, ddl), 0)
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(tmp_path / "tree") for f in names if f.endswith(".parquet")}
    before = files()
    events = [(200, "delete", "/t3", True), (201, "create", "/t4/new", False), (202, "create", "/t4/new/none", False)]
    feed.apply_batch(snapshots, spark.createDataFrame(events, ddl), 1)
    want, _ = brute_feed(first + events)
    assert {r.path: r.is_dir for r in snapshots.load().collect()} == want
    pointer = snapshots._current()
    moved = [p for p, v in pointer["parts"].items() if v == 2]
    named = {r.p for r in spark.createDataFrame([("/t3",), ("/t4",)], "t string").select(feed.part_of("t").alias("p")).collect()}
    assert set(moved) <= named and len(files() - before) <= 2 * len(named) and before <= files()
    held = {r.path for r in snapshots.load(parts=moved).collect()}
    touched = feed.involved(snapshots.load(), spark.createDataFrame([(1, "create", "/t5/x", False), (2, "delete", "/t6", True)], ddl))
    assert {r.path for r in touched.collect()} == {"/t5", "/t6", "/t6/f"} and "/t4/new" in held
    listing = spark.createDataFrame([("/t7/g", False, False), ("/t7/h", True, True)], "path string, is_dir boolean, incomplete boolean")
    assert tuple(feed.rescan(snapshots, listing, "/t7").first()) == (2, 2, 1, 0)
    now = {r.path for r in snapshots.load().collect()}
    assert now == {p for p in want if p != "/t7/f"} | {"/t7/g", "/t7/h"}
    for k in range(3):
        feed.apply_batch(snapshots, spark.createDataFrame([(300 + i, "create", f"{t}/n{k}", False) for i, t in enumerate(tops)], ddl), 2 + k)
    assert not os.path.exists(tmp_path / "tree/v=1") and snapshots.load().count() == len(now) + 29 * 3
    with pytest.raises(store.SnapshotError, match="plain names"):
        snapshots.save(snapshots.load(), parts=["a/b"])


def test_jobs_run_again_and_again(spark, tmp_path):
    import time

    runs = []
    job = feed.every(spark, 0.2, runs.append, f"file://{tmp_path}/clock")
    for _ in range(100):
        if len(runs) > 2:
            break
        time.sleep(0.2)
    job.stop()
    assert runs[:3] == [0, 1, 2]


def test_events_from_kernel_masks(spark):
    ev = spark.createDataFrame([(1, 0x100 | 0x40000000, 7, None, "d"), (2, 0x40, 8, "/p", "f"), (3, 0x2, 7, None, "x"), (4, 0x80, 0, "/", "t")], "seq long, mask long, parent_ino long, parent_path string, name string")
    dirs = spark.createDataFrame([(7, "/home"), (0, "/never")], "ino long, path string")
    got = sorted((r.seq, r.op, r.is_dir, r.path) for r in changes.with_paths(changes.classified(ev), dirs).collect())
    assert got == [(1, "create", True, "/home/d"), (2, "delete", False, "/p/f"), (4, "create", False, "/t")]
    out = spark.createDataFrame([("/home",)], "path string")
    paths = spark.createDataFrame([(1, "/home/x"), (2, "/homes")], "seq long, path string")
    assert [r.seq for r in changes.without_excluded(paths, out).collect()] == [2]


def test_folders_that_move_in_bring_what_they_hold(spark, tmp_path):
    events = [(1, "create", "/a", True, False), (2, "create", "/a/d", True, True), (3, "delete", "/a/d/x", False, False), (4, "create", "/a/e", True, True)]
    ev = spark.createDataFrame(events, "seq long, op string, path string, is_dir boolean, moved_in boolean")
    found = spark.createDataFrame([(2, "/a/d/s/deep", False), (2, "/a/d/s", True), (2, "/a/d/x", False), (2, "/a/other", False), (1, "/a/z", False)], "seq long, path string, is_dir boolean")
    got = changes.apply(changes.with_listings(ev, found))
    assert {r.path: r.is_dir for r in got.alive.collect()} == {"/a": True, "/a/d": True, "/a/d/s": True, "/a/d/s/deep": False, "/a/e": True}
    assert got.dropped.count() == 0


def test_events_from_files_of_lines(spark, tmp_path):
    from pathlens.sources import events

    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"seq": 1, "mask": 1073742080, "parent_ino": 7, "name": "d"}\n{"seq": 2, "mask": 256, "parent_path": "/home/d", "parent_ino": 0, "name": "f"}\n\n')
    dirs = spark.createDataFrame([(7, "/home")], "ino long, path string")
    snapshots = store.Store(spark, f"file://{tmp_path}/tree")
    feed.apply_batch(snapshots, spark.createDataFrame([(0, "create", "/home", True)], "seq long, op string, path string, is_dir boolean"), 0, "first")
    feed.start(events.read(spark, f"file://{tmp_path}/in", dirs, 1), snapshots, f"file://{tmp_path}/cp").awaitTermination()
    assert {r.path: r.is_dir for r in snapshots.load().collect()} == {"/home": True, "/home/d": True, "/home/d/f": False}
    lines = spark.createDataFrame([("not json",), ('{"mask": 256, "name": "x"}',), ('{"seq": 9, "mask": 2, "name": "x"}',)], "value string")
    assert [r.op for r in events.parsed(lines, dirs).collect()] == ["overflow", "overflow"]


def test_graft_keeps_what_could_not_be_read(spark):
    old = spark.createDataFrame([("/m/a", True), ("/m/a/1", False), ("/m/a/s", True), ("/m/a/s/2", False), ("/m/b", True), ("/m/b/3", False), ("/m/c", False)], "path string, is_dir boolean")
    new = spark.createDataFrame([("/m/a", True, True), ("/m/a/s", True, False), ("/m/b", True, False), ("/m/n", False, False)], "path string, is_dir boolean, incomplete boolean")
    got = {r.path: r.status for r in graft.merge(old, new, "/m").collect()}
    assert got == {"/m/a": "unchanged", "/m/a/s": "unchanged", "/m/b": "unchanged", "/m/n": "added", "/m/a/1": "kept", "/m/a/s/2": "removed", "/m/b/3": "removed", "/m/c": "removed"}
    assert tuple(graft.stats(graft.merge(old, new, "/m")).first()) == (5, 1, 3, 1)
    assert {r.path for r in graft.merge(old, new.limit(0), "/m", True).filter("status = 'kept'").collect()} == {r.path for r in old.collect()}
    live = old.withColumn("alive", F.lit(True))
    assert [r.relative for r in graft.listing(live, "/m").collect()] == ["a", "a/1", "a/s", "a/s/2", "b", "b/3", "c"]


def test_commands():
    split = exec_plan.split_clause
    assert split(["a", "-exec", "cp", "{}", "x{}y", ";", "-f"]) == (["a", "-f"], exec_plan.Command(("cp", "{}", "x{}y"), False))
    assert split(["a"]) == (["a"], None)
    for bad in (["-exec", "ls"], ["-exec", ";"], ["-exec", "ls", "+"]):
        with pytest.raises(ValueError):
            split(bad)
    assert [len(b) for b in exec_plan.batched(iter(["123456789"] * 5), 10, 30)] == [2, 2, 1]
    assert [len(b) for b in exec_plan.batched(iter(["x" * 99, "y", "x" * 99]), 0, 10)] == [1, 1, 1]


def test_batches_and_frames(spark, tmp_path):
    hits = spark.createDataFrame([(i, f"/some/{i:02d}") for i in range(5)] + [(9, "/line\nbreak")], "id long, path string").coalesce(1)
    got = exec_plan.batches(hits.filter("id < 5"), exec_plan.Command(("rm", "{}"), True), 23).collect()
    assert [r.argv for r in got] == [["rm", "/some/00", "/some/01"], ["rm", "/some/02", "/some/03"], ["rm", "/some/04"]]
    dealt = exec_plan.batches(hits.repartition(4), exec_plan.Command(("rm", "{}"), True), 13).collect()
    assert len({(r.part, r.batch) for r in dealt}) == len(dealt) == 6
    framing.write_lines(hits, f"{tmp_path}/l")
    framing.write_nul(hits, f"{tmp_path}/n")
    read = lambda d: b"".join(open(f"{tmp_path}/{d}/{f}", "rb").read() for f in os.listdir(f"{tmp_path}/{d}") if f.endswith(".txt"))
    assert read("l").count(b"\n") == 5 and read("n").split(b"\0")[5] == b"/line\nbreak"


def test_snapshots(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    with pytest.raises(store.SnapshotError):
        s.load()
    df = spark.createDataFrame([("p", 0, None, "/"), ("p", 1, 0, "a")], "part string, id long, parent_id long, name string")
    for k in range(1, 4):
        assert s.save(df) == k
    assert sorted(os.listdir(f"{tmp_path}/s/"))[-2:] == ["v=2", "v=3"]
    assert sorted(r.id for r in s.load().collect()) == [0, 1]
    s.save(df.withColumn("parent_id", F.lit(5).cast("long")))
    with pytest.raises(store.SnapshotError):
        s.load()
    for bad in ([("p", 0, None, "/"), ("p", 3, 2, "a")], [("p", 0, None, "/"), ("p", 1, 0, "a"), ("p", 1, 0, "b")], [("p", 1, 0, "a")]):
        s.save(spark.createDataFrame(bad, df.schema))
        with pytest.raises(store.SnapshotError):
            s.load()
    s.save(df.withColumn("is_dir", F.col("id") == 0))
    assert [r.path for r in tree.restored(s.load()).orderBy("id").collect()] == ["/", "/a"] and "name_fold" in tree.restored(s.load()).columns
    (tmp_path / "s/CURRENT").write_text("junk")
    (tmp_path / "s/.CURRENT.crc").unlink(missing_ok=True)
    with pytest.raises(store.SnapshotError):
        s.load()


def test_walks(spark, tmp_path):
    for d in ("top/sub/deep", "top/out/in", ".dot"):
        (tmp_path / d).mkdir(parents=True)
    (tmp_path / "top/sub/file.txt").write_text("12345")
    (tmp_path / "empty").touch()
    (tmp_path / "top/link").symlink_to(tmp_path)
    with open(os.path.join(os.fsencode(tmp_path), b"caf\xe9"), "w"):
        pass
    df = walker.read(spark, str(tmp_path), [f"{tmp_path}/top/out"])
    got = {r.path.removeprefix(str(tmp_path)): r for r in df.collect()}
    assert set(got) == {"", "/top", "/top/sub", "/top/sub/deep", "/top/sub/file.txt", "/top/link", "/.dot", "/empty", "/caf�"}
    assert got["/top/sub/file.txt"].size_bytes == 5 and not got["/top/link"].is_dir and bytes(got["/caf�"].path_raw).endswith(b"caf\xe9")
    listing, failed = walker.as_listing(df, str(tmp_path))
    assert not failed and listing.filter("incomplete").count() == 0 and listing.count() == len(got) - 1
    shut = spark.createDataFrame([(f"{tmp_path}/top", True, "denied"), (f"{tmp_path}/top", True, None), (str(tmp_path), True, None), (f"{tmp_path}/f", False, None)], "path string, is_dir boolean, error string")
    listing, failed = walker.as_listing(shut, str(tmp_path))
    kept = graft.merge(df.filter(F.col("path") != str(tmp_path)), listing, str(tmp_path), failed)
    assert {r.path.removeprefix(str(tmp_path)): r.status for r in kept.collect()} == {"/top": "unchanged", "/top/sub": "kept", "/top/sub/deep": "kept", "/top/sub/file.txt": "kept", "/top/link": "kept", "/.dot": "removed", "/empty": "removed", "/caf\ufffd": "removed", "/f": "added"}
    assert walker.as_listing(shut.limit(0), "/x")[1] and tuple(catalog.scan_report(shut).first()) == (1, 2, 1)
    found = tree.derived(df.withColumn("name", text.base_name("path")))
    assert search.hits_raw(found, b"AF\xe9").count() == 1 and search.hits_raw(found, b"AF\xe9", match_case=True).count() == 0
    assert {r.path.removeprefix(str(tmp_path)) for r in search.hits_raw(found, b"top/s", in_path=True).collect()} == {"/top/sub", "/top/sub/deep", "/top/sub/file.txt"}
    with pytest.raises(Exception, match="not a mount point"):
        walker.read(spark, str(tmp_path), mount=True).collect()


def test_generated_trees(spark):
    from pathlens.sources import generate

    made = generate.links(spark, 5000).cache()
    rows = {r.id: r for r in made.collect()}
    assert len(rows) == made.count() and sum(not r.is_dir for r in rows.values()) == 5000
    assert all(r.parent_id is None if r.id == 0 else r.parent_id < r.id and rows[r.parent_id].is_dir for r in rows.values())
    assert sorted(map(tuple, generate.links(spark, 5000, partitions=3).collect()), key=str) == sorted(map(tuple, rows.values()), key=str)
    whole = tree.derived(tree.with_paths(made))
    assert whole.agg(F.max("depth")).first()[0] == generate.LEVELS + 1
    kept = catalog.resident(whole, 3)
    assert [r.name for r in search.search(kept, "zqxv").collect()] == [generate.NEEDLE]
    assert search.hits(kept, "report").count() > 3 * search.hits(kept, "passport").count() > 0
    kept.unpersist()


def test_settings(tmp_path):
    c = config.Config.parse("# x\nroot = /a\nroot=/b\n exclude = /a/tmp \nrescan_interval = 5\n")
    assert (c.roots, c.exclude, c.rescan_interval) == (["/a", "/b"], ["/a/tmp"], 5)
    path = str(tmp_path / "c")
    c.install(path)
    assert config.Config.load(path) == c
    for bad, line in (("secret", 1), ("\nno = 1", 2), ("rescan_interval = x", 1)):
        with pytest.raises(config.ConfigError, match=f"line {line}") as e:
            config.Config.parse(bad)
        assert "secret" not in str(e.value)
    with pytest.raises(ValueError):
        config.Config(["relative"]).install(path)
