"""Operators against brute force on the smallest tables, and on rows that are null, empty, long, repeated or odd."""

import hashlib
import random
import re
import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathlens.llm import best_fit, bloom, decontaminate, hilbert_ann, html_extract, pii, quality_gbdt, queries, runtime, simhash_vptree, token_pack, tokens, toxicity_pu, url_filter

DDL = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, y int, terms string"
LONG = "wort " * 30_000


def frame(spark, rows):
    """Rows (doc_id, text) with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 0.5, "x", 1, "t") for i, t in rows], DDL)


ODD = [(1, "alpha beta gamma delta"), (2, None), (3, ""), (4, "   \n"), (5, LONG), (5, LONG), (6, "ALPHA  beta\tgamma DELTA"), (None, "no id at all here"), (7, "héllo wörld 日本 ＡＢ"), (8, "@ . + 1.2.3.4 <b>")]


def docs_of(spark, sf_dir):
    return runtime.read_table(spark, sf_dir, "documents")


# --- 1


def test_pages_give_the_article(spark, sf_dir):
    rows = queries.op1_tag_path_extract(spark, sf_dir).collect()
    pages = {r.page_id: r.html for r in runtime.read_table(spark, sf_dir, "pages").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1]
        parts = (" ".join(__import__("html").unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", body.replace("<br>", " ")))
        assert r.text == "\n\n".join(p for p in parts if p)
        assert r.n_chars == len(r.text)


PARA = "This is a long sentence of the article, with commas, stops and sense. It goes on for a while, as articles do."


def test_boilerplate_goes_and_short_blocks_stay():
    page = f"""<html><head><title>T</title></head><body class="has-sidebar"><header><h2>Site</h2></header><div class="menu"><a href=x>Home</a> <a>Two</a></div>
    <div id="cookie-notice">{PARA} {PARA}</div><main><article><header><h1>Head &amp; line</h1></header><p>{PARA}</p><p>Short.<p>{PARA}<ul><li>One</li><li>Two</li></ul>
    <div class="ad">{PARA}</div><form><p>{PARA}</p></form><script>if (a < b) {{}}</script><p>caf&eacute;&nbsp; x<br>y</p></article>
    <section class="comments"><article class="comment"><p>{PARA * 20}</p></article></section></main><aside>{PARA}</aside><footer>{PARA}</footer></body></html>"""
    want = ["Head & line", PARA, "Short.", PARA, "One", "Two", "café x y"]
    assert html_extract.main_text(page).split("\n\n") == want


def test_pages_without_semantic_tags():
    page = f"<div class=wrap><div><a href=a>Home</a> | <a href=b>News</a></div><div id=c1><h1>Head</h1><p>{PARA}</p><p>Yes.</p><p>{PARA}</p></div><div><p><a href=z>More like this one</a></p></div></div>"
    assert html_extract.main_text(page).split("\n\n") == ["Head", PARA, "Yes.", PARA]
    assert html_extract.main_text(PARA) == PARA
    for odd in (None, "", "<", "<p", "<!-- ", "<script>x", '<a href="', "<div>" * 3000, "</p></div>", "&#0; &bogus; &#x110000;"):
        assert isinstance(html_extract.main_text(odd), str)


def table_pages():
    import pyarrow.parquet as pq

    return [r["html"] for r in pq.read_table("/root/testdata/sf0.1/pages.parquet", columns=["html"]).to_pylist()]


def article_of(page):
    body = re.search("<article>(.*)</article>", page, re.S)[1]
    parts = (" ".join(__import__("html").unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", body.replace("<br>", " ")))
    return "\n\n".join(p for p in parts if p)


def naive_content(page):
    """The docstring's formulas over paths written out as strings, each mean taken by a loop over all paths."""
    elements, blocks = html_extract.parse(page)
    h = html_extract

    def chain(k):
        return [k] + (chain(elements[k].parent) if k else [])

    def path(k):
        return "/".join(elements[i].label for i in chain(k)[::-1])

    rows = []
    for b in blocks:
        above = chain(b.element)
        in_article = any(elements[i].tag in h.SEMANTIC for i in above)
        header = any(elements[i].tag == "header" and not any(elements[j].tag in h.SEMANTIC for j in chain(i)) for i in above)
        comment = any(elements[i].is_comment and elements[i].tag not in ("html", "body") and not elements[i].holds_head for i in above)
        cue = any(elements[i].cue and elements[i].tag not in h.KEEP and not elements[i].holds_main for i in above)
        if not header and not comment and not any(elements[i].never for i in above):
            rows.append((path(b.element), b.text, b.link, cue, in_article))

    def pick(rows, weigh):
        import math

        f, plain, size = {}, {}, {}
        for p in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == p]
            n, t = len(own), sum(len(r[1]) for r in own)
            q, a = sum(len(re.findall(h.PUNCTUATION, r[1])) for r in own), sum(min(r[2], len(r[1])) for r in own)
            size[p], plain[p], f[p] = t, 1 - a / t, t * math.log(1 + t / n) * math.log(2 + q / n) * (1 - a / t)

        def mean(a):
            near = [p for p in {r[0] for r in rows if not r[3]} if a in (p, p.rpartition("/")[0])]
            return sum(f[p] * size[p] for p in near) / sum(size[p] for p in near) if near else 0.0

        scores = []
        for p, _, _, cue, in_article in rows:
            steps = p.split("/")
            up = ["/".join(steps[: len(steps) - k]) for k in range(len(steps))]
            b = max([mean(p), *(h.FADE**k * mean(a) for k, a in enumerate(up[1:])), *(h.FADE**k * mean(a) for k, a in enumerate(up))])
            s = h.CUED * f[p] if cue else (f[p] + h.BOOST * plain[p] * b) / (1 + h.BOOST)
            scores.append(s * (h.OUTSIDE if weigh and not in_article else 1))
        return [r for r, s in zip(rows, scores) if max(scores) > 0 and s >= h.THRESHOLD * max(scores)]

    within = [r for r in rows if r[4]]
    out = pick(rows, bool(within)) if rows else []
    if within and sum(len(r[1]) for r in out if r[4]) < h.INSIDE * sum(len(r[1]) for r in out):
        out = pick(within, False)
    return "\n\n".join(r[1] for r in out)


def test_naive_scores_agree_on_all_pages():
    for p in table_pages():
        p = p.replace("<article>", "<div>").replace("</article>", "</div>") if len(p) % 2 else p
        assert html_extract.main_text(p) == naive_content(p)


def test_ratios_decide_without_lists(monkeypatch):
    pages = table_pages()
    want = [article_of(p) for p in pages]
    plain = [p.replace("<article>", "<div>").replace("</article>", "</div>") for p in pages]
    right = lambda given: np.mean([html_extract.main_text(p) == w for p, w in zip(given, want)])
    assert right(pages) == 1 and right(plain) > 0.97
    scores = html_extract.path_scores
    with monkeypatch.context() as m:  # scores that say nothing let everything in
        m.setattr(html_extract, "path_scores", lambda *a: tuple({p: 1.0 for p in x} for x in scores(*a)))
        assert right(pages) < 0.05 and right(plain) == 0
    for name in ("CUES", "REGIONS", "ROLES", "COMMENT_CUES"):
        monkeypatch.setattr(html_extract, name, set())
    monkeypatch.setattr(html_extract, "NEVER", {"head"})
    assert right(pages) > 0.95 and right(plain) > 0.95


def test_names_within_the_content_do_not_cut_it():
    page = f"""<article><h1>Head</h1><p>{PARA}</p><section id="social-contract"><h2>Rousseau</h2><p>{PARA}</p></section><div class="feedback-loops"><p>{PARA}</p><ul><li>One</li></ul></div>
    <div class="entry-content no-sidebar"><p>{PARA}</p></div><table class="related-work"><tr><td>cell</td><td>{PARA}</td></tr></table></article><div class=ad>Buy now.</div>"""
    assert html_extract.main_text(page).split("\n\n") == ["Head", PARA, "Rousseau", PARA, PARA, "One", PARA, "cell", PARA]
    long = "<body><nav><a href=x>Home</a></nav><article><h1>Head</h1>" + "".join(f"<p>{PARA} {i}</p>" for i in range(5000)) + "</article><div class=ad>Buy.</div></body>"
    assert html_extract.main_text(long).split("\n\n") == ["Head", *(f"{PARA} {i}" for i in range(5000))]


def test_extract_keeps_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", f"<p>{PARA}</p>", "old", "e"), (1, "u", f"<p>{PARA}</p>", "old", "e"), (2, None, None, None, None)], "page_id long, url string, html string, text string, extra string").withColumn("__html", F.lit("h"))
    got = html_extract.extract(pages).collect()
    assert sorted((r.page_id, r.text, r.extra) for r in got if r.extra) == [(1, PARA, "e")] * 2
    assert [r.text for r in got if r.page_id == 2] == [""]
    assert html_extract.extract(pages.limit(0)).count() == 0


# --- 2, 8


@pytest.mark.parametrize("query, column", [(queries.op2_quality_gbdt, "quality"), (queries.op8_toxicity_pu, "toxic")])
def test_held_out_accuracy(spark, query, column):
    sf_dir = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in query(spark, sf_dir).collect()}
    assert len(rows) == docs_of(spark, sf_dir).count()
    known = [(rows[r.doc_id], r[column]) for r in runtime.read_table(spark, sf_dir, "labels").collect()]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows.values())
    assert all(0 <= r.score <= 1 for r in rows.values())
    out = [(r.score, r.predicted, y) for r, y in known if r.held_out]
    ones, zeros = [s for s, _, y in out if y], [s for s, _, y in out if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros])
    assert auc > 0.95
    assert np.mean([p == y for _, p, y in out]) > 0.93


@pytest.mark.parametrize("module, column", [(quality_gbdt, "quality"), (toxicity_pu, "toxic")])
def test_classifiers_on_odd_rows(spark, module, column):
    labels = spark.createDataFrame([(1, 1, 1), (3, 0, 0), (None, 1, 1), (5, None, None), (2, 0, 1)], "doc_id long, quality int, toxic int")
    odd = frame(spark, ODD)
    for given in (labels, labels.limit(0)):
        got = module.score(odd, module.train(odd, given, column)).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id == 5}) == 1
    assert module.score(odd.limit(0), module.train(odd.limit(0), labels, column)).count() == 0


def test_labels_of_held_out_rows_are_not_used(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    ids = {r.doc_id for r in quality_gbdt.sample_labels(labels, "quality", 1000).collect()}
    assert ids == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5}
    assert quality_gbdt.sample_labels(labels, "quality", 7).count() == 7


def test_forest_arrays_agree_with_a_walk():
    rng = np.random.default_rng(0)
    x = rng.random((600, 4))
    y = (x[:, 0] + (x[:, 1] > 0.5) > 1).astype(float)
    f = quality_gbdt.fit(x, y, trees=20)

    def walk(row):
        total = f.base
        for node in f.roots:
            while f.feature[node] >= 0:
                node = f.left[node] + (row[f.feature[node]] > f.threshold[node])
            total += f.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(f.score(x), [walk(r) for r in x])
    assert ((f.score(x) > 0.5) == y).mean() > 0.95


def naive_forest(x, y, trees, depth, rate=0.1, bins=48, l2=2.0, least=8):
    """Predictions of boosting that tries every cut of every column by comparing values."""
    base = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    raw = np.full(len(y), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)

        def grow(rows, level):
            score = lambda r: g[r].sum() ** 2 / (h[r].sum() + l2)  # noqa: B023, E731
            best = (1e-6, None, None)
            for j in range(x.shape[1]) if level < depth and len(rows) >= 2 * least else ():
                for c in cuts[j]:
                    lo, hi = rows[x[rows, j] <= c], rows[x[rows, j] > c]
                    if min(len(lo), len(hi)) >= least and (gain := score(lo) + score(hi) - score(rows)) > best[0] + 1e-12:
                        best = (gain, lo, hi)
            if best[1] is None:
                raw[rows] += -rate * g[rows].sum() / (h[rows].sum() + l2)  # noqa: B023
            else:
                grow(best[1], level + 1)
                grow(best[2], level + 1)

        grow(np.arange(len(y)), 0)
    return 1 / (1 + np.exp(-raw))


def test_forest_agrees_with_naive_boosting():
    rng = np.random.default_rng(5)
    x = np.round(rng.random((300, 3)) * [1, 20, 3], [2, 0, 1][0])
    x[:, 2] = rng.integers(0, 3, 300)
    y = ((x[:, 0] > 0.4) ^ (x[:, 1] > 11) | (rng.random(300) < 0.1)).astype(float)
    assert np.allclose(quality_gbdt.fit(x, y, trees=8, depth=3).score(x), naive_forest(x, y, 8, 3), atol=1e-9)


def test_pu_risk_and_gradient_by_finite_differences():
    rng = np.random.default_rng(3)
    p, u = ([np.flatnonzero(rng.random(6) < q) for _ in range(n)] for q, n in ((0.6, 7), (0.3, 11)))
    prior, loss = 0.3, lambda z, y: np.log1p(np.exp(-y * z))

    def naive(w):
        f = lambda r: sum(w[i] for i in r) + w[6]
        r_pp, r_pn, r_un = (np.mean([loss(f(r), y) for r in rows]) for rows, y in ((p, 1), (p, -1), (u, -1)))
        return prior * r_pp, r_un - prior * r_pn

    for _ in range(5):
        w = rng.standard_normal(7)
        first, rest, g_first, g_rest = toxicity_pu.risks(w, toxicity_pu.packed(p), toxicity_pu.packed(u), prior)
        assert np.allclose((first, rest), naive(w))
        for i in range(7):
            step = np.eye(7)[i] * 1e-6
            num = [(a - b) / 2e-6 for a, b in zip(naive(w + step), naive(w - step))]
            assert np.allclose((g_first[i], g_rest[i]), num, atol=1e-6)
    # overfitted negatives are pushed back: with prior * R_P(-) above R_U(-) the loss may not fall below its floor
    weights, bias = toxicity_pu.fit([np.array([0])] * 30, [np.array([0])] * 5 + [np.array([1])] * 95, 2, 0.5, steps=400)
    _, rest, _, _ = toxicity_pu.risks(np.append(weights, bias), toxicity_pu.packed([np.array([0])] * 30), toxicity_pu.packed([np.array([0])] * 5 + [np.array([1])] * 95), 0.5)
    assert rest > -0.1


@pytest.mark.parametrize("module, column", [(quality_gbdt, "quality"), (toxicity_pu, "toxic")])
def test_training_rows_are_bounded_by_id(spark, monkeypatch, module, column):
    rows = [(1, f"text number {i % 7} of one id, bad words here")[:2] for i in range(500)] + [(i, f"some other text {i} of good words") for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 40)], "doc_id long, quality int, toxic int")
    taken = []
    to_pandas = type(docs).toPandas
    monkeypatch.setattr(type(docs), "toPandas", lambda self: (taken.append(len(out := to_pandas(self))), out)[1])
    if module is quality_gbdt:
        module.train(docs, labels, column, max_rows=2)
        assert max(taken) <= 2
    else:
        monkeypatch.setattr(module, "CANDIDATES", 4)
        module.train(docs, labels, column, max_p=3, max_u=4)
        assert max(taken) <= 7


# --- 3


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """prints: list of (doc_id, fingerprint) -> per row the smallest id of its component."""
    fps = np.array(sorted({f for _, f in prints}), np.uint64)
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 2):
            a, b = root(i), root(i + 1 + int(j))
            up[max(a, b)] = min(a, b)
    at = {int(f): root(i) for i, f in enumerate(fps)}
    least = {}
    for d, f in prints:
        if d is not None:
            least[at[f]] = min(least.get(at[f], d), d)
    return [least.get(at[f]) for _, f in prints]


def test_near_duplicates_by_brute_force(spark, sf_dir):
    rows = queries.op3_simhash_vptree(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in docs_of(spark, sf_dir).collect()}
    prints = [(d, brute_fingerprint(t)) for d, t in texts.items()]
    want = {d: (f"{f:016x}", c) for (d, f), c in zip(prints, brute_components(prints))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == want


def test_vantage_point_shards_find_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 3000, np.uint64)
    near = [b ^ np.uint64(1 << int(i)) ^ np.uint64(1 << int(j)) for b in base[:700] for i, j in [rng.integers(0, 64, 2)]]
    dense = [np.uint64(1 << i | 1 << j) for i in range(40) for j in range(i)]
    x = np.unique(np.concatenate([base, np.array(near, np.uint64), np.array(dense, np.uint64)]))
    prints = [(i, int(f)) for i, f in enumerate(x)]
    tree = simhash_vptree.top_tree(x, 5, 2)
    found = set()
    for _, at in simhash_vptree.route(x, tree, 2):
        for i, j in simhash_vptree.links(x[at], 2):
            found |= {tuple(sorted(p)) for p in zip(at[i], at[j])}
    want = {(i, i + 1 + int(j)) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= 2)}
    assert found == want
    nodes = spark.createDataFrame([(int(f.astype(np.int64)), i) for i, f in enumerate(x)], "fp long, least long")
    shards = simhash_vptree.sharded(nodes, 2, len(x), 800)
    sizes = [r["count"] for r in shards.groupBy("shard").count().collect()]
    assert len(sizes) > 5 and max(sizes) <= len(dense) + 800
    edges = simhash_vptree.shard_links(nodes, 2, len(x), 800)
    roots = {r.fp: r.root for r in simhash_vptree.components(edges).collect()}
    group = {}
    for i, f in enumerate(x.astype(np.int64)):
        group.setdefault(roots.get(int(f), int(f)), []).append(i)
    assert sorted(min(g) for g in group.values()) == sorted(set(brute_components(prints)))


def test_shards_stay_small_at_many_times_their_size(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 20_000, np.uint64)
    near = base[:2000] ^ np.uint64(1 << 40) ^ np.uint64(1 << 3)
    x = np.unique(np.concatenate([base, near]))
    nodes = spark.createDataFrame([(int(f),) for f in x.view(np.int64)], "fp long").repartition(4)
    shards = simhash_vptree.sharded(nodes, 2, len(x), 2000, 1000).cache()
    assert shards.groupBy("shard").count().agg(F.max("count")).first()[0] <= 4000
    home = shards.groupBy("fp").agg(F.collect_set("shard").alias("s"))
    homes = {r.fp: set(r.s) for r in home.collect()}
    assert len(homes) == len(x) and all(homes[int(a)] & homes[int(b)] for a, b in zip(base[:2000].view(np.int64), near.view(np.int64)))


def test_flipped_bits_find_the_pairs_of_dense_fingerprints(monkeypatch):
    rng = np.random.default_rng(1)
    x = np.unique(np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), False)) for _ in range(3000)], np.uint64))
    want = {(int(x[i]), int(x[i + 1 + j])) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= 2)}
    monkeypatch.setattr(simhash_vptree, "PAIRWISE", 200)
    got = {tuple(sorted((int(a), int(b)))) for i, j in simhash_vptree.links(x, 2) for a, b in zip(x[i], x[j])}
    assert got == want


def test_long_chains_settle(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(300)] + [(1000 + i, 1000) for i in range(1, 200)], "a long, b long")
    got = {r.fp: r.root for r in simhash_vptree.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1000 + i: 1000 for i in range(1, 200)}


def test_duplicates_on_odd_rows(spark):
    odd = frame(spark, ODD)
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in simhash_vptree.near_duplicates(odd).collect()), key=str)
    prints = [(d, brute_fingerprint(t)) for d, t in ODD]
    want = [(d, int(np.uint64(f).astype(np.int64)), c) for (d, f), c in zip(prints, brute_components(prints))]
    assert got == sorted(want, key=str)
    kept = simhash_vptree.drop_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 5, 7, 8, None]
    assert simhash_vptree.near_duplicates(odd.limit(0)).count() == 0


def test_repeated_and_missing_ids_keep_the_first_row(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(5, "b " + long[::-1], 2, "x"), (5, "a other words stand here", 9, "x"), (None, long, 7, "b"), (None, long, 3, "b"), (None, "lonely text of its own kind", 1, "b"), (8, "a other words stand here", 0, "x"), (9, None, 1, "x"), (None, None, 1, "y")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, __fp long, __n string").repartition(3)
        kept = simhash_vptree.drop_duplicates(docs)
        assert kept.columns == docs.columns
        assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[1], rows[3], rows[4], rows[6]], key=str)


# --- 4


def brute_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    own = words(text)
    hit, found = set(), set()
    for item, t in items:
        w = words(t)
        for win in {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else ():
            for i in range(len(own) - len(win) + 1):
                if tuple(own[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found.add(item)
    names = ",".join(sorted(map(str, found)))
    found.discard(None)
    return len(own), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("most_words", [decontaminate.MOST_WORDS, 60])
def test_decontamination_by_brute_force(spark, most_words):
    items = [(1, "One two, three four five six seven eight nine ten eleven twelve"), (2, "short item"), (20, "SHORT-item!"), (3, ""), (4, None), (5, "é日 x"), (None, "item without any id"), (6, "wort " * 23)] + [(100 + k, " ".join(f"w{k}q{i}" for i in range(30))) for k in range(12)]
    texts = ["zero ONE two three-four five six seven eight nine ten eleven twelve thirteen", "a short. item short item b", None, "", "x é日 X é日", "one two three four five six seven eight nine", LONG, " ".join(f"w3q{i}" for i in range(5, 28)) + " short item " + " ".join(f"w7q{i}" for i in range(9))]
    texts += ["short item", "short item" * 3, "short_item"]
    docs = frame(spark, list(enumerate(texts)) + [(1, texts[1])])
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.hits(docs, bench, most_words=most_words, with_spans=True)
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.summary(found).collect()}
    assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}
    spans = {r.doc_id: [texts[r.doc_id][s:e] for s, e in zip(r.spans[::2], r.spans[1::2])] for r in found.collect()}
    assert spans[0] == [texts[0][5:-9]] and spans[1] == ["short. item short item"]
    kept = decontaminate.drop_contaminated(docs, bench, most_words=most_words)
    assert {r.doc_id for r in kept.collect()} == {i for i, t in enumerate(texts) if not brute_hits(t, items)[4]}
    assert decontaminate.hits(docs.limit(0), bench).count() == 0
    assert decontaminate.summary(decontaminate.hits(docs, bench.limit(0))).filter("contaminated").count() == 0


def test_decontamination_of_the_table(spark, sf_dir):
    items = [tuple(r) for r in runtime.read_table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    texts = {r.doc_id: r.text for r in docs_of(spark, sf_dir).collect()}
    got = {r.doc_id: tuple(r)[1:] for r in queries.op4_decontaminate(spark, sf_dir).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()}
    assert got == {d: brute_hits(t, items) for d, t in texts.items()} and any(x[-1] for x in got.values())


def test_decontamination_of_repetitive_texts_by_brute_force():
    rng = random.Random(8)
    text = lambda n, k: " ".join(rng.choice("abcd"[:k]) for _ in range(n))
    for _ in range(300):
        items = [(i, text(rng.randrange(1, 30), rng.randrange(1, 5))) for i in range(4)]
        s = decontaminate.Scanner(decontaminate.Items(iter(items), 10, rng.choice([20, 1000])))
        t = text(rng.randrange(80), rng.randrange(1, 5))
        n, ranges, ids = decontaminate.scan(t, s)
        assert (n, sum(b - a for a, b in ranges), len(ids)) == brute_hits(t, items)[:3]


def test_a_large_benchmark_is_one_automaton():
    import time

    rng = np.random.default_rng(6)
    words = np.array([f"w{i}" for i in range(50_000)])
    items = [(i, " ".join(words[rng.integers(0, 50_000, 700)])) for i in range(5000)]  # some 23 MB
    assert sum(len(t) for _, t in items) > 20_000_000
    s = decontaminate.Scanner(decontaminate.Items(iter(items), 10))
    assert len(s.automata) == 1
    began, own = time.time(), items[77][1].split()
    n, ranges, ids = decontaminate.scan(" ".join(["x", *own[100:120], "y", *own[3:12], *items[4000][1].split()[:10]]), s)
    assert (ranges, ids) == ([(1, 21), (31, 41)], [77, 4000]) and time.time() - began < 1


# --- 5

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_base(text):
    def fits(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            s = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1]))
            return 14 <= len(digits) <= 19 and s % 10 == 0
        return kind != "phone" or 10 <= len(digits) <= 15

    found = [(m.start(), n, m.end()) for n, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if fits(k, m[0])]
    return [(s, e, n) for s, n, e in sorted(found)]


def test_base_spans_by_brute_force(spark, sf_dir):
    rng = random.Random(5)
    made = ["".join(rng.choice(["a", "@", ".", "1", "25", "4", "0", "+", " ", "-", "(", ")", "x.y", "é", "\n", "%", "4111111111111111"]) for _ in range(rng.randrange(60))) for _ in range(4000)]
    for t in made + [r.text for r in docs_of(spark, sf_dir).collect()]:
        assert pii.base_spans(t or "") == brute_base(t)
    for odd in ("1" * 20_000, "a" * 50_000 + "@", "1.2.3" * 5000, "+1" * 5000, "4 " * 20_000, "a@b" * 5000):
        pii.base_spans(odd)


def test_digest_of_the_table(spark, sf_dir):
    for r in queries.op5_pii_disclosure(spark, sf_dir).join(docs_of(spark, sf_dir).select("doc_id", "text"), "doc_id").collect():
        base = brute_base(r.text)
        line = ",".join(f"{list(BASE)[n]}:{s}:{e}" for s, e, n in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(n == k for _, _, n in base) for k in range(4))
        assert set(line.split(",")) <= set(r.spans.split(",")) | {""}


def brute_terms(rows, share, bits):
    """Per row the (start, end) of disclosing terms, by counting everything."""
    n, own = len(rows), []
    df_t, df_c, co = {}, {}, {}
    for _, t in rows:
        t = t or ""
        spans = brute_base(t)
        values = {(k, t[s:e].lower() if k == 0 else re.sub("[^0-9.]", "", t[s:e])) for s, e, k in spans}
        words = [(m[0].lower(), *m.span()) for m in re.finditer(r"[^\W\d_]{3,}", t) if all(m.end() <= s or m.start() >= e for s, e, _ in spans)]
        own.append((values, words))
        for w in {m.lower() for m in re.findall(r"[^\W\d_]{3,}", t)}:
            df_t[w] = df_t.get(w, 0) + 1
        for c in values:
            df_c[c] = df_c.get(c, 0) + 1
            for w in {w for w, _, _ in words}:
                co[c, w] = co.get((c, w), 0) + 1

    def tells(c, w):
        pmi = np.log2(n * co[c, w] / (df_c[c] * df_t[w]))
        return pmi >= share * np.log2(n / df_c[c]) - 1e-9 and pmi >= bits - 1e-9

    return [[(s, e) for w, s, e in words if any(tells(c, w) for c in values)] for values, words in own]


def disclosing_rows():
    """Common words, values in one or several rows, names by them, a passage copied with its value, a public value."""
    rng = random.Random(1)
    common = [f"{a}{b}" for a in ("grun", "malt", "sert", "vol") for b in ("ak", "eb", "im", "op", "uz")]
    filler = lambda k: " ".join(rng.choices(common, k=k))
    rows = [(i, filler(12)) for i in range(400)]
    rows += [(1000 + i, f"{filler(3)} the Quentinson {filler(2)} q.son@mail.org {filler(9)}.\n{filler(4)} signed quentinson") for i in range(4)]
    rows += [(1100, f"Lone Marchbank of {filler(3)}\n\n{filler(40)} +1 (234) 567 8901"), (1101, f"Shared {filler(3)} a1@x.org b2@x.org"), (1102, f"Shared {filler(3)} a1@x.org"), (1103, f"quentinson {filler(5)}")]
    rows += [(2000 + i, "copied Passage here with z@copy.org always the same") for i in range(9)]
    rows += [(3000 + i, f"{filler(4)} desk@public.org") for i in range(150)] + [(None, rows[400][1]), (None, "nothing personal"), (1000, "other text under the id of the first"), (1001, None), (7, "")]
    return rows


@pytest.mark.parametrize("share, bits", [(0.9, 4.0), (0.6, 5.0), (1.0, 2.0)])
def test_disclosing_terms_by_counting(spark, share, bits):
    rows = disclosing_rows()
    docs = frame(spark, rows).withColumn("__key", F.lit(1)).repartition(3)
    want = sorted(((i, t, sorted(x)) for (i, t), x in zip(rows, brute_terms(rows, share, bits))), key=str)
    found = pii.analyse(docs, share=share, bits=bits).select("doc_id", "base", "terms").collect()
    assert sorted((str(i), sorted(x)) for i, _, x in want) == sorted((str(r.doc_id), sorted(zip(r.terms[::2], r.terms[1::2]))) for r in found)
    if share == 0.9:
        hidden = {t[s:e] for _, t, x in want for s, e in x}
        assert {"Quentinson", "quentinson", "Marchbank", "Lone"} <= hidden and not any(w[:4] in ("grun", "malt", "sert") for w in hidden)
    clean = pii.sanitise(docs, share=share, bits=bits)
    assert clean.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == sorted(((i, t if t is None else pii.cleaned(t, brute_base(t), x)) for i, t, x in want), key=str)
    assert all(r.n_chars == len(r.text) for r in clean.collect() if r.text is not None)


def test_disclosing_terms_of_the_table(spark):
    docs = docs_of(spark, "/root/testdata/sf0.1")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {i: x for (i, _), x in zip(rows, brute_terms(rows, pii.SHARE, pii.BITS)) if x}
    got = {r.doc_id: list(zip(r.terms[::2], r.terms[1::2])) for r in pii.analyse(docs).filter("size(terms) > 0").collect()}
    assert got == want and sum(map(len, got.values())) > 5000


@pytest.mark.parametrize("page, chars", [("<a" * 20_000, 40_000), ("".join(f"<div>text {i}, words." for i in range(5000)), 93_888), ("<noscript>x" * 20_000, 20_000), ("<div>" * 3000 + "</section></p>" * 20_000, 0), ("<p>a, b.</p>x > y <!-- " + "c" * 9, 12), ("<!-- a > b", 0)])
def test_pages_that_would_take_minutes_if_read_again_for_each_tag(page, chars):
    assert len(html_extract.main_text(page)) == chars


def test_words_outside_overlapping_spans_and_in_long_texts():
    overlapping = "Foo wrote 4111 1111 1111 1111.2.3.4 and +1 (234) 567 8901@x.org then Bar\nBaz x@y.org"
    long = " ".join(f"word user{i}@example.com called" for i in range(20_000))  # every span against every other would take minutes
    for t in (overlapping, long):
        spans = pii.base_spans(t)
        got = [(s, e) for _, s, e in pii.words_outside(t, spans)]
        covered = np.zeros(len(t), bool)
        for s, e, _ in spans:
            covered[s:e] = True
        assert got and not any(covered[s:e].any() for s, e in got)
    assert len(got) == 40_000


def test_pii_on_odd_rows(spark):
    odd = frame(spark, ODD)
    got = pii.digest(pii.analyse(odd)).collect()
    assert len(got) == len(ODD) and sum(r.n_ip for r in got) == 1
    assert {r.doc_id: r.spans for r in got}[8] == "ip:6:13"
    assert sorted((r.doc_id, r.text) for r in pii.sanitise(odd).collect() if r.doc_id in (2, 3)) == [(2, None), (3, "")]
    assert pii.digest(pii.analyse(odd.limit(0))).count() == 0


def test_bloom_filters_lose_nothing(spark):
    rng = np.random.default_rng(2)
    keys = rng.integers(-(2**63), 2**63 - 1, 5000)
    words = bloom.build(spark.createDataFrame([(int(k),) for k in keys], "k long"), "k")
    assert bloom.contains(words, keys).all() and bloom.contains(words, rng.integers(-(2**63), 2**63 - 1, 50_000)).mean() < 0.001
    assert not bloom.contains(bloom.build(spark.createDataFrame([], "k long"), "k"), keys).any()


# --- 6, 10


@pytest.mark.parametrize("name", list(tokens.END_IDS))
def test_cached_ids_are_the_tokenizers(name):
    e = tokens.Encoder(tokens.tokenizer_path(name), cache_entries=50)
    rng = random.Random(2)
    texts = ["", " ", "a  b\n\n c", "don't I'LL x.y", "<|endoftext|> a", "日本 é́ ß", "a  b", LONG[:999]] + ["".join(rng.choice("aB éß.,'\n\t 1_*日<|>Σs \x1c ") for _ in range(rng.randrange(30))) for _ in range(5000)]
    signs = "abcXé 's'T\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\n\n \n\t\r0<|endoftext|>"
    texts += ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(20_000)] + ["a<|endoftext|>b", "word*** don't-it's", "\n\n  \n Line\nNext\r\n  x"]
    assert [e.encode(t) for t in texts] == [array("I", x.ids).tobytes() for x in e.whole.encode_batch(texts, add_special_tokens=False)]


def brute_ids(name, end, text):
    from tokenizers import Tokenizer

    return np.array([*Tokenizer.from_file(tokens.tokenizer_path(name)).encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_block_files_round_trip():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, int), np.array([7]), rng.integers(0, 50_000, 100_003), np.full(513, 2**32 - 1), np.r_[np.full(5000, 3), 2**31, 4], rng.integers(0, 2, 512)):
        raw = token_pack.pack(ids.astype(np.uint32))
        assert (token_pack.unpack(raw) == ids).all()
        for _ in range(5):
            a, b = sorted(rng.integers(0, len(ids) + 1, 2))
            assert (token_pack.unpack(raw, a, b) == ids[a:b]).all()
    assert len(token_pack.pack(np.r_[rng.integers(0, 16, 500), np.full(12, 2**30)].astype(np.uint32))) < 512


def check_token_files(rows, given, name="byte_bpe_50k.json", end=2):
    at = 0
    assert len(rows) == len(given)
    for r, (d, t) in zip(sorted(rows, key=lambda r: r.start), given):
        ids = brute_ids(name, end, t)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_files(spark, sf_dir):
    given = sorted((r.doc_id, r.text) for r in docs_of(spark, sf_dir).collect())
    check_token_files(queries.op6_token_blocks(spark, sf_dir).collect(), given)


def test_token_files_of_odd_rows(spark, tmp_path):
    got = token_pack.round_trip(frame(spark, ODD), path=str(tmp_path / "t")).collect()
    check_token_files(got, sorted(ODD, key=lambda r: (r[0] is not None, r[0], r[1] or "")))
    assert token_pack.round_trip(frame(spark, ODD).limit(0)).count() == 0
    ids = token_pack.read(spark, str(tmp_path / "t"), with_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in ids)


def check_packing(rows, given, slack):
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    total = 0
    for d, t in given:
        ids = brute_ids("word_bpe_49k.json", 0, t)
        total += len(ids)
        cuts = [(k, k * 2048, min(2048, len(ids) - k * 2048), zlib.crc32(ids[k * 2048 : (k + 1) * 2048].tobytes())) for k in range(-(-len(ids) // 2048))]
        got = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in pieces[d])
        assert got == sorted(cuts * (len(got) // len(cuts)))
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-total // 2048) * (1 + slack) + 1


def test_packing(spark, sf_dir):
    check_packing(queries.op10_best_fit(spark, sf_dir).collect(), [(r.doc_id, r.text) for r in docs_of(spark, sf_dir).collect()], 0.03)


def test_packing_of_odd_rows_over_levels(spark):
    odd = frame(spark, ODD)
    check_packing(best_fit.pack_documents(odd).collect(), ODD, 0.3)
    assert best_fit.pack_documents(odd.limit(0)).count() == 0
    rng = random.Random(4)
    rows = [(i, "word " * rng.randrange(1, 1800)) for i in range(300)]
    check_packing(best_fit.pack_documents(frame(spark, rows).repartition(12), open_bins=4, fan_in=3).collect(), rows, 0.2)


def test_packer_takes_the_fullest_bin_that_fits():
    rng = random.Random(9)
    packer, free, names = best_fit.Packer(50, 1000), {}, 0
    for _ in range(3000):
        size = rng.randrange(1, 51)
        fits = [f for f in free.values() if f >= size]
        b, offset = packer.place(size)
        room = free.get(b, 50)
        assert offset == 50 - room and room == min(fits, default=50)
        free[b] = room - size
    small = best_fit.Packer(10, 2)
    assert [small.place(s)[0] for s in (6, 7, 8, 3)] == [0, 1, 2, 0]  # the fullest, 1, closed for bin 2


# --- 7


def test_url_filter_has_list_history(spark):
    entries = spark.createDataFrame(
        [("a", "host", "Bad.org.", "add", "2024-01-10"), ("a", "host", "bad.org", "remove", "2024-02-10"), ("a", "host", "bad.org", "add", "2024-05-01"), ("b", "prefix", "x.com/en/", "add", "2024-01-01"), ("b", "host", "same.org", "add", "2024-01-01"), ("b", "host", "same.org", "remove", "2024-01-01"), (None, "host", "x.com", "add", "2024-01-01")],
        "list_id string, kind string, pattern string, action string, dated string",
    )
    rows = [("http://u:p@www.BAD.org:80/x", "2024-01-09"), ("http://bad.org", "2024-01-10"), ("https://sub.bad.org?q", "2024-02-09"), ("http://bad.org/", "2024-02-10"), ("http://bad.org/", "2024-12-01"), ("http://notbad.org/", "2024-12-01"), ("http://x.com/en/a/b", "2024-03-01"), ("http://x.com/english", "2024-03-01"), ("http://x.com/en#t", "2024-03-01"), ("http://same.org", "2024-03-01"), (None, "2024-03-01"), ("http://bad.org", None), ("", "2024-03-01"), ("not a url", "2024-03-01"), ("http://bad.org/", "2024-12-01")]
    rows += [("http://y.org/En/Foo/1", "2024-03-01"), ("http://y.org/en/foo/1", "2024-03-01"), ("http://y.org/", "9999-12-31"), ("http://" + "a." * 20_000 + "bad.org/" + "x/" * 20_000, "2024-06-01")]
    entries = entries.union(spark.createDataFrame([("c", "prefix", "Y.org/En/Foo", "add", "2024-01-01")], entries.schema))
    caps = spark.createDataFrame([(u, t, "k", "p", "1", "2", "3", "4") for u, t in rows], "url string, fetched_at string, key string, pattern string, __url string, __ts string, __matches string, __flags string")
    got = url_filter.flag(caps, entries).collect()
    want = {1: ["a:bad.org"], 2: ["a:bad.org"], 4: ["a:bad.org"], 6: ["b:x.com/en"], 8: ["b:x.com/en"], 14: ["a:bad.org"], 15: ["c:y.org/En/Foo"], 18: ["a:bad.org"]}
    assert sorted(((r.url, r.fetched_at, r.matches) for r in got), key=str) == sorted(((u, t, want.get(i, [])) for i, (u, t) in enumerate(rows)), key=str)
    assert url_filter.drop_flagged(caps, entries).count() == len(rows) - len(want)
    assert url_filter.flag(caps.limit(0), entries).count() == 0
    assert url_filter.flag(caps, entries.limit(0)).filter("size(matches) > 0").count() == 0


def test_open_entries_take_a_bounded_number_of_rows(spark):
    entries = spark.createDataFrame([("a", "host", "bad.org", "add", "0001-01-01")], "list_id string, kind string, pattern string, action string, dated string")
    caps = spark.createDataFrame([(f"http://bad.org/{i}", f"{y}-01-01") for i in range(200) for y in (1970, 2024, 9999)], "url string, fetched_at string")
    assert url_filter.match(caps, entries).count() == 600
    assert len(url_filter.slots_of(caps.select(F.col("fetched_at").cast("timestamp").alias("t")), "t")) <= 3


def test_url_filter_against_sql(spark, sf_dir):
    import duckdb

    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    cols = ["page_id", "url", "fetched", "matches", "blocked"]
    want = duckdb.sql(queries.OP7_SQL).select(*cols).fetchall()
    got = [tuple(r) for r in queries.op7_url_filter(spark, sf_dir).select(*cols).collect()]
    assert sorted(got) == sorted(want) and any(r[4] for r in got)


# --- 9


def brute_nearest(rows, k=10):
    from itertools import groupby

    vecs = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            vecs.setdefault(i, np.array(v, float))
    out = {}
    for q in (i for i in vecs if i % 100 == 0):
        near = sorted((float(np.sqrt(((vecs[q] - x) ** 2).sum())), i) for i, x in vecs.items() if i != q)
        out[q] = near[:k]
    return out


def check_search(got, want, recall):
    by_query = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by_query.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert set(by_query) == {q for q, near in want.items() if near}
    hits = total = 0
    for q, near in by_query.items():
        assert len(near) == len(want[q]) and near == sorted(near)
        hits += len({i for _, i in near} & {i for _, i in want[q]})
        total += len(near)
    assert hits >= recall * total


def test_search_recall(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in runtime.read_table(spark, sf_dir, "embeddings").collect()]
    check_search(queries.op9_hilbert_ann(spark, sf_dir).collect(), brute_nearest(rows), 0.9)
    table = runtime.read_table(spark, sf_dir, "embeddings")
    narrow = hilbert_ann.search(table, lambda i: i % 100 == 0, blocks=(64, 200), asks_per_task=5)
    check_search(narrow.collect(), brute_nearest(rows), 0.9)


def test_window_follows_structure(spark):
    rng = np.random.default_rng(4)
    plain = rng.standard_normal((3000, 32))
    lines = rng.standard_normal((40, 32))[rng.integers(0, 40, 3000)] + rng.random((3000, 1)) * rng.standard_normal((1, 32))
    share = {}
    for name, x in (("plain", plain), ("lines", lines)):
        share[name] = hilbert_ann.fitted_window(hilbert_ann.Curves(x[:1500], hilbert_ann.CURVES, 8, 7, 11), x[:1500], 10, 0.96)
    assert share["lines"] < 0.06 < 0.1 < share["plain"] < 0.3
    rows = list(enumerate(lines.tolist()))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    check_search(hilbert_ann.search(table, lambda i: i % 100 == 0, blocks=(64, 256)).collect(), brute_nearest(rows), 0.9)
    few = lines[:5]
    assert hilbert_ann.fitted_window(hilbert_ann.Curves(few, 8, 8, 7, 11), few, 10, 0.96) == 1.0


def test_search_with_ties_and_odd_rows(spark):
    hot = [0.5, 0.5, 0.0]
    rows = [(i, hot) for i in range(300)] + [(500, [1.0, 2.0, 3.0]), (501, None), (502, [0.0, 0.0, 0.0]), (503, [1.0, None, 2.0]), (504, [float("nan"), 1.0, 1.0]), (505, [float("inf"), 1.0, 1.0]), (None, hot), (600, [1.0, 2.0, 3.1]), (600, [1.0, 2.0, 3.1]), (700, [-1.0, -2.0, -3.0])]
    table = spark.createDataFrame([(i, v, 3, 0.1) for i, v in rows], "vec_id long, embedding array<double>, rank int, score double")
    got = hilbert_ann.search(table, lambda i: i % 100 == 0).collect()
    check_search(got, brute_nearest(rows), 1.0)
    by = {(r.query_id, r.rank): r.vec_id for r in got}
    assert [by[100, k] for k in range(1, 11)] == list(range(10)) and [by[0, k] for k in range(1, 11)] == list(range(1, 11))
    assert hilbert_ann.search(table.limit(0), lambda i: i % 100 == 0).count() == 0
    few = table.filter("vec_id in (500, 600, 501)")
    assert [(r.query_id, r.vec_id) for r in hilbert_ann.search(few, lambda i: i % 100 == 0).orderBy("query_id").collect()] == [(500, 600), (600, 500)]


def test_hilbert_keys_step_by_one_cell():
    for d, order in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << order)] * d, indexing="ij"), -1).reshape(-1, d)
        keys = hilbert_ann.hilbert_keys(cells, order)
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<div id="header"><h1>My Site</h1></div><div id="content"><h2>Title</h2><p>{PARA}</p><p>Short.</p><p>{PARA}</p></div><div id="sidebar"><p>{PARA}</p></div><div id="comments"><p>{PARA}</p></div>', ["Title", PARA, "Short.", PARA]),
        (f"<table><tr><td class=menu><a href=1>x</a></td><td><h1>Head</h1><p>{PARA}</p></td><td class='right-rail'><p>{PARA}</p></td></tr></table>", ["Head", PARA]),
        (f'<article><h1>H</h1><p>{PARA}</p><aside><p>{PARA}</p></aside><h2>Sub</h2><p>Bye</p></article><section class="reader-comments"><article><p>{PARA * 9}</p></article></section>', ["H", PARA, "Sub", "Bye"]),
        (f'<nav><a href=1>Home of things</a></nav><article><h1>Hi</h1><p>Tiny.</p></article><div class="ad">{PARA}</div>', ["Hi", "Tiny."]),
        (f"<BODY><DIV CLASS='Ad'>{PARA}</DIV><ARTICLE><P>{PARA}<P><a href=x>{PARA}</a></ARTICLE></BODY>", [PARA, PARA]),
    ],
)
def test_page_layouts(page, want):
    assert html_extract.main_text(page).split("\n\n") == want
