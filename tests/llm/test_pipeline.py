"""The pipeline against a brute-force version, stage by stage, each on its own input."""

import random
import re

import corpus_pipeline
from pathlens.llm import near_copies, pii, quality_gbdt, queries, runtime

from .test_operators import brute_base, brute_hits, brute_terms, check_packing


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def brute_copies(texts):
    """Of each group of texts linked by a Jaccard similarity of 0.8 over their 5-word shingles, the smallest id."""
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for d, t in texts.items()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in words.items()}
    ids, up = sorted(sets), {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for k, d in enumerate(ids):
        for e in ids[:k]:
            small, large = sorted((len(sets[d]), len(sets[e])))
            if 5 * small >= 4 * large and 5 * len(sets[d] & sets[e]) >= 4 * len(sets[d] | sets[e]):
                a, b = root(d), root(e)
                up[max(a, b)] = min(a, b)
    return {d for d in ids if up[d] == d}


def test_stages_by_brute_force(spark, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"] and corpus_pipeline.ORACLE_SQL is None
    docs = runtime.read_table(spark, sf_dir, "documents")
    columns, before = docs.columns, rows_of(docs)
    bench = [tuple(r) for r in runtime.read_table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = runtime.stage(stage(spark, docs, sf_dir), f"test-{name}")
        if name == "packing":
            check_packing(out.collect(), [(d, r.text) for d, r in before.items()], 0.03)
            break
        after = rows_of(out)
        assert out.columns == columns and out.count() == len(after)
        if name == "quality":
            forest = quality_gbdt.train(docs, runtime.read_table(spark, sf_dir, "labels"))
            want = {d for d, r in before.items() if forest.score(__import__("numpy").array([quality_gbdt.statistics(r.text)], "f4").astype(float))[0] >= queries.QUALITY_CUT}
        elif name == "near_duplicates":
            want = brute_copies({d: r.text for d, r in before.items()})
        elif name == "decontamination":
            want = {d for d, r in before.items() if not brute_hits(r.text, bench)[4]}
        else:
            want = set(before)
            texts = [(d, r.text) for d, r in before.items()]
            for (d, t), terms in zip(texts, brute_terms(texts, pii.SHARE, pii.BITS)):
                assert after[d].text == pii.cleaned(t, brute_base(t), terms)
                assert after[d].n_chars == len(after[d].text)
        assert set(after) == want and (name == "personal_data" or all(after[d] == before[d] for d in want))
        docs, before = out, after


def test_run_is_the_stages_in_turn(spark, sf_dir):
    got = queries.pipeline(spark, sf_dir)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} == set(got.columns)
    docs = runtime.read_table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = runtime.stage(stage(spark, docs, sf_dir), f"again-{name}")
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(keys).collect())) == sorted(map(tuple, docs.select(keys).collect()))


def test_stages_take_odd_rows(spark, tmp_path, sf_dir):
    rows = [(1, "plain words here", "en", "s", 16), (1, "plain words here", "en", "s", 16), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "mail a@b.org now", "en", "s", 16), (4, "word " * 20_000, "en", "s", 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[1:]:
            given = runtime.stage(stage(spark, given, sf_dir), f"odd-{name}")
            assert name == "packing" or given.columns == docs.columns
    quality = corpus_pipeline.STAGES[0][1](spark, docs, sf_dir)
    assert quality.columns == docs.columns and quality.count() <= len(rows)


def test_near_copies_against_brute_force_jaccard(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(3, 300))) for _ in range(40)]
    for t in texts[:30]:
        for _ in range(5):
            words = t.split()
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words + rng.choices(vocabulary, k=rng.randrange(3))))
    foot = " ".join(rng.choices(vocabulary, k=50))  # text that many share
    family = texts[3].split() * 2  # copies with so many changes that few are similar to the original
    for k in range(60):
        words = list(family)
        for _ in range(1 + k % 9):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [f"{' '.join(rng.choices(vocabulary, k=rng.randrange(1, 40)))} {foot}" for _ in range(60)] + ["", "  ", "Same few", "same  FEW"]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert 100 < len(set(group)) < len(texts) - 100
    for crowd, most in ((near_copies.CROWD, near_copies.MOST_CROWDED), (1000, 1), (1, 20)):  # the order of shingles changes no result
        monkeypatch.setattr(near_copies, "CROWD", crowd)
        monkeypatch.setattr(near_copies, "BLOCK", 4 * most)
        monkeypatch.setattr(near_copies, "MOST_CROWDED", most)
        assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == sorted(set(group))


def test_near_copies_go_by_row_and_not_by_id(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(3, long, 1), (7, long + " end", 1), (7, "a text of its own that nobody else has", 1), (7, "another one with other words in it", 1), (7, long, 2), (None, long, 3), (None, "two rows without any id here", 5), (None, "two rows without any id here", 4), (None, "lone row without an id", 1)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, __node long").repartition(3)
        kept = corpus_pipeline.near_duplicates(spark, docs, "")
        assert kept.columns == docs.columns
        assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[2], rows[3], rows[7], rows[8]], key=str)
