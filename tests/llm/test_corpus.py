"""Decontamination, near duplicates, components, and the pipeline, against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from quarry.llm import decontam, graph, neardup

from . import data


def phrases_of(items, window):
    out = {}
    for item, text in items:
        w = decontam.words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            out.setdefault(tuple(w[i : i + window]), set()).update([] if item is None else [item])
    return out


def brute_leaks(text, phrases):
    w, hit, items = decontam.words(text), set(), set()
    for p, of in phrases.items():
        for i in range(len(w) - len(p) + 1):
            if tuple(w[i : i + len(p)]) == p:
                hit |= set(range(i, i + len(p)))
                items |= of
    return len(w), hit, sorted(items)


@pytest.mark.parametrize("shard,sample", [(1, 1), (20, 3), (1 << 21, 16)])
def test_fm_index_finds_all_phrases(monkeypatch, shard, sample):
    monkeypatch.setattr(decontam, "SHARD", shard)
    monkeypatch.setattr(decontam, "SAMPLE", sample)
    random.seed(shard)
    for _ in range(120):
        v = [f"w{i}" for i in range(random.choice((1, 2, 3, 6)))]
        items = [(str(i), " ".join(random.choices(v, k=random.randint(0, 8)))) for i in range(random.randint(0, 6))]
        texts = [" ".join(random.choices([*v, "zz"], k=random.randint(0, 40))) for _ in range(random.randint(1, 8))] + [None, ""]
        n, spans, found = decontam.search_texts(texts, decontam.Phrases(items, 4))
        for t, a, b, c in zip(texts, n, spans, found):
            assert (a, {k for s in b for k in range(s["start"], s["end"])}, c) == brute_leaks(t, phrases_of(items, 4))


def test_suffix_array_and_ranks():
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(0, 4, 300), 0)
    order = decontam.suffix_array(text)
    place = iter(range(1000))
    unique = [next(place) - 1000 if c == 0 else c for c in text.tolist()]
    assert order.tolist() == sorted(range(301), key=lambda i: unique[i:])
    tree = decontam.WaveletTree(text, 5)
    for c in range(5):
        assert tree.rank(np.full(302, c), np.arange(302)).tolist() == [int((text[:i] == c).sum()) for i in range(302)]


@pytest.mark.parametrize("block", [8 << 20, 20])
def test_leaks(spark, block):
    out = decontam.leaks(data.documents(spark), data.benchmark(spark), block_bytes=block).collect()
    phrases = phrases_of([(str(r.item_id) if r.item_id is not None else None, r.text) for r in data.benchmark(spark).collect()], 10)
    want = Counter((r[0], *[tuple(x) if isinstance(x, (set, list)) else x for x in brute_leaks(r[1], phrases)]) for r in data.ROWS)
    assert Counter((r.doc_id, r.n_words, tuple({k for s in r.spans for k in range(s.start, s.end)}), tuple(r["items"])) for r in out) == want
    assert decontam.leaks(data.documents(spark, []), data.benchmark(spark), block_bytes=block).count() == 0
    assert decontam.leaks(data.documents(spark), data.benchmark(spark).limit(0)).where("size(spans) > 0").count() == 0


def brute_components(rows):
    sets = [(i, frozenset(neardup.shingle_set(t).tolist())) for i, t, *_ in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets}


def near_rows(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [f"p{i}" for i in range(30)]
    base = rng.choices(vocabulary, k=120)
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.4:  # copies of one text with up to a quarter of it changed
            words = list(base)
            for _ in range(rng.randint(0, 7)):
                words[rng.randrange(120)] = rng.choice(vocabulary)
        elif kind < 0.7:  # a shared passage among other words
            words = rng.choices(vocabulary, k=rng.randint(5, 60))
            words[3:3] = passage
        else:
            words = rng.choices(vocabulary, k=rng.randint(0, 8))
        rows.append((i, " ".join(words), None, None))
        if rng.random() < 0.1:
            rows.append((1000 + i, " ".join(words).upper(), None, None))
    return rows


@pytest.mark.parametrize("node,depth,group", [(4096, 4, 8 << 20), (6, 2, 500), (16, 0, 8 << 20)])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, node, depth, group):
    """Small nodes, branching, and blocks of nodes that stay large."""
    monkeypatch.setattr(neardup, "NODE", node)
    monkeypatch.setattr(neardup, "DEPTH", depth)
    monkeypatch.setattr(neardup, "GROUP", group)
    rows = near_rows(node)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(data.documents(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_odd_rows(spark):
    out = neardup.near_duplicates(data.documents(spark)).collect()
    assert len(out) == len(data.ROWS)
    assert all(r.component_id == 1 and r.kept == (r.doc_id == 1) for r in out if r.doc_id in (1, 2, 3))
    nameless = next(r for r in out if r.doc_id is None)
    assert nameless.component_id == 1 and not nameless.kept
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out if r.doc_id in (4, 5, 12, 13)} == {(4, 0, 4, True), (5, 0, 5, True), (12, 1, 12, True), (13, 1, 12, False)}
    assert neardup.near_duplicates(data.documents(spark, [])).count() == 0
    kept = neardup.one_of_each(data.documents(spark))
    assert kept.columns == data.documents(spark).columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6, 7, 8, 9, 10, 11, 12]
    again = neardup.one_of_each(data.documents(spark, [(2, data.NEAR, "en", "a")] * 3 + [(3, "", None, None)]))
    assert sorted(r.doc_id for r in again.collect()) == [2, 3]


def test_similar_tree_spans_components():
    rng = np.random.default_rng(3)
    for m in (2, 3, 30):
        base = rng.integers(0, 1 << 60, 60, dtype=np.uint64)
        sets = [np.unique(np.where(rng.random(60) < rng.choice([0, 0.1, 0.3]), rng.integers(0, 1 << 60, 60, dtype=np.uint64), base)) for _ in range(m)]
        pairs = {(i, j) for i in range(m) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
        tree = neardup.similar_tree(sets)
        assert all((max(p), min(p)) in pairs for p in tree)

        def label(links):
            of = list(range(m))
            for _ in range(m):
                for a, b in links:
                    of[a] = of[b] = min(of[a], of[b])
            return of

        assert label(tree) == label(pairs)


def test_components(spark):
    random.seed(6)
    links = [(random.randrange(60), random.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)] + [(300, 300 + i) for i in range(30)]
    of = {}
    for a, b in links:
        of.setdefault(a, a), of.setdefault(b, b)
    for _ in range(100):
        for a, b in links:
            of[a] = of[b] = min(of[a], of[b])
    want = {v: c for v, c in of.items() if any(v in p for p in links if p[0] != p[1])}
    got = graph.components(spark.createDataFrame(links, "a long, b long"))
    assert {r.v: r.component for r in got.collect()} == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rounds_of_a_chain_grow_with_the_logarithm(spark, monkeypatch):
    names, written = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: names.append(name) or written(df, name))
    links = [(i, i + 1) for i in range(300)] + [(1000 + i * 7 % 101, 1000 + (i + 1) * 7 % 101) for i in range(100)]
    got = graph.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.v: r.component for r in got} == {v: 0 if v < 1000 else 1000 for v in [*range(301), *range(1000, 1101)]}
    assert len(names) < 40


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from quarry.llm import pii
    from quarry.llm.q_text import PII_KEY, tokenizer_file
    from quarry.llm.tokenize_bpe import PrefixTableBPE

    folder = str(tmp_path)
    data.put(data.documents(spark), folder, "documents")
    data.put(data.benchmark(spark), folder, "benchmark")
    docs = data.documents(spark)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        seen[name] = out.collect()
        if name != "tokens":
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
            docs = out
    ids = lambda name: sorted((r.doc_id is None, r.doc_id) for r in seen[name])
    named = lambda *xs: [(False, x) for x in xs]
    assert ids("language_id") == named(1, 2, 2, 3, 7, 8, 9, 10, 11, 12, 13) + [(True, None)]
    assert ids("near_dedup") == named(1, 7, 8, 9, 10, 11, 12)
    assert ids("decontamination") == named(7, 9, 10, 11, 12)  # 1 holds "lazy dog", 8 the long item
    p, bpe = pii.Pseudonyms(PII_KEY), PrefixTableBPE(tokenizer_file())
    texts = {r[0]: pii.pseudonymise(r[1], p)[0] for r in data.ROWS}
    assert all(r.text == texts[r.doc_id] and r.n_chars == len(r.text) for r in seen["pii"])
    assert all(r.ids == bpe.encode(texts[r.doc_id]) and r.round_trip for r in seen["tokens"])
    run = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, tuple(r.ids)) for r in run) == sorted((r.doc_id, tuple(r.ids)) for r in seen["tokens"])
    data.put(data.documents(spark, []), folder, "documents")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_copies_beyond_the_broadcast_bound(spark, monkeypatch):
    """Labels joined with frequent digests apart: the same rows as by a broadcast."""
    from quarry.llm import url_filter, warc
    from quarry.llm.q_pages import URL_RULES

    docs = data.documents(spark, [*data.ROWS, *[(100 + i, data.BASE if i % 2 else None, "en", "a") for i in range(60)], *[(300 + i, f"{i} other words {i} that differ {i} in every row", "en", "b") for i in range(30)]])
    whole = Counter(neardup.near_duplicates(docs).collect())
    kept = Counter(neardup.one_of_each(docs).select("doc_id", "text").collect())
    pages = data.pages(spark)
    judged = Counter(url_filter.judge(pages, URL_RULES).collect())
    revisits = Counter(r.page_id if r.refers_to is None else (r.page_id, r.refers_to) for r in warc.with_revisits(pages).collect())
    for module in (neardup, url_filter, warc):
        monkeypatch.setattr(module, "BROADCAST_BYTES", 0)
    assert Counter(neardup.near_duplicates(docs).collect()) == whole
    assert Counter(neardup.one_of_each(docs).select("doc_id", "text").collect()) == kept
    assert Counter(url_filter.judge(pages, URL_RULES).collect()) == judged
    assert Counter(r.page_id if r.refers_to is None else (r.page_id, r.refers_to) for r in warc.with_revisits(pages).collect()) == revisits
