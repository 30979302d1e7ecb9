"""Operators that look at texts together, and the pipeline."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from daygrid.llm import jaccard, substrings


def brute_dedup(rows, window=20):
    seen, out = set(), {}
    for i, v in sorted({(i, v or "") for i, v, *_ in rows}, key=lambda r: r[0]):
        words = v.encode().split()
        gone = np.zeros(len(words), bool)
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            if key in seen:
                gone[k : k + window] = True
            seen.add(key)
        out[i] = (len(words), int(gone.sum()), hashlib.sha256(b" ".join(w for w, g in zip(words, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize(("window", "hot"), [(20, 20_000), (20, 1), (8, 20_000)])
def test_substrings_against_brute_force(table, corpus, window, hot):
    rows = [r for r in corpus if r[0] not in (None, 18)]
    got = substrings.dedup(table(rows), window=window, hot=hot).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == brute_dedup(rows, window)


def test_substrings_edge_cases(table, corpus):
    assert substrings.dedup(table([])).count() == 0
    got = substrings.dedup(table(corpus)).collect()
    assert len(got) == len(corpus) and sum(r["doc_id"] is None for r in got) == 1
    df = table(corpus)
    kept = substrings.remove_repeats(df)
    assert kept.columns == df.columns
    out = defaultdict(list)
    for r in kept.collect():
        out[r["doc_id"]].append(r["text"])
    assert 7 not in out and out[6] == [dict(corpus)[6]] and out[1] == [None] and kept.where("n_chars <> length(text)").count() == 0


def test_fm_index_search():
    rng = np.random.default_rng(2)
    text = np.r_[rng.integers(1, 5, 300), 0]
    index = substrings.FmIndex(text, 6)
    ends = np.arange(6, 301)
    left, right = index.search(text, ends, 6)
    for e, a, b in zip(ends, left, right, strict=True):
        same = [k for k in range(295) if (text[k : k + 6] == text[e - 6 : e]).all()]
        if b - a > 1:
            assert sorted(index.suffixes[a:b].tolist()) == same
        else:
            assert len(same) == 1


def brute_components(rows, words, percent):
    sets = {}
    for i, v in rows:
        w = (v or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize(("words", "percent", "block", "short"), [(4, 85, 1024, 8), (4, 85, 4, 2), (5, 80, 1024, 2), (2, 60, 8, 8)])
def test_jaccard_against_brute_force(table, corpus, monkeypatch, words, percent, block, short):
    monkeypatch.setattr(jaccard, "SHORT", short)
    rows = [(i, v) for i, v, *_ in corpus if i not in (None, 18)]
    got = jaccard.join_components(table(rows), words, percent, block=block).collect()
    assert len(got) == len(rows) and {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, words, percent)


def test_jaccard_edge_cases(table, corpus):
    assert jaccard.join_components(table([])).count() == 0
    got = jaccard.join_components(table(corpus)).collect()
    assert len(got) == len(corpus) and {r["component_id"] for r in got if r["doc_id"] in (6, 7, 8, 19)} == {6}
    assert jaccard.join_components(table([(1, None), (2, None), (3, "")])).where("doc_id <> component_id").count() == 0
    df = table(corpus)
    kept = jaccard.one_of_each(df, 4, 85)
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == df.columns and {1, 2, 3, 6} <= ids and {7, 8, 19}.isdisjoint(ids)


def test_least_shared_is_the_similarity():
    for a in range(1, 60):
        for b in range(1, 60):
            least = jaccard.least_shared(a, b, 85)
            assert all((100 * i >= 85 * (a + b - i)) == (i >= least) for i in range(0, min(a, b) + 1))


def test_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(0)
    a, b = (np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (500, 400))
    b = np.unique(np.r_[a[:300], b])
    x, y = (np.frombuffer(jaccard.sketches(s, np.array([0, len(s)]))[0], np.uint8) for s in (a, b))
    assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_pipeline_stages_keep_columns(spark, table, corpus, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(4)
    words = "the of and house tree river stone walks under blue green seven".split()
    rows = [(100 + i, " ".join(f"{w}{rng.integers(0, 40)}" for w in rng.choice(words, 90)), "en") for i in range(20)]
    rows += [(200, rows[0][1], "en"), (201, None, "en"), (202, "a b " * 60, "en"), (203, " ".join(rows[1][1].split()[:50]) + " " + " ".join(f"new{k} of" for k in range(20)), "en")]
    df = table(rows).select("doc_id", "text", "lang", "source", "n_chars")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = df, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()} if "text" in docs.columns else {r["doc_id"] for r in docs.collect()}
        assert name == "best_fit_packing" or docs.columns == df.columns
    assert 201 not in seen["language_id"] and 202 not in seen["quality_rules"] and 200 not in seen["ngram_jaccard_join"]
    assert set(range(100, 120)) <= set(seen["ngram_jaccard_join"]) and len(seen["substring_dedup"][203].split()) == 40
    assert seen["best_fit_packing"] == set(seen["substring_dedup"])
    assert {tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "length").collect()} == {tuple(r) for r in docs.select("doc_id", "piece", "length").collect()}


def test_pipeline_keeps_code_switched_documents(spark, table):
    import corpus_pipeline

    rng = np.random.default_rng(6)
    words = {lang: v.split() for lang, v in {"en": "the house and with this that were going through should", "de": "der hund und mit diese nicht werden gegangen durch sollte", "fr": "le chien avec cette pas seront parti dans devrait nous"}.items()}
    text = lambda lang, n: " ".join(rng.choice(words[lang], n))
    rows = [(i, text(lang, 40), lang) for i, lang in enumerate(["en", "de", "fr"] * 40)]
    mixed = [(500, " ".join(text(*x) for x in (("en", 40), ("de", 35), ("fr", 25))), None), (501, " ".join(text(*x) for x in (("en", 48), ("de", 48), ("fr", 4))), None), (502, "12 34 !", None)]
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, table(rows + mixed), "").collect()}
    assert {500, 501, *range(120)} <= kept and 502 not in kept
    unlabelled = table([(i, v, None) for i, v, _ in rows + mixed] + [(600, None, None)])
    assert {r["doc_id"] for r in corpus_pipeline.language_id(spark, unlabelled, "").collect()} == {500, 501, *range(120)}
