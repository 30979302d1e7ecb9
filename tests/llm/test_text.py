"""Operators that look at one text at a time."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from daygrid.llm import bpe, fingerprints, language, licences, lm, packing, quality, sharding


def by_row(df, *key):
    return Counter(tuple(r) for r in df.select(*key).collect())


def test_bpe_is_the_librarys(table, corpus):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = Counter()
    for i, v, *_ in corpus:
        ids = t.encode(v or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())] += 1
    assert by_row(bpe.encode_decode(table(corpus), path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_bpe_real_ids_and_empty_table(table):
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = bpe.encode_decode(table([(1, "hello hello world's")]), path, with_ids=True).first()
    assert out["ids"] == Tokenizer.from_file(path).encode("hello hello world's").ids and out["decoded"] == "hello hello world's"
    assert bpe.encode_decode(table([]), path).count() == 0


def packed(rows, capacity=4096):
    fill = defaultdict(list)
    for r in rows:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in fill.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(fill)


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else capacity) - n)
    return len(gaps)


def test_packing_places_every_piece(table, corpus):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = Counter()
    for i, v, *_ in corpus:
        ids = np.array([*t.encode(v or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 256):
            want[(i, k // 256, k, len(ids[k : k + 256]), zlib.crc32(ids[k : k + 256].tobytes()))] += 1
    for sweep_rows in (3, 20, 1000):
        rows = packing.best_fit(table(corpus), path, capacity=256, sweep_rows=sweep_rows).collect()
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
        assert packed(rows, 256) <= best_fit_decreasing([r["length"] for r in rows], 256) + (1 if sweep_rows == 1000 else 6)
    assert packing.best_fit(table([]), path).count() == 0


@pytest.mark.parametrize("lengths", [[1] * 700, [50] * 41, [99, 2, 51, 50, 49, 100, 1], [60] * 10 + [40] * 10])
def test_packing_is_tight(spark, lengths):
    pieces = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(pieces, capacity=100, sweep_rows=300).collect()
    best = {700: 7, 41: 21, 7: 4, 20: 10}[len(lengths)]
    assert len(rows) == len(lengths) and packed(rows, 100) == best


def brute_repeats(words):
    n = len(words)
    longest = [0] * n
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and words[i + k] == words[j + k]:
                k += 1
            longest[i], longest[j] = max(longest[i], k), max(longest[j], k)
    cover = lambda least: len({k for i in range(n) if longest[i] >= least for k in range(i, i + longest[i])})
    return cover(3), cover(5), max(longest, default=0)


def test_quality_against_brute_force(table, corpus):
    want = Counter()
    for i, v, *_ in corpus:
        v = v or ""
        words = v.encode().split()
        if len(words) > 500:
            continue
        twice, cover, longest = brute_repeats(words)
        lines = [x for x in v.split("\n") if x.encode().split()]
        failed = len(words) < 50 or 100 * twice > 50 * len(words)
        kept = not failed and cover <= 0.4 * len(words) and (longest < 5 or longest <= 0.3 * len(words))
        want[(i, len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in v), len(lines) - len(set(lines)), twice, failed, kept)] += 1
    got = by_row(quality.quality(table(corpus)), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert {k: n for k, n in got.items() if k[1] <= 500} == want
    kept = Counter(k[0] for k, n in got.items() for _ in range(n) if k[-1])
    stay = quality.keep_good(table(corpus))
    assert Counter(r["doc_id"] for r in stay.collect()) == kept and stay.columns == table(corpus).columns
    assert quality.quality(table([])).count() == 0


def test_fingerprints(table, corpus):
    rows = [r for r in corpus if r[0] != 18]
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), tuple(-ord(c) for c in (r[1] or ""))))
    want = Counter()
    for k, (i, v, *_) in enumerate(order):
        v, after = v or "", order[(k + 1) % len(order)][1] or ""
        want[(i, len(v), hashlib.sha256((v[: len(v) - len(v) // 3] + after[: len(v) // 3]).encode()).hexdigest())] += 1
    got = fingerprints.fingerprints(table(rows), span=4)
    assert by_row(got, "doc_id", "n_chars", "edited_sha256") == want
    out = {r["doc_id"]: r for r in got.collect()}
    assert out[6]["fingerprint"] == out[7]["fingerprint"] == out[19]["fingerprint"] and out[1]["fingerprint"] == ""
    assert out[7]["near_next"] == 1.0 and all(0 <= r["near_edited"] <= 1 for r in out.values())
    assert out[14]["near_edited"] > 0.5 and fingerprints.fingerprints(table([])).count() == 0


def test_fingerprints_of_short_texts_and_long_words(table):
    r = np.random.default_rng(8)
    words = ["".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(2000)]
    line = lambda n: " ".join(r.choice(words, n))
    signs = lambda n: "".join(chr(0x4E00 + k) for k in r.integers(0, 5000, n))
    rows = [(n * 100 + k, line(n)) for n in (1, 3, 5, *range(8, 15), 40, 60) for k in range(10)]
    rows += [(9000 + k, signs(n)) for k, n in enumerate((12, 30, 90, 400, 3000))] + [(9900, " \n"), (9901, None)]
    out = {r["doc_id"]: r for r in fingerprints.fingerprints(table(rows)).collect()}
    for i, v in rows:
        assert bool(out[i]["fingerprint"]) == bool((v or "").split())
        if len(v or "") > 11 and (v or "").split():
            assert out[i]["near_next"] < 0.3 and 0 < out[i]["near_edited"] < 0.9
    # a text of many words, edited by a short one, is compared with what is left of it by words
    mixed = fingerprints.fingerprints(table([(2, line(33)), (1, "x")])).where("doc_id = 2").first()
    assert mixed["n_chars"] >= 200 and 0.5 < mixed["near_edited"] < 1


def test_sharding_table_by_turns():
    def brute(shards, size):
        orders = []
        for s in shards:
            start, step = sharding._hash(f"start {s}") % size, sharding._hash(f"step {s}") % (size - 1) + 1
            orders.append([(start + k * step) % size for k in range(size)])
        free, owner = set(range(size)), [None] * size
        while free:
            for k, order in enumerate(orders):
                slot = next((x for x in order if x in free), None)
                if slot is None:
                    break
                free.discard(slot)
                owner[slot] = k
        return owner

    names = [f"n{i}" for i in range(7)]
    assert sharding.lookup_table(names, 211) == brute(names, 211)
    full, less = sharding.lookup_table(names, 10_007), sharding.lookup_table(names[:-1], 10_007)
    assert max(Counter(full).values()) - min(Counter(full).values()) <= 1
    assert sum(a != b for a, b in zip(full, less, strict=True) if a != 6) < 0.12 * 10_007
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 12)


def test_sharding_places_every_row(table, corpus):
    out = sharding.place(table(corpus), ["doc_id"], ["a", "b", "c"], 101).collect()
    assert len(out) == len(corpus) and {r["shard"] for r in out} <= {0, 1, 2}
    assert len({r["slot"] for r in out if r["doc_id"] == 19}) == 1
    assert sharding.place(table([]), ["doc_id"], ["a"], 101).count() == 0
    with pytest.raises(ValueError):
        sharding.place(table(corpus), ["doc_id"], ["a"], 101, slot="text")


def test_lattice_sums_all_segmentations():
    path = public_tokenizers.path("piece_bpe_32k.model")
    rng = np.random.default_rng(0)
    lattice = lm.Lattice(path, np.log(rng.dirichlet(np.ones(32000))))

    def brute(text):
        if not text:
            return 1.0
        total = sum(np.exp(lattice.log_p[lattice.pieces[text[:k]]]) * brute(text[k:]) for k in range(1, len(text) + 1) if text[:k] in lattice.pieces)
        return total if text[0] in lattice.pieces else np.exp(lattice.spelled(text[0])) * brute(text[1:])

    words = ["hello", "a", "états", "漢字x", "thninwh", "x" * 30]
    assert np.allclose(lattice.log10([w.encode() for w in words[:-1]]), [np.log10(brute("▁" + w)) for w in words[:-1]])
    assert np.allclose(lattice.one("hello"), lattice.many(["hello"])[0]) and np.isfinite(lattice.log10([words[-1].encode()])[0])


def test_expected_pieces_raise_the_likelihood():
    rng = np.random.default_rng(1)
    lattice = lm.Lattice(public_tokenizers.path("piece_bpe_32k.model"), np.log(rng.dirichlet(np.ones(32000))))
    words, weight = ["hello", "world", "stone", "漢字xyz"[:5], "thing"], np.array([3.0, 1.0, 2.0, 1.0, 5.0])
    before = lattice.many(words) @ weight
    total = np.zeros(32000)
    lattice.expect(words, weight, total)
    assert np.isclose(total[[lattice.pieces[p] for p in lattice.pieces if p.startswith("▁")]].sum(), weight.sum())
    assert total[lattice.bytes[ord("h")]] == 0
    lattice.log_p = np.log(np.maximum(total, 1e-12) / np.maximum(total, 1e-12).sum())
    assert lattice.many(words) @ weight > before


def test_lm_counts(table, corpus):
    counts = Counter()
    for i, v, *_ in corpus:
        if zlib.crc32(str(i).encode() if i is not None else b"") % 10:
            counts.update([*lm.tokens(v or ""), lm.END])
    n, types = sum(counts.values()), len(counts)
    out = lm.log_likelihood(table(corpus), public_tokenizers.path("piece_bpe_32k.model"), common=20)
    got = sorted((r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out.collect())
    want = []
    for i, v, *_ in corpus:
        t = [*lm.tokens(v or ""), lm.END]
        base = sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (types + 1))) for w in t)
        want.append((i or 0, zlib.crc32(str(i).encode() if i is not None else b"") % 10 == 0, len(t), sum(counts[w] > 0 for w in t), n, round(base, 6)))
    assert [g[:5] for g in got] == [w[:5] for w in sorted(want)]
    assert np.allclose([g[5] for g in got], [w[5] for w in sorted(want)])
    assert all(r["score"] < 0 for r in out.collect())
    assert lm.log_likelihood(table([]), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


ENGLISH = "the quick brown fox jumps over the lazy dog and then the other one went with him to their house in this town".split()
GERMAN = "der schnelle braune fuchs springt über den faulen hund und dann ging der andere mit ihm zu ihrem haus in dieser stadt".split()


def test_language_field(table):
    rng = np.random.default_rng(3)
    text = lambda words, n: " ".join(rng.choice(words, n))
    rows = [(i, text(ENGLISH if i % 2 else GERMAN, 30), "en" if i % 2 else "de") for i in range(200)]
    rows += [(900, None, "en"), (901, "", None), (902, "12 34 !", "de"), (903, text(ENGLISH, 5000), "en"), (None, "the house", None), (904, "Haus", None), (905, "x", "en"), (905, "x", "en")]
    out = language.languages(table(rows)).collect()
    assert len(out) == len(rows)
    right = {i: lang for i, _, lang in rows}
    for r in out:
        assert 0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 4 == 2)
        if r["doc_id"] is not None and r["doc_id"] < 200 or r["doc_id"] == 903:
            assert r["lang_pred"] == right[r["doc_id"]]
        if r["doc_id"] in (900, 901, 902):
            assert r["lang_pred"] == "und" and r["score"] == 0
    kept = language.keep_known(table(rows))
    assert kept.columns == table(rows).columns and {900, 901, 902}.isdisjoint({r["doc_id"] for r in kept.collect()}) and kept.count() >= 201
    assert language.languages(table([])).count() == 0


def test_field_marginals_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    scores, steps = rng.normal(size=(4, 3)), rng.normal(size=(3, 3))
    field = language.Field(["a", "b", "c"], {}, np.zeros((2, 3)), np.zeros((0, 3)), steps, 1)
    want = np.zeros((4, 3))
    for path in product(range(3), repeat=4):
        p = np.exp(sum(scores[t, s] for t, s in enumerate(path)) + sum(steps[a, b] for a, b in zip(path, path[1:], strict=False)))
        for t, s in enumerate(path):
            want[t, s] += p
    assert np.allclose(field.marginals(scores, np.array([0, 4]))[0], want / want.sum(axis=1, keepdims=True), atol=1e-5)


def test_code_switched_words_are_labelled():
    rng = np.random.default_rng(3)
    field = language.train([("en" if i % 2 else "de", " ".join(rng.choice(ENGLISH if i % 2 else GERMAN, 40))) for i in range(80)])
    words = [w.encode() for w in "the quick brown fox jumps der schnelle braune fuchs springt".split()]
    p = field.marginals(field.look_up(words)[:, :-1], np.array([0, 10]))[0]
    assert [field.langs[k] for k in p.argmax(axis=1)] == ["en"] * 5 + ["de"] * 5


def test_licences(table, corpus):
    rows = [*[r for r in corpus if r[0] != 14], (100, "some words here\nReleased under the MIT License.\nmore"), (101, "Licensed under the Apache License, Version 2.0."), (102, "foo\nLicensed under the Frobnicate License, edition seven"),
            (103, "this program is licensed under the GNU general public license version 3 only"), (104, "we drank under the apache helicopter, version two")]
    out = {r["doc_id"]: r for r in licences.licences(table(rows)).collect()}
    assert [out[k]["families"] for k in (100, 101, 103)] == ["mit", "apache-2.0", "gpl-3.0"] and out[100]["n_paragraphs"] == 3
    assert out[102]["licence"] in ("unknown", None) and out[104]["families"] == "" and out[1]["licence"] is None
    assert all(out[i]["families"] == "" for i, *_ in corpus if i not in (None, 14))
    assert licences.licences(table([])).count() == 0


GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version."""
BSD = """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are met:
#
# 1. Redistributions of source code must retain the above copyright notice.
# 2. Redistributions in binary form must reproduce the above copyright notice.
# 3. Neither the name of the copyright holder nor the names of its contributors
#    may be used to endorse or promote products derived from this software."""
APACHE = """// Licensed under the
// Apache License,
// Version 2.0 (the "License"); you may not use
// this file except in compliance with the License."""


def notices(table, corpus, rows):
    return {r["doc_id"]: r for r in licences.licences(table([*[r for r in corpus if r[0] != 14], *rows])).collect()}


def test_wrapped_licences(table, corpus):
    line = dict(corpus)[6]
    out = notices(table, corpus, [(200, GPL), (201, f"{line}\n{BSD}\n{line}"), (202, APACHE), (203, "it is licensed under\n\nthe MIT\n\nlicense"), (204, f"{line}\n{line}")])
    assert [out[k]["families"] for k in (201, 202)] == ["bsd-3-clause", "apache-2.0"]
    assert all(out[k]["confirmed"] for k in (200, 201, 202)) and out[200]["n_paragraphs"] == 4
    assert out[203]["families"] == out[204]["families"] == ""


def test_sibling_licences_are_not_confirmed(table, corpus):
    others = ["This work is licensed under the GNU Affero General Public License, version 3", GPL.replace("GNU", "GNU Affero"), GPL.replace("GNU", "GNU Lesser").replace("version 3", "version 2.1"),
              "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "Licensed under CC BY-NC-SA 4.0", "Licensed under CC BY 3.0",
              BSD[: BSD.index("# 3.")], "Released under the BSD 2-Clause License", "Licensed under the Apache License, Version 1.1", "Licensed under the Mozilla Public License 1.1",
              "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation"]
    own = [(GPL, "gpl-3.0"), (GPL.replace("version 3", "version 2"), "gpl-2.0"), (GPL.replace("GNU", "GNU Lesser"), "lgpl-3.0"), (BSD, "bsd-3-clause"), ("Released under the BSD 3-Clause License", "bsd-3-clause"), (APACHE, "apache-2.0"),
           *[(t, f) for f, ts in licences.TEMPLATES.items() for t in ts if f in ("cc-by-4.0", "cc-by-nc-4.0", "cc-by-sa-4.0", "gpl-2.0", "gpl-3.0", "mpl-2.0", "mit", "cc0-1.0", "all-rights-reserved")]]
    out = notices(table, corpus, [*[(300 + k, t) for k, t in enumerate(others)], *[(400 + k, t) for k, (t, _) in enumerate(own)]])
    assert [(k, out[300 + k]["families"]) for k in range(len(others)) if out[300 + k]["confirmed"] or out[300 + k]["families"]] == []
    assert [(t, out[400 + k]["families"]) for k, (t, f) in enumerate(own) if out[400 + k]["families"] != f] == []
