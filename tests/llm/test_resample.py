"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from daygrid.llm import resample

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_grams(text, least, most):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + n]).encode() for n in range(least, most + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, least, most, buckets, min_words, percent, seed=2024):
    count = lambda texts: Counter(zlib.crc32(g) % buckets for v in texts for g in plain_grams(v, least, most)[1])
    s, t = count([r[1] for r in rows]), count(target)
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for i, v, *_ in rows:
        n_words, each = plain_grams(v, least, most)
        weight = sum(gain(zlib.crc32(g) % buckets) for g in each) // max(len(each), 1)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n_words, len(each), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for rank, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[5] = rank
    return Counter(map(tuple, out))


@pytest.mark.parametrize(("least", "most", "percent"), [(1, 1, 10), (1, 2, 50), (2, 3, 100)])
def test_resample_against_brute_force(table, corpus, least, most, percent):
    target = ["One two three " * 3, None, corpus[12][1], "漢字 é"]
    got = resample.resample(table(corpus), table([(k, v) for k, v in enumerate(target)]), least, most, 1000, 20, percent)
    assert Counter(map(tuple, got.collect())) == brute(corpus, target, least, most, 1000, 20, percent)


def test_crc_of_runs(corpus):
    values = [v or "" for _, v, *_ in corpus] + ["y" * 70_000 + " Z " + "x" * 300, "a" * 64 + " b", "\x00\x7f", "0 9 a z A Z [ ` { \x80  "]
    codes, owner, n_words = resample.grams(values, 1, 4)
    want = Counter((i, zlib.crc32(g)) for i, v in enumerate(values) for g in plain_grams(v, 1, 4)[1])
    assert Counter(zip(owner.tolist(), codes.tolist())) == want and n_words.tolist() == [plain_grams(v, 1, 1)[0] for v in values]


def test_draw_and_empty_tables(table, corpus):
    rows = [(i, f"{v} {i}") for i, (_, v, *_) in enumerate(corpus)]
    docs, none = table(rows), table([])
    assert resample.resample(none, none).count() == 0
    got = resample.resample(docs, none)
    assert got.count() == len(rows)
    ranks = sorted(r["rank"] for r in got.where("rank is not null").collect())
    assert ranks == list(range(1, sum(plain_grams(v, 1, 1)[0] >= 20 for _, v in rows) // 10 + 1))
    drawn = resample.draw(docs, none, percent=50)
    assert drawn.columns == docs.columns
    assert {r["doc_id"] for r in drawn.collect()} == {r["doc_id"] for r in resample.resample(docs, none, percent=50).where("rank is not null").collect()}


def test_global_places(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(int(x),) for x in rng.integers(0, 50, 2000)], "v long").repartition(5)
    got = sorted((r["place"], r["v"]) for r in resample.places(df, [df["v"].asc()]).collect())
    assert [p for p, _ in got] == list(range(2000)) and [v for _, v in got] == sorted(v for _, v in got)
