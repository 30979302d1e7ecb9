"""Licence families of paragraphs: a trained n-gram classifier with an unknown class, confirmed by templates."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrid.llm.common import BLANKS, alone, chunks, ddl, fields, record, texts

# Notices by which public licences are commonly declared.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "all-rights-reserved": ("All rights reserved", "Copyright, all rights reserved, no part may be reproduced without permission"),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0", "You may not use this file except in compliance with the License", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
                   "Released under the Apache 2.0 license"),
    "bsd-3-clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD 3-Clause License"),
    "cc-by-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"),
    "cc-by-nc-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0"),
    "cc-by-sa-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0"),
    "cc0-1.0": ("To the extent possible under law, the author has waived all copyright and related rights to this work", "Released under CC0 1.0 Universal"),
    "gpl-2.0": ("This work is licensed under the GNU General Public License, version 2", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
                "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version"),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3", "under the terms of the GNU General Public License version 3 as published by the Free Software Foundation",
                "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    "lgpl-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    "mit": ("Released under the MIT License", "Licensed under the MIT license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License 2.0"),
}
# Notices of licences that are no family here, though most of their words are those of one.
SIBLINGS = (
    "This work is licensed under the GNU Affero General Public License, version 3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "This library is licensed under the GNU Lesser General Public License, version 2.1", "under the terms of the GNU Library General Public License as published by the Free Software Foundation",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "Licensed under CC BY-ND 4.0",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "Licensed under CC BY-NC-ND 4.0",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "Licensed under CC BY-NC-SA 4.0",
    "Released under the BSD 2-Clause License", "Released under the MIT No Attribution License", "Licensed under the Apache License, Version 1.1", "Licensed under the Mozilla Public License 1.1",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
)
#: Families that differ by few words: the classifier tells the group, those words the family.
GROUPS = (("gpl-2.0", "gpl-3.0", "lgpl-3.0"), ("cc-by-4.0", "cc-by-nc-4.0", "cc-by-sa-4.0"))
NONE = "none"
UNKNOWN = "unknown"
WORD = re.compile(r"[^\s.,;:()\[\]\"'!?<>]+(?:[.\-:/][^\s.,;:()\[\]\"'!?<>]+)*")
#: What may stand around a line's words in a comment.
SIGNS = BLANKS + "/*#;%!|<>+=~-"
#: Words before and after the end of a line that are read together, for notices that go on in the next lines.
REACH = 32
#: Words whose numbers a worker keeps.
CACHED = 300_000

_OUT = fields(doc_id=pa.int64(), n_paragraphs=pa.int64(), n_licence=pa.int64(), families=pa.string(), licence=pa.string(), probability=pa.float64(), confirmed=pa.bool_())


@dataclass(frozen=True)
class Training:
    """The bounded sample: paragraphs of the first `texts` documents by a hash of their id, at most `paragraphs`, are the
    negatives; every template is varied `copies` times."""

    texts: int = 400
    paragraphs: int = 3000
    copies: int = 60
    steps: int = 300
    rate: float = 0.5
    decay: float = 1e-4
    least: float = 0.5
    confirm: float = 0.6


_GNU = re.compile(r"\b(?:(affero|lesser|library) )?(?:gnu )?(?:(affero|lesser|library) )?general public licen[sc]e|\b([al]?)gpl")
_VERSION = re.compile(r"(?<![\w.])(?:version |licen[sc]e[ -]|gpl[ -]?|apache[ -])?v?[. -]?(\d+(?:\.\d+)*)(?!\w)")
_CC = re.compile(r"\bcreative commons attribution|\bcc[ -]by\b|\blicenses/by\b|\battribution\b")
_FLAG = re.compile(r"(?<![a-z])(?:(nc|non-?commercial|non commercial)|(sa|share-?alike|share alike)|(nd|no-?deriv\w*|no deriv\w*))(?![a-z])")
_CLAUSES = re.compile(r"\bbsd[ -](\w+)[ -]clause|\b(\w+)[ -]clause bsd")


def version(text: str, at: int = 0) -> str:
    """The first number from there on, without closing zeros."""
    m = _VERSION.search(text, at)
    return re.sub(r"(\.0)+$", "", m[1]) if m else ""


def agrees(family: str, text: str, whole: str) -> bool:
    """Whether the words that set a family apart from its siblings (version, kind, clauses) are those of the paragraph,
    given as words with single blanks. The clauses of a licence text may stand in other paragraphs, so `whole` has all words."""
    if family in GROUPS[0]:
        m = _GNU.search(text)
        kind = "" if not m else (m[1] or m[2] or {"a": "affero", "l": "lesser"}.get(m[3] or "", ""))
        return m is not None and kind == ("lesser" if family == "lgpl-3.0" else "") and version(text, m.end()) == family.split("-")[1][0]
    if family in GROUPS[1]:
        m = _CC.search(text)
        number = _VERSION.search(text, m.end()) if m else None
        if not number:
            return False
        flags = {n for f in _FLAG.finditer(text[m.start() : number.start()]) for n, x in zip(("nc", "sa", "nd"), f.groups(), strict=True) if x}
        return flags == set(family.split("-")[2:-1]) and version(text, m.end()) == "4"
    if family == "apache-2.0":
        m = re.search(r"\bapache\b", text)
        return m is not None and version(text, m.end()) == "2"
    if family == "mpl-2.0":
        m = re.search(r"\bmozilla public licen[sc]e|\bmpl\b", text)
        return m is not None and version(text, m.end()) == "2"
    if family == "cc0-1.0":
        m = re.search(r"\bcc0\b", text)
        return "waived all copyright" in text or m is not None and version(text, m.end()) == "1"
    if family == "bsd-3-clause":
        m = _CLAUSES.search(text)
        if m:
            return (m[1] or m[2]) in ("3", "three")
        return re.search(r"\bneither the names? of\b.*\bendorse or promote\b", whole) is not None and "advertising materials" not in whole
    if family == "mit":
        return re.search(r"\bmit (no attribution|zero)\b|\bmit-0\b", text) is None and re.search(r"\bmit[ -]licen[sc]e\b|to any person obtaining a copy of this software and associated\b", text) is not None
    return "all rights reserved" in text


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def ngrams(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


class Classifier:
    """Multinomial logistic regression over the presence of 1- to 3-grams of the templates.

    An n-gram that no template has carries no weight, so a paragraph's score is the sum over those it shares with them.
    """

    def __init__(self, plan: Training):
        self.plan = plan
        self.labels = [NONE, UNKNOWN, *TEMPLATES]
        self.grams = {g: i for i, g in enumerate(sorted({g for ts in (*TEMPLATES.values(), SIBLINGS) for t in ts for g in ngrams(words_of(t))}))}
        self.words = {w: i + 1 for i, w in enumerate(sorted({w for g in self.grams for w in g}))}
        base = self.base = len(self.words) + 1
        key = np.array([sum(self.words[w] * base ** (2 - i) for i, w in enumerate(g)) for g in self.grams], np.int64)
        order = np.argsort(key)
        self.keys, self.at = key[order], order
        self.weights, self.bias = np.zeros((len(self.grams), len(self.labels))), np.zeros(len(self.labels))
        self.heat = 1.0
        self.seen: dict[str, tuple[int, ...]] = {}
        self.templates = {f: [self.pairs([self.words[w] for w in words_of(t)]) for t in ts] for f, ts in TEMPLATES.items()}
        self.known_pairs = np.array(sorted(set().union(*(t for ts in self.templates.values() for t in ts))), np.int64)

    def pairs(self, row: list[int]) -> set[int]:
        """Keys of neighbouring words, both of which some template has."""
        return {a * self.base + b for a, b in zip(row, row[1:], strict=False) if a and b}

    def numbers(self, text: str) -> list[int]:
        """Numbers of a paragraph's words in order, 0 for those that no template has."""
        if len(self.seen) > CACHED:
            self.seen.clear()
        out: list[int] = []
        for raw in text.split():
            if raw not in self.seen:
                self.seen[raw] = tuple(self.words.get(w, 0) for w in words_of(raw))
            out += self.seen[raw]
        return out

    def shared(self, rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """(paragraph, n-gram) pairs, each once, of paragraphs as numbers."""
        size = np.array([len(r) for r in rows], np.int64)
        ids = np.fromiter((i for r in rows for i in r), np.int64, int(size.sum()))
        owner = np.repeat(np.arange(len(rows)), size)
        found = []
        key, whole = ids * self.base**2, ids > 0
        for n in (1, 2, 3):
            if n > 1:
                if len(ids) < n:
                    break
                key = key[:-1] + ids[n - 1 :] * self.base ** (3 - n)
                whole = whole[:-1] & (ids[n - 1 :] > 0) & (owner[: len(key)] == owner[n - 1 :])
            some = np.flatnonzero(whole)
            at = np.minimum(np.searchsorted(self.keys, key[some]), len(self.keys) - 1)
            hit = self.keys[at] == key[some]
            found.append(owner[some[hit]] * len(self.grams) + self.at[at[hit]])
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return both // len(self.grams), both % len(self.grams)

    def probabilities(self, rows: list[list[int]]) -> np.ndarray:
        row, gram = self.shared(rows)
        scores = np.tile(self.bias, (len(rows), 1))
        np.add.at(scores, row, self.weights[gram])
        scores = np.exp((scores - scores.max(axis=1, keepdims=True)) / self.heat)
        return scores / scores.sum(axis=1, keepdims=True)

    def likeness(self, family: str, row: list[int]) -> float:
        """The largest share of a template's word pairs that the paragraph has."""
        own = self.pairs(row)
        return max(len(t & own) / len(t) for t in self.templates[family])

    def fit(self, negatives: list[str]) -> Classifier:
        rng = np.random.default_rng(11)
        rows, gold = list(negatives), [0] * len(negatives)
        filler = [w for n in negatives for w in words_of(n)] or ["a"]
        unlike = [words_of(t) for ts in TEMPLATES.values() for t in ts]
        for k, ts in enumerate((SIBLINGS, *TEMPLATES.values())):
            for t in ts:
                words = words_of(t)
                for c in range(self.plan.copies):
                    kept = [w for w in words if c == 0 or rng.random() > 0.08] or words
                    around = [filler[i] for i in rng.integers(0, len(filler), rng.integers(0, 12))]
                    cut = int(rng.integers(0, len(around) + 1))
                    rows.append(" ".join(around[:cut] + kept + around[cut:]))
                    gold.append(k + 1)
        # the unknown class: licence language of no family, from the words of all templates without their order
        for _ in range(self.plan.copies * 6):
            a = unlike[int(rng.integers(0, len(unlike)))]
            mixed = ["licensed", "under", "the"][: int(rng.integers(1, 4))] + [str(rng.choice(filler)) for _ in range(int(rng.integers(1, 4)))] + [str(w) for w in rng.permutation(a)[: int(rng.integers(1, 4))]] + ["license"]
            rows.append(" ".join(mixed))
            gold.append(1)
        y = np.array(gold)
        held = rng.random(len(rows)) < 0.25
        row, gram = self.shared([self.numbers(r) for r in rows])
        x = np.zeros((len(rows), len(self.grams)))
        x[row, gram] = 1
        share = 1 / np.maximum(np.bincount(y, minlength=len(self.labels)), 1)[y] ** 0.5
        train = ~held
        target = np.eye(len(self.labels))[y[train]]
        importance = (share[train] / share[train].sum())[:, None]
        power = [np.full(a.shape, 1e-8) for a in (self.weights, self.bias)]
        for _ in range(self.plan.steps):
            p = x[train] @ self.weights + self.bias
            p = np.exp(p - p.max(axis=1, keepdims=True))
            miss = (target - p / p.sum(axis=1, keepdims=True)) * importance
            for values, squares, g in ((self.weights, power[0], x[train].T @ miss - self.plan.decay * self.weights / len(x)), (self.bias, power[1], miss.sum(axis=0))):
                squares += g * g
                values += self.plan.rate * g / np.sqrt(squares)
        # calibration: the temperature with which the rows left out are most likely
        if held.any():
            scores = x[held] @ self.weights + self.bias

            def loss(heat: float) -> float:
                s = scores / heat
                return float((np.log(np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)) + s.max(axis=1) - s[np.arange(len(s)), y[held]]).mean())

            self.heat = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
        return self

    def windows(self, ids: np.ndarray, starts: np.ndarray, block: np.ndarray) -> list[tuple[int, int, int]]:
        """(line, from, to): words around the end of a line that has a template's pair of words, where one more stands in
        the lines after it. Lines of different blocks are never read together. What is left out has no two pairs of
        words, or no more than a line by itself or a later window, so no template could confirm it."""
        if len(ids) < 2:
            return []
        line = np.repeat(np.arange(len(block)), np.diff(starts))
        pair = (ids[:-1] > 0) & (ids[1:] > 0) & (block[line[:-1]] == block[line[1:]]) & np.isin(ids[:-1] * self.base + ids[1:], self.known_pairs)
        count = np.r_[0, np.cumsum(pair)]
        last = np.searchsorted(block, block, side="right")
        end = starts[1:]
        to, begin = np.minimum(starts[last], end + REACH), np.maximum(starts[:-1], end - REACH)
        before = lambda at: count[np.clip(at, 0, len(count) - 1)]
        total, own, first = before(to - 1) - before(begin), before(np.maximum(end - 1, begin)) - before(begin), before(end) - before(begin)
        chosen = np.flatnonzero((to > end) & (total > 1) & (total > own) & (first > 0))
        return list(zip(chosen.tolist(), begin[chosen].tolist(), to[chosen].tolist(), strict=True))

    def settle(self, p: np.ndarray, row: list[int], words: Callable[[], list[str]], whole: Callable[[], str]) -> tuple[bool, float, str] | None:
        """Whether a template and the words that set the family apart confirm it, how probable it is, and the family, of
        a paragraph that has a licence. Siblings count together; among them those words decide."""
        k = int(p.argmax())
        if self.labels[k] == NONE:
            return None
        group = next((g for g in GROUPS if self.labels[k] in g), (self.labels[k],))
        prob = float(sum(p[self.labels.index(f)] for f in group))
        if self.labels[k] != UNKNOWN and prob >= self.plan.least:
            for f in group:
                if self.likeness(f, row) >= self.plan.confirm and agrees(f, " ".join(words()), whole()):
                    return True, prob, f
        return False, prob, UNKNOWN

    def scan(self, values: list[str]) -> list[tuple]:
        """For each text its paragraphs, those with a licence, the confirmed families, and the most probable one."""
        lines, block, counts, b = [], [], [], 0
        for v in values:
            counts.append(-len(lines))
            b += 1
            for x in v.split("\n"):
                bare = x.strip(SIGNS)
                if not bare:  # a blank line, or one of signs only
                    b += 1
                if x.strip(BLANKS):
                    lines.append(bare)
                    block.append(b)
            counts[-1] += len(lines)
        rows = [self.numbers(x) for x in lines]
        starts = np.zeros(len(rows) + 1, np.int64)
        np.cumsum([len(r) for r in rows], out=starts[1:])
        ids = np.fromiter((i for r in rows for i in r), np.int64, int(starts[-1]))
        windows = self.windows(ids, starts, np.array(block, np.int64))
        found: list[list[tuple]] = [[] for _ in values]
        text = np.repeat(np.arange(len(values)), counts)
        first = np.r_[0, np.cumsum(counts)]
        whole = lambda t: " ".join(w for x in lines[first[t] : first[t + 1]] for w in words_of(x))

        def words(i: int, a: int, z: int) -> list[str]:
            out: list[str] = []
            for k in range(i, len(lines)):
                if starts[k] >= z:
                    break
                out += [w for raw in lines[k].split() for w in words_of(raw)]
            return out[a - starts[i] : z - starts[i]]

        p = self.probabilities(rows)
        for i in np.flatnonzero(p.argmax(axis=1)).tolist():
            found[text[i]].append((*self.settle(p[i], rows[i], lambda i=i: words_of(lines[i]), lambda i=i: whole(text[i])), i, i))
        wrapped = []
        for q, (i, a, z) in zip(self.probabilities([ids[a:z].tolist() for _, a, z in windows]), windows, strict=True):
            if got := self.settle(q, ids[a:z].tolist(), lambda i=i, a=a, z=z: words(i, a, z), lambda i=i: whole(text[i])):
                at = a + np.arange(z - a - 1)
                if got[0]:  # only the lines with the template's words
                    at = at[np.isin(ids[at] * self.base + ids[at + 1], list(set().union(*self.templates[got[2]])))]
                wrapped.append((*got, *(int(np.searchsorted(starts, k, side="right")) - 1 for k in (at[0], at[-1] + 1)), int(text[i])))
        for sure, prob, family, lo, hi, t in sorted(wrapped, key=lambda w: (-w[0], -w[1], w[3])):
            meets = [f for f in found[t] if f[3] <= hi and f[4] >= lo]
            if sure and not any(f[0] and f[2] == family for f in meets):
                found[t] = [f for f in found[t] if f[0] or f not in meets] + [(sure, prob, family, lo, hi)]
            elif not sure and not meets:
                found[t].append((sure, prob, family, lo, hi))
        out = []
        for n, each in zip(counts, found, strict=True):
            top = max((f[:3] for f in each), default=None)
            names = sorted({f[2] for f in each if f[0]})
            out.append((n, len(each), ",".join(names), top[2] if top else None, top[1] if top else 0.0, bool(top and top[0])))
        return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: Training = Training()) -> Classifier:
    """Fit on varied templates and on paragraphs of a bounded sample of documents that share little with any template."""
    lines = texts(docs, id_col, text_col).orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(plan.texts)
    lines = lines.select(F.explode(F.split("text", "\n")).alias("line"), F.xxhash64("doc_id").alias("h")).where("trim(line) <> ''")
    found = [r["line"] for r in lines.orderBy("h", F.xxhash64("line"), "line").limit(plan.paragraphs).select(F.substring("line", 1, 4000).alias("line")).collect()]
    model = Classifier(plan)
    return model.fit([x for x in found if max(model.likeness(f, model.numbers(x)) for f in TEMPLATES) < 0.3])


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Classifier | None = None) -> DataFrame:
    """Licence families of every whole text, one row per input row, without a shuffle of texts.

    A paragraph is a line with a word; a notice that goes on in the next lines (up to a blank one, comment signs aside)
    is read over them and counts as one with a licence, in place of its lines.
    `families` are those that a paragraph is predicted to have and a template confirms, together with the words that set the family apart (version,
    lesser or affero, clauses and the like); `licence`
    is the most probable of them, `unknown` where the classifier sees a licence that no template confirms, else null.
    A null or empty text has no paragraphs; null ids stay null; repeated rows give repeated results; an empty table no
    rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs, id_col, text_col))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for part in chunks(batches):
            yield record(_OUT, part.column(0), *zip(*shared.value.scan(part.column(1).to_pylist()), strict=True))

    return texts(docs, id_col, text_col).mapInArrow(run, ddl(_OUT))
