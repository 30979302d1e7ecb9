"""Quality rules: repetition inside a text, from a suffix array of its words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from daygrid.llm.common import BLANKS, alone, chunks, ddl, fields, flat_words, keep_rows, record, texts

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """A text fails the base with under `min_words` words or over `max_repeat_words` of them in repeated 3-word windows.

    Beyond that, repeats of at least `min_repeat` words may cover at most `max_covered` of the words, and the longest
    may have at most `max_longest` of them.
    """

    min_words: int = 50
    max_repeat_words: float = 0.5
    min_repeat: int = 5
    max_covered: float = 0.4
    max_longest: float = 0.3


_OUT = fields(doc_id=pa.int64(), n_words=pa.int64(), word_chars=pa.int64(), n_symbols=pa.int64(), n_dup_lines=pa.int64(), n_repeat_words=pa.int64(),
              covered_words=pa.int64(), longest_repeat=pa.int64(), base_failed=pa.bool_(), kept=pa.bool_())


def suffix_repeats(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest run of symbols from there that also begins elsewhere in its own text.

    One suffix array for all texts (the text's number is the first sort key) by prefix doubling. Only suffixes whose
    prefix is still shared are sorted on. The ranks of each doubling are kept; from the longest to the shortest they
    give the common prefix of neighbours in the array, and a position's longest repeat is the larger of its two.
    """
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    end = starts[1:][text]
    key = text * (int(symbols.max()) + 1) + symbols
    suffixes = np.argsort(key, kind="stable")
    first = np.r_[True, key[suffixes][1:] != key[suffixes][:-1]]
    slot = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[suffixes] = slot
    size = np.bincount(slot, minlength=n)
    open_ = suffixes[size[slot] > 1]
    shared = np.sort(rank[open_])  # slots of all suffixes that have one symbol in common with another
    where = np.flatnonzero(size[slot] > 1)
    levels, k = [rank.copy()], 1
    while len(open_):
        ahead = open_ + k
        inside = ahead < end[open_]
        second = np.where(inside, rank[np.where(inside, ahead, 0)] + 1, 0)
        order = np.lexsort((second, rank[open_]))
        open_, second = open_[order], second[order]
        old = rank[open_]
        group = np.r_[True, old[1:] != old[:-1]]
        index = np.arange(len(open_))
        place = old + index - np.maximum.accumulate(np.where(group, index, 0))
        part = group | np.r_[True, second[1:] != second[:-1]]
        new = place[np.maximum.accumulate(np.where(part, index, 0))]
        suffixes[place] = open_
        rank[open_] = new
        k *= 2
        last = np.r_[part[1:], True]
        open_ = open_[~(part & last)]
        if len(open_):
            levels.append(rank.copy())
    longest = np.zeros(n, np.int64)
    if not len(shared):
        return longest
    a, b = suffixes[where[:-1]], suffixes[where[1:]]
    pair = (where[1:] == where[:-1] + 1) & (levels[0][a] == levels[0][b])
    a, b = a[pair], b[pair]
    common = np.zeros(len(a), np.int64)
    for i in reversed(range(len(levels))):
        x, y = a + common, b + common
        fits = (x < end[a]) & (y < end[b])
        same = fits & (levels[i][np.where(fits, x, 0)] == levels[i][np.where(fits, y, 0)])
        # equal ranks at a level mean that as many symbols agree, or that both texts end; the ends differ within a text
        common += same * (1 << i)
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return longest


def covered(longest: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """Words of each text inside a repeat of at least `least` words: the union of the repeats' spans."""
    at = np.flatnonzero(longest >= least)
    edge = np.zeros(len(longest) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + longest[at], -1)
    inside = np.r_[0, np.cumsum(np.cumsum(edge[:-1]) > 0)]
    return inside[starts[1:]] - inside[starts[:-1]]


def measure(values: list[str], rules: Rules) -> tuple[np.ndarray, ...]:
    words, starts = flat_words(values)
    seen: dict[bytes, int] = {}
    symbols = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    longest = suffix_repeats(symbols, starts)
    n = np.diff(starts)
    most = np.zeros(len(n), np.int64)
    np.maximum.at(most, np.repeat(np.arange(len(n)), n), longest)
    repeat, cover = covered(longest, starts, 3), covered(longest, starts, rules.min_repeat)
    chars = [len(v) - sum(map(v.count, BLANKS)) for v in values]
    marks = [sum(map(v.count, SYMBOLS)) for v in values]
    lines = [[x for x in v.split("\n") if x.strip(BLANKS)] for v in values]
    twice = [len(x) - len(set(x)) for x in lines]
    failed = (n < rules.min_words) | (repeat > rules.max_repeat_words * n)
    kept = ~failed & (cover <= rules.max_covered * n) & (np.where(most >= rules.min_repeat, most, 0) <= rules.max_longest * n)
    return n, np.array(chars, np.int64), np.array(marks, np.int64), np.array(twice, np.int64), repeat, cover, most, failed, kept


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Measures and verdict of every whole text, one row per input row, without a shuffle.

    A null text has no words and fails; so does an empty one. A null id stays null, repeated rows give repeated
    results, an empty table gives no rows. Other columns are not read. A very long text is one chunk of its own.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for part in chunks(batches):
            yield record(_OUT, part.column(0), *measure(part.column(1).to_pylist(), rules))

    return texts(docs, id_col, text_col).mapInArrow(run, ddl(_OUT))


def keep_good(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows whose text passes, with all their columns as they are."""
    return keep_rows(docs, text_col, lambda values: measure(values, rules)[-1].tolist())
