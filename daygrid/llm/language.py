"""Language of each word by a linear-chain conditional random field, and of a text by its words."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from daygrid.llm.common import alone, chunks, crc_of_id, ddl, fields, flat_words, keep_rows, record, texts, written

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: Words whose scores a worker keeps; the table is emptied beyond that.
CACHED = 250_000
#: Words whose n-grams are laid out at once.
WORDS = 20_000
#: Rows of the chosen sample up to which it is broadcast.
FEW = 1_000_000

_OUT = fields(doc_id=pa.int64(), held_out=pa.bool_(), lang_pred=pa.string(), score=pa.float64())


@dataclass(frozen=True)
class Training:
    """The bounded sample that the field is fitted on: for each language, `texts` labelled texts (the first by a hash of
    their id) and `words` consecutive words from the middle of each."""

    texts: int = 600
    words: int = 160
    lexicon: int = 8000
    bits: int = 17
    rounds: int = 3
    batch: int = 128
    rate: float = 0.3


def grams(words: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of 2 to 4 bytes of each lower-cased word with its two ends marked (those at an end are its
    affixes), flat, and where each word's begin."""
    framed = [b"\x02" + w + b"\x03" for w in words]
    length = np.array([len(f) for f in framed], np.int64)
    code = np.frombuffer(b"".join(framed), np.uint8).astype(np.uint64)
    end = np.repeat(np.cumsum(length), length)
    at = np.arange(len(code))
    gram, hashes, owner = code.copy(), [], []
    word = np.repeat(np.arange(len(words)), length)
    for n in (2, 3, 4):
        gram = gram[:-1] | (code[n - 1 :] << np.uint64(8 * (n - 1)))
        inside = at[: len(gram)] + n <= end[: len(gram)]
        mixed = (gram[inside] + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)
        hashes.append((mixed >> np.uint64(64 - bits)).astype(np.int64))
        owner.append(word[: len(gram)][inside])
    owners = np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.bincount(owners, minlength=len(words)), out=starts[1:])
    return np.concatenate(hashes)[order], starts


def lower(word: bytes) -> bytes:
    return word.decode().lower().encode()


class Field:
    """Scores of a word for each language, from its n-grams and the lexicon, and of each step from one to the next."""

    def __init__(self, langs: list[str], lexicon: dict[bytes, int], weights: np.ndarray, known: np.ndarray, steps: np.ndarray, bits: int):
        self.langs, self.lexicon, self.weights, self.known, self.steps, self.bits = langs, lexicon, weights, known, steps, bits
        self.seen: dict[bytes, int] = {}
        self.rows = np.zeros((0, len(langs) + 1), np.float32)

    def emissions(self, words: list[bytes]) -> np.ndarray:
        low = [lower(w) for w in words]
        hashes, starts = grams(low, self.bits)
        out = np.add.reduceat(self.weights[hashes], starts[:-1], axis=0)
        found = np.array([self.lexicon.get(w, -1) for w in low])
        out[found >= 0] += self.known[found[found >= 0]]
        return out

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """A row per word: its scores, and 1 if it has a letter. Each distinct word is scored once per worker."""
        if len(self.seen) > CACHED:
            self.seen, self.rows = {}, self.rows[:0]
        new = list(set(words) - self.seen.keys())
        if new:
            self.seen.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            parts = [self.rows]
            for some in batched(new, WORDS):
                letter = np.array([LETTER.search(w.decode()) is not None for w in some], np.float32)
                parts.append(np.c_[self.emissions(list(some)), letter].astype(np.float32))
            self.rows = np.concatenate(parts)
        seen = self.seen
        return self.rows[np.fromiter((seen[w] for w in words), np.int64, len(words))]

    def marginals(self, scores: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward-backward over all texts at once, the longest first: at step t those with more than t words.

        Returns the probability of each language for each word, and forward and (scaled) backward rows.
        """
        length = np.diff(starts)
        order = np.argsort(-length, kind="stable")
        begin, length = starts[:-1][order], length[order]
        alive = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), side="left")
        local = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float32)
        step = np.exp(self.steps - self.steps.max()).astype(np.float32)
        forward, backward = np.empty_like(local), np.ones_like(local)
        state = None
        for t, n in enumerate(alive.tolist()):
            at = begin[:n] + t
            state = local[at] if t == 0 else (state[:n] @ step) * local[at]
            state = state / state.sum(axis=1, keepdims=True)
            forward[at] = state
        for t in range(len(alive) - 2, -1, -1):
            at = begin[: alive[t + 1]] + t
            back = (backward[at + 1] * local[at + 1]) @ step.T
            backward[at] = back / back.sum(axis=1, keepdims=True)
        both = forward * backward
        return both / both.sum(axis=1, keepdims=True), forward, backward

    def predict(self, values: list[str]) -> tuple[list[str], list[float]]:
        """The language with the largest mean probability over the words with a letter, and that mean."""
        words, starts = flat_words(values)
        if not self.langs or not words:
            return [UNKNOWN] * len(values), [0.0] * len(values)
        rows = self.look_up(words)
        share = rows.copy()
        share[:, :-1] = self.marginals(rows[:, :-1], starts)[0] * rows[:, -1:]
        total = np.zeros((len(values), len(self.langs) + 1))
        full = np.flatnonzero(np.diff(starts))
        total[full] = np.add.reduceat(share, starts[:-1][full], axis=0, dtype=np.float64)
        count = total[:, -1]
        mean = total[:, :-1] / np.maximum(count, 1)[:, None]
        best = mean.argmax(axis=1)
        pred = [self.langs[b] if c else UNKNOWN for b, c in zip(best.tolist(), count.tolist(), strict=True)]
        return pred, np.where(count > 0, np.clip(mean[np.arange(len(best)), best], 0, 1), 0.0).tolist()


    def certainty(self, values: list[str]) -> list[float]:
        """How surely the words with a letter are labelled, whatever languages these are: the mean of each one's largest
        probability. 0 where no word has a letter, 1 otherwise if there are no languages to tell apart."""
        words, starts = flat_words(values)
        total, count = (np.zeros(len(values)) for _ in range(2))
        if words:
            if self.langs:
                rows = self.look_up(words)
                letter, top = rows[:, -1], self.marginals(rows[:, :-1], starts)[0].max(axis=1)
            else:
                letter, top = np.array([LETTER.search(w.decode()) is not None for w in words], np.float32), np.ones(len(words), np.float32)
            full = np.flatnonzero(np.diff(starts))
            count[full] = np.add.reduceat(letter, starts[:-1][full], dtype=np.float64)
            total[full] = np.add.reduceat(letter * top, starts[:-1][full], dtype=np.float64)
        return np.clip(total / np.maximum(count, 1), 0, 1).tolist()


def train(sample: list[tuple[str, str]], plan: Training = Training()) -> Field:
    """Fit the field to (language, words) by stochastic ascent on the likelihood of code-switched sequences.

    The sequences are laid out from spans of 4 to 40 words of the labelled texts, in random order, so that the steps
    from one language to another are learned as well as the words.
    """
    langs = sorted({lang for lang, _ in sample})
    rng = np.random.default_rng(7)
    spans: list[tuple[int, list[bytes]]] = []
    for lang, text in sample:
        words = text.encode().split()
        at = 0
        while at < len(words):
            n = int(rng.integers(4, 41))
            spans.append((langs.index(lang), words[at : at + n]))
            at += n
    order = rng.permutation(len(spans))
    words = [w for i in order for w in spans[i][1]]
    gold = np.array([spans[i][0] for i in order for _ in spans[i][1]], np.int64)
    distinct: dict[bytes, int] = {}
    ids = np.array([distinct.setdefault(w, len(distinct)) for w in words], np.int64)
    common = [w for w, _ in sorted(Counter(lower(w) for w in words).items(), key=lambda x: (-x[1], x[0]))[: plan.lexicon]]
    lexicon = {w: i for i, w in enumerate(common)}
    k = len(langs)
    field = Field(langs, lexicon, np.zeros((1 << plan.bits, k)), np.zeros((len(lexicon), k)), np.zeros((k, k)), plan.bits)
    if k < 2 or not words:
        return field
    low = [lower(w) for w in distinct]
    hashes, at = grams(low, plan.bits)
    entry = np.array([lexicon.get(w, -1) for w in low])
    power = [np.full(a.shape, 1.0) for a in (field.weights, field.known, field.steps)]

    def climb(values: np.ndarray, squares: np.ndarray, gradient: np.ndarray) -> None:
        squares += gradient * gradient
        values += plan.rate * gradient / np.sqrt(squares)

    edges = np.r_[np.arange(0, len(words), 64), len(words)]
    batches = [edges[i : i + plan.batch + 1] for i in range(0, len(edges) - 1, plan.batch)]
    for _ in range(plan.rounds):
        for b in rng.permutation(len(batches)).tolist():
            starts = batches[b] - batches[b][0]
            own = ids[batches[b][0] : batches[b][-1]]
            y = gold[batches[b][0] : batches[b][-1]]
            count = at[own + 1] - at[own]
            flat = np.repeat(at[own] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            h = hashes[flat]
            scores = np.add.reduceat(field.weights[h], np.r_[0, np.cumsum(count)[:-1]], axis=0)
            hit = entry[own] >= 0
            scores[hit] += field.known[entry[own[hit]]]
            p, forward, backward = field.marginals(scores, starts)
            miss = np.eye(k)[y] - p
            spread = np.repeat(miss, count, axis=0)
            climb(field.weights, power[0], np.stack([np.bincount(h, spread[:, j], 1 << plan.bits) for j in range(k)], axis=1))
            climb(field.known, power[1], np.stack([np.bincount(entry[own[hit]], miss[hit, j], len(lexicon)) for j in range(k)], axis=1))
            inner = np.setdiff1d(np.arange(1, len(own)), starts)
            local = np.exp(scores[inner] - scores[inner].max(axis=1, keepdims=True)) * backward[inner]
            pairs = forward[inner - 1][:, :, None] * np.exp(field.steps - field.steps.max())[None] * local[:, None, :]
            pairs /= pairs.sum(axis=(1, 2), keepdims=True)
            real = np.bincount(y[inner - 1] * k + y[inner], minlength=k * k).reshape(k, k)
            climb(field.steps, power[2], real - pairs.sum(axis=0))
    field.weights, field.known = field.weights.astype(np.float32), field.known.astype(np.float32)
    return field


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", plan: Training = Training()) -> Field:
    """Train on labelled rows whose crc32(id) mod 4 is not 2. Ids are chosen first (each task keeps its first ones of a
    language), so that only the sample's texts are cut into words and move."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.where((crc_of_id("doc_id") % 4 != 2) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = written(rows.select("lang", "doc_id").withColumn("n", F.row_number().over(first)).where(F.col("n") <= plan.texts), "sample")
    if chosen.count() <= FEW:
        chosen = F.broadcast(chosen)
    words = F.expr("filter(split(text, '[ \\\\x09-\\\\x0D]+'), w -> w <> '')")
    cut = F.slice(F.col("w"), F.greatest(F.lit(1), F.floor((F.size("w") - plan.words) / 2).cast("int") + 1), plan.words)
    found = rows.join(chosen, ["lang", "doc_id"]).withColumn("w", words).select("lang", "n", F.array_join(cut, " ").alias("words"))
    sample = found.groupBy("lang", "n").agg(F.min("words").alias("words")).collect()  # repeated rows count once
    return train([(r["lang"], r["words"]) for r in sorted(sample, key=lambda r: (r["lang"], r["n"]))], plan)


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", field: Field | None = None) -> DataFrame:
    """Language of every whole text, one row per input row, without a shuffle of texts.

    `und` with score 0 where the text is null or has no letter, or nothing was there to learn from. A row with a null id
    is not learned from (its remainder is that of the empty text) and stays null; repeated rows give repeated results
    and are learned from once; an empty table gives no rows; of the other columns none is read.
    """
    model = docs.sparkSession.sparkContext.broadcast(field or fit(docs, id_col, text_col, lang_col))  # a few MB, whatever the table

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for part in chunks(batches):
            yield record(_OUT, part.column(0), part.column(2), *model.value.predict(part.column(1).to_pylist()))

    return texts(docs, id_col, text_col).withColumn("held_out", crc_of_id() % 4 == 2).mapInArrow(run, ddl(_OUT))


def keep_known(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose words are labelled with at least that certainty, with all their columns as they are: also those in
    several languages. Texts without a letter go; without labelled rows to learn from all others stay."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col))

    def known(values: list[str]) -> list[bool]:
        return [0 < s >= least for s in model.value.certainty(values)]

    return keep_rows(docs, text_col, known)
