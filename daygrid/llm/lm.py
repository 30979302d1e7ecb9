"""Probability of a text under a subword lattice: the sum over all segmentations into pieces."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrid.llm.common import chunks, crc_of_id, ddl, fields, per_worker, record, texts, written

#: The token that ends every text; no word is empty.
END = b""
#: Distinct words that a task counts before it passes them on.
HELD = 200_000
#: Frequent words sent to every worker; all others meet their counts in a join.
COMMON = 150_000
#: Words up to this length are laid out in rows of one length; longer ones go one by one.
WIDE = 24
#: Rounds of expectation in which the pieces' probabilities are fitted.
ROUNDS = 2
#: Words of one length in a step of the recursion.
ROWS = 8192

_COUNT = fields(word=pa.binary(), c=pa.int64(), t=pa.int64())
_PIECE = fields(piece=pa.int32(), n=pa.float64())
_WORD = fields(word=pa.binary(), c=pa.int64(), known=pa.bool_(), base=pa.float64(), lattice=pa.float64())
_PART = fields(uid=pa.int64(), word=pa.binary(), doc_id=pa.int64(), held_out=pa.bool_(), n_tokens=pa.int64(), n_known=pa.int64(), base=pa.float64(), lattice=pa.float64())
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Lattice:
    """Pieces of an existing vocabulary with their probabilities.

    A character that is no piece is spelled with the vocabulary's byte pieces, as its tokenizer does.
    """

    def __init__(self, path: str, log_p: np.ndarray | None = None):
        from sentencepiece import SentencePieceProcessor

        self.tokenizer = SentencePieceProcessor(model_file=path)
        n = self.tokenizer.get_piece_size()
        self.log_p = np.zeros(n) if log_p is None else log_p
        usable = [i for i in range(n) if not (self.tokenizer.is_byte(i) or self.tokenizer.is_control(i) or self.tokenizer.is_unknown(i))]
        pieces = {self.tokenizer.id_to_piece(i): i for i in usable}
        self.bytes = [self.tokenizer.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, pieces))
        hashes = np.array([self.hash(p) for p in pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(list(pieces.values()))[order]
        self.pieces = pieces

    @staticmethod
    def hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) % (1 << 64)
        return h

    def spelled(self, c: str) -> float:
        return sum(self.log_p[self.bytes[b]] for b in c.encode())

    def one(self, word: str) -> float:
        """Log probability of a word: log-space forward recursion over the ends of pieces."""
        text = "▁" + word
        forward = np.full(len(text) + 1, -np.inf)
        forward[0] = 0.0
        for j in range(1, len(text) + 1):
            ways = [forward[i] + self.log_p[self.pieces[text[i:j]]] for i in range(max(0, j - self.longest), j) if text[i:j] in self.pieces]
            if text[j - 1] not in self.pieces:
                ways.append(forward[j - 1] + self.spelled(text[j - 1]))
            forward[j] = np.logaddexp.reduce(ways)
        return float(forward[-1])

    def edges(self, words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """The lattice of words of one length: for each end in turn, the first begin, and for every begin and word the
        piece between them, whether there is one, and the log probability of the way (-inf where there is none)."""
        n = len(words[0]) + 1
        code = np.frombuffer("".join("▁" + w for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), n).astype(np.uint64)
        prefix = np.zeros((n + 1, len(words)), np.uint64)
        for j in range(n):
            prefix[j + 1] = prefix[j] * _BASE + code[:, j] + np.uint64(1)
        power = [np.uint64(1)]
        for _ in range(min(n, self.longest)):
            power.append(np.uint64(int(power[-1]) * int(_BASE) % (1 << 64)))
        for j in range(1, n + 1):
            first = max(0, j - self.longest)
            h = np.stack([prefix[j] - prefix[i] * power[j - i] for i in range(first, j)])
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            found = self.hashes[at] == h
            piece = self.ids[at]
            way = np.where(found, self.log_p[piece], -np.inf)
            alone = ~found[-1]
            if alone.any():
                spelled = {c: self.spelled(chr(c)) for c in np.unique(code[alone, j - 1]).tolist()}
                way[-1, alone] = [spelled[c] for c in code[alone, j - 1].tolist()]
            yield first, piece, found, way

    def many(self, words: list[str]) -> np.ndarray:
        """The same for words of one length, end by end over all of them."""
        forward = np.full((len(words[0]) + 2, len(words)), -np.inf)
        forward[0] = 0.0
        for j, (first, _, _, way) in enumerate(self.edges(words), 1):
            ways = forward[first:j] + way
            top = ways.max(axis=0)
            forward[j] = top + np.log(np.exp(ways - top).sum(axis=0))
        return forward[-1]

    def expect(self, words: list[str], weight: np.ndarray, total: np.ndarray) -> None:
        """Add to `total` how often each piece is expected in the segmentations of words of one length (forward-backward)."""
        n, kept = len(words[0]) + 1, list(self.edges(words))
        forward, backward = (np.full((n + 1, len(words)), -np.inf) for _ in range(2))
        forward[0], backward[n] = 0.0, 0.0
        for j, (first, _, _, way) in enumerate(kept, 1):
            ways = forward[first:j] + way
            top = ways.max(axis=0)
            forward[j] = top + np.log(np.exp(ways - top).sum(axis=0))
        for j in range(n, 0, -1):
            first, piece, found, way = kept[j - 1]
            onward = way + backward[j]
            backward[first:j] = np.logaddexp(backward[first:j], onward)
            share = np.exp(forward[first:j] + onward - forward[n]) * weight
            total += np.bincount(piece[found], share[found], len(total))
            for k in np.flatnonzero(~found[-1]).tolist():
                for byte in ("▁" + words[k])[j - 1].encode():
                    total[self.bytes[byte]] += share[-1, k]

    def log10(self, words: list[bytes]) -> np.ndarray:
        """log10 of each word's probability, summed over all its segmentations; of END as the piece that ends a text."""
        text = [w.decode() for w in words]
        length = np.array([len(t) for t in text], np.int64)
        out = np.empty(len(words))
        order = np.argsort(length, kind="stable")
        edges = np.searchsorted(length[order], np.arange(1, WIDE + 2))
        for a, b in zip(edges, edges[1:], strict=False):
            for i in range(a, b, ROWS):
                some = order[i : min(i + ROWS, b)]
                out[some] = self.many([text[k] for k in some.tolist()])
        for k in order[edges[-1] :].tolist():
            out[k] = self.one(text[k])
        out[length == 0] = self.log_p[self.tokenizer.eos_id()]
        return out / np.log(10)


def _lattice(path: str, log_p: np.ndarray | None) -> Lattice:
    return per_worker(("lattice", path, None if log_p is None else log_p.tobytes()), lambda: Lattice(path, log_p))


def tokens(text: str) -> list[bytes]:
    """Words with A-Z in lower case; bytes.lower() touches ASCII only."""
    return text.encode().lower().split()


def word_counts(rows: DataFrame) -> DataFrame:
    """Counts of every distinct token of all texts, in training (c) and at all (t); each task sums before it shuffles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            train, test = held
            words = list(train.keys() | test.keys())
            out = record(_COUNT, words, [train[w] for w in words], [train[w] + test[w] for w in words])
            train.clear()
            test.clear()
            return out

        for part in chunks(batches):
            for text, out in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                held[out].update(tokens(text))
                held[out][END] += 1
            if len(held[0]) + len(held[1]) > HELD:
                yield flush()
        yield flush()

    return rows.mapInArrow(run, ddl(_COUNT)).groupBy("word").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))


def piece_log_p(counts: DataFrame, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the vocabulary's pieces, from all training words by their counts.

    The start is how often the vocabulary's own segmentation uses each piece, and 0.1 more; in each round it is how
    often a piece is expected over all segmentations. The result has one number per piece of the vocabulary.
    """
    lattice = Lattice(path)
    trained = counts.where("c > 0")
    ends = trained.where(F.col("word") == F.lit(END)).agg(F.sum("c")).first()[0] or 0
    words = trained.where(F.col("word") != F.lit(END)).select("word", "c")
    log_p = None
    for _ in range(rounds + 1):

        def run(batches: Iterable[pa.RecordBatch], log_p: np.ndarray | None = log_p) -> Iterator[pa.RecordBatch]:
            lattice = _lattice(path, log_p)
            total = np.zeros(len(lattice.log_p))
            for batch in batches:
                text, c = [w.decode() for w in batch.column(0).to_pylist()], batch.column(1).to_numpy().astype(float)
                length = np.array([len(t) for t in text])
                own = np.flatnonzero(length > WIDE) if log_p is not None else np.arange(len(text))
                ids = lattice.tokenizer.encode([text[k] for k in own.tolist()], num_threads=1)
                n = [len(x) for x in ids]
                total += np.bincount(np.fromiter(chain.from_iterable(ids), np.int64, sum(n)), np.repeat(c[own], n), len(total))
                for n in np.unique(length[length <= WIDE]).tolist() if log_p is not None else ():
                    some = np.flatnonzero(length == n)
                    lattice.expect([text[k] for k in some.tolist()], c[some], total)
            used = np.flatnonzero(total)
            yield record(_PIECE, used.astype(np.int32), total[used])

        n = np.full(len(lattice.log_p), 0.1)
        for r in words.mapInArrow(run, ddl(_PIECE)).groupBy("piece").agg(F.sum("n").alias("n")).collect():
            n[r["piece"]] += r["n"]
        n[lattice.tokenizer.eos_id()] = ends + 0.1
        log_p = np.log(n / n.sum())
    return log_p


def frequent(counts: DataFrame, most: int) -> int:
    """The least total count that at most `most` words reach, from counts in steps of an eighth of a power of two."""
    step = F.ceil(F.log2("t") * 8).cast("int")
    at_least, reach = 0, 1 << 62
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        at_least += r["count"]
        if at_least > most:
            return reach
        reach = int(np.floor(2 ** ((r["step"] - 1) / 8))) + 1
    return 0


def log_likelihood(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", common: int = COMMON) -> DataFrame:
    """Probability of every whole text under the lattice and under smoothed word counts.

    Both learn from the rows whose crc32(id as text) mod 10 is not 0. `score` is log10 of the product, over the words
    and the end, of the sum over all segmentations into pieces: a word's sum doesn't depend on its neighbours, so the
    forward recursion runs once per distinct word. Words are counted with map-side sums; the `common` most frequent
    are sent to the workers, all others are joined to their counts.

    A null text is empty (its end alone), a null id is the empty text in the choice of training rows and stays null,
    repeated rows are scored each, an empty table gives no rows. Without training rows every count is 0. Other columns
    are not read.
    """
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col).withColumn("held_out", crc_of_id() % 10 == 0)
    counts = written(word_counts(rows), "word-counts")
    sums = counts.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    n, v = sums["n"] or 0, sums["v"] or 0
    log_p, reach = piece_log_p(counts, vocabulary), frequent(counts, common)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(vocabulary, log_p)
        for batch in batches:
            words, c = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            yield record(_WORD, words, c, c > 0, np.log10((c + 0.1) / (n + 0.1 * (v + 1))), lattice.log10(words))

    scored = lambda part: part.select("word", "c").mapInArrow(score, ddl(_WORD))
    top = scored(counts.where(F.col("t") >= reach)).collect()
    table = spark.sparkContext.broadcast(({bytes(r["word"]): i for i, r in enumerate(top)}, np.array([(r["known"], r["base"], r["lattice"]) for r in top] + [(0, 0, 0)], float)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, values = table.value
        none, uid = len(index), TaskContext.get().partitionId() << 33
        for part in chunks(batches):
            split = [[*tokens(t), END] for t in part.column(1).to_pylist()]
            size = np.array([len(s) for s in split])
            flat = list(chain.from_iterable(split))
            at = np.fromiter((index.get(w, none) for w in flat), np.int64, len(flat))
            sums = np.add.reduceat(values[at], np.r_[0, np.cumsum(size)[:-1]], axis=0)
            own = np.arange(uid, uid + len(split))
            uid += len(split)
            # a blank and the row's number: no word, so it finds no partner and the rows of texts are spread
            yield record(_PART, own, [b" %d" % i for i in own.tolist()], part.column(0), part.column(2), size, sums[:, 0].astype(np.int64), sums[:, 1], sums[:, 2])
            rare = np.flatnonzero(at == none)
            zero = np.zeros(len(rare), np.int64)
            empty = pa.nulls(len(rare), pa.int64())
            yield record(_PART, np.repeat(own, size)[rare], [flat[i] for i in rare.tolist()], empty, pa.nulls(len(rare), pa.bool_()), zero, zero, zero.astype(float), zero.astype(float))

    rest = scored(counts.where(F.col("t") < reach)).select("word", F.col("known").cast("long").alias("known"), F.col("base").alias("rare_base"), F.col("lattice").alias("rare_lattice"))
    joined = rows.mapInArrow(run, ddl(_PART)).join(rest, "word", "left")
    plus = lambda a, b: F.sum(F.col(a) + F.coalesce(F.col(b), F.lit(0)))
    total = joined.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
                                      plus("n_known", "known").alias("n_known"), plus("base", "rare_base").alias("base_score"), plus("lattice", "rare_lattice").alias("score"))
    return total.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
