"""Byte-level BPE encoding and decoding with batched numpy merge rounds."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from daygrid.llm.common import chunks, ddl, fields, per_worker, record, texts

#: How the published byte-level vocabularies cut a text before the merges.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A blank run of two or more that ends or begins with a space: the text isn't cut at single spaces then.
RUNS = regex.compile(r"\s \S|\s\s|^\s|\s$")
#: Units kept per worker; the table is emptied beyond that.
CACHED = 300_000
#: Distinct words merged at once.
WORDS = 50_000

_OUT = fields(doc_id=pa.int64(), n_tokens=pa.int64(), ids_sha256=pa.string(), decoded_sha256=pa.string())


def byte_symbols() -> dict[str, int]:
    """The published stand-in character of each byte: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A vocabulary file of the tokenizers library, as arrays.

    `pairs` holds left * size + right of every merge, sorted; `ranks` and `merged` go with it, so the rank of a pair of
    neighbours is a binary search.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab, of = data["model"]["vocab"], byte_symbols()
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.size = max(*vocab.values(), *self.special.values()) + 1
        self.bytes: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.bytes[i] = bytes(of[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.lengths = np.array([len(b) for b in self.bytes])
        self.start = np.zeros(256, np.int64)
        for c, b in of.items():
            self.start[b] = vocab[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in merges])
        order = np.argsort(key, kind="stable")
        self.pairs, self.ranks = key[order], order
        self.merged = np.array([vocab[a + b] for a, b in merges])[order]
        self.split_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers.

        The symbols of all words stand in one flat array. In every round each word merges its pair of lowest rank,
        wherever that pair stands in the word (from the left, without overlap); words without a pair leave.
        """
        out: list[bytes] = [b""] * len(words)
        length = np.array([len(w) for w in words])
        symbol = self.start[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), length)
        none = len(self.pairs)
        while len(symbol):
            at = np.full(len(symbol), none)
            if len(symbol) > 1:
                key = symbol[:-1] * self.size + symbol[1:]
                found = np.minimum(np.searchsorted(self.pairs, key), none - 1)
                hit = (self.pairs[found] == key) & (word[:-1] == word[1:])
                at[:-1] = np.where(hit, found, none)
            rank = np.where(at < none, self.ranks[np.minimum(at, none - 1)], none)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, first)
            count = np.diff(np.r_[first, len(symbol)])
            done = least == none
            if done.any():
                ended = np.repeat(done, count)
                ids = symbol[ended].astype("<u4").tobytes()
                edges = (np.r_[0, np.cumsum(count[done])] * 4).tolist()
                for w, a, b in zip(word[first[done]].tolist(), edges, edges[1:], strict=False):
                    out[w] = ids[a:b]
                symbol, word, at, rank = symbol[~ended], word[~ended], at[~ended], rank[~ended]
                least, count = least[~done], count[~done]
            take = (rank == np.repeat(least, count)) & (rank < none)
            if not len(symbol):
                break
            # of overlapping pairs (a run of one symbol) every second one counts, from the left
            index = np.arange(len(symbol))
            begins = take & ~np.r_[False, take[:-1] & (word[:-1] == word[1:])]
            take &= (index - np.maximum.accumulate(np.where(begins, index, 0))) % 2 == 0
            symbol = np.where(take, self.merged[np.minimum(at, none - 1)], symbol)
            keep = ~np.r_[False, take[:-1]]
            symbol, word = symbol[keep], word[keep]
        return out

    def learn(self, units: set[str]) -> None:
        """Put the ids of these units into the table."""
        cut = {u: PRETOKEN.findall(u) for u in units}
        new = list({w for ws in cut.values() for w in ws} - self.words.keys())
        for i in range(0, len(new), WORDS):
            some = new[i : i + WORDS]
            self.words.update(zip(some, self.merge([w.encode() for w in some]), strict=True))
        words = self.words
        self.units.update((u, b"".join([words[w] for w in ws])) for u, ws in cut.items())

    def cut(self, text: str) -> list[str]:
        """Units whose ids don't depend on their neighbours: words with the one space before them where all blanks are
        single, pretokens else."""
        if not text:
            return []
        if RUNS.search(text):
            return PRETOKEN.findall(text)
        head, *rest = text.split(" ")
        return [head, *[" " + r for r in rest]]

    def encode(self, values: list[str]) -> list[bytes]:
        if len(self.units) + len(self.words) > CACHED:
            self.units.clear()
            self.words.clear()
        parts = [self.pieces(v) for v in values]
        self.learn({u for p in parts for u in p} - self.units.keys() - self.special.keys())
        units = self.units | {s: i.to_bytes(4, "little") for s, i in self.special.items()} if any(s in v for v in values for s in self.special) else self.units
        return [b"".join([units[u] for u in p]) for p in parts]

    def pieces(self, text: str) -> list[str]:
        """Units of a text, with special tokens on their own (no unit of the rest can hold one)."""
        if not any(s in text for s in self.special):
            return self.cut(text)
        return [u for p in self.split_special.split(text) for u in ([p] if p in self.special else self.cut(p))]

    def decode(self, ids: bytes) -> str:
        """As decode() with special tokens kept: the tokens' bytes, with U+FFFD where they aren't UTF-8."""
        table = self.bytes
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Ids of every whole text and the text decoded from them, as digests (`with_ids`: and as arrays and text).

    A null text is empty and has no tokens. A null id stays null, repeated rows give repeated results, an empty table
    no rows; other columns are not read. Nothing is shuffled; a worker holds one chunk of texts, a bounded table of
    words and the vocabulary, whose file every machine has.
    """
    schema = pa.schema([*_OUT, pa.field("ids", pa.list_(pa.int64())), pa.field("decoded", pa.string())]) if with_ids else _OUT

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = per_worker(("bpe", vocabulary), lambda: Bpe(vocabulary))
        for part in chunks(batches):
            ids = bpe.encode(part.column(1).to_pylist())
            back = [bpe.decode(i) for i in ids]
            columns = [part.column(0), [len(i) // 4 for i in ids], [hashlib.sha256(i).hexdigest() for i in ids], [hashlib.sha256(b.encode()).hexdigest() for b in back]]
            yield record(schema, *columns, *([[np.frombuffer(i, "<u4").tolist() for i in ids], back] if with_ids else []))

    return texts(docs, id_col, text_col).mapInArrow(run, ddl(schema))
