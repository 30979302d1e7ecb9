"""Removal of repeated passages: windows of words that begin earlier in the corpus too."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrid.llm.common import alone, chunks, ddl, fields, flat_words, prepare, record, written

#: Words of the runs whose smallest hash sends a window to its index shard.
ANCHOR = 5
#: Different segments of one anchor from which on its windows are compared one by one, over all tasks.
HOT = 20_000
#: Words that one FM-index holds at most, but for a single anchor.
SHARD_WORDS = 400_000
_LOWEST = -(2**63)
_FACTOR, _POWER = 0xD6E8FEB86659FD93, np.uint64(0x9E3779B97F4A7C15)

_SEGMENT = fields(h=pa.int64(), id=pa.int64(), p=pa.int64(), d=pa.int64())
_CUT = fields(hot=pa.bool_(), h=pa.int64(), d=pa.int64(), id=pa.int64(), p=pa.int64(), words=pa.binary())
_MASK = fields(h=pa.int64(), d=pa.int64(), mask=pa.int32())
_OUT = fields(doc_id=pa.int64(), n_words=pa.int64(), n_removed=pa.int64(), kept_sha256=pa.string())


def _mix(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(31))) * _POWER
    return a ^ (a >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, np.uint64(base % (1 << 64)))
    out[0] = 1
    return np.multiply.accumulate(out)


def segments(values: list[str], window: int) -> tuple[np.ndarray, ...]:
    """Each text's windows, in runs that share the place of their smallest anchor hash.

    Returns, per run: the anchor's hash, the number of the text, the first window, the number of windows and a hash of
    all the run's words. Equal windows have equal anchors wherever they stand, and a run has no window twice.
    """
    words, starts = flat_words(values)
    n, width = len(words), window - ANCHOR + 1
    if n < window:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    gram = np.zeros(n - ANCHOR + 1, np.uint64)
    for j in range(ANCHOR):
        gram = gram * np.uint64(_FACTOR) + hashes[j : n - ANCHOR + 1 + j]
    gram = _mix(gram)
    bits = np.uint64((1 << int(n).bit_length()) - 1)
    low = (gram & ~bits) | np.arange(len(gram), dtype=np.uint64)
    reach = 1
    while reach < width:  # smallest of `width` neighbours, by doubling
        step = min(reach, width - reach)
        low = np.minimum(low[:-step], low[step:])
        reach += step
    at = (low & bits).astype(np.int64)
    text = np.repeat(np.arange(len(values)), np.diff(starts))
    count = n - window + 1
    whole = text[:count] == text[window - 1 :]
    begin = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (whole[1:] != whole[:-1]) | (text[1:count] != text[: count - 1])])
    size = np.diff(np.r_[begin, count])[whole[begin]]
    begin = begin[whole[begin]]
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_mix(hashes) * _powers(_FACTOR, n)[:n], out=prefix[1:])
    content = _mix((prefix[begin + size + window - 1] - prefix[begin]) * _powers(pow(_FACTOR, -1, 1 << 64), n)[begin])
    return gram[at[begin]].view(np.int64), text[begin], begin - starts[text[begin]], size, content.view(np.int64)


class FmIndex:
    """An index of word sequences for backward search, and where each suffix begins.

    The last column of the sorted suffixes is kept as a wavelet matrix: one bit vector per bit of a word's number, with
    a count of ones before every 64 bits.
    """

    def __init__(self, text: np.ndarray, depth: int):
        n, self.n = len(text), len(text)
        rank = text.astype(np.int64)
        k = 1
        while True:  # suffixes in the order of their first `depth` words or more
            key = rank * (int(rank.max()) + 2) + np.r_[rank[k:] + 1, np.zeros(min(k, n), np.int64)]
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
            rank, k = new, 2 * k
            if k > depth or int(rank[order[-1]]) == n - 1:
                break
        self.suffixes = order
        self.before = np.zeros(int(text.max()) + 2, np.int64)
        np.cumsum(np.bincount(text), out=self.before[1:])
        last = text[order - 1]
        self.levels = []
        for bit in reversed(range(max(1, int(text.max()).bit_length()))):
            ones = (last >> bit) & 1
            padded = np.zeros(-(-(n + 1) // 64) * 64, np.uint8)
            padded[:n] = ones
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            blocks = np.r_[0, np.cumsum(np.bitwise_count(words).astype(np.int64))]
            self.levels.append((bit, words, blocks, n - int(ones.sum())))
            last = np.r_[last[ones == 0], last[ones == 1]]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the last column."""
        low = np.zeros(len(at), np.int64)
        for bit, words, blocks, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            both = np.concatenate([low, at])
            block = both >> 6
            below = (np.uint64(1) << (both & 63).astype(np.uint64)) - np.uint64(1)
            ones = blocks[block] + np.bitwise_count(words[block] & below)
            a, b = ones[: len(at)], ones[len(at) :]
            low, at = np.where(one, zeros + a, low - a), np.where(one, zeros + b, at - b)
        return at - low

    def search(self, text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics up to `length`, backwards from each end: the interval of the suffixes that begin with
        the last `length` words before it. A query leaves as soon as one suffix only is left, its own."""
        left, right = np.zeros(len(ends), np.int64), np.full(len(ends), self.n)
        live = np.arange(len(ends))
        for step in range(1, length + 1):
            symbol = text[ends[live] - step]
            both = self.rank(np.r_[symbol, symbol], np.r_[left[live], right[live]])
            left[live] = self.before[symbol] + both[: len(live)]
            right[live] = self.before[symbol] + both[len(live) :]
            live = live[right[live] - left[live] > 1]
            if not len(live):
                break
        return left, right


def repeated(ids: np.ndarray, firsts: np.ndarray, sizes: np.ndarray, words: list[bytes], window: int) -> np.ndarray:
    """For each segment a bit per window: whether its words also begin earlier in the shard.

    The segments' words, each segment closed by a word that stands nowhere else, are indexed, and then streamed through
    the index. Windows with one interval are copies; the first of them, by document and place, stays.
    """
    split = [w.split() for w in words]
    seen: dict[bytes, int] = {}
    length = np.array([len(s) for s in split])
    flat = np.fromiter((seen.setdefault(w, len(seen) + 1) for s in split for w in s), np.int64, int(length.sum()))
    starts = np.cumsum(np.r_[0, length + 1])[:-1]
    text = np.zeros(int(length.sum()) + len(split), np.int64)
    text[np.arange(len(flat)) + np.repeat(np.arange(len(split)), length)] = flat
    index = FmIndex(text, window)
    owner = np.repeat(np.arange(len(split)), sizes)
    local = np.arange(len(owner)) - np.repeat(np.cumsum(np.r_[0, sizes])[:-1], sizes)
    left, right = index.search(text, starts[owner] + local + window, window)
    shared = np.flatnonzero(right - left > 1)
    order = shared[np.lexsort((firsts[owner[shared]] + local[shared], ids[owner[shared]]))]
    _, first = np.unique(left[order], return_index=True)
    later = np.ones(len(order), bool)
    later[first] = False
    mask = np.zeros(len(split), np.int64)
    np.add.at(mask, owner[order[later]], 1 << local[order[later]])
    return mask


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LOWEST)).alias("id"), text.alias("text"), F.crc32(text.cast("binary")).alias("crc"))


def _part(p: Column, name: str) -> Column:
    """p packs, from the top: first window, number of windows, crc of the text."""
    return {"first": F.shiftright(p, 37), "n": F.shiftright(p, 32).bitwiseAND(F.lit(31)), "crc": p.bitwiseAND(F.lit(0xFFFFFFFF))}[name]


def repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Spans to remove, one row per text that has any: id, crc of the text, and an array of first window << 16 | bits.

    Windows meet by content: the smallest hash of the 5-word runs inside a window (its anchor) sends it to an index
    shard, and consecutive windows with the same one travel as a segment. Segments whose anchor stands once in the
    corpus go no further; equal segments are counted as one; only the first copy of segments that share an anchor but
    differ is read back from its text, indexed and searched. Anchors with over `hot` different segments are taken
    apart into windows, which are summed up by their 128-bit hash before they are shuffled.
    """
    if not ANCHOR <= window < ANCHOR + 16:
        raise ValueError("a segment's windows are marked in 16 bits: the window has from 5 to 20 words")
    rows = _keyed(docs, id_col, text_col)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for part in chunks(batches):
            ids, crc = (part.column(c).to_numpy() for c in (0, 2))
            h, text, first, size, content = segments(part.column(1).to_pylist(), window)
            yield record(_SEGMENT, h, ids[text], (first << 37) | (size << 32) | crc[text], content)

    found = rows.mapInArrow(cut, ddl(_SEGMENT))
    # written, so that the join below has an exchange of its own on either side and a hot anchor's rows can be split
    twice = written(found.groupBy("h").count().where("count > 1").select("h"), "shared-anchors")
    found = written(found.join(twice, "h", "left_semi"), "segments")
    contents = found.groupBy("h", "d").agg(F.min(F.struct("id", "p")).alias("rep"))
    several = contents.groupBy("h").agg(F.count("*").alias("several")).where("several > 1")
    contents = written(contents.join(several, "h", "left"), "segment-contents")
    differ = contents.where(f"several <= {hot}").select("h", "d", "rep.id", "rep.p", F.lit(False).alias("hot"))
    frequent = contents.where(f"several > {hot}").select("h").distinct()
    apart = found.join(frequent, "h", "left_semi").select("h", "d", "id", "p", F.lit(True).alias("hot"))
    wanted = differ.unionByName(apart).groupBy("id", _part(F.col("p"), "crc").alias("crc")).agg(F.collect_list(F.struct("hot", "h", "d", "p")).alias("wanted"))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for part in chunks(batches):
            out = []
            for doc, text, wanted in zip(*(c.to_pylist() for c in part.columns), strict=True):
                words = text.encode().split()
                for w in wanted:
                    first, n = w["p"] >> 37, w["p"] >> 32 & 31
                    if not w["hot"]:
                        out.append((False, w["h"], w["d"], doc, w["p"], b" ".join(words[first : first + n + window - 1])))
                        continue
                    for k in range(first, first + n):
                        both = xxhash.xxh3_128_intdigest(b" ".join(words[k : k + window]))
                        a, b = ((x ^ (1 << 63)) - (1 << 63) for x in (both >> 64, both & (1 << 64) - 1))
                        out.append((True, a, b, doc, k << 37 | 1 << 32 | w["p"] & 0xFFFFFFFF, None))
            yield record(_CUT, *(zip(*out, strict=True) if out else [[]] * len(_CUT)))

    texts_ = written(rows.join(wanted, ["id", "crc"]).select("id", "text", "wanted").mapInArrow(read, ddl(_CUT)), "segment-texts")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        held: list[pa.RecordBatch] = []

        def index(table: pa.Table) -> pa.RecordBatch:
            p = table.column("p").to_numpy()
            mask = repeated(table.column("id").to_numpy(), p >> 37, p >> 32 & 31, table.column("words").to_pylist(), window)
            return record(_MASK, table.column("h").to_numpy(), table.column("d").to_numpy(), mask.astype(np.int32))

        size = 0
        for part in chunks(batches, "words", SHARD_WORDS):
            held.append(part)
            size += part.column("words").nbytes
            if size >= 6 * SHARD_WORDS:
                table = pa.Table.from_batches(held)
                h = table.column("h").to_numpy()
                whole = int(np.searchsorted(h, h[-1]))  # the last anchor may go on
                if whole:
                    yield index(table.slice(0, whole))
                    held, size = table.slice(whole).combine_chunks().to_batches(), 0
        if held:
            yield index(pa.Table.from_batches(held))

    sharded = texts_.where("not hot").select("h", "d", "id", "p", "words").dropDuplicates(["h", "d"]).repartition("h").sortWithinPartitions("h")
    masks = sharded.mapInArrow(search, ddl(_MASK))
    full = F.expr("shiftleft(1L, cast(shiftright(p, 32) & 31 as int)) - 1")
    same = contents.where(f"several is null or several <= {hot}").join(masks, ["h", "d"], "left")
    bits = F.when(F.struct("id", "p") == F.col("rep"), F.coalesce("mask", F.lit(0)).cast("long")).otherwise(full)
    marked = found.join(same, ["h", "d"]).select("id", "p", bits.alias("bits"))
    windows = texts_.where("hot").select("h", "d", "id", "p")
    earliest = windows.groupBy("h", "d").agg(F.min(F.struct("id", "p")).alias("rep"))
    single = windows.join(earliest, ["h", "d"]).where(F.struct("id", "p") != F.col("rep")).select("id", "p", F.lit(1).cast("long").alias("bits"))
    span = F.shiftleft(_part(F.col("p"), "first"), 16).bitwiseOR(F.col("bits"))
    return marked.unionByName(single).where("bits <> 0").groupBy("id", _part(F.col("p"), "crc").alias("crc")).agg(F.collect_list(span).alias("spans"))


def kept_words(words: list[bytes], spans: np.ndarray | None, window: int) -> list[bytes]:
    """The words outside all marked windows."""
    if spans is None or not len(spans):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    spans = np.asarray(spans, np.int64)
    for bit in range(16):
        at = (spans >> 16)[(spans >> bit & 1) == 1] + bit
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def _with_spans(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Column]:
    text = F.coalesce(F.col(f"d.`{text_col}`").cast("string"), F.lit(""))
    on = (F.coalesce(F.col(f"d.`{id_col}`").cast("long"), F.lit(_LOWEST)) == F.col("s.id")) & (F.crc32(text.cast("binary")) == F.col("s.crc"))
    return docs.alias("d").join(spans.alias("s"), on, "left"), text


def dedup(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Digest of every text after the removal of each word in a window that also begins earlier.

    Earlier is a smaller id, or the same and an earlier start. A null text has no words; a null id counts as the
    smallest and stays null; rows with the same id and text are one document and get the same result; rows with the
    same id and other text go by start, then by the text's crc32. Texts shorter than a window stay whole. An empty
    table gives no rows; other columns are not read.
    """
    joined, text = _with_spans(docs.select(f"`{id_col}`", f"`{text_col}`"), repeats(docs, window, id_col, text_col, hot), id_col, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for part in chunks(batches):
            n, gone, digest = [], [], []
            for value, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                words = value.encode().split()
                kept = kept_words(words, spans, window)
                n.append(len(words))
                gone.append(len(words) - len(kept))
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield record(_OUT, part.column(0), n, gone, digest)

    return joined.select(F.col(f"d.`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), "s.spans").mapInArrow(run, ddl(_OUT))


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The table with such words taken out of its texts, with all its columns.

    A text without repeats is untouched; of others the kept words are joined by one space, and the length is counted
    anew where the table has one; a text of which nothing is left goes.
    """
    joined, _ = _with_spans(docs, repeats(docs, window, id_col, text_col), id_col, text_col)
    at, length_at = docs.columns.index(text_col), docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for part in chunks(batches, at):
            columns, names = part.columns[:-1], part.schema.names[:-1]
            text, spans = columns[at].to_pylist(), part.columns[-1].to_pylist()
            cut = [bool(s) for s in spans]
            text = [b" ".join(kept_words(t.encode().split(), s, window)).decode() if c else t for t, s, c in zip(text, spans, cut, strict=True)]
            columns[at] = pa.array(text, columns[at].type)
            if length_at is not None:
                old = columns[length_at].to_pylist()
                columns[length_at] = pa.array([len(t) if c else n for t, n, c in zip(text, old, cut, strict=True)], columns[length_at].type)
            stay = pa.array([not c or t != "" for t, c in zip(text, cut, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(stay)

    return joined.select(*(F.col(f"d.`{c}`") for c in docs.columns), F.col("s.spans").alias("removed spans")).mapInArrow(run, docs.schema)
