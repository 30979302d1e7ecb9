"""Best-fit packing of token sequences in bulk-synchronous rounds."""

from __future__ import annotations

import json
import os
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrid.llm.common import alone, chunks, ddl, fields, per_worker, record, texts, written

#: Words kept per worker; the table is emptied beyond that.
CACHED = 800_000
#: Waiting documents that one sweep holds.
SWEEP_ROWS = 100_000

WAITING, GAP, PLACED = 0, 1, 2
_PIECE = fields(doc_id=pa.int64(), piece=pa.int32(), start=pa.int64(), length=pa.int64(), ids_crc32=pa.int64())
_STATE = fields(kind=pa.int32(), size=pa.int32(), uid=pa.int64(), sequence_id=pa.int64(), offset=pa.int64(), doc_id=pa.int64(), piece=pa.int32(), start=pa.int64(), length=pa.int64(), ids_crc32=pa.int64())
_NAMES = [f.name for f in _STATE]


class Numbers(dict):
    """Numbers of words in the order in which they are first asked for; `new` lists those not yet encoded."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class WordIds:
    """Ids of whole texts from a tokenizer that drops blanks: those of its words, each encoded once per worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        with open(path, encoding="utf-8") as f:
            data = json.load(f) | {"truncation": None, "padding": None}
        self.tokenizer = Tokenizer.from_str(json.dumps(data))
        # its normalizer lower-cases and leaves other printable ASCII as it is
        self.plain = Tokenizer.from_str(json.dumps(data | {"normalizer": None}))
        self.words, self.ids = Numbers(), []

    def encode(self, values: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.words) > CACHED:
            self.words, self.ids = Numbers(), []
        number = self.words.__getitem__
        found = [list(map(number, v.encode().split())) for v in values]
        self.learn()
        ids = self.ids.__getitem__
        return [b"".join(map(ids, f)) for f in found]

    def learn(self) -> None:
        for some in batched(self.words.new, 5000):
            text = [w.decode() for w in some]
            plain = [t.isascii() and t.isprintable() and "<|" not in t for t in text]
            for tokenizer, own in ((self.plain, True), (self.tokenizer, False)):
                of = [i for i, p in enumerate(plain) if p is own]
                for i, e in zip(of, tokenizer.encode_batch_fast([text[i].lower() if own else text[i] for i in of], add_special_tokens=False), strict=True):
                    text[i] = array("I", e.ids).tobytes()
            self.ids += text
        self.words.new.clear()


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts and digests of every whole text and its end id, cut at `capacity` only where it is longer."""
    end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = per_worker(("words", vocabulary), lambda: WordIds(vocabulary))
        for part in chunks(batches):
            rows = []
            for doc, ids in zip(part.column(0).to_pylist(), ids_of.encode(part.column(1).to_pylist()), strict=True):
                ids += end
                rows += [(doc, k, a // 4, min(step, len(ids) - a) // 4, zlib.crc32(ids[a : a + step])) for k, a in enumerate(range(0, len(ids), step))]
            yield record(_PIECE, *zip(*rows, strict=True))

    return texts(docs, id_col, text_col).mapInArrow(run, ddl(_PIECE))


def sweep(table: pa.Table, capacity: int, open_from: int, last: bool) -> pa.Table:
    """One range: from the longest document down, each takes its successor, the smallest gap that holds it.

    Documents of one length go by rank (their uid), and so do gaps of one size; the gap that is left stays in the
    sweep. A document without a successor waits for the next round, or opens a sequence if it has at least `open_from`
    tokens. But for the `last` round, a new sequence that could hold more of this range is taken back at the end: the
    next round fills it from all ranges.
    """
    kind, size, uid, seq = (table.column(n).to_numpy() for n in ("kind", "size", "uid", "sequence_id"))
    out_kind, offset, to = kind.copy(), table.column("offset").to_numpy().copy(), seq.copy()
    sizes: list[int] = []
    stacks: dict[int, list[int]] = {}

    def put(gap: int, sequence: int) -> None:
        if gap not in stacks:
            stacks[gap] = []
            insort(sizes, gap)
        stacks[gap].append(sequence)

    gaps = np.flatnonzero(kind == GAP)
    for i in gaps[np.lexsort((-uid[gaps], size[gaps]))].tolist():
        put(int(size[i]), int(seq[i]))
    waiting = np.flatnonzero(kind == WAITING)
    opened: dict[int, list[int]] = {}
    for i in waiting[np.lexsort((uid[waiting], -size[waiting]))].tolist():
        need = int(size[i])
        k = bisect_left(sizes, need)
        if k < len(sizes):
            gap = sizes[k]
            sequence = stacks[gap].pop()
            if not stacks[gap]:
                del stacks[gap], sizes[k]
        elif need >= open_from:
            gap, sequence = capacity, int(uid[i])
            opened[sequence] = []
        else:
            continue
        out_kind[i], to[i], offset[i] = PLACED, sequence, capacity - gap
        if sequence in opened:
            opened[sequence].append(i)
        if gap > need:
            put(gap - need, sequence)
    left = [(g, s) for g, stack in stacks.items() for s in stack]
    if not last and len(waiting):
        back = {s for g, s in left if s in opened and g >= size[waiting].min()}
        left = [(g, s) for g, s in left if s not in back]
        again = [i for s in back for i in opened[s]]
        out_kind[again], offset[again], to[again] = WAITING, 0, uid[again]
    docs = table.select(_NAMES).set_column(0, _STATE.field(0), pa.array(out_kind, pa.int32())).set_column(3, _STATE.field(3), pa.array(to, pa.int64())).set_column(4, _STATE.field(4), pa.array(offset, pa.int64())).filter(pa.array(kind != GAP)).cast(_STATE)
    if not left:
        return docs
    g, s = (np.array(x, np.int64) for x in zip(*left, strict=True))
    none = np.zeros(len(g), np.int64)
    return pa.concat_tables([docs, pa.Table.from_arrays([pa.array(x).cast(f.type) for f, x in zip(_STATE, (none + GAP, g, s, s, none, none, none, none, none, none), strict=True)], schema=_STATE)])


def _sweeper(capacity: int, open_from: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        alone()  # the words are not asked for again
        return sweep(table, capacity, open_from, last)

    return run


def _by_size(values: list[int], size: Column) -> Column:
    """values[size], as one constant array."""
    return F.element_at(F.split(F.lit(",".join(map(str, values))), ","), size + 1).cast("int")


def ranges(lengths: dict[int, int], capacity: int, rows: int) -> tuple[list[int], list[int]]:
    """For each size from 0 to capacity: the first task of its range and how many share it.

    Ranges hold about `rows` documents; a length that has more is dealt over several tasks. A gap goes to the range of
    its longest possible document; -1 where none fits.
    """
    first, share, task, held = [-1] * (capacity + 1), [1] * (capacity + 1), -1, rows
    for size in range(1, capacity + 1):
        n = lengths.get(size, 0)
        if n > rows:
            task += 1 if task < 0 else share[size - 1]
            share[size], held = -(-n // rows), rows
        elif n and held + n > rows:
            task += 1 if task < 0 else share[size - 1]
            held = n
        elif n:
            held += n
        else:
            share[size] = share[size - 1]
        first[size] = task
    return first, share


def pack(pieces_: DataFrame, capacity: int = 4096, sweep_rows: int = SWEEP_ROWS) -> DataFrame:
    """Sequence and place of every piece, in as few sequences as best fit finds.

    What is longer than half a sequence opens one. Then, in rounds: documents and gaps are dealt into ranges of size
    (cut at the counts by length, at most `capacity` of them; frequent lengths are dealt over several tasks), every
    range is swept at once, gaps shrink, and what found none goes on. Documents longer than every gap open sequences,
    the longer half of the lengths first, so that shorter ones fill what is left. Each round reads the table that
    the one before has written, so a lost executor repeats one round at most.
    """
    rows = written(pieces_.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    long = F.col("length") * 2 > capacity
    none = F.lit(0).cast("long")
    state = rows.select(F.when(long, PLACED).otherwise(WAITING).alias("kind"), F.col("length").cast("int").alias("size"), "uid", F.col("uid").alias("sequence_id"), none.alias("offset"), "doc_id", "piece", "start", "length", "ids_crc32")
    gaps = rows.where(long & (F.col("length") < capacity)).select(
        F.lit(GAP).alias("kind"), (capacity - F.col("length")).cast("int").alias("size"), "uid", F.col("uid").alias("sequence_id"), none.alias("offset"), none.alias("doc_id"), F.lit(0).alias("piece"), none.alias("start"), none.alias("length"), none.alias("ids_crc32"))
    state, placed, before, stuck = state.unionByName(gaps), [], None, False
    while True:
        placed.append(state.where(F.col("kind") == PLACED))
        state = state.where(F.col("kind") != PLACED)
        counts = {(r["kind"], r["size"]): r["count"] for r in state.groupBy("kind", "size").count().collect()}  # at most 2 * capacity rows
        lengths = {s: n for (k, s), n in counts.items() if k == WAITING}
        if not lengths:
            break
        stuck, before = sum(lengths.values()) == before, sum(lengths.values())
        widest = max((s for k, s in counts if k == GAP), default=0)
        open_from = 1 if stuck else max(widest + 1, max(lengths) // 2)
        first, share = ranges(lengths, capacity, sweep_rows)
        last = stuck or first[-1] + share[-1] <= 1
        dealt = state.withColumn("task", _by_size(first, F.col("size")) + F.pmod(F.xxhash64("uid"), _by_size(share, F.col("size"))).cast("int")).where("task >= 0")
        state = written(dealt.groupBy("task").applyInArrow(_sweeper(capacity, open_from, last), ddl(_STATE)), "packing")
    return reduce(DataFrame.unionByName, placed).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def best_fit(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", sweep_rows: int = SWEEP_ROWS) -> DataFrame:
    """Tokenize every whole text and pack it.

    A null or empty text is its end id alone. Repeated rows are packed each on their own, a null id stays null, an
    empty table gives no rows, other columns are not read. Equal lengths go by row.
    """
    return pack(pieces(docs, vocabulary, capacity, end_id, id_col, text_col), capacity, sweep_rows)
