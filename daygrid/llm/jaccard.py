"""Exact Jaccard join of word n-gram sets, as connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrid.llm.common import alone, chunks, ddl, fields, record, texts, written

#: Cells of the table of n-gram counts that orders the n-grams; its size doesn't depend on the data.
CELLS = 1 << 20
SLICE = 1 << 16
#: 64-bit words of a set's parity sketch.
SKETCH = 32
#: Sets of one list that are compared in one task; longer lists are a grid of blocks.
BLOCK = 1024
#: Lists up to this length tell all their pairs at once.
SHORT = 8
_LOWEST = -(2**63)

_SET = fields(doc_id=pa.int64(), n=pa.int64(), s=pa.int64(), sketch=pa.binary(), slice=pa.int32(), counts=pa.binary())
_ENTRY = fields(token=pa.int64(), s=pa.int64(), at=pa.int64())
_PAIR = fields(x=pa.int64(), y=pa.int64())
_SUM = fields(slice=pa.int32(), counts=pa.binary())


def _mix(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return a ^ (a >> np.uint64(29))


def ngram_sets(values: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed n-grams of all texts, sorted within each, and where each text's begin.

    A-Z count as lower case. A text with fewer words has its whole sequence as its one n-gram, one without words none.
    """
    split = [v.encode().lower().split() for v in values]
    length = np.array([len(s) for s in split], np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, (w for s in split for w in s)), np.uint64, int(length.sum()))
    begin = np.r_[0, np.cumsum(length)[:-1]].astype(np.int64)
    full = np.flatnonzero(length >= words)
    count = length[full] - words + 1
    first = np.repeat(begin[full] - np.r_[0, np.cumsum(count)[:-1]].astype(np.int64), count) + np.arange(count.sum())
    gram = np.zeros(len(first), np.uint64)
    for j in range(words):
        gram = gram * np.uint64(0xD6E8FEB86659FD93) + h[first + j]
    text = np.repeat(full, count)
    short = np.flatnonzero((length > 0) & (length < words))
    if len(short):
        gram = np.r_[gram, np.array([xxhash.xxh3_64_intdigest(b" ".join(split[k])) for k in short.tolist()], np.uint64)]
        text = np.r_[text, short]
    gram = _mix(gram)
    order = np.lexsort((gram, text))
    gram, text = gram[order], text[order]
    keep = np.r_[True, (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])][: len(gram)]
    gram, text = gram[keep], text[keep]
    starts = np.zeros(len(values) + 1, np.int64)
    np.cumsum(np.bincount(text, minlength=len(values)), out=starts[1:])
    return gram, starts


def set_ids(gram: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set; 0 of an empty one."""
    total = np.r_[np.uint64(0), np.cumsum(_mix(gram), dtype=np.uint64)]
    n = np.diff(starts)
    return np.where(n > 0, _mix(total[starts[1:]] - total[starts[:-1]] + n.astype(np.uint64)), np.uint64(0)).view(np.int64)


def sketches(gram: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """For each set, SKETCH * 64 bits: the parity of how many n-grams fall on each. Two sets differ in at least as many
    n-grams as their sketches in bits."""
    bits = SKETCH * 64
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at = text * bits + (gram >> np.uint64(20)).astype(np.int64) % bits
    odd = (np.bincount(at, minlength=(len(starts) - 1) * bits) & 1).astype(np.uint8)
    packed = np.packbits(odd.reshape(-1, bits), axis=1)
    return [r.tobytes() for r in packed]


def least_shared(a, b, percent: int):
    """The least intersection with which sets of a and b n-grams link."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_size(n, percent: int):
    return n - -(-percent * n // 100) + 1


def describe(rows: DataFrame, words: int) -> DataFrame:
    """Size, hash and sketch of each text's set, and each task's count of n-grams per cell."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        cells = np.zeros(CELLS, np.uint32)
        for part in chunks(batches):
            gram, starts = ngram_sets(part.column(1).to_pylist(), words)
            cells += np.bincount((gram & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS).astype(np.uint32)
            none = pa.nulls(len(part), pa.int32())
            yield record(_SET, part.column(0), np.diff(starts), set_ids(gram, starts), sketches(gram, starts), none, pa.nulls(len(part), pa.binary()))
        zero = [0] * (CELLS // SLICE)
        yield record(_SET, zero, zero, zero, [b""] * len(zero), list(range(len(zero))), [cells[i : i + SLICE].tobytes() for i in range(0, CELLS, SLICE)])

    return written(rows.mapInArrow(run, ddl(_SET)), "sets")


def cell_counts(described: DataFrame) -> np.ndarray:
    """How many n-grams of the whole corpus fall on each cell; slices are summed apart, CELLS numbers come back."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.uint32).astype(np.int64) for c in table.column("counts").to_pylist())
        return pa.table({"slice": pa.array([table.column("slice")[0].as_py()], pa.int32()), "counts": pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})

    parts = described.where("slice is not null").select("slice", "counts").groupBy("slice").applyInArrow(add, ddl(_SUM)).collect()
    out = np.zeros(CELLS, np.uint32)
    for r in parts:
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], np.uint32)
    return out


def index_entries(rows: DataFrame, cells: np.ndarray, words: int, percent: int) -> DataFrame:
    """The index lists: each set's prefix of its rarest n-grams (by the count of their cell, then by hash), with the
    set's size and the n-gram's position in it as size << 32 | position. Sets that link share one of these."""
    table = rows.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for part in chunks(batches):
            gram, starts = ngram_sets(part.column(1).to_pylist(), words)
            n = np.diff(starts)
            text = np.repeat(np.arange(len(n)), n)
            # stable: n-grams of cells with one count stay in the order of their hashes
            order = np.lexsort((table.value[(gram & np.uint64(CELLS - 1)).astype(np.int64)], text))
            at = np.arange(len(gram)) - starts[:-1][text]
            taken = at < prefix_size(n, percent)[text]
            own = text[taken]
            yield record(_ENTRY, gram[order[taken]].view(np.int64), set_ids(gram, starts)[own], (n[own] << 32) | at[taken])

    return rows.mapInArrow(run, ddl(_ENTRY))


def lists(rows: DataFrame, sets: DataFrame, cells: np.ndarray, words: int, percent: int) -> DataFrame:
    """Entries of every list with two different sets or more, one list for each combination of members.

    Of lists with the same members the one that comes first in the order stays: it has the smallest positions, and a
    pair's first shared n-gram is among the lists that stay.
    """
    entries = index_entries(rows, cells, words, percent)
    # written, so that the join below has an exchange of its own on either side and a hot list's rows can be split
    shared = written(entries.groupBy("token").agg(F.min("s").alias("a"), F.max("s").alias("b")).where("a <> b").select("token"), "shared-tokens")
    entries = written(entries.join(shared, "token", "left_semi").groupBy("token", "s").agg(F.min("at").alias("at")), "lists")
    seeded = F.xxhash64("s", F.lit(1))
    members = entries.groupBy("token").agg(F.bit_xor("s").alias("a"), F.bit_xor(seeded).alias("b"), F.count("*").alias("k"), F.sum(F.col("at").bitwiseAND(F.lit(0xFFFFFFFF))).alias("places"))
    first = members.groupBy("a", "b", "k").agg(F.min_by("token", F.struct("places", "token")).alias("token"))
    return written(entries.join(first.select("token", "k"), "token").join(sets, "s").select("token", "k", "node", "at", "sketch"), "first-lists")


def passing(key: np.ndarray, n: np.ndarray, at: np.ndarray, sketch: np.ndarray, side: np.ndarray | None, comp: np.ndarray | None, percent: int) -> tuple[np.ndarray, ...]:
    """Pairs of one list that may link, with the distance of their sketches.

    Rows are sorted by list, then by size. Neighbours at growing distance are compared while any pair of the list has
    sizes that can link; left out are pairs whose positions leave too few n-grams to share, whose sketches differ in
    too many bits, that are of one component already, or of one side of a grid's pair of blocks.
    """
    left, right, apart = [], [], []
    alive = np.arange(len(key))
    step = 1
    while True:
        alive = alive[alive + step < len(key)]
        alive = alive[(key[alive] == key[alive + step])]
        # sorted by size: once the larger is too large for this row it stays so
        alive = alive[100 * n[alive] >= percent * n[alive + step]]
        if not len(alive):
            break
        a, b = alive, alive + step
        if side is not None:
            ok = side[a] != side[b]
            a, b = a[ok], b[ok]
        if comp is not None:
            ok = comp[a] != comp[b]
            a, b = a[ok], b[ok]
        need = least_shared(n[a], n[b], percent)
        ok = np.minimum(n[a] - at[a], n[b] - at[b]) >= need
        a, b, need = a[ok], b[ok], need[ok]
        for i in range(0, len(a), 1 << 16):
            p, q = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
            bits = np.bitwise_count(sketch[p] ^ sketch[q]).sum(axis=1, dtype=np.int64)
            ok = bits <= n[p] + n[q] - 2 * need[i : i + (1 << 16)]
            left.append(p[ok])
            right.append(q[ok])
            apart.append(bits[ok])
        step += 1
    if not left:
        none = np.zeros(0, np.int64)
        return none, none, none
    return np.concatenate(left), np.concatenate(right), np.concatenate(apart)


def spanning(key: np.ndarray, left: np.ndarray, right: np.ndarray, apart: np.ndarray, sizes: dict[int, int]) -> np.ndarray:
    """Of lists longer than SHORT, the pairs of a smallest spanning forest; of others all pairs."""
    group = key[left]
    short = np.array([sizes[g] <= SHORT for g in group.tolist()], bool)
    chosen = np.flatnonzero(short).tolist()
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    rest = np.flatnonzero(~short)
    for i in rest[np.lexsort((apart[rest], group[rest]))].tolist():
        a, b = root(int(left[i])), root(int(right[i]))
        if a != b:
            parent[a] = b
            chosen.append(i)
    return np.array(chosen, np.int64)


def pairs(blocks: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Pairs to verify, from rows (list, k, node, at, sketch[, side, comp]); a whole list or block is in one task."""
    columns = ["list", "node", "at", "sketch"] + ([] if forest else ["side", "comp"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        held: list[pa.RecordBatch] = []

        def compare(table: pa.Table) -> pa.RecordBatch:
            key, node, at = (table.column(c).to_numpy() for c in ("list", "node", "at"))
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(key), SKETCH)
            side, comp = (None, None) if forest else (table.column("side").to_numpy(), table.column("comp").to_numpy())
            order = np.lexsort((node, at >> 32, key))
            key, node, at, sketch = key[order], node[order], at[order], sketch[order]
            if not forest:
                # one block with itself has one side only: its pairs are told apart by their order
                alone = {k for k, lo, hi in _extremes(table.column("list").to_numpy(), side) if lo == hi}
                side, comp = side[order].astype(np.int64), comp[order]
                own = np.array([k in alone for k in key.tolist()], bool)
                side = np.where(own, np.arange(len(key)) + (1 << 32), side)
            left, right, apart = passing(key, at >> 32, at & 0xFFFFFFFF, sketch, side, comp, percent)
            if forest and len(left):
                ids, count = np.unique(key, return_counts=True)
                some = spanning(key, left, right, apart, dict(zip(ids.tolist(), count.tolist(), strict=True)))
                left, right = left[some], right[some]
            x, y = node[left], node[right]
            return record(_PAIR, np.minimum(x, y), np.maximum(x, y))

        rows = 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= 20_000:
                table = pa.Table.from_batches(held)
                key = table.column("list").to_numpy()
                whole = int(np.searchsorted(key, key[-1]))
                if whole:
                    yield compare(table.slice(0, whole))
                    held = table.slice(whole).combine_chunks().to_batches()
                    rows = len(table) - whole
        if rows:
            yield compare(pa.Table.from_batches(held))

    return blocks.select(*columns).repartition("list").sortWithinPartitions("list").mapInArrow(run, ddl(_PAIR)).where("x <> y").distinct()


def _extremes(key: np.ndarray, value: np.ndarray) -> Iterator[tuple[int, int, int]]:
    order = np.lexsort((value, key))
    key, value = key[order], value[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    last = np.r_[first[1:], len(key)] - 1
    return zip(key[first].tolist(), value[first].tolist(), value[last].tolist(), strict=True)


def verified(candidates: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose whole sets link. A node is the smallest id with its set; its text is read again."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for part in chunks(batches, "a"):
            n = len(part)
            gram, starts = ngram_sets(part.column("a").to_pylist() + part.column("b").to_pylist(), words)
            size = np.diff(starts)
            pair = np.repeat(np.r_[np.arange(n), np.arange(n)], size)
            order = np.lexsort((gram, pair))
            g, p = gram[order], pair[order]
            both = np.bincount(p[1:][(g[1:] == g[:-1]) & (p[1:] == p[:-1])], minlength=n)
            ok = pa.array(both >= least_shared(size[:n], size[n:], percent))
            yield record(_PAIR, part.column("x").filter(ok), part.column("y").filter(ok))

    a = rows.select(F.col("doc_id").alias("x"), F.col("text").alias("a"))
    b = rows.select(F.col("doc_id").alias("y"), F.col("text").alias("b"))
    return candidates.join(a, "x").join(b, "y").select("x", "y", "a", "b").mapInArrow(run, ddl(_PAIR))


def components(links: DataFrame) -> DataFrame:
    """Every linked node with the smallest node of its component.

    Labels shrink to the smallest of the neighbours', then to the label of the label, until none changes; each round
    is written, and hot nodes are summed before they are shuffled.
    """
    edges = written(links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    labels = written(edges.groupBy("x").agg(F.least(F.min("x"), F.min("y")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("x").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("near"))
        low = written(labels.join(near, "x").select("x", "label", F.least("label", "near").alias("low")), "labels")
        jump = low.select(F.col("x").alias("low"), F.col("low").alias("further"))
        new = written(low.join(jump, "low", "left").select("x", "label", F.least("low", F.coalesce("further", "low")).alias("low")), "labels")
        changed = new.where("low <> label").count()
        labels = new.select("x", F.col("low").alias("label"))
        if not changed:
            return labels.select(F.col("x").alias("node"), F.col("label").alias("comp"))


def join_components(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Every row with the size of its n-gram set and the smallest id it reaches by links.

    Two sets link when 100 * intersection >= percent * union. Equal sets are one node from the start. Index lists over
    each set's rarest n-grams are cut into blocks and compared by size, position and sketch; in the first turn a list
    tells a spanning forest of its likely links, which are verified on the whole sets. In the second turn a set takes
    over what its similar sets have answered: only pairs of different components are compared, and all that may link
    are verified. So no link is lost, and a group of copies isn't expanded into pairs.

    A null text, or one without words, has an empty set and links with nothing. A null id counts as the smallest and
    stays null (as the component of the rows it is in, too). Rows that share an id keep their own sets, but lead on to
    each other's links. An empty table
    gives no rows; other columns are not read. Sets are told apart by 64-bit hashes of their n-grams' 64-bit hashes.
    """
    rows = texts(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(_LOWEST)))
    described = describe(rows, words)
    own = described.where("slice is null")
    sets = written(own.where("n > 0").groupBy("s").agg(F.min(F.struct("doc_id", "sketch")).alias("m")).select("s", F.col("m.doc_id").alias("node"), F.col("m.sketch").alias("sketch")), "nodes")
    cells = cell_counts(described)
    found = lists(rows, sets, cells, words, percent)
    shares = F.ceil(F.col("k") / block).cast("int")
    placed = found.withColumn("part", F.pmod(F.xxhash64("node"), shares).cast("int"))
    centre = placed.groupBy("token").agg(F.min("node").alias("centre"))
    spread = placed.where(F.col("k") > block).join(centre, "token").where("node = centre").withColumn("part", F.explode(F.sequence(F.lit(0), shares - 1)))
    blocks = placed.unionByName(spread.select(placed.columns)).dropDuplicates(["token", "part", "node"])
    links = written(verified(written(pairs(blocks.withColumn("list", F.xxhash64("token", "part")), percent, True), "pairs"), rows, words, percent), "first-links")
    comps = components(links)
    known = found.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = known.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    known = known.join(mixed, "token", "left_semi").withColumn("side", F.pmod(F.xxhash64("node"), shares).cast("int"))
    grid = known.withColumn("other", F.explode(F.sequence(F.lit(0), shares - 1))).withColumn("list", F.xxhash64("token", F.least("side", "other"), F.greatest("side", "other")))
    more = written(verified(written(pairs(grid, percent, False), "pairs"), rows, words, percent), "more-links")
    comps = components(links.unionByName(more))
    out = own.join(sets.select("s", "node"), "s", "left").join(comps, "node", "left")
    back = lambda c: F.nullif(c, F.lit(_LOWEST))
    return out.select(back(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), back(F.coalesce("comp", "node", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of one id of each component, the smallest, with all their columns; rows without words are no copies and
    stay. Repeated rows of one id stay or go together."""
    found = join_components(docs, words, percent, id_col, text_col)
    same = found.where("n_shingles > 0 and not (doc_id <=> component_id)").select("doc_id").distinct()
    return docs.alias("d").join(same.alias("s"), F.col(f"d.`{id_col}`").cast("long").eqNullSafe(F.col("s.doc_id")), "left_anti")
