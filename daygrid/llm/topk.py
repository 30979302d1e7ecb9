"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from daygrid.llm.common import ddl, fields, prepare, record

#: Components (rows times dimensions) that a cell's lists hold, and queries that a cell answers.
CELL_COMPONENTS, CELL_QUERIES = 1 << 19, 4096
#: Entries first read of each list; every further reading is twice as deep.
FIRST = 16
_LAST = 2**63 - 1
_OUT = fields(query_id=pa.int64(), query=pa.int64(), vec_id=pa.int64(), score=pa.int64())


class Lists:
    """Vectors of a cell with one list per dimension, sorted by its component; rows are in order of id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by_id], vectors[by_id]
        self.order = np.argsort(self.vectors, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(self.vectors, self.order, axis=0)
        self.real = self.vectors.astype(np.float64)
        self.largest = np.abs(self.real).max(initial=0.0)
        self.read = 0

    def scores(self, rows: np.ndarray, query: np.ndarray, real: np.ndarray) -> np.ndarray:
        """Exact inner products: in doubles where every partial sum is a whole number below 2^53, else in Python's
        integers, held to 64 bits at the end."""
        if self.largest * np.abs(real).sum() < 2.0**53:
            return (self.real[rows] @ real).astype(np.int64)
        exact = self.vectors[rows].astype(object) @ query.astype(object)
        return np.array([min(max(s, -_LAST - 1), _LAST) for s in exact], np.int64)

    def bound(self, depth: int, up: np.ndarray, down: np.ndarray, query: np.ndarray) -> int:
        """The most that a row can score that no list has shown down to `depth`."""
        n = len(self.ids)
        top = self.sorted[n - depth, up].astype(object) @ query[up].astype(object) if len(up) else 0
        return top + (self.sorted[depth - 1, down].astype(object) @ query[down].astype(object) if len(down) else 0)

    def top(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but those of id `own`, ties by id.

        The lists are read side by side, each from the end that is best for the query's sign; every row met is scored
        whole. When the bound on unseen rows is below the k-th score, no unseen row can be among the best, nor tie.
        """
        n, real = len(self.ids), query.astype(np.float64)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        allowed = self.ids != own
        best, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        if not len(up) and not len(down):
            best = np.flatnonzero(allowed)[:k]
            return self.ids[best], np.zeros(len(best), np.int64)
        depth, step = 0, FIRST
        while depth < n:
            to = min(n, depth + step)
            met = np.zeros(n, bool)
            met[self.order[n - to : n - depth, up]] = True
            met[self.order[depth:to, down]] = True
            fresh = np.flatnonzero(met & allowed)
            allowed[fresh] = False
            self.read += len(fresh)
            best, scores = np.r_[best, fresh], np.r_[scores, self.scores(fresh, query, real)]
            if len(best) > k:
                least = np.partition(scores, len(scores) - k)[len(scores) - k]
                best, scores = best[scores >= least], scores[scores >= least]
                first = np.lexsort((best, ~scores))[:k]
                best, scores = best[first], scores[first]
            if len(best) == k and self.bound(to, up, down, query) < scores.min():
                break
            depth, step = to, step * 2
        first = np.lexsort((best, ~scores))
        return self.ids[best[first]], scores[first]


def matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """A list column as a matrix; a shorter vector's missing components are zero."""
    flat = column.flatten().to_numpy()
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), max(width, sizes.max(initial=0))), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def stretched(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m


def answers(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """For rows sorted by cell, candidates (kind 0) before queries (kind 1): each query's k best of its cell."""
    cell, waiting, lists = None, [], None
    for batch in batches:
        places = np.stack([batch.column(c).to_numpy() for c in ("block", "turn", "kind")])
        cut = [0, *(np.flatnonzero((np.diff(places) != 0).any(axis=0)) + 1), batch.num_rows]
        for a, b in zip(cut, cut[1:], strict=False):
            if a == b:
                continue
            here, kind = tuple(places[:2, a]), places[2, a]
            if here != cell:
                cell, waiting, lists = here, [], None
            part = batch.slice(a, b - a)
            ids, vectors = part.column("vec_id").to_numpy(), matrix(part.column("vector"))
            if kind == 0:
                waiting.append((ids, vectors))
                continue
            if not waiting:
                continue
            if lists is None:
                width = max(v.shape[1] for _, v in waiting)
                lists = Lists(np.concatenate([i for i, _ in waiting]), np.concatenate([stretched(v, width) for _, v in waiting]))
            width = lists.vectors.shape[1]
            keys, found = part.column("query").to_numpy(), []
            for own, q in zip(ids, stretched(vectors, width)[:, :width], strict=True):
                found.append(lists.top(own, q, k))
            sizes = [len(i) for i, _ in found]
            yield record(_OUT, np.repeat(ids, sizes), np.repeat(keys, sizes), np.concatenate([i for i, _ in found]), np.concatenate([s for _, s in found]))


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """Usable vectors as whole numbers, floor(scale * x) in doubles; a component beyond 64 bits is the nearest there is."""
    x = F.col(f"`{vector_col}`")
    usable = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.coalesce(usable, F.lit(False))).select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST)).alias("vec_id"), F.transform(x, lambda c: F.floor(scale * c.cast("double"))).alias("vector"))


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0,
          cell_components: int = CELL_COMPONENTS, cell_queries: int = CELL_QUERIES) -> DataFrame:
    """The k best rows (query_id, rank, vec_id, score) for each row whose id is divisible by `every`.

    Candidates are cut into blocks of bounded size and queries into turns of bounded size; a block and a turn meet in
    one cell, whose lists the threshold algorithm reads, and only k rows a query leave the cell. Rows are dealt by a hash
    of their place in the table, so no id and no vector, however frequent, makes a cell larger.

    Vectors that are null or hold a null or non-finite component take no part; an empty vector scores 0 and a shorter
    one's missing components count as zero. A query's own row is every row of its id. A repeated row is listed as often
    as it stands; equal query rows are one query, and different vectors under one id are queries of their own. A null id
    is no query and comes last in ties. Fewer candidates than k give fewer rows, an empty table gives none, and other
    columns are not read.
    """
    prepare(vectors.sparkSession)
    rows = whole_numbers(vectors, id_col, vector_col, scale)
    is_query = (F.col("vec_id") % every == 0) & (F.col("vec_id") != _LAST)
    n, asked, width = rows.agg(F.count("*"), F.count_if(is_query), F.max(F.size("vector"))).first()
    blocks = -(-n // max(cell_components // max(width or 1, 1), 1)) or 1
    turns = -(-asked // cell_queries) or 1
    queries = rows.where(is_query).dropDuplicates(["vec_id", "vector"])
    every_block, every_turn = (F.explode(F.sequence(F.lit(0), F.lit(x - 1))) for x in (blocks, turns))
    candidates = rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")).select("block", every_turn.alias("turn"), F.lit(0).alias("kind"), "vec_id", F.lit(0).cast("long").alias("query"), "vector")
    asking = queries.withColumn("turn", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(turns)).cast("int")).select(every_block.alias("block"), "turn", F.lit(1).alias("kind"), "vec_id", F.xxhash64("vector").alias("query"), "vector")
    cells = candidates.unionByName(asking).repartition("block", "turn").sortWithinPartitions("block", "turn", "kind")
    found = cells.mapInArrow(lambda batches: answers(batches, k), ddl(_OUT))
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.nullif("vec_id", F.lit(_LAST)).alias("vec_id"), "score")
