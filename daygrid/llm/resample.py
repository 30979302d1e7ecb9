"""Importance resampling towards a target distribution of hashed n-grams, from running CRCs of each text."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from daygrid.llm.common import alone, chunks, ddl, fields, record, texts, written

#: Reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Lengths in bytes whose shift is one table; longer ones are taken apart into powers of two.
SHORT = 64
#: Words in 0-9, a-z after lower-casing, and all beyond ASCII; every other byte separates.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTS = fields(bucket=pa.int32(), n=pa.int64())
_WEIGHTS = fields(doc_id=pa.int64(), n_words=pa.int64(), n_features=pa.int64(), weight=pa.int64())


@cache
def byte_table() -> np.ndarray:
    """CRC register after one byte, by the register's low byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(POLYNOMIAL), c >> 1)
    return c


def mapped(tables: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    """A linear map of registers, given as four tables by byte."""
    return tables[0][crcs & 255] ^ tables[1][(crcs >> 8) & 255] ^ tables[2][(crcs >> 16) & 255] ^ tables[3][crcs >> 24]


def as_tables(columns: np.ndarray) -> np.ndarray:
    """Four tables of 256 from the images of the 32 single bits."""
    out = np.zeros((4, 256), np.uint32)
    for bit, image in enumerate(columns):
        out[bit // 8] ^= np.where(np.arange(256) >> (bit % 8) & 1, image, 0).astype(np.uint32)
    return out


@cache
def shifts() -> tuple[np.ndarray, np.ndarray]:
    """Maps that append zero bytes to a register: by 0 to SHORT - 1 of them, and by every power of two."""
    one = lambda c: byte_table()[c & 255] ^ (c >> 8)
    images, short = np.uint32(1) << np.arange(32, dtype=np.uint32), []
    for _ in range(SHORT):
        short.append(as_tables(images))
        images = one(images)
    powers = [short[1]]
    for _ in range(40):
        powers.append(as_tables(mapped(powers[-1], mapped(powers[-1], np.uint32(1) << np.arange(32, dtype=np.uint32)))))
    return np.stack(short), np.stack(powers)


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each register moved on by its own number of zero bytes."""
    short, powers = shifts()
    low = lengths % SHORT
    out = short[low, 0, crcs & 255] ^ short[low, 1, (crcs >> 8) & 255] ^ short[low, 2, (crcs >> 16) & 255] ^ short[low, 3, crcs >> 24]
    for k in range(6, int(lengths.max(initial=0)).bit_length()):
        at = np.flatnonzero(lengths >> k & 1)
        out[at] = mapped(powers[k], out[at])
    return out


def prefixes(value: str) -> tuple[list[int], list[int]]:
    """Lengths of a text's words, and the running CRC at the end of each in the text with single spaces."""
    words = value.encode("utf-8", "replace").translate(_FOLD).split()
    if not words:
        return [], []
    crc32 = zlib.crc32
    return [*map(len, words)], [*accumulate([b" " + w for w in words[1:]], lambda c, w: crc32(w, c), initial=crc32(words[0]))]


def grams(values: list[str], least: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC of every run of `least` to `most` words of each text, the text's number, and the number of words by text.

    The CRC of a run is that at its end, without what the CRC before it has become by there: crc(AB) is crc(A) moved on
    by len(B) bytes, xor crc(B).
    """
    each = [prefixes(v) for v in values]
    n_words = np.array([len(s) for s, _ in each], np.int64)
    sizes = np.fromiter((x for s, _ in each for x in s), np.int64, n_words.sum())
    ends = np.fromiter((x for _, e in each for x in e), np.uint32, n_words.sum())
    doc = np.repeat(np.arange(len(values)), n_words)
    first = np.repeat(np.cumsum(n_words) - n_words, n_words)
    at = np.arange(len(sizes)) - first
    # the register where a word begins: after the space that follows the word before; nothing comes before the first
    before = np.zeros(len(sizes), np.uint32)
    register = ~ends[:-1]
    before[1:] = ~(byte_table()[(register ^ 32) & 255] ^ (register >> 8))
    before[at == 0] = 0
    total = np.r_[0, np.cumsum(sizes + 1)]
    codes, owners = [], []
    for n in range(least, most + 1):
        k = np.flatnonzero(at + n <= n_words[doc]) if n > 1 else np.arange(len(sizes))
        length = total[k + n] - total[k] - 1
        codes.append(ends[k + n - 1] ^ shifted(before[k], length))
        owners.append(doc[k])
    return (np.concatenate(codes), np.concatenate(owners), n_words) if codes else (np.empty(0, np.uint32), np.empty(0, np.int64), n_words)


def bucket_counts(rows: DataFrame, least: int, most: int, buckets: int) -> list[int]:
    """How often every bucket occurs over all rows; a task sends one number a bucket, and the driver gets one a bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        counts = np.zeros(buckets, np.int64)
        for part in chunks(batches):
            codes = grams(part.column("text").to_pylist(), least, most)[0]
            counts += np.bincount(codes % np.uint32(buckets), minlength=buckets)
        there = np.flatnonzero(counts)
        yield record(_COUNTS, there.astype(np.int32), counts[there])

    out = [0] * buckets
    for bucket, n in rows.mapInArrow(run, ddl(_COUNTS)).groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: list[int], target: list[int]) -> np.ndarray:
    """What a feature of each bucket adds: 1000 times the log of its smoothed share in the target over that in the corpus."""
    s, t, buckets = np.array(corpus, np.float64), np.array(target, np.float64), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(rows: DataFrame, gain: np.ndarray, least: int, most: int) -> DataFrame:
    """Number of words and features, and the floored mean gain, of every text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for part in chunks(batches):
            codes, doc, n_words = grams(part.column("text").to_pylist(), least, most)
            n = np.bincount(doc, minlength=part.num_rows)
            total = np.zeros(part.num_rows, np.int64)
            np.add.at(total, doc, gain[codes % np.uint32(len(gain))])
            yield record(_WEIGHTS, part.column("doc_id"), n_words, n, total // np.maximum(n, 1))

    return rows.mapInArrow(run, ddl(_WEIGHTS))


def chance(seed: int, id_col: str = "doc_id") -> Column:
    """Gumbel noise by a document's id, in thousandths; a null id counts as the empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def places(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with their place (from 0) in a global order: sorted ranges, each moved on by the rows of those before it."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranged = written(ranged, "ranged")
    part = F.shiftrightunsigned("at", 33)
    sizes = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    # one row a range: their number is that of the shuffle's partitions
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("part", earlier.alias("start")))
    return ranged.join(starts, part == F.col("part")).withColumn("place", F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "start", "at")


def resample(docs: DataFrame, target: DataFrame, least: int = 1, most: int = 1, buckets: int = 10_000, min_words: int = 20, percent: int = 10, seed: int = 2024,
             id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Weight, score and rank of every document for a draw without replacement (Gumbel top-k) towards the target texts.

    A document's features are its runs of `least` to `most` words, hashed into buckets. Of the documents with at least
    `min_words` words, `percent` in a hundred are drawn, those with the highest scores; ties go to the smaller id. Any
    number of documents is drawn: ranks come from sorted ranges and their sizes, never from one window.

    A null or empty text has no features and weight 0; a null id draws its noise from an empty id and comes last in ties.
    Repeated rows are kept and drawn one by one, a long text is a chunk of its own, an empty table gives no rows, an empty
    target no features to prefer. Other columns are not read.
    """
    rows = texts(docs, id_col, text_col)
    wanted = texts(target.select(F.lit(0).alias("doc_id"), F.col(f"`{target_col}`").alias("text")))
    gain = gains(bucket_counts(rows, least, most, buckets), bucket_counts(wanted, least, most, buckets))
    scored = written(weighed(rows, gain, least, most).withColumn("score", F.col("weight") + chance(seed)), "scores")
    fit = scored.where(F.col("n_words") >= min_words)
    quota = percent * fit.count() // 100
    placed = places(fit, [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")])
    rank = F.when(F.col("place") < quota, F.col("place") + 1)
    out = placed.withColumn("rank", rank).drop("place").unionByName(scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def draw(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows drawn, with all their columns as they are; ids have to be unique and not null for this."""
    id_col = how.get("id_col", "doc_id")
    drawn = resample(docs, target, **how).where(F.col("rank").isNotNull()).select(F.col("doc_id").alias("_drawn"))
    return docs.join(drawn, F.col(f"`{id_col}`") == F.col("_drawn"), "left_semi")
