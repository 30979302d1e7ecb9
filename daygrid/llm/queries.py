"""Registered queries of the document operators: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from daygrid.llm import bpe, fingerprints, jaccard, language, licences, lm, packing, quality, repair, resample, sharding, substrings, topk
from daygrid.llm.common import documents, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


#: Production parameters of the sharding query: 64 output shards in a table of about a thousand slots each.
SHARDS, SLOTS = [f"shard-{i:03d}" for i in range(64)], 65_537


def _sharding_sql() -> str:
    owners = ", ".join(map(str, sharding.lookup_table(SHARDS, SLOTS)))
    return f"""WITH placed AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SLOTS} AS INT) AS slot FROM documents),
    owners AS (SELECT [{owners}] AS list)
    SELECT doc_id, slot, CAST(list[slot + 1] AS INT) AS shard FROM placed, owners"""


@query("op2_sharding", _sharding_sql())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(documents(spark, sf_dir).select("doc_id"), ["doc_id"], SHARDS, SLOTS)


@query("op3_bpe_encode_decode")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query("op4_lm_scoring")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.log_likelihood(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


#: Words of every text; row_number() keeps the first of equal windows.
_REPEATS_SQL = """WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
    windows AS (SELECT doc_id, start, array_to_string(list_slice(words, start, start + 19), ' ') AS win
                FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS start FROM docs)),
    later AS (SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY win ORDER BY doc_id, start) AS n FROM windows) WHERE n > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS k FROM later),
    each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM docs),
    kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS text FROM each ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM docs LEFT JOIN kept USING (doc_id)"""


@query("op5_substring_dedup", _REPEATS_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(documents(spark, sf_dir))


@query("op6_licence_scans")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(documents(spark, sf_dir))


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(documents(spark, sf_dir))


_JACCARD_SQL = """WITH RECURSIVE docs AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
    sets AS (SELECT DISTINCT doc_id, array_to_string(list_slice(words, k, k + 3), ' ') AS gram
             FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS k FROM docs WHERE len(words) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM sets a JOIN sets b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS (SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * shared.n >= 85 * (a.n + b.n - shared.n)),
    reach AS (SELECT doc_id, doc_id AS other FROM docs UNION SELECT reach.doc_id, y FROM reach JOIN links ON other = x)
    SELECT docs.doc_id, coalesce(sizes.n, 0) AS n_shingles, component_id
    FROM docs LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)"""


@query("op8_ngram_jaccard_join", _JACCARD_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(documents(spark, sf_dir))


@query("op9_fingerprints")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


@query("op10_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


_TOP_SQL = """WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), FALSE))) = len(embedding)),
    scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM scored QUALIFY rank <= 5"""


@query("op11_exact_top_k", _TOP_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


_RESAMPLE_SQL = """WITH steps AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
    words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words, n
        FROM (SELECT doc_id, text, row_number() OVER () AS n FROM documents UNION ALL SELECT NULL, text, 0 FROM benchmark)),
    each AS (SELECT n, unnest(words) AS w FROM words),
    codes AS (SELECT w, xor(list_reduce(list_transform(range(0, len(h), 2), lambda i: CAST('0x' || substr(h, i + 1, 2) AS BIGINT)), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1]), 4294967295), 4294967295) % 10000 AS bucket
        FROM (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM each)), steps),
    counts AS (SELECT bucket, count(*) FILTER (n > 0) AS s, count(*) FILTER (n = 0) AS t FROM each JOIN codes USING (w) GROUP BY 1),
    totals AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM counts),
    gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * (s_all + 10000) / (CAST(s + 1 AS DOUBLE) * (t_all + 10000)))) AS BIGINT) AS g FROM counts, totals),
    weights AS (SELECT n, CAST(floor(CAST(sum(g) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM each JOIN codes USING (w) JOIN gain USING (bucket) GROUP BY 1),
    scored AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
        FROM words LEFT JOIN weights USING (n) WHERE n > 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS fit FROM scored)
    SELECT doc_id, n_features AS n_words, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * fit // 100 THEN place END AS rank FROM ranked"""


@query("op12_importance_resampling", _RESAMPLE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query("op13_conversation_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.Repair(repair.damaged(repair.plain(table(spark, sf_dir, "conversations")))).report()
