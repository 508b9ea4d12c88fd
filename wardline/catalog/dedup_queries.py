"""Registered queries: token sets, near duplicates, MinHash bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline import settings
from wardline.catalog.inputs import strip_sql, table
from wardline.catalog.registry import query
from wardline.functions.text import token_set
from wardline.operators.dedup import near_dedup, near_duplicate_pairs
from wardline.operators.minhash import PRIME, each_band, minhash_bands, minhash_dedup, permutation_factors

_TOKENS_SQL = f"""
cleaned AS (SELECT doc_id, lower({strip_sql('text')}) AS cleaned FROM documents),
token_sets AS (SELECT doc_id, CASE WHEN cleaned = '' THEN []::VARCHAR[]
  ELSE list_distinct(string_split_regex(cleaned, '\\s+')) END AS tokens FROM cleaned)"""


def greedy_sql(pairs: str, nodes: str, rounds: int = 4) -> str:
    """CTEs that settle (a, b) pairs by "first kept wins"; `kept_n` holds the kept ids of the last round.

    A round keeps the open ids without an open earlier partner. Were the rounds too few, ids would be missing.
    """
    ctes = [f"open_0 AS (SELECT id FROM {nodes})", "kept_0 AS (SELECT id FROM open_0 WHERE false)"]
    for i in range(1, rounds + 1):
        before = f"open_{i - 1}"
        ctes += [
            f"new_{i} AS MATERIALIZED (SELECT id FROM {before} WHERE id NOT IN (SELECT b FROM {pairs} p JOIN {before} o ON p.a = o.id))",
            f"kept_{i} AS MATERIALIZED (SELECT id FROM kept_{i - 1} UNION ALL SELECT id FROM new_{i})",
            f"open_{i} AS MATERIALIZED (SELECT id FROM {before} WHERE id NOT IN (SELECT id FROM new_{i}) "
            f"AND id NOT IN (SELECT b FROM {pairs} p JOIN new_{i} n ON p.a = n.id))",
        ]
    return ", ".join(ctes)


# All pairs that have a token in common, by counting common tokens.
_NEAR_SQL = f"""{_TOKENS_SQL},
tokens AS MATERIALIZED (SELECT doc_id, unnest(tokens) AS token, len(tokens) AS n FROM token_sets),
near AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared, any_value(x.n + y.n) - count(*) AS total
  FROM tokens x JOIN tokens y ON x.token = y.token AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id
  HAVING 100 * count(*) >= {settings.JACCARD_PERCENT} * (any_value(x.n + y.n) - count(*))),
nodes AS (SELECT doc_id AS id FROM documents)"""


def near_sql(rows: str, key: str) -> str:
    """The same CTEs over other rows."""
    return _NEAR_SQL.replace("documents", rows).replace("doc_id", key)


@query("token_set", f"""
WITH {_TOKENS_SQL} SELECT doc_id, len(tokens) AS n, array_to_string(list_sort(tokens), ' ') AS tokens FROM token_sets""")
def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.col("t")
    return table(spark, sf_dir, "documents").select("doc_id", token_set("text").alias("t")).select(
        "doc_id", F.size(tokens).cast("bigint").alias("n"), F.array_join(F.array_sort(tokens), " ").alias("tokens")
    )


@query("near_dedup", f"WITH {_NEAR_SQL}, {greedy_sql('near', 'nodes')} SELECT id AS doc_id FROM kept_4")
def near_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), order_cols=["doc_id"]).select("doc_id")


@query("near_dedup_hot_keys", f"WITH {_NEAR_SQL}, {greedy_sql('near', 'nodes')} SELECT id AS doc_id FROM kept_4")
def near_deduplicated_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with so low a limit that most shared keys count as hot."""
    return near_dedup(table(spark, sf_dir, "documents"), order_cols=["doc_id"], hot_limit=2).select("doc_id")


@query("near_duplicate_pairs", f"""
WITH {_NEAR_SQL}, {greedy_sql('near', 'nodes')}
SELECT b AS duplicate, min(a) AS kept, arg_min(shared, a)::INTEGER AS shared, arg_min(total, a)::INTEGER AS total
FROM near WHERE a IN (SELECT id FROM kept_4) GROUP BY b""")
def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_pairs(table(spark, sf_dir, "documents"), order_cols=["doc_id"])


_FACTORS = ", ".join(f"({i}, {a}::BIGINT, {b}::BIGINT)" for i, (a, b) in enumerate(permutation_factors()))
_BANDS_SQL = f"""{_TOKENS_SQL},
factors AS (SELECT * FROM (VALUES {_FACTORS}) v(i, a, b)),
hashes AS MATERIALIZED (SELECT DISTINCT doc_id, ('0x' || substr(md5(token), 1, 8))::BIGINT % {PRIME} AS h
  FROM (SELECT doc_id, unnest(tokens) AS token FROM token_sets)),
minima AS (SELECT d.doc_id, i, coalesce(min((a * h + b) % {PRIME}), {PRIME}) AS m
  FROM (SELECT doc_id, i, a, b FROM documents, factors) d LEFT JOIN hashes USING (doc_id) GROUP BY d.doc_id, i),
bands AS MATERIALIZED (SELECT doc_id, i // {settings.MINHASH_ROWS} AS band,
  md5((i // {settings.MINHASH_ROWS})::VARCHAR || ',' || string_agg(m::VARCHAR, ',' ORDER BY i)) AS digest
  FROM minima GROUP BY doc_id, i // {settings.MINHASH_ROWS})"""


@query("minhash_candidates", f"WITH {_BANDS_SQL} SELECT digest AS band, count(*) AS n, min(doc_id) AS first_doc FROM bands GROUP BY digest")
def minhash_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bands with the number of their rows: rows sharing a band are candidates."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bands = minhash_bands(docs, token_set("text")).select("doc_id", each_band().alias("band"))
    return bands.groupBy("band").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("minhash_dedup", f"""
WITH {_BANDS_SQL}, band_pairs AS MATERIALIZED (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM bands x JOIN bands y
  ON x.digest = y.digest AND x.doc_id < y.doc_id), nodes AS (SELECT doc_id AS id FROM documents),
{greedy_sql('band_pairs', 'nodes')} SELECT id AS doc_id FROM kept_4""")
def minhash_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(table(spark, sf_dir, "documents"), order_cols=["doc_id"]).select("doc_id")
