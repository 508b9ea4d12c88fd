"""Registered queries: sources, projections, sampling, splitting, writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline import settings
from wardline.catalog.inputs import (
    ALL_EXAMPLES_SQL, EXAMPLE_COLUMNS, PROMPTS_SQL, SPECS, benchmark_source, examples_sql, prompts, raw_sources,
    strip_sql, table,
)
from wardline.catalog.dedup_queries import greedy_sql, near_sql
from wardline.catalog.registry import query
from wardline.functions.text import long_enough, strip_text
from wardline.operators import corpus as c
from wardline.operators import sampling as s
from wardline.operators.evaluation import label_distribution, source_distribution
from wardline.plans.prepare import PrepareOptions, deduplicated, prepare_corpus
from wardline.sources import readers, writers
from wardline.workdir import new_path

EXAMPLES = ", ".join(EXAMPLE_COLUMNS)


def examples(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return c.normalise(raw_sources(spark, sf_dir)[name], SPECS[name], list(SPECS).index(name)).drop("source_rank")


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.union_sources(raw_sources(spark, sf_dir)).drop("source_rank")


def benchmark_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.normalise(benchmark_source(spark, sf_dir), SPECS["rogue_benchmark"]).drop("source_rank")


# --- Sources -------------------------------------------------------------------------------------------
@query("scan_splits", """
SELECT doc_id AS row_id, text, 'train' AS split FROM documents UNION ALL SELECT item_id, text, 'test' FROM benchmark""")
def scan_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.scan_splits({
        "train": table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text"),
        "test": table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row_id"), "text"),
    })


_REGISTRY = (
    c.SourceSpec("docs", "text", id_col="doc_id", label=0),
    c.SourceSpec("site", "html", id_col="page_id", label=1, attack_types=("jailbreak", "jailbreak")),
    c.SourceSpec("held_out", "text", id_col="item_id", label=1, include_in_training=False),
    c.SourceSpec("absent", "text", label=1),
)


@query("source_registry", f"""
WITH rows AS (SELECT {strip_sql('text')} AS text, 0 AS label, 'docs' AS source, 'benign' AS attack_type FROM documents
  UNION ALL SELECT {strip_sql('html')}, 1, 'site', 'jailbreak' FROM pages)
SELECT * FROM rows WHERE length(text) >= 5""")
def source_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four registered sources: two read, one not for training, one whose path does not exist."""
    paths = {
        "docs": {"train": f"{sf_dir}/documents.parquet"},
        "site": {"train": f"{sf_dir}/pages.parquet"},
        "held_out": {"test": f"{sf_dir}/benchmark.parquet"},
        "absent": {"train": f"{sf_dir}/no_such_table.parquet"},
    }
    return c.to_schema(readers.source_registry(spark, paths, _REGISTRY))


@query("resolve_columns", f"WITH {examples_sql('neuralchemy')} SELECT {EXAMPLES} FROM examples")
def resolve_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neither configured column exists; text and label are found by part of their names."""
    raw = raw_sources(spark, sf_dir)["neuralchemy"]
    assert c.resolve_columns(raw, SPECS["neuralchemy"]) == ("user_Prompt", "Target_label")
    return examples(spark, sf_dir, "neuralchemy")


# --- Projections and filters -----------------------------------------------------------------------------
def _register_examples(query_name: str, source: str) -> None:
    @query(query_name, f"WITH {examples_sql(source)} SELECT {EXAMPLES} FROM examples")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return examples(spark, sf_dir, source)


_register_examples("conversation_user_turns", "wildchat")
_register_examples("prompter_messages", "oasst1")
_register_examples("labelled_examples", "neuralchemy")
_register_examples("all_positive_examples", "advbench")
_register_examples("split_labelled_examples", "tensor_trust")


@query("eval_only_examples", f"WITH {examples_sql('rogue_benchmark')} SELECT {EXAMPLES} FROM examples")
def eval_only_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_rows(spark, sf_dir)


@query("filter_toxic", """
SELECT doc_id, 'column' AS flags FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS DISTINCT FROM 1
UNION ALL SELECT doc_id, 'table' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def filter_toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags as a column of the rows, and as a table of their own."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    by_column = c.filter_toxic(docs.join(labels, "doc_id", "left")).select("doc_id", F.lit("column").alias("flags"))
    return by_column.unionByName(
        c.filter_toxic_by_labels(docs, labels, "doc_id").withColumn("flags", F.lit("table"))
    )


@query("normalize_label", """
WITH raw AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'Injection' WHEN 1 THEN ' injection' WHEN 2 THEN 'INJECTED' WHEN 3 THEN '1'
    WHEN 4 THEN 'malicious' WHEN 5 THEN 'Attack' WHEN 6 THEN 'benign' END AS word, (doc_id % 30) / 10::DOUBLE - 0.5 AS number
  FROM documents)
SELECT doc_id, CASE WHEN word IS NULL THEN NULL WHEN lower(word) IN ('1', 'injection', 'injected', 'malicious', 'attack') THEN 1
    ELSE 0 END AS label,
  CASE WHEN word IS NULL THEN NULL WHEN lower(word) IN ('1', 'injection', 'malicious', 'attack') THEN 1 ELSE 0 END AS eval_label,
  trunc(number)::INTEGER AS numeric_label FROM raw""")
def normalize_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ["Injection", " injection", "INJECTED", "1", "malicious", "Attack", "benign", None]
    doc = F.col("doc_id")
    raw = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.element_at(F.array(*[F.lit(w) for w in words]), (doc % 8 + 1).cast("int")).alias("word"),
        (doc % 30 / F.lit(10.0) - 0.5).alias("number"),
    )
    return raw.select(
        "doc_id",
        c.normalize_label(raw, "word", SPECS["neuralchemy"].positive_words).alias("label"),
        c.normalize_label(raw, "word", SPECS["rogue_benchmark"].positive_words).alias("eval_label"),
        c.normalize_label(raw, "number", ()).alias("numeric_label"),
    )


_PADDED = "chr(160) || chr(9) || text || chr(10) || chr(12288) || ' ' || chr(28)"


@query("strip_text", f"SELECT doc_id, {strip_sql('(' + _PADDED + ')')} AS text FROM documents")
def stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit("\xa0\t"), F.col("text"), F.lit("\n　 \x1c"))
    return table(spark, sf_dir, "documents").select("doc_id", strip_text(padded).alias("text"))


@query("min_length_filter", f"SELECT doc_id FROM documents WHERE length({strip_sql('text')}) >= 5")
def min_length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(long_enough(strip_text("text"))).select("doc_id")


@query("to_schema", f"WITH {ALL_EXAMPLES_SQL} SELECT text, label, source, attack_type FROM examples")
def to_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.to_schema(training_rows(spark, sf_dir))


@query("eval_only_guard", f"WITH {ALL_EXAMPLES_SQL} SELECT row_key FROM examples")
def eval_only_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.eval_only_guard(training_rows(spark, sf_dir)).select("row_key")


@query("union_sources", f"WITH {ALL_EXAMPLES_SQL} SELECT {EXAMPLES} FROM examples")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_rows(spark, sf_dir)


_UNIQUE_SQL = f"{near_sql('examples', 'row_key')}, {greedy_sql('near', 'nodes', 6)}"


@query("dedup_toggle", f"""
WITH {ALL_EXAMPLES_SQL}, {_UNIQUE_SQL} SELECT row_key, row_key IN (SELECT id FROM kept_6) AS kept_when_on FROM examples""")
def dedup_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows, as they are with the toggle off, and whether they stay with it on."""
    rows = training_rows(spark, sf_dir)
    on = deduplicated(rows, PrepareOptions()).select("row_key", F.lit(True).alias("kept"))
    off = deduplicated(rows, PrepareOptions(dedup="off")).select("row_key")
    return off.join(on, "row_key", "left").select("row_key", F.coalesce("kept", F.lit(False)).alias("kept_when_on"))


# --- Counts ------------------------------------------------------------------------------------------------
@query("label_distribution", f"WITH {ALL_EXAMPLES_SQL} SELECT label, count(*) AS n FROM examples GROUP BY label")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_distribution(training_rows(spark, sf_dir))


@query("source_distribution", f"WITH {ALL_EXAMPLES_SQL} SELECT source, count(*) AS n FROM examples GROUP BY source")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_distribution(training_rows(spark, sf_dir))


# --- Sampling ------------------------------------------------------------------------------------------------
def draw_sql(purpose: str) -> str:
    return f"md5('{settings.SEED}|{purpose}|' || row_key)"


@query("sample_k", f"""
WITH {ALL_EXAMPLES_SQL} SELECT row_key FROM examples ORDER BY {draw_sql('sample')} LIMIT 300""")
def sample_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.sample_k(training_rows(spark, sf_dir).select("row_key"), 300)


@query("cap_training_rows", f"""
WITH {ALL_EXAMPLES_SQL} SELECT row_key, label FROM examples ORDER BY {draw_sql('sample')} LIMIT 1000""")
def cap_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.cap_training_rows(training_rows(spark, sf_dir), 1000).select("row_key", "label")


# One half benign, not the default share: so that some benign rows go.
_BALANCED_SQL = f"""
sizes AS (SELECT count(*) FILTER (label = 1) AS positives FROM examples),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {draw_sql('balance')}) AS place FROM examples),
balanced AS (SELECT {EXAMPLES} FROM ranked, sizes WHERE positives = 0 OR label = 1
  OR (label = 0 AND place <= trunc(positives * 0.5::DOUBLE / (1.0::DOUBLE - 0.5::DOUBLE))))"""


def balanced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.balance_classes(training_rows(spark, sf_dir), benign_share=0.5)


@query("balance_classes", f"WITH {ALL_EXAMPLES_SQL}, {_BALANCED_SQL} SELECT row_key, label FROM balanced")
def balance_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_rows(spark, sf_dir).select("row_key", "label")


_DEFAULT_BALANCE_SQL = _BALANCED_SQL.replace("0.5::DOUBLE", "0.8::DOUBLE")


@query("balance_classes_default", f"""
WITH {examples_sql('neuralchemy')}, {_DEFAULT_BALANCE_SQL} SELECT row_key, label FROM balanced""")
def balance_classes_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default share on a source with few positives, where it does remove benign rows."""
    return s.balance_classes(examples(spark, sf_dir, "neuralchemy")).select("row_key", "label")


@query("union_classes", f"WITH {ALL_EXAMPLES_SQL}, {_BALANCED_SQL} SELECT row_key, label, source FROM balanced")
def union_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn benign rows and all positives put together from two tables."""
    rows = training_rows(spark, sf_dir)
    kept_benign = balanced_rows(spark, sf_dir).where("label = 0")
    return s.union_classes(kept_benign, rows.where("label = 1")).select("row_key", "label", "source")


@query("shuffle_rows", f"""
WITH {ALL_EXAMPLES_SQL} SELECT row_key, {draw_sql('shuffle')} AS draw FROM examples""")
def shuffle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training_rows(spark, sf_dir).select("row_key")
    return s.shuffle_rows(rows).withColumn("draw", s.sampling_key("row_key", purpose="shuffle"))


SPLIT_SQL = f"""
sizes_by_label AS (SELECT label, count(*) AS n FROM examples GROUP BY label),
total AS (SELECT sum(n) AS total, sum(n) - ceil((1.0::DOUBLE - 0.85::DOUBLE) * sum(n)) AS train FROM sizes_by_label),
shares AS (SELECT label, n, n / total::DOUBLE * train AS share, train FROM sizes_by_label, total),
floors AS (SELECT *, floor(share) AS whole, row_number() OVER (ORDER BY share - floor(share) DESC, label) AS rank FROM shares),
quotas AS (SELECT label, n - whole - CASE WHEN rank <= train - (SELECT sum(whole) FROM floors) THEN 1 ELSE 0 END AS quota FROM floors),
placed AS (SELECT examples.*, row_number() OVER (PARTITION BY label ORDER BY {draw_sql('split')}) AS place FROM examples),
parts AS (SELECT placed.*, CASE WHEN place <= quota THEN 'eval' ELSE 'train' END AS part FROM placed JOIN quotas USING (label))"""


@query("stratified_split", f"WITH {ALL_EXAMPLES_SQL}, {SPLIT_SQL} SELECT row_key, label, part FROM parts")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.stratified_split(training_rows(spark, sf_dir)).select("row_key", "label", "part")


_UNLABELLED = "row_key LIKE '%7a0'"


@query("stratified_split_unlabelled", f"""
WITH {ALL_EXAMPLES_SQL.replace('examples AS', 'given AS', 1)},
examples AS (SELECT * REPLACE (CASE WHEN {_UNLABELLED} THEN NULL ELSE label END AS label) FROM given),
{SPLIT_SQL.replace('JOIN quotas USING (label)', 'JOIN quotas ON placed.label IS NOT DISTINCT FROM quotas.label')}
SELECT row_key, label, part FROM parts""")
def stratified_split_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a label are a class of their own."""
    label = F.when(~F.expr(_UNLABELLED), F.col("label"))
    return s.stratified_split(training_rows(spark, sf_dir).withColumn("label", label)).select("row_key", "label", "part")


@query("prepare_corpus", f"""
WITH {ALL_EXAMPLES_SQL.replace('examples AS', 'given AS', 1)},
labelled AS (SELECT * FROM given WHERE NOT {_UNLABELLED}),
{near_sql('labelled', 'row_key')}, {greedy_sql('near', 'nodes', 6)},
examples AS (SELECT * FROM labelled WHERE row_key IN (SELECT id FROM kept_6)), {_BALANCED_SQL},
{SPLIT_SQL.replace('FROM examples', 'FROM balanced').replace('examples.*', 'balanced.*')}
SELECT row_key, text, label, source, attack_type, part FROM parts""")
def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job: guard, rows without a label left out, exact near-dedup, balance, shuffle, split."""
    rows = training_rows(spark, sf_dir)
    rows = rows.withColumn("label", F.when(~F.expr(_UNLABELLED), F.col("label")))
    return prepare_corpus(rows, PrepareOptions(benign_share=0.5)).select(*EXAMPLE_COLUMNS, "part")


# --- Writing and reading back -----------------------------------------------------------------------------
_PREPARED_SQL = f"""
WITH {examples_sql('neuralchemy')}, {SPLIT_SQL}, held AS (
  SELECT {strip_sql('text')} AS text FROM benchmark WHERE length({strip_sql('text')}) >= 5)"""


def _prepared_paths(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    split = s.stratified_split(examples(spark, sf_dir, "neuralchemy"))
    return writers.write_corpus(split, benchmark_rows(spark, sf_dir), new_path(spark, "corpus"))


@query("write_corpus", f"""{_PREPARED_SQL}
SELECT part AS file, text, label, source, attack_type FROM parts
UNION ALL SELECT 'benchmark', text, 1, 'rogue_benchmark', 'unknown' FROM held""")
def write_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = _prepared_paths(spark, sf_dir)
    return readers.scan_splits({name: spark.read.parquet(path) for name, path in paths.items()}, "file")


@query("read_eval_sets", f"""{_PREPARED_SQL}
SELECT text, label, source, attack_type, 'internal_eval' AS dataset FROM parts WHERE part = 'eval'
UNION ALL SELECT text, 1, 'rogue_benchmark', 'unknown', 'benchmark_eval' FROM held""")
def read_eval_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_eval_sets(spark, _prepared_paths(spark, sf_dir))


@query("read_training_columns", f"{_PREPARED_SQL} SELECT text, label FROM parts WHERE part = 'train'")
def read_training_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_training_columns(spark, _prepared_paths(spark, sf_dir)["train"])


@query("prompt_texts", f"WITH {PROMPTS_SQL} SELECT doc_id, text FROM prompts")
def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts the gate queries run on, to check that both engines see the same."""
    return prompts(spark, sf_dir).select("doc_id", "text")
