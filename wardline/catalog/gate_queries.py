"""Registered queries: rules, cascade, verdicts, statistics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.catalog.inputs import (
    PROMPTS_SQL, decided_sql, pattern_sql, payload_sql, prompts, sql_text, table,
)
from wardline.catalog.registry import query
from wardline.functions.rules import DEFAULT_RULES, Rule, base64_payload, match_rules, rule_table
from wardline.functions.scores import effective_threshold, sanitize_score
from wardline.functions.text import text_preview
from wardline.operators import gate as g
from wardline.operators import verdicts as v
from wardline.operators.scoring import batch_scorer, table_scorer
from wardline.operators.stats import decision_stats, log_entries

DECISION = ("doc_id", "decision", "stage", "score", "pattern", "reasoning")
SELECT_DECISION = "SELECT doc_id, decision, stage, score, pattern, reasoning FROM"


def gated(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return g.gate(prompts(spark, sf_dir), scorer="given_score", threshold_col="threshold", **options)


# --- Rules -------------------------------------------------------------------------------------------
_RULE_VALUES = ", ".join(
    f"({i}, {sql_text(r.name)}, {sql_text(r.regex)}, {sql_text(r.flags)}, {str(r.decode_check).lower()})"
    for i, r in enumerate(DEFAULT_RULES)
)
_RULES_SQL = f"rules AS (SELECT * FROM (VALUES {_RULE_VALUES}) v(position, name, regex, flags, decode_check))"


@query("rule_catalogue", f"""
WITH {PROMPTS_SQL}, {_RULES_SQL}, matched AS (SELECT {pattern_sql('text')} AS name FROM prompts)
SELECT position, name, regex, flags, decode_check, (SELECT count(*) FROM matched m WHERE m.name = rules.name) AS hits
FROM rules""")
def rule_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue with the number of texts reported under each rule."""
    hits = match_rules(prompts(spark, sf_dir)).groupBy(F.col("pattern").alias("name")).agg(F.count("*").alias("hits"))
    return rule_table(spark).join(hits, "name", "left").na.fill(0, ["hits"])


@query("rule_names", f"""
WITH {PROMPTS_SQL}, {_RULES_SQL}, matched AS (SELECT DISTINCT {pattern_sql('text')} AS name FROM prompts)
SELECT position, name, name IN (SELECT name FROM matched WHERE name IS NOT NULL) AS used FROM rules""")
def rule_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered names in order, and whether any text is reported under them."""
    used = match_rules(prompts(spark, sf_dir)).groupBy(F.col("pattern").alias("name")).agg(F.lit(True).alias("used"))
    return rule_table(spark).select("position", "name").join(used, "name", "left").na.fill(False, ["used"])


@query("rule_first_match", f"""
WITH {PROMPTS_SQL}, matched AS (SELECT doc_id, {pattern_sql('text')} AS pattern FROM prompts)
SELECT doc_id, pattern IS NOT NULL AS s1_matched, pattern FROM matched""")
def rule_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_rules(prompts(spark, sf_dir)).select("doc_id", "s1_matched", "pattern")


@query("base64_payload_match", f"WITH {PROMPTS_SQL} SELECT doc_id, {payload_sql('text')} AS payload FROM prompts")
def base64_payload_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts(spark, sf_dir).select("doc_id", base64_payload(F.col("text")).alias("payload"))


@query("custom_rules", f"""
WITH {PROMPTS_SQL}, matched AS (
  SELECT doc_id, given_score, CASE WHEN regexp_matches(text, '(?i)license\\s+(text|line)') THEN 'licence'
    WHEN regexp_matches(text, '(?m)^Die ') THEN 'article' WHEN regexp_matches(text, '(?s)los.la') THEN 'wide' END AS pattern
  FROM prompts)
SELECT doc_id, pattern, CASE WHEN pattern IS NOT NULL THEN 'BLOCKED' WHEN isnan(given_score) THEN 'REVIEW'
  WHEN given_score >= 0.9 THEN 'BLOCKED' WHEN given_score < 0.2 THEN 'ALLOWED' ELSE 'REVIEW' END AS decision FROM matched""")
def custom_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own rules and bounds in place of the defaults."""
    rules = (
        Rule("licence", r"license\s+(text|line)", "IGNORECASE"),
        Rule("article", r"^Die ", "MULTILINE"),
        Rule("wide", r"los.la", "DOTALL"),
    )
    decided = g.gate(prompts(spark, sf_dir), scorer="given_score", rules=rules, default_threshold=0.9, lower=0.2)
    return decided.select("doc_id", "pattern", "decision")


# --- Requests and score expressions -------------------------------------------------------------------
_REQUESTS_SQL = f"""{PROMPTS_SQL}, requests AS (
  SELECT doc_id, CASE doc_id % 11 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE text END AS text,
    CASE doc_id % 13 WHEN 0 THEN -0.1::DOUBLE WHEN 1 THEN 1.5::DOUBLE WHEN 2 THEN 'NaN'::DOUBLE WHEN 3 THEN 1.0::DOUBLE
      WHEN 4 THEN 0.0::DOUBLE END AS threshold FROM prompts)"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    odd = {0: -0.1, 1: 1.5, 2: float("nan"), 3: 1.0, 4: 0.0}
    threshold = F.lit(None).cast("double")
    for slot, value in odd.items():
        threshold = F.when(doc % 13 == slot, F.lit(value)).otherwise(threshold)
    text = F.when(doc % 11 == 0, None).when(doc % 11 == 1, "").otherwise(F.col("text"))
    return prompts(spark, sf_dir).select("doc_id", text.alias("text"), threshold.alias("threshold"))


@query("validate_requests", f"""
WITH {_REQUESTS_SQL}
SELECT doc_id, CASE WHEN text IS NULL THEN 'text missing' WHEN text = '' THEN 'text empty'
  WHEN threshold IS NOT NULL AND (isnan(threshold) OR threshold < 0 OR threshold > 1) THEN 'threshold outside [0, 1]'
  END AS reject_reason FROM requests""")
def validate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.validate_requests(_requests(spark, sf_dir)).select("doc_id", "reject_reason")


@query("effective_threshold", f"WITH {PROMPTS_SQL} SELECT doc_id, coalesce(threshold, 0.65::DOUBLE) AS threshold FROM prompts")
def effective_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts(spark, sf_dir).select("doc_id", effective_threshold(F.col("threshold")).alias("threshold"))


@query("sanitize_score", f"""
WITH {PROMPTS_SQL}, raw AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Infinity'::DOUBLE WHEN 1 THEN '-Infinity'::DOUBLE
  ELSE given_score END AS score FROM prompts)
SELECT doc_id, CASE WHEN isnan(score) OR isinf(score) THEN NULL ELSE score END AS score FROM raw""")
def sanitized_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = F.col("doc_id") % 5
    raw = F.when(slot == 0, float("inf")).when(slot == 1, float("-inf")).otherwise(F.col("given_score"))
    return prompts(spark, sf_dir).select("doc_id", sanitize_score(raw).alias("score"))


@query("text_preview", f"WITH {PROMPTS_SQL} SELECT doc_id, substr(text, 1, 120) AS text_preview FROM prompts")
def text_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts(spark, sf_dir).select("doc_id", text_preview("text").alias("text_preview"))


# --- Cascade -------------------------------------------------------------------------------------------
@query("gate", f"WITH {decided_sql()} {SELECT_DECISION} decided")
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated(spark, sf_dir).select(*DECISION)


@query("decision_reason", f"WITH {decided_sql('0.65')} SELECT doc_id, reasoning FROM decided")
def decision_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.gate(prompts(spark, sf_dir), scorer="given_score").select("doc_id", "reasoning")


@query("gate_unscored", f"""
WITH {PROMPTS_SQL}, matched AS (SELECT doc_id, {pattern_sql('text')} AS pattern FROM prompts)
SELECT doc_id, CASE WHEN pattern IS NULL THEN 'REVIEW' ELSE 'BLOCKED' END AS decision,
  CASE WHEN pattern IS NULL THEN 2 ELSE 1 END AS stage, NULL::DOUBLE AS score, pattern,
  CASE WHEN pattern IS NULL THEN 'Stage 2 model unavailable: Model directory not found: models/none'
    ELSE 'Heuristic pattern matched: ' || pattern END AS reasoning FROM matched""")
def gate_unscored(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = g.gate(prompts(spark, sf_dir), unavailable="Model directory not found: models/none")
    return decided.select(*DECISION)


@query("gate_nan", f"""
WITH {PROMPTS_SQL}, matched AS (SELECT doc_id, given_score, {pattern_sql('text')} AS pattern FROM prompts)
SELECT doc_id, CASE WHEN pattern IS NOT NULL THEN 'BLOCKED' ELSE 'REVIEW' END AS decision,
  CASE WHEN pattern IS NULL THEN 'NaN'::DOUBLE END AS score FROM matched""")
def gate_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scorer that always answers NaN: neither bound holds, so every row without a hit is ambiguous."""
    decided = g.gate(prompts(spark, sf_dir), scorer=F.col("given_score") * float("nan"))
    return decided.select("doc_id", "decision", "score")


_AMBIGUOUS_SQL = f"""{PROMPTS_SQL},
matched AS (SELECT *, {pattern_sql('text')} AS pattern, coalesce(threshold, 0.65) AS limit_ FROM prompts),
unsettled AS (SELECT doc_id, text, given_score FROM matched WHERE pattern IS NULL
  AND (isnan(given_score) OR (given_score < limit_ AND given_score >= 0.4)))"""


def _unsettled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.ambiguous_subset(prompts(spark, sf_dir), "given_score", threshold_col="threshold")


@query("ambiguous_subset", f"WITH {_AMBIGUOUS_SQL} SELECT doc_id, given_score AS score FROM unsettled")
def ambiguous_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unsettled(spark, sf_dir).select("doc_id", "score")


# --- Verdicts ------------------------------------------------------------------------------------------
@query("verdict_requests", f"WITH {_AMBIGUOUS_SQL} SELECT doc_id, 'USER TEXT:' || chr(10) || text AS request FROM unsettled")
def verdict_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.verdict_requests(_unsettled(spark, sf_dir), "doc_id")


# Reply shapes; `{id}` is replaced by the row's id and `{s}` by its score.
REPLIES = (
    '{"is_injection": true, "confidence": {s}, "reasoning": "row {id}"}',
    '{"is_injection": false, "confidence": {s}, "reasoning": "row {id}"}',
    '```json\n{"is_injection": true, "confidence": 0.75, "reasoning": "fenced {id}"}\n```',
    '{"is_injection": "false", "confidence": "0.25", "reasoning": "text flag"}',
    '{"is_injection": 0, "confidence": 1, "reasoning": "number flag"}',
    '{"reasoning": "only a reason {id}"}',
    'I think this is TRUE for row {id}',
    'no verdict on row {id}',
    '{"is_injection": true, "confidence": "high", "reasoning": "true"}',
    '{"is_injection": true, "confidence": null}',
    '[true, {id}]',
    '{"is_injection": null, "confidence": 0.123456, "reasoning": "null flag"}',
    '  {"is_injection": 1, "confidence": 2.5, "reasoning": ""}  ',
    # The last of repeated keys holds, and texts that say "true" elsewhere change nothing.
    '{"is_injection": true, "is_injection": false, "confidence": 0.9, "reasoning": "true story {id}"}',
    '{"is_injection": false, "is_injection": true, "confidence": "x", "confidence": {s}, "reasoning": 1.0}',
    '{"is_injection": [], "confidence": true, "reasoning": {"why": [null, true]}}',
)
# What the SQL engine's reader takes otherwise than Python: the same replies in a form that both read alike.
PLAIN_REPLIES = {
    13: '{"is_injection": false, "confidence": 0.9, "reasoning": "true story {id}"}',
    14: '{"is_injection": true, "confidence": {s}, "reasoning": "1.0"}',
    15: '{"is_injection": false, "confidence": 1.0, "reasoning": "{\'why\': [None, True]}"}',
}


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    shape = F.element_at(F.array(*[F.lit(r) for r in REPLIES]), (doc % len(REPLIES) + 1).cast("int"))
    with_id = F.replace(shape, F.lit("{id}"), doc.cast("string"))
    score = F.concat(F.lit("0."), F.lpad((doc * 7919 % 1000).cast("string"), 3, "0"))
    return table(spark, sf_dir, "documents").select("doc_id", F.replace(with_id, F.lit("{s}"), score).alias("reply"))


_REPLY_CASES = " ".join(f"WHEN {i} THEN {sql_text(r)}" for i, r in enumerate(PLAIN_REPLIES.get(k, r) for k, r in enumerate(REPLIES)))
_VERDICTS_SQL = f"""
replies AS (SELECT doc_id, trim(replace(replace(CASE doc_id % {len(REPLIES)} {_REPLY_CASES} END, '{{id}}', doc_id::VARCHAR),
  '{{s}}', '0.' || lpad((doc_id * 7919 % 1000)::VARCHAR, 3, '0'))) AS reply FROM documents),
raw AS (SELECT doc_id, CASE WHEN starts_with(reply, '```') THEN array_to_string(string_split(reply, chr(10))[2:-2], chr(10))
  ELSE reply END AS raw FROM replies),
typed AS (SELECT doc_id, raw, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM raw),
kinds AS (SELECT *, json_type(j) AS kind, json_type(j, '$.is_injection') AS flag_kind, j ->> '$.is_injection' AS flag,
  json_type(j, '$.confidence') AS conf_kind, j ->> '$.confidence' AS conf, coalesce(j ->> '$.reasoning', '') AS why FROM typed),
branches AS (SELECT *, CASE WHEN j IS NULL THEN 'plain' WHEN kind <> 'OBJECT' OR conf_kind = 'NULL' THEN 'error'
  WHEN conf_kind = 'VARCHAR' AND try_cast(conf AS DOUBLE) IS NULL THEN 'plain' ELSE 'read' END AS branch FROM kinds),
verdicts AS (SELECT doc_id,
  CASE branch WHEN 'error' THEN false WHEN 'plain' THEN contains(lower(raw), 'true')
    ELSE CASE WHEN flag_kind IS NULL OR flag_kind = 'NULL' THEN false WHEN flag_kind = 'BOOLEAN' THEN flag = 'true'
      WHEN flag_kind = 'VARCHAR' THEN flag <> '' ELSE flag::DOUBLE <> 0 END END AS is_injection,
  CASE WHEN branch = 'read' AND conf_kind IS NOT NULL THEN conf::DOUBLE ELSE 0.5::DOUBLE END AS confidence,
  CASE branch WHEN 'error' THEN 'Stage 3 error: unusable reply' WHEN 'plain' THEN 'Failed to parse structured response.'
    ELSE why END AS reasoning FROM branches)"""


@query("parse_verdicts", f"WITH {_VERDICTS_SQL} SELECT doc_id, is_injection, confidence, reasoning FROM verdicts")
def parse_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.parse_verdicts(_replies(spark, sf_dir)).drop("reply")


# Every third row is left without a reply.
@query("resolve_verdicts", f"""
WITH {_AMBIGUOUS_SQL}, {_VERDICTS_SQL}, answered AS (SELECT * FROM verdicts WHERE doc_id % 3 <> 0),
reviewed AS (SELECT matched.doc_id, CASE WHEN coalesce(is_injection, false) THEN 'BLOCKED' ELSE 'ALLOWED' END AS decision,
    3 AS stage, coalesce(confidence, 0.5) AS score, coalesce(reasoning, 'Stage 3 error: no verdict') AS reasoning
  FROM matched JOIN unsettled USING (doc_id) LEFT JOIN answered USING (doc_id)),
settled AS (SELECT doc_id, CASE WHEN pattern IS NOT NULL OR given_score >= limit_ THEN 'BLOCKED' ELSE 'ALLOWED' END AS decision,
    CASE WHEN pattern IS NOT NULL THEN 1 ELSE 2 END AS stage, CASE WHEN pattern IS NULL THEN given_score END AS score,
    CASE WHEN pattern IS NOT NULL THEN 'Heuristic pattern matched: ' || pattern
      WHEN given_score >= limit_ THEN
        'Classifier score ' || printf('%.4f', given_score) || ' exceeds threshold ' || printf('%.2f', limit_)
      ELSE 'Classifier score ' || printf('%.4f', given_score) || ' below ambiguous zone' END AS reasoning
  FROM matched WHERE doc_id NOT IN (SELECT doc_id FROM unsettled))
SELECT * FROM reviewed UNION ALL SELECT * FROM settled""")
def resolve_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cascade with verdicts; the rule name is left out, being part of the reasoning."""
    answered = v.parse_verdicts(_replies(spark, sf_dir)).where(F.col("doc_id") % 3 != 0)
    decided = gated(spark, sf_dir, verdicts=answered, id_col="doc_id")
    return decided.select("doc_id", "decision", "stage", "score", "reasoning")


@query("verdict_defaults", f"""
WITH {_AMBIGUOUS_SQL}, {_VERDICTS_SQL}, answered AS (SELECT * FROM verdicts WHERE doc_id % 3 <> 0)
SELECT doc_id, 'reviewer off' AS reviewer, false AS is_injection, 0.5::DOUBLE AS confidence, 'Stage 3 is disabled.' AS reasoning
FROM unsettled
UNION ALL SELECT doc_id, 'reviewer on', coalesce(is_injection, false), coalesce(confidence, 0.5::DOUBLE),
  coalesce(reasoning, 'Stage 3 error: timeout') FROM unsettled LEFT JOIN answered USING (doc_id)""")
def verdict_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _unsettled(spark, sf_dir).select("doc_id")
    answered = v.parse_verdicts(_replies(spark, sf_dir)).where(F.col("doc_id") % 3 != 0)
    off = v.resolve_verdicts(rows, None, "doc_id").withColumn("reviewer", F.lit("reviewer off"))
    on = v.resolve_verdicts(rows, answered, "doc_id", error="timeout").withColumn("reviewer", F.lit("reviewer on"))
    return off.unionByName(on)


def _length_review(requests: pd.Series) -> pd.Series:
    return requests.map(lambda r: '{"is_injection": %s, "confidence": 0.9}' % str(len(r) % 2 == 0).lower())


@query("custom_analyzer", f"""
WITH {_AMBIGUOUS_SQL} SELECT doc_id, length(text) % 2 = 1 AS is_injection, 0.9::DOUBLE AS confidence FROM unsettled""")
def custom_analyzer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An own reviewer over Arrow batches of the ambiguous rows only (the request adds 11 characters)."""
    requests = v.verdict_requests(_unsettled(spark, sf_dir), "doc_id")
    replies = v.review_batches(requests, "doc_id", _length_review)
    return v.parse_verdicts(replies).select("doc_id", "is_injection", "confidence")


# --- Scorers --------------------------------------------------------------------------------------------
def _length_score(texts: pd.Series) -> pd.Series:
    return texts.str.len() % 1000 / 1000.0


@query("score_text", """
SELECT doc_id, (length(text) % 1000) / 1000::DOUBLE AS injection_score,
  printf('%.6f', 1.0::DOUBLE - (length(text) % 1000) / 1000::DOUBLE)::DOUBLE AS benign_score FROM documents""")
def score_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = batch_scorer(_length_score)(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "injection_score", "benign_score")


_CUSTOM_SCORER_SQL = f"""
WITH {PROMPTS_SQL},
matched AS (SELECT doc_id, {pattern_sql('text')} AS pattern, (length(text) % 1000) / 1000::DOUBLE AS s FROM prompts)
SELECT doc_id, CASE WHEN pattern IS NOT NULL OR s >= 0.65 THEN 'BLOCKED' WHEN s < 0.4 THEN 'ALLOWED' ELSE 'REVIEW' END AS decision,
  CASE WHEN pattern IS NULL THEN s END AS score FROM matched"""


@query("custom_scorer", _CUSTOM_SCORER_SQL)
def custom_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade with an own scoring function; it sees only the rows no rule blocks."""
    decided = g.gate(prompts(spark, sf_dir), scorer=batch_scorer(_length_score))
    return decided.select("doc_id", "decision", "score")


@query("custom_scorer_table", _CUSTOM_SCORER_SQL)
def custom_scorer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the scores in a table."""
    rows = prompts(spark, sf_dir)
    scores = rows.select("doc_id", (F.length("text") % 1000 / F.lit(1000.0)).alias("score"))
    return g.gate(rows, scorer=table_scorer(scores, "doc_id")).select("doc_id", "decision", "score")


# --- Log and statistics --------------------------------------------------------------------------------
_STATS_SQL = """
SELECT count(*) AS total_requests, count(*) FILTER (decision = 'BLOCKED') AS blocked_count,
  count(*) FILTER (decision = 'ALLOWED') AS allowed_count, count(*) FILTER (decision = 'REVIEW') AS review_count,
  printf('%.3f', avg(latency_ms))::DOUBLE AS average_latency_ms, count(*) FILTER (stage = 1) AS stage_1,
  count(*) FILTER (stage = 2) AS stage_2, count(*) FILTER (stage = 3) AS stage_3"""


def flat_stats(stats: DataFrame) -> DataFrame:
    stages = [F.col("stage_distribution")[f"stage_{i}"].alias(f"stage_{i}") for i in (1, 2, 3)]
    return stats.select(*[c for c in stats.columns if c != "stage_distribution"], *stages)


@query("decision_stats", f"WITH {decided_sql()} {_STATS_SQL} FROM decided")
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_stats(decision_stats(gated(spark, sf_dir)))


LOG_SQL = f"""
WITH {decided_sql()} SELECT substr(text, 1, 120) AS text_preview, decision, stage,
  CASE WHEN isnan(score) THEN NULL ELSE score END AS score, pattern, latency_ms FROM decided"""


@query("decision_log_entries", LOG_SQL)
def decision_log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_entries(gated(spark, sf_dir)).drop("timestamp")


