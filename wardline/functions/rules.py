"""Stage 1: ordered regex rules as native expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.text import WHITESPACE_CLASS


@dataclass(frozen=True)
class Rule:
    """A named pattern, written as a Python `str` regex.

    `hints` are lower-case literals of which any matching text holds at least one (ignoring case).
    They only spare the regex scan of texts that cannot match; leave them empty when unsure.
    """

    name: str
    regex: str
    flags: str = "0"
    decode_check: bool = False
    hints: tuple[str, ...] = ()


# Names, patterns, flags and order decide which rule a text is reported under.
DEFAULT_RULES: tuple[Rule, ...] = (
    Rule("ignore_instructions", r"ignore\s+(all\s+)?(previous\s+|prior\s+)?instructions", "IGNORECASE",
         hints=("ignore",)),
    Rule("disregard", r"disregard\s+(all\s+|prior\s+|above\s+|previous\s+)", "IGNORECASE",
         hints=("disregard",)),
    Rule("you_are_now", r"you\s+are\s+now\s+(DAN|in developer mode|jailbroken|unfiltered)", "IGNORECASE",
         hints=("dan", "in developer mode", "jailbroken", "unfiltered")),
    Rule("system_prompt_injection", r"system\s*prompt\s*[:=]", "IGNORECASE", hints=("system",)),
    Rule("base64_decode", r"base64\s*(decode|encoded|string)", "IGNORECASE", hints=("base64",)),
    Rule("no_restrictions", r"pretend\s+you\s+(are|have)\s+no\s+(restrictions|rules|guidelines)", "IGNORECASE",
         hints=("pretend",)),
    Rule("template_injection_inst", r"\[INST\]|\[/INST\]", hints=("inst]",)),
    Rule("template_injection_sys", r"<<SYS>>|<</SYS>>", hints=("sys>>",)),
    Rule("do_anything_now", r"do\s+anything\s+now", "IGNORECASE", hints=("anything",)),
    Rule("respond_as_unrestricted", r"respond\s+as\s+(an\s+unrestricted|a\s+completely\s+different)", "IGNORECASE",
         hints=("respond",)),
    Rule("jailbreak_dan", r"\bDAN\b|developer\s+mode\s+enabled|jailbreak\s+mode", "IGNORECASE",
         hints=("dan", "developer", "jailbreak")),
    Rule("override_directives",
         r"(override|bypass|circumvent)\s+(your\s+)?(safety|guidelines|rules|restrictions|directives|training)",
         "IGNORECASE", hints=("override", "bypass", "circumvent")),
    Rule("new_instructions", r"your\s+new\s+(instructions|directive|task|role|purpose)\s+(is|are|will)", "IGNORECASE",
         hints=("your",)),
    Rule("forget_previous",
         r"(forget|clear|erase|reset)\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions|context|rules)",
         "IGNORECASE", hints=("forget", "clear", "erase", "reset")),
    Rule("base64_payload", r"[A-Za-z0-9+/]{40,}={0,2}", decode_check=True),
)
BASE64_RUN = r"[A-Za-z0-9+/]{40,}={0,2}"
DECODED_KEYWORDS = r"(ignore|disregard|override|bypass|jailbreak|DAN|system\s*prompt|new\s+instructions)"

# The inline letters of the flags that may be named; any other flag text means no flag.
_WORD = r"\p{L}\p{N}_"
_FLAG_LETTERS = {"IGNORECASE": "i", "MULTILINE": "m", "DOTALL": "s"}
# The only characters outside ASCII that a case-blind match takes for an ASCII letter (s, k, i, i).
_FOLDING_EXTRAS = ("\u017f", "\u212a", "\u0131", "\u0130")


def rules_from_config(entries: Sequence[Mapping] | None) -> tuple[Rule, ...]:
    """Rules from mappings with name, regex and optional flags and decode_check; the default list for none."""
    return tuple(
        Rule(e["name"], e["regex"], str(e.get("flags", "0")), bool(e.get("decode_check", False)))
        for e in entries or ()
    ) or DEFAULT_RULES


def java_regex(regex: str, flags: str = "0") -> str:
    """The same pattern in Java's dialect, with Python's notion of white space, word characters and edges."""
    out, in_class, i = [], False, 0
    while i < len(regex):
        step = 2 if regex[i] == "\\" else 1
        token = regex[i : i + step]
        if token in (r"\s", r"\w"):
            body = WHITESPACE_CLASS if token == r"\s" else _WORD
            token = body if in_class else f"[{body}]"
        elif token == r"\b" and not in_class:
            token = f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"
        elif token == "[" and not in_class:
            in_class = True
        elif token == "]" and in_class:
            in_class = False
        out.append(token)
        i += step
    return f"(?{_FLAG_LETTERS.get(str(flags), '')}U)" + "".join(out)


def base64_payload(text: Column) -> Column:
    """True when a long base64 run decodes to text holding an attack keyword.

    Runs of impossible length are skipped and undecodable bytes dropped, so a run never fails the row.
    """
    keywords = F.lit(java_regex(DECODED_KEYWORDS, "IGNORECASE"))
    runs = F.transform(F.regexp_extract_all(text, F.lit(BASE64_RUN), 0), lambda r: F.rtrim(r, F.lit("=")))
    runs = F.filter(runs, lambda r: F.length(r) % 4 != 1)
    return F.exists(runs, lambda r: F.rlike(_decode_run(r), keywords))


def _decode_run(run: Column) -> Column:
    padded = F.rpad(run, (F.ceil(F.length(run) / 4) * 4).cast("int"), "=")
    decoded = F.unbase64(padded).cast("string")
    # A real U+FFFD is set aside first, so that only those standing for bad bytes are dropped.
    decoded = F.replace(decoded, F.lit("\ufffd"), F.lit("\x00"))
    return F.replace(F.make_valid_utf8(decoded), F.lit("\ufffd"), F.lit(""))


def rule_hit(rule: Rule, text: Column, lowered: Column, folds: Column) -> Column:
    """Whether one rule matches anywhere in the text.

    `lowered` is the lower-cased text; `folds` tells that the text holds one of the characters for which
    a look at ASCII letters alone would not do, so that the hints must not be trusted.
    """
    hit = F.rlike(text, F.lit(java_regex(rule.regex, rule.flags)))
    if rule.decode_check:
        hit = hit & base64_payload(text)
    if rule.hints:
        hinted = _any_of([F.contains(lowered, F.lit(h)) for h in rule.hints])
        hit = (hinted | folds if rule.flags == "IGNORECASE" else hinted) & hit
    return hit


def first_match(text: Column, lowered: Column, folds: Column, rules: Sequence[Rule] = DEFAULT_RULES) -> Column:
    """Name of the first rule that matches, else null. Later rules are not evaluated after a hit."""
    chain = None
    for rule in rules:
        hit = rule_hit(rule, text, lowered, folds)
        chain = F.when(hit, F.lit(rule.name)) if chain is None else chain.when(hit, F.lit(rule.name))
    return F.lit(None).cast("string") if chain is None else chain


def match_rules(df: DataFrame, text_col: str = "text", rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """Add `s1_matched` and `pattern`, each rule being evaluated at most once per row.

    The result comes out of a one-element generator: Catalyst moves a filter on a plain column below its
    projection and so evaluates the column twice, but leaves a filter on generated columns in place.
    """
    lowered, folds = "_lowered", "_folds"
    text = F.col(text_col)
    kept = [F.col(c) for c in df.columns if c not in ("pattern", "s1_matched")]
    prepared = df.withColumns({
        lowered: F.lower(text),
        folds: _any_of([F.contains(text, F.lit(c)) for c in _FOLDING_EXTRAS]),
    })
    found = first_match(text, F.col(lowered), F.col(folds), rules)
    return prepared.select(*kept, F.explode(F.array(found)).alias("pattern")).withColumn(
        "s1_matched", F.col("pattern").isNotNull()
    )


def rule_table(spark: SparkSession, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """The catalogue as rows (one per rule, so its size is that of the list)."""
    rows = [(i, r.name, r.regex, r.flags, r.decode_check) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "position int, name string, regex string, flags string, decode_check boolean")


def rule_names(rules: Sequence[Rule] = DEFAULT_RULES) -> list[str]:
    return [r.name for r in rules]


def _any_of(conditions: list[Column]) -> Column:
    out = conditions[0]
    for condition in conditions[1:]:
        out = out | condition
    return out
