"""Registers the queries of all operators of this subpackage."""

from wardline.llm import bpe, collocations, decontaminate, langid, lm_score, phrases, quality, resampling, rules, simhash, suffixes, token_files, warc  # noqa: F401
