"""Corpus pipeline: quality rules, near-dedup, redaction, mixing, encoding (stages in ``oreline.llm.pipeline``)."""

from oreline.llm.pipeline import ORACLE_SQL, STAGES, encoding, near_dedup, personal_data, quality_rules, run, source_mix

__all__ = ["ORACLE_SQL", "STAGES", "encoding", "near_dedup", "personal_data", "quality_rules", "run", "source_mix"]
