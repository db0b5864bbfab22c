"""A corpus from raw documents in five stages. The stages are in strataforge.llm.pipeline."""

from strataforge.llm.pipeline import COLUMNS, ORACLE_SQL, STAGES, decontaminate, emitted, language, mixture, near_dedup, private, run

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "decontaminate", "emitted", "language", "mixture", "near_dedup", "private", "run"]
