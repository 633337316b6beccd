"""The corpus pipeline: its stages, the query over all of them, and its SQL (none)."""

from plumbline.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
