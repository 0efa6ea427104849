"""The corpus pipeline of the text operators: its stages, its SQL, and the whole run."""

from binomia.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
