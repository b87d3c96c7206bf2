"""The training-corpus pipeline: stages and run; all of it is in recallspark.llm.pipeline."""

from recallspark.llm.pipeline import COLUMNS, ORACLE_SQL, STAGES, run

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "run"]
