"""From documents to packed training sequences: the stages of `eventtally.llm.pipeline`."""

from eventtally.llm.pipeline import ORACLE_SQL, STAGES, run  # noqa: F401
