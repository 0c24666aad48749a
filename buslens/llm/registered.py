"""All queries of this subpackage."""

import corpus_pipeline
from buslens.llm import queries, queries_text, queries_web  # noqa: F401
from buslens.llm.registry import ORACLES, QUERIES

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

__all__ = ["ORACLES", "QUERIES"]
