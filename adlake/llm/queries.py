"""One query per operator over its whole table, in the columns of its contract."""

from adlake.llm import (  # noqa: F401
    dedup_queries,
    model_queries,
    negative_queries,
    text_queries,
    token_queries,
    vector_queries,
    web_queries,
    word_queries,
)
from adlake.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
