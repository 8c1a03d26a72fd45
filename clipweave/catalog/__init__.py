"""Every operator run on the driver tables, with the SQL it is checked against."""

from .registry import SPARK, SQL
from . import (  # noqa: F401
    ground_queries,
    io_queries,
    join_queries,
    qa_queries, reader_queries,
    signal_queries,
    text_queries,
    timeline_queries,
    track_queries,
    vote_queries,
)

__all__ = ["SPARK", "SQL"]
