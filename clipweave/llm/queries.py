"""The registered queries of this package and the SQL of those that SQL can express."""

from . import (  # noqa: F401
    byte_bpe,
    collocations,
    exact_dedup,
    fill_in_middle,
    jaccard_join,
    language_id,
    line_dedup,
    mixing,
    topk_search,
    token_counts,
    toxicity,
    url_filter,
    warc,
)
from .common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
