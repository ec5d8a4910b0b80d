"""All queries of this package."""

from reviewlake.llm import (  # noqa: F401
    codes,
    decontaminate,
    html_text,
    licenses,
    merkle,
    minhash,
    mixture,
    prefix_forest,
    quality,
    simhash,
    toxicity,
    url_filter,
    warc,
)
from reviewlake.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
