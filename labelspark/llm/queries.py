"""Collects the registered queries of the text operators and their SQL."""

from labelspark.llm import (  # noqa: F401
    decontaminate, divergence, line_dedup, mixing, neighbours, ngram_join, passages, quality, severity, spelling, surrogates,
    token_counts, url_rules,
)
from labelspark.llm.common import REGISTRY, SQL  # noqa: F401
