"""All queries of this subpackage; importing the modules registers them."""

from groundscope.llm import (  # noqa: F401
    ann, decontamination, html_text, jaccard_join, language, lexical, packing, quality, runs, sharding, suffix_dedup, topk, toxicity,
)
from groundscope.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
