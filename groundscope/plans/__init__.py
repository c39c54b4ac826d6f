"""Named queries over the driver tables, each with an optional SQL oracle."""

from groundscope.plans import datasets, effects, evaluation, evidence, grounding, profiling, questionlog, storage, surface  # noqa: F401
from groundscope.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
