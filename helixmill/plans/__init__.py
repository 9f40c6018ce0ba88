"""Named queries of the engine, and their SQL."""

from . import contract_plans, design_plans, ensemble_plans, interpretation_plans, join_plans, learner_plans, sequence_plans, statistics_plans, target_plans  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
