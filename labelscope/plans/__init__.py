"""Whole queries over the driver tables, each with its SQL oracle where SQL can express it."""

from labelscope.plans import evaluation, recordings
from labelscope.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "evaluation", "recordings"]
