"""All registered queries."""

from colscope.plans import evaluation_queries, model_queries, profile_queries, relation_queries, score_queries  # noqa: F401
from colscope.plans.registry import ORACLES, QUERIES  # noqa: F401
