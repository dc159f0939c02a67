"""All registered queries: importing the modules adds them."""

from __future__ import annotations

import tickframe.plans.decision_queries
import tickframe.plans.detectors
import tickframe.plans.estimator_queries
import tickframe.plans.family_queries
import tickframe.plans.feature_queries
import tickframe.plans.learning_queries
import tickframe.plans.line_queries
import tickframe.plans.null_queries
import tickframe.plans.order_queries
import tickframe.plans.outcome_queries
import tickframe.plans.pattern_queries
import tickframe.plans.pressure_queries
import tickframe.plans.recurrences
import tickframe.plans.relation_queries
import tickframe.plans.reports
import tickframe.plans.scalar_queries
import tickframe.plans.situation_queries
import tickframe.plans.state_queries
import tickframe.plans.statistic_queries
import tickframe.plans.strategy_queries
import tickframe.plans.stream_queries
import tickframe.plans.study_queries
import tickframe.plans.trigger_queries  # noqa: F401
from tickframe.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
