"""Card-transaction fraud analytics on Spark."""

from .operators.dictionary import (
    build_dictionaries,
    build_dictionary,
    encode,
    extend_dictionary,
)
from .operators.features import (
    build_features,
    calendar_features,
    featurize,
    model_inputs,
    separate,
    training_set,
)
from .operators.joins import lookup_join
from .operators.metrics import auc, auc_thresholded, confusion, report
from .operators.rules import (
    Rule,
    RuleSet,
    attach_rules,
    cascade,
    combine,
    model_review,
    rule_vector,
)
from .operators.spend import user_spend
from .operators.verdicts import verdict, verdict_within
from .session import build_session

__all__ = [
    "Rule", "RuleSet", "attach_rules", "auc", "auc_thresholded", "build_dictionaries",
    "build_dictionary", "build_features", "build_session", "calendar_features", "cascade",
    "combine", "confusion", "encode", "extend_dictionary", "featurize", "lookup_join",
    "model_inputs", "model_review", "report", "rule_vector", "separate", "training_set",
    "user_spend", "verdict", "verdict_within",
]
