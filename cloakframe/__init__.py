"""Find, mask and restore sensitive values in Spark DataFrames."""

from cloakframe.plans.extend import register_detector, register_masker
from cloakframe.plans.masking import analyze_text, findings, mask_text, mask_with_stats
from cloakframe.plans.policy import FieldRule, Policy, Rule

__all__ = [
    "FieldRule",
    "Policy",
    "Rule",
    "analyze_text",
    "findings",
    "mask_text",
    "mask_with_stats",
    "register_detector",
    "register_masker",
]
