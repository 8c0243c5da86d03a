"""The decision gate: fourteen ordered rules as one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellwarden import constants as C

# Context column -> value used when a caller's table lacks the column.
CONTEXT_DEFAULTS = {
    "unsupported_input": False,
    "security_violation": False,
    "authority_level": 0,
    "required_authority": 0,
    "action_impact": "LOW",
    "policy_status": "MISSING",
    "out_of_distribution": False,
    "conformal_abstain": False,
    "conflict": 0.0,
    "max_conflict": C.MAX_CONFLICT,
    "ignorance": 0.0,
    "max_ignorance": C.MAX_IGNORANCE,
    "reference_verified": False,
    "repair_reversible": False,
    "repair_deterministic": False,
    "validated_autonomy": False,
}


def gate(columns) -> Column:
    """Struct (decision, uncertainty_type, rule) over the context columns.

    ``columns`` lists the context columns at hand; the rest take defaults.
    """
    have = set(columns)
    ctx = {k: F.col(k) if k in have else F.lit(v) for k, v in CONTEXT_DEFAULTS.items()}
    repairable = ctx["repair_deterministic"] & ctx["repair_reversible"]
    rules = [
        (ctx["unsupported_input"], "BLOCK", None),
        (ctx["security_violation"], "BLOCK", None),
        (ctx["authority_level"] < ctx["required_authority"], "ESCALATE", "authority"),
        (ctx["action_impact"] == "HIGH", "ESCALATE", "authority"),
        (repairable & (ctx["action_impact"] == "LOW") & ~ctx["out_of_distribution"]
         & (ctx["conflict"] < ctx["max_conflict"]), "AUTO", None),
        (ctx["policy_status"] != "ACTIVE", "ESCALATE", "policy"),
        (ctx["out_of_distribution"], "ESCALATE", "factual"),
        (ctx["conformal_abstain"], "ESCALATE", "factual"),
        (ctx["conflict"] >= ctx["max_conflict"], "ESCALATE", "factual"),
        (ctx["ignorance"] >= ctx["max_ignorance"], "ESCALATE", "factual"),
        (~ctx["reference_verified"], "ESCALATE", "factual"),
        (repairable, "AUTO", None),
        (ctx["validated_autonomy"], "AUTO", None),
        (F.lit(True), "ESCALATE", "factual"),
    ]
    outcome = None
    for number, (condition, decision, uncertainty) in reversed(list(enumerate(rules, 1))):
        value = F.struct(
            F.lit(decision).alias("decision"),
            F.lit(uncertainty).cast("string").alias("uncertainty_type"),
            F.lit(number).alias("rule"),
        )
        outcome = value if outcome is None else F.when(condition, value).otherwise(outcome)
    return outcome
