"""Recommendations, critic checks and the final decision of each dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.tables import renewed

RECOMMENDATION_LIMIT = 10

# Words that make an action destructive.
DESTRUCTIVE = ("delete", "terminate", "destroy", "shutdown", "remove")

# What each recommended investigation assumes.
ASSUMPTIONS = (
    "Investigation required before implementation",
    "Billing data only — utilization data not available",
)

# Confidence in a dataset by quality status.
QUALITY_CONFIDENCE = {"PASS": 0.95, "WARN": 0.6, "FAIL": 0.1}

# Decision confidence.
CONFIDENCE_FLOOR, FAILED_PENALTY, MISSING_PENALTY = 0.3, 0.2, 0.1

# The wording of titles, check messages and rationales in the functions below.

PASSED, FAILED, MISSING, UNSUPPORTED = "passed", "failed", "missing_evidence", "unsupported"


def quality_gate(quality: DataFrame) -> DataFrame:
    """Whether each dataset may be analysed, and how far it is trusted."""
    status = F.col("overall_status")
    trust = F.lit(None).cast("double")
    for name, value in QUALITY_CONFIDENCE.items():
        trust = F.when(status == name, value).otherwise(trust)
    return quality.select(
        "dataset_id", "overall_status", (status != "FAIL").alias("usable"), trust.alias("confidence")
    )


def usable_only(rows: DataFrame, gate: DataFrame) -> DataFrame:
    """Rows of datasets that passed the gate."""
    return rows.join(renewed(gate.where("usable").select("dataset_id")), "dataset_id", "left_semi")


def recommend(
    opportunities: DataFrame, limit: int = RECOMMENDATION_LIMIT, *, with_facts: bool = False
) -> DataFrame:
    """One investigation per top opportunity (``rank`` from ``opportunity.ranked``).

    ``with_facts`` carries the figures a savings estimate needs along, which spares the
    join back to the opportunities.
    """
    facts = ["entity", "confidence", "potential_savings_estimate"] if with_facts else []
    entity = F.col("entity")
    action = F.struct(
        F.lit("investigate").alias("action_type"),
        F.concat(
            F.lit("Investigate "),
            entity,
            F.lit(
                ": review current usage patterns, identify root cause of cost change, "
                "assess optimization options."
            ),
        ).alias("description"),
        F.col("description").alias("rationale"),
        F.array(*[F.lit(a) for a in ASSUMPTIONS]).alias("assumptions"),
        F.col("confidence").alias("confidence"),
    )
    return opportunities.where(F.col("rank") <= limit).select(
        scores.stable_id(F.lit("recommendation"), F.col("opportunity_id")).alias("recommendation_id"),
        "opportunity_id",
        "dataset_id",
        F.concat(F.lit("Investigate "), entity, F.lit(" ("), F.col("opportunity_type"), F.lit(")")).alias("title"),
        "description",
        F.array(action).alias("actions"),
        F.col("rank").alias("priority_rank"),
        F.lit("low").alias("risk_level"),
        "evidence",
        F.lit("pending").alias("status"),
        *facts,
    )


def _check(stage: int, outcome: Column, message: Column, rank=None, action=None) -> Column:
    zero = F.lit(0)
    return F.struct(
        F.lit(stage).alias("stage"),
        (zero if rank is None else rank).cast("int").alias("priority_rank"),
        (zero if action is None else action).cast("int").alias("action"),
        outcome.alias("outcome"),
        message.alias("message"),
    )


def _gate_check() -> Column:
    usable = F.col("usable")
    return _check(
        1,
        F.when(usable, PASSED).otherwise(FAILED),
        F.when(usable, "Data quality gate: PASSED").otherwise(
            "Data quality gate: FAILED — pipeline should not have proceeded"
        ),
    )


def _label_check(savings_note: str) -> Column:
    if "ESTIMATED" in savings_note.upper():
        outcome, message = PASSED, "Savings clearly labelled as ESTIMATED (not realized)"
    else:
        outcome, message = UNSUPPORTED, "Savings estimates should be clearly labelled as ESTIMATED"
    return _check(5, F.lit(outcome), F.lit(message))


def _evidence_check() -> Column:
    title = F.col("title")
    present = F.coalesce(F.size("evidence") > 0, F.lit(False))
    return _check(
        2,
        F.when(present, PASSED).otherwise(MISSING),
        F.when(present, F.concat(F.lit("Evidence present for: "), F.substring(title, 1, 50))).otherwise(
            F.concat(F.lit("Recommendation '"), title, F.lit("' has no supporting evidence"))
        ),
        F.col("priority_rank"),
    )


def _action_checks(action: Column, at: Column) -> Column:
    rank, kind, wording = F.col("priority_rank"), action["action_type"], action["description"]
    stated = F.coalesce(F.size(action["assumptions"]) > 0, F.lit(False))
    destructive = F.lower(wording).rlike("|".join(DESTRUCTIVE))
    return F.array(
        _check(
            3,
            F.when(stated, PASSED).otherwise(MISSING),
            F.concat(
                F.when(stated, "Assumptions disclosed for action: ").otherwise("No assumptions for action: "),
                kind,
            ),
            rank,
            at,
        ),
        _check(
            4,
            F.when(destructive, FAILED).otherwise(PASSED),
            F.when(
                destructive,
                F.concat(
                    F.lit("Recommendation contains potentially destructive action: "),
                    F.substring(wording, 1, 100),
                ),
            ).otherwise(F.concat(F.lit("Safety check: no destructive action in '"), kind, F.lit("'"))),
            rank,
            at,
        ),
    )


def checks(gate: DataFrame, recommendations: DataFrame, savings_note: str = "ESTIMATED SAVINGS") -> DataFrame:
    """Critic checks, one row each; ``(stage, priority_rank, action)`` is report order.

    Per dataset: quality gate and the labelling of savings.  Per recommendation:
    evidence.  Per action: stated assumptions, no destructive wording.
    """
    per_dataset = gate.select(
        "dataset_id",
        F.lit(None).cast("string").alias("recommendation_id"),
        F.inline(F.array(_gate_check(), _label_check(savings_note))),
    )
    per_action = F.flatten(F.transform("actions", _action_checks))
    per_recommendation = recommendations.select(
        "dataset_id", "recommendation_id", F.inline(F.concat(F.array(_evidence_check()), per_action))
    )
    return per_dataset.unionByName(per_recommendation)


def _messages(outcome: str) -> Column:
    found = F.array_sort(
        F.collect_list(
            F.when(F.col("outcome") == outcome, F.struct("stage", "priority_rank", "action", "message"))
        )
    )
    return F.transform(found, lambda item: item["message"])


def decide(check_rows: DataFrame) -> DataFrame:
    """REJECT on a failed check, APPROVE with recommendations, else INVESTIGATE.

    Checks are bounded by the recommendation limit, so a dataset's list is short.
    Every recommendation has one evidence check, which is how they are counted.
    """
    advised = F.col("stage") == 2
    outcomes = check_rows.groupBy("dataset_id").agg(
        F.count_if(F.col("outcome") == PASSED).alias("checks_passed"),
        F.count_if(F.col("outcome") == FAILED).alias("checks_failed"),
        F.count_if(F.col("outcome") == MISSING).alias("missing_evidence"),
        F.count_if(F.col("outcome") == UNSUPPORTED).alias("unsupported_claims"),
        F.count_if(advised).alias("recommendation_count"),
        F.min_by("recommendation_id", F.when(advised, F.col("priority_rank"))).alias("recommendation_id"),
        _messages(PASSED).alias("_passed"),
        _messages(FAILED).alias("_failed"),
    )
    failed, count = F.col("checks_failed"), F.col("recommendation_count")
    trust = F.greatest(
        F.lit(CONFIDENCE_FLOOR),
        1 - failed * FAILED_PENALTY - F.col("missing_evidence") * MISSING_PENALTY,
    )
    rejected = F.concat(F.lit("Critic rejected: "), F.array_join(F.slice("_failed", 1, 3), "; "))
    approved = F.concat(
        count.cast("string"),
        F.lit(" recommendations passed critic validation with confidence "),
        F.format_string("%.2f", trust),
    )
    nothing = "No actionable recommendations found. Further investigation recommended."
    warned = F.array(F.concat(F.lit("WARNINGS: "), F.array_join(F.slice("_failed", 1, 2), "; ")))
    return outcomes.withColumns(
        {
            "decision": F.when(failed > 0, "REJECT").when(count > 0, "APPROVE").otherwise("INVESTIGATE"),
            "confidence": F.round(trust, 3),
            "rationale": F.when(failed > 0, rejected).when(count > 0, approved).otherwise(nothing),
            "evidence_summary": F.concat(
                F.slice("_passed", 1, 5),
                F.when(failed > 0, warned).otherwise(F.array().cast("array<string>")),
            ),
        }
    ).drop("_passed", "_failed")
