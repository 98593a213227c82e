"""Scores of knowledge edges and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def relation_score(confidence: Column, strong: Column, reasoning: Column, evidence: Column, mentions: Column, status: Column, unspecific: Column) -> Column:
    """Confidence with weights for the relation's strength, the evidence and the review status, between 0 and 1."""
    pick = lambda c, yes, no: F.when(c, yes).otherwise(no)
    total = (
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))
        + pick(strong, 0.12, -0.08)
        + pick(reasoning, 0.06, -0.04)
        + pick(F.length(F.coalesce(evidence, F.lit(""))) >= 8, 0.08, -0.25)
        + pick(mentions, 0.06, 0.0)
        + pick(status == "CONFIRMED", 0.12, 0.0)
        + pick(status.isin("REJECTED", "DISABLED"), -1.0, 0.0)
        + pick(unspecific, -0.18, 0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def path_score(confidences: Column, qualities: Column, strengths: Column) -> Column:
    """Mean confidence and quality, strengths of 0.08 either way, and 0.03 off for each further edge, between 0 and 1."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    n = F.size(confidences)
    s = 0.45 * total(confidences) / n + 0.45 * total(qualities) / n + total(strengths) - 0.03 * (n - 1)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))
