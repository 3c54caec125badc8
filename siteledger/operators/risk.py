"""Percentile risk scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteledger.functions.texts import when_list
from siteledger.operators.ordering import exact_quantiles
from siteledger.rules import (
    RISK_LABELS, RISK_NONE_LABEL, RISK_NONE_TEXT, RISK_PHRASES, Rules,
)

LOW_IS_BAD = [0.10, 0.25, 0.50]
HIGH_IS_BAD = [0.90, 0.75]
WANTED = {
    "billing_gap": LOW_IS_BAD,
    "margin_pct": LOW_IS_BAD,
    "rejected_value_ratio": HIGH_IS_BAD,
    "total_rfis": HIGH_IS_BAD,
}


def _limit_name(metric: str, q: float) -> str:
    return f"{metric}_q{round(q * 100)}"


def risk_quantiles(analysis: DataFrame) -> DataFrame:
    """One row holding the ten thresholds."""
    long = exact_quantiles(analysis, WANTED)
    return long.agg(
        *[
            F.max(F.when((F.col("metric") == m) & (F.col("q") == q), F.col("value"))).alias(
                _limit_name(m, q)
            )
            for m, qs in WANTED.items()
            for q in qs
        ]
    )


def require_columns(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def _points(metric: str, points: tuple, low: bool) -> Column:
    score = F.lit(0)
    x = F.col(metric)
    for q, value in reversed(list(zip(WANTED[metric], points))):
        limit = F.col(f"_limits.{_limit_name(metric, q)}")
        score = F.when(x <= limit if low else x >= limit, value).otherwise(score)
    return score.cast("bigint")


def risk_components(analysis: DataFrame, limits: DataFrame, rules: Rules) -> DataFrame:
    require_columns(analysis, ["project_id", *WANTED])
    one_row = limits.select(F.struct(*limits.columns).alias("limits"))
    return (
        analysis.withColumn("_limits", one_row.scalar())
        .withColumns(
            {
                "billing_score": _points("billing_gap", rules.billing_points, True),
                "margin_score": _points("margin_pct", rules.margin_points, True),
                "change_order_score": _points(
                    "rejected_value_ratio", rules.change_order_points, False
                ),
                "rfi_score": _points("total_rfis", rules.rfi_points, False),
            }
        )
        .drop("_limits")
    )


def risk_level(score: Column, rules: Rules) -> Column:
    return (
        F.when(score >= rules.risk_high, "HIGH")
        .when(score >= rules.risk_medium, "MEDIUM")
        .otherwise("LOW")
    )


def main_issue() -> Column:
    top = F.greatest(*RISK_LABELS)
    labels = when_list(*[(F.col(c) == top, F.lit(t)) for c, t in RISK_LABELS.items()])
    return F.when(top == 0, RISK_NONE_LABEL).otherwise(F.array_join(labels, ", "))


def risk_explanation() -> Column:
    phrases = when_list(*[(F.col(c) > 0, F.lit(t)) for c, t in RISK_PHRASES.items()])
    text = F.array_join(phrases, "; ")
    sentence = F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)), F.lit("."))
    return F.when(F.size(phrases) == 0, RISK_NONE_TEXT).otherwise(sentence)


def risk_scores(components: DataFrame, rules: Rules) -> DataFrame:
    total = sum((F.col(c) for c in list(RISK_LABELS)[1:]), F.col("billing_score"))
    return components.withColumns(
        {
            "risk_score": total,
            "risk_level": risk_level(total, rules),
            "main_issue": main_issue(),
            "explanation": risk_explanation(),
        }
    )
