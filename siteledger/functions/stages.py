"""Project stage and date helpers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteledger.rules import Rules


def stage_of(share: Column, rules: Rules, scale: float = 1.0) -> Column:
    """Stage from a share; NULL share gives NULL."""
    return (
        F.when(share >= rules.stage_complete * scale, "complete")
        .when(share >= rules.stage_late * scale, "late")
        .when(share >= rules.stage_active * scale, "active")
        .when(share.isNotNull(), "early")
    )


def stage_or_unknown(share: Column, rules: Rules) -> Column:
    return F.coalesce(stage_of(share, rules), F.lit("unknown"))


def stage_full(
    completion: Column, complete_pct: Column, billed_pct: Column, rules: Rules, as_of: dt.date
) -> Column:
    return F.coalesce(
        F.when(completion <= F.lit(as_of), F.lit("complete")),
        stage_of(complete_pct, rules, 100),
        stage_of(billed_pct, rules, 100),
        F.lit("unknown"),
    )


def parse_date_multi(c: Column) -> Column:
    """ISO, US slash or ISO slash date text."""
    text = F.trim(c.cast("string"))
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-M-d")).cast("date"),
        F.try_to_timestamp(text, F.lit("M/d/yyyy")).cast("date"),
        F.try_to_timestamp(text, F.lit("yyyy/M/d")).cast("date"),
    )


def monday(c: Column) -> Column:
    return F.date_trunc("week", c).cast("date")


def days_open(
    submitted: Column, responded: Column, status: Column, as_of: dt.date
) -> Column:
    """Days an RFI took, or has been waiting. `status` is normalized text."""
    answered = responded.isNotNull() & ~status.isin("open", "pending response")
    return F.when(
        submitted.isNotNull(),
        F.when(answered, F.datediff(responded, submitted)).otherwise(
            F.datediff(F.lit(as_of), submitted)
        ),
    ).cast("bigint")
