"""The account-trust filter: cheap rules that drop edits before any scorer runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_SECONDS = 86_400.0

# The public trust levels as (account age in days, edit count).
TRUST_LEVELS = {"autoconfirmed": (4, 10), "extendedconfirmed": (30, 500)}
POLICIES = ("bots", "autoconfirmed", "extendedconfirmed")
DEFAULT_POLICY = "extendedconfirmed"


def account_age_days(registration: Column, timestamp: Column) -> Column:
    """Age when the edit was made; no registration date means older than the field."""
    age = (timestamp.cast("double") - F.unix_micros(registration) / 1e6) / DAY_SECONDS
    return F.when(registration.isNull(), F.lit(float("inf"))).otherwise(age)


def policy_levels() -> Column:
    """All policies as an array to explode: one row per (edit, policy) in a single scan."""
    return F.array(
        *[
            F.struct(
                F.lit(p).alias("policy"),
                F.lit(TRUST_LEVELS.get(p, (None, None))[0]).cast("double").alias("days"),
                F.lit(TRUST_LEVELS.get(p, (None, None))[1]).cast("bigint").alias("edits"),
            )
            for p in POLICIES
        ]
    )


def rule(user_class: Column, account: Column, timestamp: Column, days: Column, edits: Column) -> Column:
    """bot / trusted-account / kept. NULL thresholds stand for the bots-only policy."""
    old_enough = account_age_days(account["registration"], timestamp) >= days
    busy_enough = account["editcount"] >= edits
    trusted = (user_class == "registered") & account.isNotNull() & old_enough & busy_enough
    return (
        F.when(user_class == "bot", "bot")
        .when(F.coalesce(trusted, F.lit(False)), "trusted-account")
        .otherwise("kept")
    )


def decide(user_class: Column, account: Column, timestamp: Column, policy: str = DEFAULT_POLICY) -> Column:
    """STRUCT<policy, keep, rule> for one policy."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    days, edits = TRUST_LEVELS.get(policy, (None, None))
    outcome = rule(user_class, account, timestamp, F.lit(days).cast("double"), F.lit(edits).cast("bigint"))
    return F.struct(F.lit(policy).alias("policy"), (outcome == "kept").alias("keep"), outcome.alias("rule"))
