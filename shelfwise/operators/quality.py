"""Declared row rules and column masking."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

PII = ("credit_card_last4",)
MARKETER_PII = (*PII, "email")


def _checks(rules: Mapping[str, str]) -> dict[str, Column]:
    """A rule that yields null counts as broken."""
    return {name: F.coalesce(F.expr(rule), F.lit(False)) for name, rule in rules.items()}


def rule_violations(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Rows seen and rows that break each rule, from one pass."""
    checks = _checks(rules)
    counts = df.agg(F.count("*").alias("rows"), *[F.count_if(~check).alias(name) for name, check in checks.items()])
    listed = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in checks])
    return counts.select("rows", F.inline(listed))


def expect_or_drop(
    df: DataFrame, rules: Mapping[str, str], observation: Observation | str | None = None
) -> DataFrame:
    """Keep the rows that satisfy every rule.

    With ``observation`` the same pass counts the rows and each rule's violations.
    """
    checks = _checks(rules)
    if observation is not None:
        counts = [F.count_if(~check).alias(name) for name, check in checks.items()]
        df = df.observe(observation, F.count(F.lit(1)).alias("rows"), *counts)
    for check in checks.values():
        df = df.where(check)
    return df


def mask_pii(df: DataFrame, marketer: bool = False) -> DataFrame:
    """Drop the raw card digits, and for marketers the address as well."""
    return df.drop(*(MARKETER_PII if marketer else PII))
