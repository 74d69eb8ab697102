"""Audit results: item normal form, counts, conformance checks, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.text import first_filled


def normalize_items(items: DataFrame) -> DataFrame:
    """items (risk, key, content, replace_text, ...) with risk, risk_label and action_type in normal form."""
    risk = labels.final_risk(F.col("risk"))
    label = labels.intermediate_risk(F.col("risk"))
    out = items.withColumn("risk_label", label).withColumn("risk", risk)
    return out.withColumn("action_type", labels.action_type(F.col("risk"), F.col("key"), F.col("content"), F.col("replace_text")))


def risk_points(items: DataFrame) -> DataFrame:
    """What becomes a risk point: no passes; what would be appended is left to a person."""
    kept = items.where("risk <> 'pass'")
    return kept.withColumn("action_type", F.when(F.col("action_type") == "append", "manual").otherwise(F.col("action_type")))


def counts(items: DataFrame, by: str, *more: Column) -> DataFrame:
    """Counts by final risk, as strings, and more aggregates of the same rows."""
    n = lambda risk, name: F.count_if(F.col("risk") == risk).cast("string").alias(name)
    return items.groupBy(by).agg(n("pass", "agreeCount"), n("high", "highlevelriskCount"), n("medium", "mediumlevelriskCount"), n("low", "lowlevelriskCount"), *more)


def conformance(items: DataFrame, totals: DataFrame, by: str) -> DataFrame:
    """Checks of a result: known risks and actions, labels that fit, codes present, counts that add up; issues lists failures."""
    bad = lambda c: F.count_if(~F.coalesce(c, F.lit(False)))
    names = ("risk_domain", "action_domain", "label_fits", "code_present")
    checks = (
        F.col("risk").isin("high", "medium", "low", "pass"),
        F.col("action_type").isin("manual", "append", "insert", "replace"),
        F.col("risk_label") == labels.intermediate_risk(F.col("risk")),
        first_filled(F.col("rule_code")) != "",
    )
    got = items.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[(bad(c) == 0).alias(n) for n, c in zip(names, checks, strict=True)])
    total = sum((F.col(c).cast("long") for c in ("agreeCount", "highlevelriskCount", "mediumlevelriskCount", "lowlevelriskCount")), F.lit(0))
    out = totals.join(got, by, "left").withColumn("counts_add_up", total == F.coalesce("n", F.lit(0)))
    every = (*names, "counts_add_up")
    return out.withColumn("issues", F.array_compact(F.array(*[F.when(~F.coalesce(F.col(c), F.lit(True)), F.lit(c)) for c in every]))).select(by, *every, "issues")


def total_risks(enhanced: DataFrame, by: str, non_substantive: Column) -> DataFrame:
    """High and medium risks, and low ones that are more than wording."""
    counted = F.col("risk_level").isin("high", "medium") | ((F.col("risk_level") == "low") & ~non_substantive)
    return enhanced.groupBy(by).agg(F.count_if(counted).alias("total_risks"))


def quotes_valid(kind: Column, old_quote: Column, new_quote: Column, old_text: Column, new_text: Column) -> Column:
    """Each quote stands in its version; an added or deleted passage has one side only."""
    o, n = F.coalesce(old_quote, F.lit("")), F.coalesce(new_quote, F.lit(""))
    in_old, in_new = (o != "") & F.contains(old_text, o), (n != "") & F.contains(new_text, n)
    return F.when(kind == "added", (o == "") & in_new).when(kind == "deleted", (n == "") & in_old).otherwise(in_old & in_new)


def status_counts(rows: DataFrame, by: list[str], status: Column) -> DataFrame:
    """total, confirmed, ignored and the rest as pending."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(status == "confirmed").alias("confirmed"), F.count_if(status == "ignored").alias("ignored"),
        F.count_if(~status.isin("confirmed", "ignored")).alias("pending"),
    )
