"""Labelled rows for fitting, and calibration of a score."""

from __future__ import annotations

from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that a classifier is fitted on: those whose id has the least hashes.
FIT_ROWS = 20_000


def fold(id: Column, of: int) -> Column:
    return F.crc32(id.cast("string").cast("binary")) % of


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text, label) of at most `rows` labelled documents that keep allows, drawn by a hash of the id.

    The hash bound comes from the count of labelled rows, so the draw is spread over all partitions.
    """
    known = labels.where(keep & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    n = known.count()
    if n > rows:
        share = F.shiftrightunsigned(F.xxhash64(F.lit(7), "doc_id"), 11) / F.lit(float(1 << 53))
        known = known.where(share < rows / n)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(known, "doc_id")


def isotonic(scored: DataFrame) -> IsotonicRegressionModel:
    """The whole isotonic map from x to the share of label 1, linear between its steps. scored: (x, label); not empty."""
    return IsotonicRegression(featuresCol="x", labelCol="label", predictionCol="calibrated").fit(scored)


def calibrated(scored: DataFrame, model: IsotonicRegressionModel) -> DataFrame:
    """scored with a column calibrated, from its column x, between 0 and 1."""
    return model.transform(scored).withColumn("calibrated", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("calibrated"))))
