"""Replacement spans: validity, overlap, and the text with them applied."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def check_spans(spans: DataFrame, by: str) -> DataFrame:
    """spans (by, start, end) with problem: invalid, overlaps (starts before the end of the one before), or null."""
    before = F.lag("end").over(Window.partitionBy(by).orderBy("start", "end"))
    problem = F.when((F.col("start") < 0) | (F.col("end") < F.col("start")), "invalid").when(before.isNotNull() & (F.col("start") < before), "overlaps")
    return spans.withColumn("problem", problem)


def apply_spans(docs: DataFrame, spans: DataFrame, by: str, text_col: str = "text") -> DataFrame:
    """docs with spliced_text; documents with a bad span get null, those without any keep their text."""
    checked = check_spans(spans, by)
    one = F.collect_list(F.struct("start", "end", "replace_text"))
    grouped = checked.groupBy(by).agg(one.alias("_s"), F.count("problem").alias("_bad"))
    out = docs.join(grouped, by, "left")
    return out.withColumn("spliced_text", F.when(F.col("_s").isNull(), F.col(text_col)).when(F.col("_bad") == 0, T.splice(F.col(text_col), F.col("_s")))).drop("_s", "_bad")
