"""Evaluation: ratios with their conventions for empty denominators, one-to-one matches, percentiles, stability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written


def ratio_or_null(hits: Column, of: Column) -> Column:
    """Share of rows with hits among those with of; null over nothing."""
    return F.try_divide(F.count_if(hits & of).cast("double"), F.count_if(of).cast("double"))


def ratio_or(hits: Column, of: Column, empty: float) -> Column:
    return F.coalesce(ratio_or_null(hits, of), F.lit(empty))


def match_equal(gold: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Greedy one-to-one matches of equal keys: the n-th of one side meets the n-th of the other."""
    n = lambda df, order: df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order)))
    return n(gold, "gold_id").join(n(found, "found_id"), [*key, "_n"]).drop("_n")


def change_key(kind: Column, old_quote: Column, new_quote: Column) -> Column:
    """What a found difference must share with a gold one: type and new quote of an addition, type and old quote of a deletion, else all.

    An addition with an old quote, or a deletion with a new one, matches nothing and has no key.
    """
    o, n = F.coalesce(old_quote, F.lit("")), F.coalesce(new_quote, F.lit(""))
    some = F.when(kind == "added", o == "").when(kind == "deleted", n == "").otherwise(True)
    return F.when(some, F.struct(kind.alias("kind"), o.alias("old"), n.alias("new")))


def prf(matched: int | Column, gold: Column, found: Column) -> list[Column]:
    """precision, recall and F1 to six places; 0 over nothing."""
    p, r = F.coalesce(F.try_divide(matched, found), F.lit(0.0)), F.coalesce(F.try_divide(matched, gold), F.lit(0.0))
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1")]


def at_places(rows: DataFrame, by: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """The values at places (from 0, expressions of n, the group's number of values) in each group's order; nulls don't count.

    Equal values are counted, the counts put in order over all tasks, and running sums taken inside each task's range
    and over the ranges' totals, so that a group may be of any size.
    """
    c = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    c = written(c.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id()), "ordered-counts")
    ranges = c.groupBy(*by, "_part").agg(F.sum("_c").alias("_t"))
    before = Window.partitionBy(*by).orderBy("_part")
    ranges = ranges.withColumn("_off", F.sum("_t").over(before) - F.col("_t")).withColumn("n", F.sum("_t").over(Window.partitionBy(*by)))
    run = c.withColumn("_end", F.sum("_c").over(Window.partitionBy(*by, "_part").orderBy("_v")))
    run = run.join(ranges, [*by, "_part"]).withColumn("_end", F.col("_end") + F.col("_off")).withColumn("_start", F.col("_end") - F.col("_c"))
    return run.groupBy(*by).agg(*[F.max(F.when((place >= F.col("_start")) & (place < F.col("_end")), F.col("_v"))).alias(name) for name, place in places.items()], F.max("n").alias("n"))


def latency(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """avg, p95 (interpolated) and max."""
    at = (F.col("n") - 1) * 0.95
    found = at_places(rows, by, value, {"_low": F.floor(at), "_high": F.ceil(at)})
    at = (F.col("n") - 1) * 0.95
    p95 = F.col("_low") + (F.col("_high") - F.col("_low")) * (at - F.floor(at))
    sums = rows.groupBy(*by).agg(F.round(F.avg(value), 6).alias("avg_value"), F.round(F.max(value), 6).alias("max_value"))
    return sums.join(found.select(*by, F.round(p95, 6).alias("p95_value")), by, "left").select(*by, "avg_value", "p95_value", "max_value")


def nearest_rank(rows: DataFrame, by: list[str], value: str, shares=(0.5, 0.95)) -> DataFrame:
    """The value at place round-half-even(p * (n - 1)) of the order, for each share p."""
    return at_places(rows, by, value, {f"p{round(100 * p)}": F.bround(F.lit(p) * (F.col("n") - 1)) for p in shares}).drop("n")


def stability(runs: DataFrame, by: str, signature: str) -> DataFrame:
    """For each case the share of runs that gave its commonest result."""
    c = runs.groupBy(by, signature).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(by).agg((F.max("n") / F.sum("n")).alias("stability"))


def report(rows: DataFrame, dim: str, measures: list[Column]) -> DataFrame:
    """Overall (dim null) and by dim."""
    return rows.rollup(dim).agg(*measures)


def canonical(answer: Column) -> Column:
    """A JSON text with its objects' keys in order and without blanks, so that equal answers are equal texts."""
    return F.to_json(F.try_parse_json(answer))


def _items(answer: Column) -> Column:
    return F.coalesce(F.from_json(F.get_json_object(answer, "$.enhanced"), "array<string>"), F.array().cast("array<string>"))


def structure(answer: Column) -> Column:
    """What an answer is built like: its keys in their order, success, and of each item its keys, change type and risk."""
    each = lambda path: F.transform(_items(answer), lambda x: F.coalesce(F.get_json_object(x, path), F.lit("")))
    keys = F.transform(_items(answer), lambda x: F.array_join(F.array_sort(F.coalesce(F.json_object_keys(x), F.array().cast("array<string>"))), ","))
    return F.to_json(F.struct(F.json_object_keys(answer).alias("top"), F.get_json_object(answer, "$.success").alias("success"), keys.alias("keys"), each("$.change_type").alias("kinds"), each("$.risk_level").alias("risks")))


def quotes(answer: Column) -> Column:
    """An answer's change types and quotes, whatever their order."""
    text = lambda x, path: F.coalesce(F.get_json_object(x, path), F.lit(""))
    one = lambda x: F.struct(text(x, "$.change_type").alias("kind"), text(x, "$.old_quote").alias("old"), text(x, "$.new_quote").alias("new"))
    return F.to_json(F.array_sort(F.transform(_items(answer), one)))


def answer_stability(runs: DataFrame, by: str, answer: str) -> DataFrame:
    """For each case how many runs it had and the share of those that gave its commonest answer: whole, by structure, by quotes."""
    signed = runs.select(by, *[f(F.col(answer)).alias(n) for n, f in (("exact", canonical), ("structure", structure), ("quotes", quotes))])
    out = signed.groupBy(by).agg(F.count(F.lit(1)).alias("n_runs"))
    for n in ("exact", "structure", "quotes"):
        out = out.join(stability(signed.select(by, F.coalesce(n, F.lit("")).alias(n)), by, n).select(by, F.col("stability").alias(f"{n}_rate")), by)
    return out
