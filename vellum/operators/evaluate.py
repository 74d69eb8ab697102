"""Evaluation of answers against what was expected: which item answers which expectation, and the rates over them.

Rates over nothing are null. Joins are by case (and rule code); a case is one answer, so what meets inside it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .metrics import ratio_or_null

#: Labels of risks, and the phrase for a clause that isn't there.
RISK_LABELS_ZH = (("pass", "通过"), ("high", "高风险"), ("medium", "中风险"), ("low", "低风险"))
MISSING_ZH, NOTHING_ZH = "未发现明确原文，但相关内容缺失", "无"


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def find_items(items: DataFrame, expectations: DataFrame, case: str = "case_id") -> DataFrame:
    """expectations (case, expectation_id, rule_code, key_aliases, ...) with item, a struct of items' columns or null.

    The first item of the same rule code, by pos; else the first whose key has an alias in it or is in an alias.
    """
    packed = items.select(F.col(case), F.col("rule_code").alias("_code"), F.col("key").alias("_key"), "pos", F.struct(*items.columns).alias("_item"))
    coded = packed.where(_filled(F.col("_code"))).groupBy(case, "_code").agg(F.min_by("_item", "pos").alias("_by_code"))
    e = expectations.withColumnRenamed("rule_code", "_code").join(coded, [case, "_code"], "left")
    # an alias, where no code was found
    asked = expectations.select(case, "expectation_id", F.explode("key_aliases").alias("_alias")).where(_filled(F.col("_alias")))
    either = F.contains(F.col("_key"), F.col("_alias")) | F.contains(F.col("_alias"), F.col("_key"))
    open_ = asked.join(e.where("_by_code IS NULL").select(case, "expectation_id"), [case, "expectation_id"], "left_semi")
    aliased = open_.join(packed.withColumn("_key", F.coalesce("_key", F.lit(""))), case).where(either).groupBy(case, "expectation_id").agg(F.min_by("_item", "pos").alias("_by_alias"))
    return e.join(aliased, [case, "expectation_id"], "left").withColumn("item", F.coalesce("_by_code", "_by_alias")).withColumnRenamed("_code", "rule_code").drop("_by_code", "_by_alias")


def expectation_rates(found: DataFrame, by: list[str]) -> DataFrame:
    """Rates over find_items' rows; columns of expectations that are lacking count as null."""
    have = set(found.columns)
    e = lambda name, kind: F.col(name) if name in have else F.lit(None).cast(kind)
    fields = set(found.schema["item"].dataType.names)
    i = lambda name: F.coalesce(F.col(f"item.{name}") if name in fields else F.lit(None).cast("string"), F.lit(""))
    there = F.col("item").isNotNull()
    mode, anchor = F.coalesce(e("content_mode", "string"), F.lit("")), F.coalesce(e("content_anchor", "string"), F.lit(""))
    gone = F.contains(i("content"), F.lit(MISSING_ZH))
    quoted = F.when(mode == "none", i("content") == NOTHING_ZH).when(mode == "missing_clause", gone).when(mode == "quote", (anchor != "") & F.contains(i("content"), anchor)).otherwise(False)
    advice = F.coalesce(e("advice_expectation", "string"), F.lit(""))
    strict = F.coalesce(e("must_not_invent_numbers", "boolean"), F.lit(False))
    needed = F.coalesce(e("quality_bucket", "string") == "defective", F.lit(False)) & F.coalesce(e("expected_present", "boolean"), F.lit(False))
    rates = {
        "risk_accuracy": (i("risk") == e("risk_gold", "string"), there),
        "action_type_accuracy": (i("action_type") == e("action_type_gold", "string"), there),
        "key_hit_rate": (there & F.exists("key_aliases", lambda a: F.contains(i("key"), a)), F.size("key_aliases") > 0),
        "content_quote_accuracy": (there & quoted, mode != ""),
        "missing_clause_accuracy": (there & gone, mode == "missing_clause"),
        "advice_alignment_rate": (F.contains(i("advice"), advice), there & (advice != "")),
        "non_fabrication_rate": ((i("replace_text") == NOTHING_ZH) | ~i("replace_text").rlike("[0-9]"), there & strict),
        "false_negative_rate": (~there | (i("risk") == "pass"), needed),
    }
    return found.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(there).alias("n_found"), *[F.round(ratio_or_null(F.coalesce(hit, F.lit(False)), of), 6).alias(name) for name, (hit, of) in rates.items()])


def item_rates(items: DataFrame, by: list[str]) -> DataFrame:
    """items (risk, risk_label, rule_code, quality_bucket): consistent labels, filled codes, false alarms on standard cases."""
    label = None
    for risk, name in RISK_LABELS_ZH:
        label = F.when(F.col("risk") == risk, name) if label is None else label.when(F.col("risk") == risk, name)
    all_, standard = F.lit(True), F.coalesce(F.col("quality_bucket") == "standard", F.lit(False))
    return items.groupBy(*by).agg(
        F.round(ratio_or_null(F.col("risk_label").eqNullSafe(label), all_), 6).alias("label_consistency_rate"),
        F.round(ratio_or_null(_filled(T.strip(F.col("rule_code"))), all_), 6).alias("code_fill_rate"),
        F.round(ratio_or_null(~F.col("risk").eqNullSafe("pass"), standard), 6).alias("false_positive_rate"),
    )


def record_rates(records: DataFrame, by: list[str]) -> DataFrame:
    """records (schema_pass, counts_agree, predicted_type, expected_type, n_output, n_rules): a row for each answer."""
    known = F.col("predicted_type").isNotNull()
    kept = F.sum(F.when(F.col("n_rules").isNotNull(), F.least("n_output", "n_rules"))).cast("double")
    return records.groupBy(*by).agg(
        F.round(ratio_or_null(F.col("schema_pass"), F.lit(True)), 6).alias("schema_pass_rate"),
        F.round(ratio_or_null(F.col("counts_agree"), F.lit(True)), 6).alias("count_alignment_rate"),
        F.round(ratio_or_null(F.col("predicted_type") == F.col("expected_type"), known), 6).alias("type_accuracy"),
        F.round(F.try_divide(kept, F.sum("n_rules").cast("double")), 6).alias("retention_rate"),
    )


def run_stability(runs: DataFrame, case: str, order: str, signatures: list[str], by: list[str]) -> DataFrame:
    """Share of later runs of a case that equal its first one, for each of signatures."""
    w = Window.partitionBy(case).orderBy(order)
    seen = runs.withColumn("_n", F.row_number().over(w))
    for s in signatures:
        seen = seen.withColumn(f"_{s}", F.col(s).eqNullSafe(F.first(s).over(w)))
    return seen.groupBy(*by).agg(*[F.round(ratio_or_null(F.col(f"_{s}"), F.col("_n") > 1), 6).alias(f"{s}_stability") for s in signatures])


def keyword_edges(generated: DataFrame, expected: DataFrame, sample: str, fields: dict[str, str], threshold: float) -> DataFrame:
    """(sample, expected_pos, generated_pos) where the modules agree and every field has enough of its keywords.

    fields: a column of generated -> the column of expected with its keywords. expected.modules lists what is allowed.
    """
    g = generated.select(sample, F.col("pos").alias("generated_pos"), F.lower("review_module").alias("_module"), *[F.col(f).alias(f"_g_{f}") for f in fields])
    e = expected.select(sample, F.col("pos").alias("expected_pos"), F.explode(F.array_distinct(F.transform("modules", F.lower))).alias("_module"), *[F.col(k).alias(f"_e_{f}") for f, k in fields.items()])
    both = e.join(g, [sample, "_module"])
    for f in fields:
        both = both.where(T.keyword_ratio(F.coalesce(f"_g_{f}", F.lit("")), F.coalesce(f"_e_{f}", F.array())) >= threshold)
    return both.select(sample, "expected_pos", "generated_pos").distinct()


def greedy(edges: DataFrame, sample: str) -> DataFrame:
    """One-to-one matches: each expected rule in turn takes the first generated one that is still free.

    A sample's edges are folded as one sorted array; a sample is one evaluated answer.
    """
    e = F.sort_array(F.collect_list(F.struct("expected_pos", "generated_pos")))
    none = F.array().cast("array<struct<expected_pos:int,generated_pos:int>>")

    def step(taken, x):
        met = F.exists(taken, lambda t: (t["expected_pos"] == x["expected_pos"]) | (t["generated_pos"] == x["generated_pos"]))
        return F.when(met, taken).otherwise(F.array_append(taken, x))

    ints = edges.select(sample, F.col("expected_pos").cast("int"), F.col("generated_pos").cast("int"))
    return ints.groupBy(sample).agg(e.alias("_e")).select(sample, F.explode(F.aggregate("_e", none, step)).alias("_m")).select(sample, "_m.*")


def match_summary(expected: Column, generated: Column, matched: Column) -> list[Column]:
    """Coverage (1 if nothing is expected), precision and the share lost by merging or splitting (0 over nothing)."""
    over = lambda a, b, empty: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))
    lost = F.greatest(F.lit(0), expected - F.least(generated, matched))
    return [over(matched, expected, 1.0).alias("coverage"), over(matched, generated, 0.0).alias("precision"), over(lost, expected, 0.0).alias("overmerge_rate")]
