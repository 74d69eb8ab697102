"""Scores of a whole run: form checks, counts for each case, weighted scores, diagnostics of traces, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import metrics
from .answers import ENHANCED

#: What each check adds to a rule's score, and each measure to the score of a dense sample.
WEIGHTS = {
    "generation_ok": 0.25, "review_module_hit": 0.15, "risk_hit": 0.15, "trigger_hit": 0.15, "suggestion_hit": 0.10,
    "trace_evidence_accuracy": 0.10, "schema_ok": 0.05, "backend_fields_clean": 0.05,
}
DENSE_WEIGHTS = {
    "expected_rule_coverage": 0.35, "usable_rule_precision": 0.30, "split_accuracy": 0.20, "schema_ok": 0.05, "backend_fields_clean": 0.05, "trace_evidence_accuracy": 0.05,
}
#: Fields of a result, and the values that its items may have.
FIELDS = ("success", "enhanced", "total_risks", "message")
TYPES, LEVELS = ("added", "deleted", "modified", "moved"), ("high", "medium", "low")
#: Suggestions that a gold difference may ask for, and the share of keywords that counts as met.
REVIEW_ZH, FORMAT_ZH, THRESHOLD = "建议人工复核该改动是否符合业务预期", "无需修改，建议人工确认", 0.6


def weighted_score(weights=WEIGHTS) -> Column:
    """Sum of weights times columns of their names; true counts 1, what is lacking or false 0."""
    return reduce(lambda x, y: x + y, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in weights.items()])


def form_errors(body: Column) -> Column:
    """What is wrong with the form of a result (JSON text): its fields, their types, the items' fields and values."""
    keys = F.json_object_keys(body)
    items = F.from_json(F.get_json_object(body, "$.enhanced"), "array<map<string,string>>")
    listed = F.get_json_object(body, "$.enhanced").startswith("[")
    same = lambda have, want: (F.size(F.array_except(have, want)) == 0) & (F.size(F.array_except(want, have)) == 0)
    names = lambda fields: F.array(*map(F.lit, fields))
    raw = lambda name, pattern: F.coalesce(body.rlike(rf'"{name}"\s*:\s*{pattern}'), F.lit(False))
    bad = lambda test: F.coalesce(F.exists(items, test), F.lit(False))
    checks = {
        "top_level_fields": ~F.coalesce(same(keys, names(FIELDS)), F.lit(False)), "success_type": ~raw("success", "(true|false)"), "total_risks_type": ~raw("total_risks", "-?[0-9]+[ \\n]*[,}]"),
        "message_type": ~raw("message", '"'), "enhanced_not_list": ~F.coalesce(listed, F.lit(False)), "item_fields": bad(lambda x: ~same(F.map_keys(x), names(ENHANCED))),
        "change_type": bad(lambda x: ~F.coalesce(F.element_at(x, "change_type").isin(*TYPES), F.lit(False))), "risk_level": bad(lambda x: ~F.coalesce(F.element_at(x, "risk_level").isin(*LEVELS), F.lit(False))),
    }
    return F.array_compact(F.array(*[F.when(wrong, F.lit(name)) for name, wrong in checks.items()]))


def case_counts(cases: DataFrame, gold: DataFrame, found: DataFrame, case: str = "case_id") -> DataFrame:
    """Counts of each case, to be summed over runs.

    cases (case, old_text, new_text, success, total_risks, expected_total_risks), gold (case, gold_id, change_type, old_quote,
    new_quote, required_facts, categories, risk_levels, suggestion_mode, suggestion_template), found (case, found_id and the
    fields of an item). A gold difference takes the first free item of the same key (metrics.change_key).
    """
    key = metrics.change_key(F.col("change_type"), F.col("old_quote"), F.col("new_quote"))
    g = gold.select(case, "gold_id", metrics.change_key(F.col("change_type"), F.when(F.col("change_type") == "added", "").otherwise(F.col("old_quote")), F.when(F.col("change_type") == "deleted", "").otherwise(F.col("new_quote"))).alias("key"))
    f = found.select(case, "found_id", key.alias("key")).where("key IS NOT NULL")
    pairs = metrics.match_equal(g, f, [case, "key"]).select(case, "gold_id", "found_id")
    both = pairs.join(gold.select(case, "gold_id", F.struct("old_quote", "new_quote", "required_facts", "categories", "risk_levels", "suggestion_mode", "suggestion_template").alias("g")), [case, "gold_id"])
    both = both.join(found.select(case, "found_id", F.struct("*").alias("f")), [case, "found_id"])
    e = lambda c: F.coalesce(c, F.lit(""))
    mode, said = F.col("g.suggestion_mode"), e(F.col("f.suggestion"))
    asked = e(F.col("g.suggestion_template"))
    suggested = F.when(mode == "rule_template", (asked != "") & F.contains(said, asked)).when(mode == "default_review", said == REVIEW_ZH).when(mode == "default_format", said == FORMAT_ZH).otherwise(True)
    hits = both.groupBy(case).agg(
        F.count(F.lit(1)).alias("matched_diff_total"),
        F.count_if((e(F.col("f.old_quote")) == e(F.col("g.old_quote"))) & (e(F.col("f.new_quote")) == e(F.col("g.new_quote")))).alias("matched_quote_preserved"),
        F.count_if(T.covers(e(F.col("f.original")), F.col("g.required_facts"))).alias("matched_original_fact_hits"), F.count_if(F.array_contains("g.categories", F.col("f.category"))).alias("matched_category_hits"),
        F.count_if(F.array_contains("g.risk_levels", F.col("f.risk_level"))).alias("matched_risk_level_hits"), F.count_if(suggested).alias("matched_suggestion_hits"),
    )
    texts = found.select(case, "old_quote", "new_quote").join(cases.select(case, "old_text", "new_text"), case)
    some, stands = lambda c: e(F.col(c)) != "", lambda quote, text: (e(F.col(quote)) != "") & F.contains(F.col(text), F.col(quote))
    quoted = texts.groupBy(case).agg(
        F.count(F.lit(1)).alias("pred_diff_total"), F.count_if(some("old_quote")).alias("old_quote_hit_total"), F.count_if(stands("old_quote", "old_text")).alias("old_quote_hits"),
        F.count_if(some("new_quote")).alias("new_quote_hit_total"), F.count_if(stands("new_quote", "new_text")).alias("new_quote_hits"),
    )
    n = gold.groupBy(case).agg(F.count(F.lit(1)).alias("gold_diff_total"))
    out = cases.join(n, case, "left").join(quoted, case, "left").join(hits, case, "left")
    counts = [c for df in (n, quoted, hits) for c in df.columns if c != case]
    return out.select(
        case, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.col("success").cast("long").alias("success_case_total"),
        (F.col("success") & F.coalesce(F.col("total_risks") == F.col("expected_total_risks"), F.lit(False))).cast("long").alias("total_risks_hits"),
    )


def summed(counts: DataFrame, by: list[str], case: str = "case_id") -> DataFrame:
    """case_counts added up, with recall, precision and the rates of what was matched (1 over nothing)."""
    names = [c for c in counts.columns if c not in (case, *by)]
    s = counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in names])
    over = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(1.0)), 6)
    rates = {"recall": ("matched_diff_total", "gold_diff_total"), "precision": ("matched_diff_total", "pred_diff_total"), "risk_level_accuracy": ("matched_risk_level_hits", "matched_diff_total"), "old_quote_rate": ("old_quote_hits", "old_quote_hit_total"), "total_risks_accuracy": ("total_risks_hits", "success_case_total")}
    return s.select("*", *[over(*of).alias(name) for name, of in rates.items()])


def trace_diagnostics(samples: DataFrame, diffs: DataFrame, expected: DataFrame, rules: DataFrame, sample: str = "sample_id") -> DataFrame:
    """How a sample's differences became rules.

    diffs (sample, diff_id, review_module, change_type, before, after, is_substantive), expected (sample, rule_id, modules,
    change_type or null, keywords), rules (sample, rule_id, source_diff_id, evidence_before, evidence_after, valid).
    """
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    text = F.concat_ws("\n", F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")))
    e = expected.select(sample, F.col("rule_id").alias("_rule"), F.explode(F.array_distinct(F.transform("modules", F.lower))).alias("_module"), F.col("change_type").alias("_kind"), F.coalesce("keywords", F.array()).alias("_keywords")).alias("e")
    d = diffs.select(sample, F.lower("review_module").alias("_module"), "change_type", text.alias("_text")).alias("d")
    same = (F.col(f"e.{sample}") == F.col(f"d.{sample}")) & (F.col("e._module") == F.col("d._module"))
    met = e.join(d, same & (F.col("_kind").isNull() | (F.col("_kind") == F.col("change_type"))) & (T.keyword_ratio(F.col("_text"), F.col("_keywords")) >= THRESHOLD), "left_semi")
    asked = expected.select(sample, F.col("rule_id").alias("_rule"), F.lit(0).alias("_covered")).unionByName(met.select(sample, "_rule", F.lit(1).alias("_covered")))
    asked = asked.where("_rule IS NOT NULL").groupBy(sample, "_rule").agg(F.max("_covered").alias("_covered"))
    r = rules.select(sample, F.col("rule_id").alias("_rule"), F.concat_ws("\n", "evidence_before", "evidence_after").alias("_told")).alias("r")
    noop = diffs.where("NOT is_substantive").select(sample, "before", "after").alias("n")
    pointed = r.join(noop, (F.col(f"r.{sample}") == F.col(f"n.{sample}")) & (F.contains("_told", "before") | F.contains("_told", "after")), "left_semi")
    parts = (
        diffs.select(sample, F.lit(1).alias("candidate_diff_count"), one(F.col("is_substantive")).alias("substantive_diff_count"), one(~F.col("is_substantive")).alias("noop_diff_count")),
        asked.select(sample, F.lit(1).alias("_expected"), "_covered"),
        pointed.where("_rule IS NOT NULL").select(sample, "_rule").distinct().select(sample, F.lit(1).alias("_noop_rules")),
        rules.select(sample, F.lit(1).alias("_rules"), one(F.col("valid")).alias("_valid"), one(F.coalesce("source_diff_id", F.lit("")) != "").alias("_traced")),
    )
    # summed together: joined one by one, all parts' sums and sorted rows would stand in one task
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    sums = rows.groupBy(sample).agg(*[F.sum(c).alias(c) for c in rows.columns if c != sample])
    out = samples.select(sample).join(sums, sample, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    over = lambda a, b, empty: F.round(F.coalesce(F.try_divide(zero(a), zero(b)), F.lit(empty)), 6)
    return out.select(
        sample, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("candidate_diff_count", "substantive_diff_count")], over("_covered", "_expected", 1.0).alias("expected_diff_coverage"),
        F.round(1 - F.coalesce(F.try_divide(zero("_noop_rules"), zero("noop_diff_count")), F.lit(0.0)), 6).alias("move_noop_filter_accuracy"), over("_rules", "substantive_diff_count", 0.0).alias("diff_to_rule_conversion_rate"),
        over("_valid", "_rules", 0.0).alias("trace_validated_rate"), over("_traced", "_rules", 0.0).alias("trace_diff_id_present_rate"),
    )


def audit_summary(records: DataFrame, items: DataFrame, expectations: DataFrame, runs: DataFrame) -> DataFrame:
    """One row of all measures of an audit run, from the parts that evaluate.* give with by = ["all"]."""
    return records.join(items, "all", "left").join(expectations, "all", "left").join(runs, "all", "left").drop("all")


def merge_reports(*reports: DataFrame) -> DataFrame:
    """Rows of several reports, with report (its place); columns that one lacks are null."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [df.withColumn("report", F.lit(i)) for i, df in enumerate(reports)])


def write_report(report: DataFrame, path: str, kind: str = "json") -> None:
    """As JSON lines, or as CSV with a header and its columns in order of their names, in as many parts as there are partitions."""
    if kind == "csv":
        report.select(*sorted(report.columns)).write.mode("overwrite").option("header", True).csv(path)
    else:
        report.write.mode("overwrite").json(path)


def stub_outputs(gold: DataFrame) -> DataFrame:
    """Gold differences as a perfect answer's items, in order, for runs without a model; where `original` lacks it is the facts asked for."""
    e = lambda c: F.coalesce(F.col(c), F.lit("")) if c in gold.columns else F.lit("")
    facts = F.array_compact(F.transform(F.coalesce("required_facts", F.array().cast("array<array<string>>")), lambda o: F.get(F.filter(o, lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(0))))
    original = F.when(e("original") != "", e("original")).otherwise(F.concat_ws("；", facts))
    return gold.select("case_id", F.col("gold_id").alias("found_id"), *[(original if c == "original" else e(c)).alias(c) for c in sorted(ENHANCED)])


def expanded(text: Column) -> Column:
    """A sample's text: itself, or its parts, what is repeated so many times, and its suffix, joined by line feeds.

    text: struct (parts, repeat, repeat_count, suffix).
    """
    none = F.array().cast("array<string>")
    often = F.flatten(F.array_repeat(F.coalesce(text["repeat"], none), F.coalesce(text["repeat_count"], F.lit(0)).cast("int")))
    return F.array_join(F.concat(F.coalesce(text["parts"], none), often, F.coalesce(text["suffix"], none)), "\n")
