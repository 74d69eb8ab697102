"""The rule catalogue: validation, import, filters, buckets, dedup and look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..functions import text as T

#: Columns of a rule file by their headers, and the values of its two lists.
HEADERS_ZH = {
    "规则编码": "rule_code", "合同类型": "contract_type", "审查视角": "review_perspective", "审查模块": "review_module", "风险名称": "risk_name",
    "审查要点": "check_point", "触发条件": "trigger_condition", "默认风险等级": "default_risk_level", "建议模板": "suggestion_template", "示例条款": "example_clause",
}
REQUIRED = ("rule_code", "contract_type", "review_module", "risk_name", "check_point", "trigger_condition", "default_risk_level", "suggestion_template")
LEVELS_ZH, PERSPECTIVES_ZH = ("高", "中", "低"), ("甲方", "乙方", "通用")
GENERIC_ZH, OTHER_ZH = "通用", "其他"


def payload_errors(required=REQUIRED, levels=LEVELS_ZH, perspectives=PERSPECTIVES_ZH) -> Column:
    """Array of what is wrong with a rule; empty if nothing."""
    blank = [F.when(T.blank_to_null(F.col(c)).isNull(), F.lit(f"{c} is required")) for c in required]
    level = F.when(T.blank_to_null(F.col("default_risk_level")).isNotNull() & ~T.strip(F.col("default_risk_level")).isin(*levels), F.lit("default_risk_level is unknown"))
    side = F.when(~T.strip(F.coalesce("review_perspective", F.lit(perspectives[-1]))).isin(*perspectives), F.lit("review_perspective is unknown"))
    return F.array_compact(F.array(*blank, level, side))


def check_import(rows: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """rows (with row_number) and errors: invalid fields, codes met before in the file; exists: code in the catalogue."""
    again = F.row_number().over(Window.partitionBy("rule_code").orderBy("row_number")) > 1
    out = rows.withColumn("errors", F.array_compact(F.concat(payload_errors(), F.array(F.when(again & T.blank_to_null(F.col("rule_code")).isNotNull(), F.lit("rule_code occurs twice"))))))
    if catalogue is None:
        return out.withColumn("exists", F.lit(False))
    known = catalogue.select("rule_code", F.lit(True).alias("exists")).distinct()
    return out.join(known, "rule_code", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def importable(checked: DataFrame) -> DataFrame:
    """Rows to append: none if any row has an error, else those the catalogue lacks."""
    wrong = checked.where(F.size("errors") > 0).limit(1)
    return checked.where(~F.col("exists")).join(wrong.select(F.lit(1).alias("_w")), F.lit(True), "left_anti").drop("errors", "exists")


def list_rules(rules: DataFrame, contract_type: str | None = None, enabled: bool | None = None) -> DataFrame:
    """Equality filters; None filters nothing."""
    if contract_type is not None:
        rules = rules.where(F.col("contract_type") == contract_type)
    return rules if enabled is None else rules.where(F.col("enabled") == enabled)


def audit_rules(rules: DataFrame, contract_type: str | None, generic: str = GENERIC_ZH, other: str = OTHER_ZH) -> DataFrame:
    """Enabled rules of the type and generic ones; of no type or `other`, generic ones only."""
    types = [generic] if not contract_type or contract_type == other else [generic, contract_type]
    return rules.where(F.col("enabled") & F.col("contract_type").isin(*types))


def snapshot(rules: DataFrame, contract_type: str | None, generic: str = GENERIC_ZH) -> DataFrame:
    """As audit_rules, but `other` is a type like any."""
    types = [generic, contract_type] if contract_type else [generic]
    return rules.where(F.col("enabled") & F.col("contract_type").isin(*types))


#: Fields of a rule as a snapshot has them, and the names that they go by in an answer to another service.
SNAPSHOT = ("rule_code", "contract_type", "review_module", "risk_name", "check_point", "trigger_condition", "default_risk_level", "suggestion_template", "example_clause", "review_perspective")
RENAMED = {"rule_code": "rule_id", "review_module": "module"}


def snapshot_fields(rules: DataFrame) -> DataFrame:
    return rules.select(*SNAPSHOT)


def service_fields(rules: DataFrame) -> DataFrame:
    return rules.select(*[F.col(c).alias(RENAMED.get(c, c)) for c in SNAPSHOT if c != "review_perspective"])


def type_counts(rules: DataFrame, generic: str = GENERIC_ZH) -> DataFrame:
    """Rules of each type and of each of its modules, how many modules it has, and whether it is the common one."""
    each = rules.groupBy("contract_type", "review_module").agg(F.count(F.lit(1)).alias("n_module"))
    whole = each.groupBy("contract_type").agg(F.sum("n_module").alias("n_rules"), F.count(F.lit(1)).alias("n_modules"))
    return each.join(whole, "contract_type").withColumn("scope", F.when(F.col("contract_type") == generic, "common").otherwise("specific"))


def bucket(rules: DataFrame, bucket_of: Column) -> DataFrame:
    """One row for each bucket: its rules' codes by module and code, and how many are of which type."""
    one = F.sort_array(F.collect_list(F.struct("review_module", "rule_code")))
    return rules.groupBy(bucket_of.alias("bucket")).agg(F.count(F.lit(1)).alias("n_rules"), F.transform(one, lambda r: r["rule_code"]).alias("rule_codes"))


def dedup(rules: DataFrame, position: str = "pos") -> DataFrame:
    """The first rule of each code; without a code, of each risk name; without either, of each whole row."""
    whole = F.sha2(F.to_json(F.struct(*[c for c in rules.columns if c != position])), 256)
    key = F.coalesce(F.concat(F.lit("c:"), T.blank_to_null(F.col("rule_code"))), F.concat(F.lit("n:"), T.blank_to_null(F.col("risk_name"))), F.concat(F.lit("w:"), whole))
    first = F.row_number().over(Window.partitionBy("_key").orderBy(position))
    return rules.withColumn("_key", key).withColumn("_n", first).where("_n = 1").drop("_key", "_n")


def halves(rules: DataFrame, order: str) -> DataFrame:
    """half 1 or 2 inside each module; the first is the larger one."""
    return rules.withColumn("half", F.ntile(2).over(Window.partitionBy("review_module").orderBy(order)))


def resolve_codes(items: DataFrame, rules: DataFrame) -> DataFrame:
    """items with rule_code: their own, else that of the first rule of the same risk name."""
    by_name = rules.groupBy("risk_name").agg(F.min_by("rule_code", "pos").alias("_code"))
    return items.join(by_name, "risk_name", "left").withColumn("rule_code", F.coalesce(T.blank_to_null(F.col("rule_code")), "_code", F.lit(""))).drop("_code")


#: The names that a rule's fields go by, the first filled one counts.
FIELD_NAMES = {
    "rule_code": ("rule_code", "rule_id", "规则编号"),
    "contract_type": ("contract_type", "合同类型"),
    "review_module": ("review_module", "module", "审核模块"),
    "risk_name": ("risk_name", "风险名称"),
    "check_point": ("check_point", "检查点"),
    "trigger_condition": ("trigger_condition", "触发条件"),
    "default_risk_level": ("default_risk_level", "默认风险等级"),
    "suggestion_template": ("suggestion_template", "修改建议模板"),
    "example_clause": ("example_clause", "示例问题条款"),
}


def named_fields(raw: DataFrame, fallback: str = OTHER_ZH, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rules whose columns go by any of FIELD_NAMES, under the fields' own names; a field that no column has is empty."""
    have = set(raw.columns)
    picked = {field: T.first_filled(*[F.col(f"`{n}`") for n in names if n in have]) for field, names in FIELD_NAMES.items()}
    picked["review_module"] = labels.rule_module(picked["review_module"], F.lit(fallback))
    out = raw.select(*keep, *[c.alias(f) for f, c in picked.items()])
    return out.withColumns({"rule_id": F.col("rule_code"), "module": F.col("review_module")})
