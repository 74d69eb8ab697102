"""Rule mining: queries by module, rules from differences, evidence checks and the merge of candidates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..functions import text as T
from ..functions.text import blank_to_null, first_filled, strip
from .answers import rule_code
from .base_info import change_direction

#: What a rule of a module is called, checks, is triggered by, and suggests.
TEMPLATES_ZH = {
    "付款条款": (
        "付款及发票条件不明确",
        "检查付款期限、付款起算节点、合法有效发票和付款前置条件是否明确。",
        "合同未明确30日内付款、合法有效发票或付款起算条件时触发；参考修改后表述：",
        "建议明确在验收或确认完成并收到合法有效发票后30日内付款，避免付款期限和发票条件不清。",
    ),
    "服务水平": (
        "SLA响应和未达标扣减机制缺失",
        "检查SLA响应时间、恢复时间、未达标整改和服务费扣减机制是否明确。",
        "合同未明确1小时等响应时间、恢复时限或5%等服务费扣减机制时触发；参考修改后表述：",
        "建议明确SLA响应时间、恢复时间、连续未达标的整改方案和服务费扣减机制。",
    ),
    "知识产权": (
        "成果和源代码知识产权归属不明确",
        "检查源代码、技术文档、接口文档、交付成果和既有组件的知识产权归属是否清晰。",
        "合同未明确源代码、交付成果归属或未约定甲方所有及既有组件保留时触发；参考修改后表述：",
        "建议明确知识产权归属，区分定制成果、源代码、技术文档和乙方既有组件或通用工具。",
    ),
    "交付验收": (
        "验收标准和整改机制不明确",
        "检查验收标准、验收期限、验收不合格处理和免费整改机制是否明确。",
        "合同未明确验收标准、验收期限或整改期限时触发；参考修改后表述：",
        "建议明确验收标准、组织验收期限、验收不合格后的免费整改期限和再次验收安排。",
    ),
    "押金退还": (
        "押金退还条件和期限不明确",
        "检查押金退还条件、房屋交接、款项结清和退还期限是否明确。",
        "合同仅约定视情况退还押金，未明确7个工作日等退还期限或交接条件时触发；参考修改后表述：",
        "建议明确交接、结清费用和无损坏等退还条件，并约定出租方在固定期限内退还押金。",
    ),
    "数据安全": (
        "数据处理和返还删除义务不明确",
        "检查数据处理目的、处理范围、数据返还、删除和书面证明义务是否明确。",
        "合同未明确数据处理边界、10日内返还或删除及书面证明义务时触发；参考修改后表述：",
        "建议明确数据处理目的和范围，约定合同终止后的返还、删除期限及书面证明。",
    ),
    "管辖法院": (
        "争议解决和管辖法院约定不明确",
        "检查争议解决路径、协商期限和管辖法院是否明确且便利。",
        "合同未明确协商不成后的起诉路径、甲方所在地或有管辖权法院时触发；参考修改后表述：",
        "建议明确协商不成后的争议解决方式，并约定管辖法院所在地，例如甲方所在地有管辖权的法院。",
    ),
    "保密条款": (
        "保密范围和保密期限不明确",
        "检查保密范围、客户数据、个人信息和合同终止后的保密期限是否明确。",
        "合同未明确客户数据等保密范围或终止后5年等保密期限时触发；参考修改后表述：",
        "建议明确保密范围、保密期限、客户数据和个人信息保护要求，并约定终止后的持续保密义务。",
    ),
    "解除条款": (
        "解除通知和费用结算机制缺失",
        "检查单方解除是否约定提前书面通知、已完成工作量和费用结算。",
        "合同允许随时解除但未约定30日书面通知或结算已完成工作量时触发；参考修改后表述：",
        "建议约定解除需提前30日书面通知，并按已完成工作量进行费用结算。",
    ),
}
#: The rule of any other module, around the module's name.
GENERIC_ZH = (
    ("", "约定不明确", "安排不当", "条款"),
    ("检查", "是否存在与本次修改相同或类似的风险安排。"),
    ("", "条款出现类似修改前表述，可能影响权利义务、责任承担或履约确定性时触发。"),
    ("建议参考本次修改后的表达，明确", "中的关键条件、责任边界和履行要求。"),
)
#: A contract's type and a rule's level and intent where none is told; what stands for a missing side.
NO_TYPE_ZH, NO_MODULE_ZH, LEVEL_ZH = "通用合同", "通用条款", "中"
NO_CASE_INTENT_ZH = "无高匹配知识库案例，仅基于修改行为反推候选审核规则，需人工确认后入库。"
GUESSED_INTENT_ZH = "根据合同修改行为逆向推断候选审核规则"
NO_BEFORE_ZH, NO_AFTER_ZH = "原合同未约定对应内容", "修改后未保留对应内容"
#: Confidence of a rule from a case, from a template, and of a trace that was filled in.
FROM_CASE, FROM_TEMPLATE, FILLED_IN = 0.78, 0.52, 0.72
#: Words added to a search for a module's context, and what ends a query for cases.
CONTEXT_ZH = {
    "服务水平": "SLA 响应时间 恢复时间 服务费 扣减 未达标",
    "知识产权": "源代码 交付成果 既有组件 技术文档 权利归属",
    "交付验收": "验收标准 验收期限 整改 不合格",
    "押金退还": "押金 退还 交接 结清 工作日",
}
NO_ROLE_ZH, QUERY_END_ZH = "通用角色", "逆向生成审核规则"


def clipped(text: Column, limit: int = 80) -> Column:
    t = strip(text)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit), F.lit("...")))


RULE_TEXTS = ("risk_name", "check_point", "trigger_condition", "suggestion_template")


def templates(spark: SparkSession) -> DataFrame:
    """(t_module, and RULE_TEXTS with t_ in front): a row for each module that has a rule of its own."""
    return spark.createDataFrame([(name, *texts) for name, texts in TEMPLATES_ZH.items()], ", ".join(f"t_{c} string" for c in ("module", *RULE_TEXTS)))


def template_texts(module: Column, evidence: Column) -> list[Column]:
    """RULE_TEXTS of a row joined with templates(), by name; evidence ends a module's trigger."""
    (_, named, other, end), *around = GENERIC_ZH
    generic = [F.concat(module, F.when(module.endswith(end), named).otherwise(other)), *[F.concat(F.lit(a), module, F.lit(b)) for a, b in around]]
    own = [F.concat(F.col(f"t_{c}"), clipped(evidence)) if c == "trigger_condition" else F.col(f"t_{c}") for c in RULE_TEXTS]
    return [F.coalesce(x, y).alias(c) for c, x, y in zip(RULE_TEXTS, own, generic, strict=True)]


def stub_candidates(diffs: DataFrame, pairs: DataFrame, cases: DataFrame, pair_col: str = "pair_id") -> DataFrame:
    """A candidate rule for each substantive difference, without a model: by its module's template, else its first case.

    diffs (pair, diff_id, review_module, before, after, is_substantive), pairs (pair, contract_type, review_role),
    cases (pair, pos, review_module and the fields of a rule): what retrieval gave, in order.
    """
    fields = ("risk_name", "check_point", "trigger_condition", "suggestion_template", "example_clause", "default_risk_level", "user_intent")
    first = cases.groupBy(pair_col, "review_module").agg(F.min_by(F.struct(*fields, "contract_type"), "pos").alias("case"))
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    d = diffs.where("is_substantive").withColumn("review_module", F.when(empty(F.col("review_module")), NO_MODULE_ZH).otherwise(F.col("review_module")))
    d = d.join(pairs.select(pair_col, F.col("contract_type").alias("_type"), "review_role"), pair_col).join(first, [pair_col, "review_module"], "left")
    # as many rows as TEMPLATES_ZH has
    d = d.join(F.broadcast(templates(d.sparkSession)), F.col("review_module") == F.col("t_module"), "left")
    before, after = (F.coalesce(c, F.lit("")) for c in ("before", "after"))
    cased = F.col("case").isNotNull() & F.col("t_module").isNull()
    made = dict(zip(RULE_TEXTS, template_texts(F.col("review_module"), F.when(after != "", after).otherwise(before)), strict=True))
    of = lambda name, other: F.when(cased, F.col(f"case.{name}")).otherwise(other)
    filled = lambda c, other: F.when(c == "", other).otherwise(c)
    return d.select(
        pair_col, "diff_id", "review_module",
        F.coalesce(blank_to_null(F.col("_type")), F.when(cased, blank_to_null(F.get("case.contract_type", F.lit(0)))), F.lit(NO_TYPE_ZH)).alias("contract_type"),
        labels.perspective(F.coalesce("review_role", F.lit(""))).alias("review_perspective"),
        *[of(n, made[n]).alias(n) for n in ("risk_name", "check_point", "trigger_condition", "suggestion_template")],
        F.when(cased, F.coalesce(blank_to_null(F.col("case.default_risk_level")), F.lit(LEVEL_ZH))).otherwise(LEVEL_ZH).alias("default_risk_level"),
        F.when(cased, F.coalesce(blank_to_null(F.col("case.example_clause")), before)).otherwise(filled(before, after)).alias("example_clause"),
        F.when(cased, before).otherwise(filled(before, F.lit(NO_BEFORE_ZH))).alias("evidence_before"),
        F.when(cased, after).otherwise(filled(after, F.lit(NO_AFTER_ZH))).alias("evidence_after"),
        of("user_intent", F.lit(NO_CASE_INTENT_ZH)).alias("user_intent"), F.when(cased, FROM_CASE).otherwise(FROM_TEMPLATE).alias("confidence"),
    )


def coerced(raw: DataFrame, pairs: DataFrame, diffs: DataFrame, pair_col: str = "pair_id") -> DataFrame:
    """A model's rules in normal form, one row each.

    raw (pair, rule_id, risk_name, rule_name, contract_type: array, review_perspective, review_role, review_module,
    default_risk_level, n_traces). A list of types gives its first; a rule without a trace is tied to the first
    substantive difference of its module, else of its pair.
    """
    out = raw.join(pairs.select(pair_col, F.col("contract_type").alias("_type"), F.col("review_role").alias("_role")), pair_col, "left")
    role = F.coalesce(blank_to_null(F.col("review_perspective")), blank_to_null(F.col("review_role")), F.col("_role"), F.lit(""))
    kind = F.when(F.col("contract_type").isNull(), F.col("_type")).otherwise(F.coalesce(F.get("contract_type", F.lit(0)), F.lit(NO_TYPE_ZH)))
    out = out.select(
        pair_col, "rule_id", "review_module", "n_traces", F.coalesce("risk_name", "rule_name").alias("risk_name"), F.coalesce(kind, F.lit(NO_TYPE_ZH)).alias("contract_type"),
        labels.perspective(role).alias("review_perspective"), F.coalesce("default_risk_level", F.lit(LEVEL_ZH)).alias("default_risk_level"),
    )
    asked = out.where("n_traces = 0").select(pair_col, "review_module").distinct()
    best = best_clause(diffs, asked, pair_col).withColumnRenamed("diff_id", "source_diff_id")
    return out.join(best.withColumn("n_traces", F.lit(0)), [pair_col, "review_module", "n_traces"], "left").withColumn("confidence", F.when(F.col("source_diff_id").isNotNull(), FILLED_IN))


def catalogue_record(candidates: DataFrame, at: Column, key: list[str]) -> DataFrame:
    """Candidates as rows of the catalogue: a code from their module and key, enabled, stamped."""
    code = rule_code(F.col("review_module"), *map(F.col, key))
    return candidates.select(
        F.sha2(F.concat_ws("|", *key), 256).alias("id"), code.alias("rule_code"), "contract_type", "review_module", "risk_name", "check_point", "trigger_condition", "default_risk_level",
        "suggestion_template", "example_clause", "review_perspective", F.lit(True).alias("enabled"), at.alias("created_at"), at.alias("updated_at"), *key,
    )


def import_candidates(candidates: DataFrame, asked: DataFrame, at: Column, key: str = "candidate_id", task: str = "task_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new rows of the catalogue, asked ones left out, candidates stamped with imported_rule_id).

    asked: (task, key) of what is to be imported; only candidates that were included are.
    """
    wanted = candidates.join(asked.select(task, key).distinct(), [task, key], "left_semi")
    records = catalogue_record(wanted.where("decision = 'included'"), at, [key])
    left = wanted.where("decision IS DISTINCT FROM 'included'")
    stamped = candidates.join(records.select(key, F.col("id").alias("imported_rule_id")), key, "left")
    return records, left, stamped


def decision_counts(candidates: DataFrame, task: str = "task_id") -> DataFrame:
    """included, ignored and pending candidates of each task, and how many source pairs gave any."""
    n = lambda d: F.count_if(F.coalesce("decision", F.lit("pending")) == d).alias(d)
    return candidates.groupBy(task).agg(n("included"), n("ignored"), n("pending"), F.countDistinct("source_pair_index").alias("pair_count"))


def context_query(module: Column, before: Column, after: Column) -> Column:
    """What a difference's context is searched by: module and both texts, and words of the module."""
    more = None
    for name, words in CONTEXT_ZH.items():
        more = F.when(module == name, words) if more is None else more.when(module == name, words)
    return F.concat_ws(" ", module, before, after, more)


def generated(diffs: DataFrame, provider, schema: str, key: str = "diff_id") -> DataFrame:
    """Rules from a provider that is passed in: provider(row as dict) -> list of dicts of schema's fields, or an exception.

    A difference whose call fails has one row with its error and no rule; the provider runs inside the tasks.
    """
    names = [f.split()[0] for f in schema.split(", ")]
    kind = diffs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                try:
                    out += [(row[key], *[rule.get(n) for n in names], None) for rule in provider(row)]
                except Exception as e:  # noqa: BLE001  whatever a provider raises is that difference's error
                    out.append((row[key], *[None] * len(names), f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(out, columns=[key, *names, "error"])

    return diffs.mapInPandas(run, f"{key} {kind}, {schema}, error string")


def case_queries(diffs: DataFrame, pairs: DataFrame, pair_col: str = "pair_id") -> DataFrame:
    """(pair, review_module, query): type, role, module, what its substantive changes are about, each once, in order."""
    told = diffs.where("is_substantive").select(pair_col, "review_module", "n", change_direction(F.col("before"), F.col("after")).alias("t"))
    once = told.groupBy(pair_col, "review_module", "t").agg(F.min("n").alias("n"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]), "；")
    q = once.groupBy(pair_col, "review_module").agg(listed.alias("directions")).join(pairs.select(pair_col, "contract_type", "review_role"), pair_col)
    parts = (F.coalesce(blank_to_null(F.col("contract_type")), F.lit(NO_TYPE_ZH)), F.coalesce(blank_to_null(F.col("review_role")), F.lit(NO_ROLE_ZH)), blank_to_null(F.col("review_module")), blank_to_null(F.col("directions")), F.lit(QUERY_END_ZH))
    return q.select(pair_col, "review_module", F.concat_ws(" ", *parts).alias("query"))


def retrieval_queries(diffs: DataFrame, by: list[str]) -> DataFrame:
    """One query for each module: its differences' texts, each once, in order."""
    one = F.sort_array(F.collect_list(F.struct("n", F.concat_ws(" ", "before", "after").alias("t"))))
    return diffs.groupBy(*by, "review_module").agg(F.concat_ws(" ", F.array_distinct(F.transform(one, lambda x: x["t"]))).alias("query"))


def best_clause(diffs: DataFrame, wanted: DataFrame, pair_col: str = "pair_id") -> DataFrame:
    """wanted (pair, review_module) with the first substantive clause of that module, else the first substantive one."""
    s = diffs.where("is_substantive").select(pair_col, F.col("review_module").alias("m"), "n", "diff_id")
    both = wanted.join(s, pair_col)
    return both.groupBy(*wanted.columns).agg(F.min_by("diff_id", F.struct((F.col("m") != F.col("review_module")).alias("other"), F.col("n"))).alias("diff_id"))


def unique_match(traces: DataFrame, diffs: DataFrame, pair_col: str = "pair_id") -> DataFrame:
    """Traces tied to the difference that holds both evidences, if there is exactly one."""
    d = diffs.select(pair_col, "diff_id", "before", "after")
    both = traces.join(d, pair_col).where(F.contains("before", "evidence_before") & F.contains("after", "evidence_after"))
    found = both.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"), F.min("diff_id").alias("source_diff_id")).where("n = 1").drop("n")
    return traces.join(found, "trace_id", "left")


def evidence_check(rules: DataFrame, diffs: DataFrame) -> DataFrame:
    """rules (rule_id, diff_id, required fields, traces) with valid: fields filled, traces present, of the
    rule's difference, and with evidence that its texts hold."""
    d = diffs.select("diff_id", "before", "after")
    filled = F.lit(True)
    for c in ("risk_name", "check_point", "trigger_condition", "suggestion_template"):
        filled = filled & (first_filled(F.col(c)) != "")
    ok = lambda t: (t["source_diff_id"] == F.col("diff_id")) & F.contains(F.col("before"), t["evidence_before"]) & F.contains(F.col("after"), t["evidence_after"]) & ((t["evidence_before"] != "") | (t["evidence_after"] != ""))
    valid = filled & (F.size("traces") > 0) & F.forall("traces", ok)
    return rules.join(d, "diff_id", "left").withColumn("valid", F.coalesce(valid, F.lit(False))).drop("before", "after")


def merge_candidates(rules: DataFrame, key: list[str], order: str, trace_key: list[str]) -> DataFrame:
    """Candidates of one key become one: the first's attributes, all traces, each once, in order.

    rules: one row for each trace. Both choices are aggregates of structs, not sorts of whole groups.
    """
    first = Window.partitionBy(*key, *trace_key).orderBy(order)
    once = rules.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    traces = F.transform(F.sort_array(F.collect_list(F.struct(order, *trace_key))), lambda t: F.struct(*[t[c].alias(c) for c in trace_key]))
    rest = [c for c in rules.columns if c not in (*key, order, *trace_key)]
    return once.groupBy(*key).agg(*[F.min_by(c, order).alias(c) for c in rest], F.min(order).alias(order), traces.alias("traces"))


def rules_without_case(diffs: DataFrame, templates: DataFrame) -> DataFrame:
    """A candidate for each substantive difference from its module's template; other modules take the default (null) one.

    Templates are joined by module; Spark sends them to all tasks itself where they are small.
    """
    t = templates
    named = t.where("review_module IS NOT NULL")
    generic = t.where("review_module IS NULL").select(*[F.col(c).alias(f"_{c}") for c in templates.columns if c != "review_module"], F.lit(1).alias("_one"))
    clip = lambda c: F.when(F.length(c) > 80, F.concat(F.substring(c, 1, 80), F.lit("..."))).otherwise(F.col(c))
    out = diffs.where("is_substantive").join(named, "review_module", "left").withColumn("_one", F.lit(1)).join(generic, "_one", "left")
    fields = [F.coalesce(c, f"_{c}").alias(c) for c in templates.columns if c != "review_module"]
    return out.select("diff_id", "review_module", *fields, clip("before").alias("evidence_before"), clip("after").alias("evidence_after"), "confidence")


#: How many pairs of versions a request may have.
PAIRS = (1, 5)


def checked_requests(requests: DataFrame, pairs: DataFrame, by: str = "request_id") -> DataFrame:
    """requests with n_pairs and error: null if they have 1 to 5 pairs (by, before_text, after_text) and no text is blank."""
    blank = F.greatest(*[(F.coalesce(T.strip(F.col(c)), F.lit("")) == "").cast("int") for c in ("before_text", "after_text")])
    counted = pairs.groupBy(by).agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(blank).alias("_blank"))
    out = requests.join(counted, by, "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)))
    error = F.when(~F.col("n_pairs").between(*PAIRS), f"a request has {PAIRS[0]} to {PAIRS[1]} pairs").when(F.col("_blank") > 0, "a text is blank")
    return out.withColumn("error", error).drop("_blank")
