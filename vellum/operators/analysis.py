"""Free-text analyses: the section of each rule, and an item made from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions import text as T
from .answers import quote_in

#: Words that tell a risk, in order; then what passes; then what falls back to the rule's own level.
LEVELS_ZH = (
    ("高风险", ("高风险", "风险等级：高", "风险: 高", "Risk: 高")),
    ("中风险", ("中风险", "风险等级：中", "风险: 中", "Risk: 中")),
    ("低风险", ("低风险", "风险等级：低", "风险: 低", "Risk: 低")),
)
PASSES_ZH, PASSES = ("通过", "无风险"), ("this passes", "pass.", " pass", "no risk")
RISKY_ZH = ("存在风险", "构成风险", "未约定", "不明确", "缺失", "另行协商")
RISKY = ("this is a risk", "is a risk", "risk: yes", "trigger", "doesn't mention", "does not mention", "doesn't specify", "not specify", "vague")
#: Lines that are no tip, and lines that are one.
NO_TIP = ("rule ", "check point", "trigger", "default risk", "contract content")
TIP, TIP_ZH = ("doesn't", "does not", "not specify", "vague", "unclear", "missing", "risk"), ("未约定", "不明确", "缺失", "另行协商", "风险")
NOTHING_ZH, PASS_ZH = "无", "通过"
TIP_CHARS = 120


def _name(r: Column, *fields: str) -> Column:
    return F.coalesce(*[T.blank_to_null(T.strip(r[f])) for f in fields], F.lit(""))


def _at(text: Column, word: Column, start: Column) -> Column:
    """Place of word in text from start on, or null; an empty word has none."""
    at = F.position(word, text, start)
    return F.when((word != "") & (at > 0), at)


def sections(answers: DataFrame, text_col: str = "text", rules_col: str = "rules") -> DataFrame:
    """answers with one row for each rule of their array (rule_code, rule_id, risk_name, ...): rule, rule_index, section.

    A section starts at the rule's code, else at its name, and ends where the next later rule that occurs does.
    """
    text, rules = F.col(text_col), F.col(rules_col)
    one = F.lit(1)
    each = answers.select("*", F.posexplode(rules).alias("rule_index", "rule"))
    start = F.coalesce(_at(text, _name(F.col("rule"), "rule_code", "rule_id"), one), _at(text, _name(F.col("rule"), "risk_name"), one))
    each = each.withColumn("_start", start)
    later = F.slice(rules, F.col("rule_index") + 2, F.size(rules))
    places = F.transform(later, lambda r: F.least(_at(text, _name(r, "rule_code", "rule_id"), F.col("_start") + 1), _at(text, _name(r, "risk_name"), F.col("_start") + 1)))
    end = F.coalesce(F.get(F.filter(places, lambda p: p.isNotNull()), F.lit(0)), F.length(text) + 1)
    section = F.when(F.col("_start").isNull(), "").otherwise(F.substring(text, F.col("_start"), end - F.col("_start")))
    return each.withColumn("section", F.coalesce(section, F.lit(""))).drop("_start")


def risk_in(section: Column, level: Column) -> Column:
    """The risk a section tells; level is the rule's own, for sections that tell a risk without its level."""
    s, low = F.coalesce(section, F.lit("")), F.lower(F.coalesce(section, F.lit("")))
    out = F.when(F.lit(False), "")
    for risk, words in LEVELS_ZH:
        out = out.when(labels.has_any(s, words), risk)
    out = out.when(labels.has_any(s, PASSES_ZH) | labels.has_any(low, PASSES), PASS_ZH)
    own = labels.intermediate_risk(F.coalesce(T.blank_to_null(level), F.lit("中")))
    return out.when(labels.has_any(s, RISKY_ZH) | labels.has_any(low, RISKY), own).otherwise(PASS_ZH)


def tip_in(section: Column) -> Column:
    """The first line that tells a risk, else the second line, else the first; to 120 characters."""
    lines = F.transform(F.split(F.coalesce(section, F.lit("")), r"\r?\n"), lambda x: F.regexp_replace(x, r"^[ \-*\t]+|[ \-*\t]+$", ""))
    tells = lambda x: ~labels.has_any(F.lower(x), NO_TIP) & (labels.has_any(F.lower(x), TIP) | labels.has_any(x, TIP_ZH))
    found = F.get(F.filter(lines, lambda x: (x != "") & tells(x)), F.lit(0))
    return T.preview(F.coalesce(found, F.get(lines, F.lit(1)), F.get(lines, F.lit(0))), TIP_CHARS)


def items(answers: DataFrame, text_col: str = "text", rules_col: str = "rules") -> DataFrame:
    """sections with risk, key, tip, content, advice and replace_text of each rule; a rule that passes has nothing to say."""
    rule = F.col("rule")
    out = sections(answers, text_col, rules_col).withColumn("risk", risk_in(F.col("section"), rule["default_risk_level"])).withColumn("key", _name(rule, "risk_name", "check_point"))
    told = F.col("risk") != PASS_ZH
    said = lambda c: F.when(told, c).otherwise(NOTHING_ZH)
    tip = F.coalesce(T.blank_to_null(tip_in(F.col("section"))), F.concat("key", F.lit("存在风险，建议人工复核。")))
    advice = F.coalesce(T.blank_to_null(rule["suggestion_template"]), F.concat(F.lit("建议补充并明确"), F.col("key"), F.lit("相关条款。")))
    return out.withColumn("tip", said(tip)).withColumn("content", said(quote_in(F.col("section")))).withColumn("advice", said(advice)).withColumn("replace_text", F.lit(NOTHING_ZH))
