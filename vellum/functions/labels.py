"""Classifications by ordered keyword rules, and normal forms of labels. Order is meaning throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null, first_filled, strip


def has_any(text: Column, words) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def cascade(text: Column, rules, default) -> Column:
    """The name of the first rule one of whose words text has."""
    out = None
    for name, words in rules:
        out = F.when(has_any(text, words), name) if out is None else out.when(has_any(text, words), name)
    return out.otherwise(default)


#: Words of key clauses.
KEY_CLAUSE_ZH = ("违约", "赔偿", "责任", "罚款", "解除", "终止", "付款", "金额", "交付", "保密", "知识产权")

#: Pattern, type and level of headings, in order of trial; lengths 2 to 200 only.
HEADINGS_ZH = (
    (r"(?U)^第[一二三四五六七八九十百千零\d]+[条章节款项]", "heading2", 2),
    (r"(?U)^[一二三四五六七八九十百千零\d]+[、.。]", "heading3", 3),
    (r"^[《『「]?[一-龥]{2,20}[》』」]?$", "heading1", 1),
)
#: The same for Latin texts, in forms that any regular-expression engine agrees on.
HEADINGS_LATIN = (
    (r"^(Section|Article|Chapter) [0-9]+", "heading2", 2),
    (r"^[0-9]+[.)]", "heading3", 3),
    (r"^[A-Z][a-z]{1,19}[.]?$", "heading1", 1),
)


def heading(text: Column, patterns=HEADINGS_ZH) -> Column:
    """Struct (type, level) of a paragraph; of stripped text."""
    t = strip(text)
    made = lambda kind, level: F.struct(F.lit(kind).alias("type"), F.lit(level).alias("level"))
    out = F.when((F.length(t) > 200) | (F.length(t) < 2), made("body", 0))
    for pattern, kind, level in patterns:
        out = out.when(t.rlike(pattern), made(kind, level))
    return out.otherwise(made("body", 0))


def style_heading(style: Column) -> Column:
    """Level of a heading by its style's name; null if it is none."""
    s = F.lower(F.coalesce(style, F.lit("")))
    out = None
    for level in (1, 2, 3):
        hit = s.rlike(rf"heading\s*{level}|标题\s*{level}")
        out = F.when(hit, level) if out is None else out.when(hit, level)
    return out


#: Review modules of changed clauses, in order of trial.
MODULES_ZH = (
    ("知识产权", ("知识产权", "源代码", "交付成果", "技术文档", "接口文档", "既有技术", "通用组件")),
    ("服务水平", ("SLA", "服务水平", "响应", "恢复", "故障", "未达标", "扣减", "扣款")),
    ("押金退还", ("押金", "退还", "无息退还", "剩余押金")),
    ("所有权/风险转移", ("所有权", "风险转移", "灭失", "毁损", "到货签收", "验收合格并完成交接")),
    ("合同标的", ("合同标的", "设备数量", "新增", "试点")),
    ("保密条款", ["保密"]),
    ("解除条款", ("解除", "终止")),
    ("数据安全", ("数据", "个人信息", "删除", "返还", "书面证明", "加密", "访问控制")),
    ("付款条款", ("付款", "支付", "款项", "付款申请", "支付相应款项", "服务费", "发票")),
    ("交付验收", ("验收标准", "组织验收", "验收期限", "验收不合格", "免费整改", "整改")),
    ("管辖法院", ("管辖", "法院", "仲裁")),
    ("争议解决", ["争议"]),
    ("赔偿责任上限", ("责任上限", "赔偿总额", "赔偿上限", "已收取费用总额", "合同总价为上限")),
)
#: Words of a breach, which is a cap on damages if both further words stand in the text.
BREACH_ZH, CAP_ZH = ("违约", "赔偿", "损失", "律师费"), ("上限", "赔偿")


def review_module(before: Column, after: Column) -> Column:
    text = F.concat(F.coalesce(before, F.lit("")), F.coalesce(after, F.lit("")))
    capped = F.contains(text, F.lit(CAP_ZH[0])) & F.contains(text, F.lit(CAP_ZH[1]))
    last = F.when(has_any(text, BREACH_ZH), F.when(capped, "赔偿责任上限").otherwise("违约责任")).otherwise("通用条款")
    return cascade(text, MODULES_ZH, last)


#: Categories of differences, in order of trial.
CATEGORIES_ZH = (
    ("付款条款", ("付款", "支付")), ("合同金额", ("金额", "价款", "合同总价", "价格")), ("发票条款", ["发票"]), ("税费承担", ("税", "税费")),
    ("验收条款", ["验收"]), ("交付条款", ("交付", "交货")), ("违约责任", ("违约", "赔偿")), ("解除终止", ("解除", "终止")),
    ("保密义务", ["保密"]), ("知识产权归属", ("知识产权", "著作权", "专利", "成果归属")), ("争议解决", ("争议", "仲裁", "法院", "管辖")),
)
#: Categories of medium risk.
MEDIUM_ZH = ("合同金额", "付款条款", "违约责任", "验收条款", "争议解决", "知识产权归属")
#: Fixed values.
CHANGE_TYPES = ("added", "deleted", "modified", "moved")


def change_type(value: Column) -> Column:
    return F.when(value.isin(*CHANGE_TYPES), value).otherwise("modified")


def diff_category(original: Column, old_quote: Column, new_quote: Column, kind: Column) -> Column:
    text = F.concat(*[F.coalesce(c, F.lit("")) for c in (original, old_quote, new_quote)])
    return cascade(text, CATEGORIES_ZH, F.when(change_type(kind) == "moved", "条款位置").otherwise("其他"))


def diff_risk(category: Column) -> Column:
    return F.when(category.isin(*MEDIUM_ZH), "medium").otherwise("low")


#: Final risk, its word in results, and the spellings it goes by.
RISKS = (
    ("high", "高风险", ("high", "高", "高风险")),
    ("medium", "中风险", ("medium", "mid", "中", "中风险")),
    ("low", "低风险", ("low", "低", "低风险")),
    ("pass", "通过", ("pass", "passed", "通过")),
)


def _risk(value: Column, place: int) -> Column:
    v = F.replace(F.lower(F.coalesce(blank_to_null(value), F.lit("pass"))), F.lit(" "), F.lit(""))
    out = None
    for row in RISKS:
        hit = v.isin(*row[2]) | F.contains(v, F.lit(row[1]))
        out = F.when(hit, row[place]) if out is None else out.when(hit, row[place])
    return out.otherwise(RISKS[-1][place])


def final_risk(value: Column) -> Column:
    """high, medium, low or pass; anything unknown passes."""
    return _risk(value, 0)


def intermediate_risk(value: Column) -> Column:
    return _risk(value, 1)


def compare_risk(value: Column) -> Column:
    """high, medium or low; anything unknown is low."""
    v = F.when(value == "高", "high").when(value == "中", "medium").when(value == "低", "low").otherwise(value)
    return F.when(v.isin("high", "medium", "low"), v).otherwise("low")


#: What stands for nothing, for text that was not found, and for a vague key.
NOTHING, NOT_FOUND, VAGUE = "无", ("未发现明确原文", "相关内容缺失"), ("缺失", "不明确", "不清晰", "不具体", "不足")


def action_type(risk: Column, key: Column, content: Column, replace_text: Column) -> Column:
    key, content, new = (first_filled(c) for c in (key, content, replace_text))
    none = lambda c: (c == "") | (c == NOTHING)
    out = F.when(risk == "pass", "manual").when(none(new), "manual")
    out = out.when(none(content) | has_any(content, NOT_FOUND), "append")
    return out.when(has_any(key, VAGUE), "insert").otherwise("replace")


def earliest(text: Column, names, default) -> Column:
    """text itself if it is a name; else the name that occurs first in it, of equals the first listed."""
    places = F.array(*[F.struct(F.locate(n, text).alias("at"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, n in enumerate(names)])
    found = F.array_min(F.filter(places, lambda p: p["at"] > 0))["name"]
    return F.when(text.isin(*names), text).otherwise(F.coalesce(found, F.lit(default)))


#: Roles on the side of either party; all others are neutral.
ROLES_A = ("甲方", "起诉方", "采购方", "委托方", "用户方", "守约方", "通知接收方", "个人信息处理委托方")
ROLES_B = ("乙方", "收款方", "服务方", "交付方", "披露方", "开发方", "履约方", "被限制方", "开票方", "被审计方", "供应方")


def perspective(role: Column) -> Column:
    r = strip(role)
    return F.when(r.isin(*ROLES_A), "甲方").when(r.isin(*ROLES_B), "乙方").otherwise("通用")


def rule_module(value: Column, fallback: Column) -> Column:
    """Finance, legal or performance by their words; else the fallback if it is one of the four modules."""
    v = F.coalesce(value, F.lit(""))
    out = F.when(has_any(v, ["财务"]), "财务").when(has_any(v, ["法务", "法律"]), "法务").when(has_any(v, ["履约", "履行"]), "履约")
    return out.otherwise(F.when(fallback.isin("财务", "法务", "履约", "其他"), fallback).otherwise("其他"))
