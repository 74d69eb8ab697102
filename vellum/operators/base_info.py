"""What a pair of versions is about: type, role, subject, parties with a confidence; and the direction of a change."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions import text as T

#: Kinds of contract by the words that tell them, in order, with what they add to the confidence.
TYPES_ZH = (("技术服务合同", ("技术服务",), 0.24), ("采购合同", ("采购", "供应", "供货", "设备", "货物"), 0.24), ("合作协议", ("合作",), 0.22), ("服务合同", ("服务", "委托", "咨询"), 0.2))
OTHER_TYPE_ZH = ("通用合同", 0.03)
#: Roles by patterns, in order.
ROLES_ZH = (
    ("乙方", r"(?U)向\s*乙方\s*支付|支付[^。；;\n]*乙方", 0.2),
    ("乙方", r"乙方[^。；;\n]*(供应|供货|交付|安装|调试|服务|收款)", 0.18),
    ("甲方", r"甲方[^。；;\n]*(采购|付款|委托|验收|接收)", 0.14),
)
OTHER_ROLE_ZH = ("通用角色", 0.03)
#: Subjects where no title tells one: all words must be there.
SUBJECTS_ZH = (("智能设备采购及安装调试", ("智能设备", "安装调试"), 0.16), ("设备采购", ("设备", "采购"), 0.12), ("服务事项", ("服务",), 0.1))
OTHER_SUBJECT_ZH = ("通用合同事项", 0.03)
#: Parties by patterns that must all match, and by kind.
SUPPLY_ZH = (r"甲方[^。；;\n]*采购", r"乙方[^。；;\n]*(供应|供货)", r"乙方[^。；;\n]*(安装|调试)")
SUPPLY_PARTIES_ZH = ("采购方", "供应及安装调试方", 0.18)
PARTIES_ZH = (("采购合同", "采购方", "供应方", 0.14), ("服务合同", "委托方", "服务方", 0.12), ("技术服务合同", "委托方", "服务方", 0.12), ("合作协议", "合作方", "合作方", 0.08))


def _told(value, score: float) -> Column:
    return F.struct((value if isinstance(value, Column) else F.lit(value)).alias("value"), F.lit(score).alias("score"))


def _first(cases: list[tuple[Column, Column]], other: Column) -> Column:
    out = F.when(*cases[0])
    for test, value in cases[1:]:
        out = out.when(test, value)
    return out.otherwise(other)


def base_info(text: Column) -> Column:
    """Struct of contract_type, review_role, contract_subject, either party's identity, and confidence (0.2 to 0.92)."""
    kind = _first([(labels.has_any(text, words), _told(name, s)) for name, words, s in TYPES_ZH], _told(*OTHER_TYPE_ZH))
    role = _first([(text.rlike(p), _told(name, s)) for name, p, s in ROLES_ZH], _told(*OTHER_ROLE_ZH))
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"), lambda x: F.regexp_replace(x, r"^[ \t：:]+|[ \t：:]+$", ""))
    title = F.get(F.filter(lines, lambda x: x.rlike("合同|协议") & (F.length(x) <= 60)), F.lit(0))
    bare = T.strip(F.regexp_replace(F.regexp_replace(T.strip(title), r"""^[《“"']|[》”"']$""", ""), "(合同|协议)$", ""))
    named = _told(F.coalesce(T.blank_to_null(bare), F.lit(OTHER_SUBJECT_ZH[0])), 0.18)
    every = lambda words: reduce(lambda x, y: x & y, [F.contains(text, F.lit(w)) for w in words])
    subject = _first([(title.isNotNull(), named), *[(every(words), _told(name, s)) for name, words, s in SUBJECTS_ZH]], _told(*OTHER_SUBJECT_ZH))
    sides = lambda a, b, s: F.struct(F.lit(a).cast("string").alias("a"), F.lit(b).cast("string").alias("b"), F.lit(s).alias("score"))
    supply = text.rlike(SUPPLY_ZH[0]) & text.rlike(SUPPLY_ZH[1]) & text.rlike(SUPPLY_ZH[2])

    def put(k: Column, r: Column, s: Column) -> Column:
        party = _first([(supply, sides(*SUPPLY_PARTIES_ZH)), *[(k["value"] == name, sides(a, b, x)) for name, a, b, x in PARTIES_ZH]], sides(None, None, 0.0))
        sure = F.least(F.lit(0.92), F.greatest(F.lit(0.2), F.lit(0.2) + k["score"] + r["score"] + s["score"] + party["score"]))
        return F.struct(
            k["value"].alias("contract_type"), r["value"].alias("review_role"), s["value"].alias("contract_subject"),
            party["a"].alias("party_a_identity"), party["b"].alias("party_b_identity"), F.round(sure, 2).alias("confidence"),
        )

    return T.let(F.struct(kind.alias("k"), role.alias("r"), subject.alias("s")), lambda x: put(x["k"], x["r"], x["s"]))


def pair_info(pairs: DataFrame, before: str = "before_text", after: str = "after_text") -> DataFrame:
    """pairs with base_info; a type and a role that the pair came with take precedence."""
    text = F.concat(F.coalesce(before, F.lit("")), F.lit("\n"), F.coalesce(after, F.lit("")))
    out = pairs.withColumn("base_info", base_info(text))
    for name in ("contract_type", "review_role"):
        if name in pairs.columns:
            out = out.withColumn("base_info", F.col("base_info").withField(name, F.coalesce(T.blank_to_null(F.col(name)), F.col(f"base_info.{name}"))))
    return out


#: What a change is called by words of either version; a number's change is added where True.
CHANGES_ZH = (
    ("SLA响应时间恢复时间未达标扣减", ("SLA", "响应", "恢复", "故障", "扣减", "未达标"), True),
    ("源代码交付成果知识产权归属", ("知识产权", "源代码", "交付成果", "技术文档", "接口文档"), False),
    ("验收标准验收期限不合格整改", ("验收标准", "组织验收", "验收不合格", "整改"), True),
    ("押金退还交接期限", ("押金", "退还", "交接"), True),
)
#: Changes told by a word before and a word after; then by words anywhere.
TURNS_ZH = (("随时解除改提前通知", "随时解除", "通知"), ("全部损失改赔偿责任上限", "全部损失", "上限"), ("普通发票改合法有效发票", "普通发票", "合法有效"))
SECRECY_ZH, DISPUTE_ZH, CHANGED_ZH = ("保密期限调整", "保密", "期限"), ("争议解决或管辖安排调整", ("管辖", "法院", "仲裁")), "实质性修改"
_NUMBER = r"(?U)\d+\s*(?:日|天|年|个月|月|%|％)?"


def number_change(before: Column, after: Column) -> Column:
    """The first number of either version with its unit, if the versions' numbers differ; else null."""
    numbers = lambda c: F.transform(F.regexp_extract_all(c, F.lit(_NUMBER), F.lit(0)), lambda x: F.regexp_replace(x, r"(?U)\s", ""))
    b, a = numbers(before), numbers(after)
    return F.when((F.size(b) > 0) & (F.size(a) > 0) & (b != a), F.concat(F.get(b, F.lit(0)), F.lit("改"), F.get(a, F.lit(0))))


def change_direction(before: Column, after: Column) -> Column:
    """What a change is about, in words for a search."""
    b, a = F.coalesce(before, F.lit("")), F.coalesce(after, F.lit(""))
    both, number = F.concat(b, a), number_change(b, a)
    cases = [(labels.has_any(both, words), F.concat_ws(" ", F.lit(name), number) if numbered else F.lit(name)) for name, words, numbered in CHANGES_ZH]
    cases.append((number.isNotNull(), number))
    cases += [(F.contains(b, F.lit(x)) & F.contains(a, F.lit(y)), F.lit(name)) for name, x, y in TURNS_ZH]
    cases.append((F.contains(both, F.lit(SECRECY_ZH[1])) & F.contains(both, F.lit(SECRECY_ZH[2])), F.lit(SECRECY_ZH[0])))
    cases.append((labels.has_any(both, DISPUTE_ZH[1]), F.lit(DISPUTE_ZH[0])))
    return _first(cases, F.lit(CHANGED_ZH))
