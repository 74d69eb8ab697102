"""Sample clauses in the place of contract texts, which the driver's tables don't have, as columns and as SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PHRASES = (
    "甲方应在验收合格后30日内付款并取得发票",
    "乙方可随时解除合同",
    "任何一方解除合同须提前30日书面通知",
    "故障响应时间不超过2小时，未达标扣减服务费",
    "源代码及技术文档归甲方所有",
    "押金在交接后7日内退还",
    "设备到货签收后风险转移",
    "双方对保密信息承担5年保密义务",
    "个人信息应当加密并按期返还",
    "验收不合格的乙方应免费整改",
    "争议由甲方所在地法院管辖",
    "赔偿总额以合同总价为上限",
    "违约方应赔偿全部损失",
    "合同标的为20套设备",
    "文字表述调整",
    "",
)


def pick(values, n: Column | str) -> Column:
    """values[n mod their number]"""
    n = F.col(n) if isinstance(n, str) else n
    return F.get(F.array(*map(F.lit, values)), F.pmod(n, F.lit(len(values))).cast("int"))


def pick_sql(values, n: str) -> str:
    return f"([{', '.join(quoted(v) for v in values)}])[({n}) % {len(values)} + 1]"


def quoted(v) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def any_sql(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(w)})" for w in words) + ")"


def cascade_sql(text: str, rules, default: str) -> str:
    """The SQL of labels.cascade; default is SQL."""
    return "CASE " + " ".join(f"WHEN {any_sql(text, words)} THEN {quoted(name)}" for name, words in rules) + f" ELSE {default} END"


def in_sql(value: str, names) -> str:
    return f"{value} IN ({', '.join(map(quoted, names))})"
