import io
import random
import zipfile

from pyspark.sql import functions as F
from vellum.operators import analysis, base_info, cases, evaluate
from vellum.sources import docx, files


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_items_are_found_by_code_then_by_alias(spark):
    items = spark.createDataFrame(
        [("c", 0, "R1", "付款期限", "high"), ("c", 1, "R1", "验收", "low"), ("c", 2, None, "保密", "pass"), ("d", 0, "", "", "high")], "case_id string, pos int, rule_code string, key string, risk string"
    )
    asked = spark.createDataFrame(
        [("c", 1, "R1", ["x"], "high"), ("c", 2, "", ["保密义务"], "high"), ("c", 3, "R9", ["无关"], "high"), ("d", 4, None, ["任何"], "high")], "case_id string, expectation_id int, rule_code string, key_aliases array<string>, risk_gold string"
    )
    found = evaluate.find_items(items, asked)
    assert {r.expectation_id: r.item and r.item.pos for r in found.collect()} == {1: 0, 2: 2, 3: None, 4: 0}
    r = evaluate.expectation_rates(found, ["case_id"]).where("case_id = 'c'").first()
    assert (r.n, r.n_found, r.risk_accuracy, r.false_negative_rate) == (3, 2, 0.5, None)


def test_greedy_matches_equal_a_loop(spark):
    rng = random.Random(3)
    edges = {(s, rng.randrange(6), rng.randrange(6)) for s in range(20) for _ in range(9)}
    want = set()
    for s in range(20):
        used = set()
        for e in range(6):
            free = [g for g in range(6) if (s, e, g) in edges and g not in used]
            if free:
                used.add(free[0])
                want.add((s, e, free[0]))
    df = spark.createDataFrame(sorted(edges), "sample int, expected_pos int, generated_pos int")
    assert {tuple(r) for r in evaluate.greedy(df, "sample").collect()} == want


def test_keyword_edges_and_summary(spark):
    g = spark.createDataFrame([("s", 0, "Pay", "Late payment fee"), ("s", 1, "Term", "notice")], "sample string, pos int, review_module string, risk_name string")
    e = spark.createDataFrame([("s", 0, ["pay", "PAY"], ["payment", "late"]), ("s", 1, ["term"], []), ("s", 2, ["term"], ["absent"])], "sample string, pos int, modules array<string>, words array<string>")
    edges = evaluate.keyword_edges(g, e, "sample", {"risk_name": "words"}, 0.6)
    assert {tuple(r) for r in edges.collect()} == {("s", 0, 0), ("s", 1, 1)}
    r = spark.range(1).select(*evaluate.match_summary(F.lit(4), F.lit(2), F.lit(1))).first()
    assert (r.coverage, r.precision, r.overmerge_rate) == (0.25, 0.5, 0.75)
    assert spark.range(1).select(*evaluate.match_summary(F.lit(0), F.lit(0), F.lit(0))).first()[:3] == (1.0, 0.0, 0.0)


def test_item_and_record_rates(spark):
    i = spark.createDataFrame([("g", "pass", "通过", "R", "standard"), ("g", "high", "低风险", " ", "standard"), ("g", "low", "低风险", None, "other")], "g string, risk string, risk_label string, rule_code string, quality_bucket string")
    assert evaluate.item_rates(i, ["g"]).first()[1:] == (0.666667, 0.333333, 0.5)
    r = spark.createDataFrame([("g", True, False, "a", "a", 3, 4), ("g", True, True, None, "b", 9, 5)], "g string, schema_pass boolean, counts_agree boolean, predicted_type string, expected_type string, n_output int, n_rules int")
    assert evaluate.record_rates(r, ["g"]).first()[1:] == (1.0, 0.5, 1.0, 0.888889)


def test_base_info(spark):
    text = "《智能设备采购合同》\n甲方向乙方采购设备。\n乙方负责供货。\n乙方负责安装。"
    r = value(spark, base_info.base_info(F.lit(text)))
    assert r.asDict() == {"contract_type": "采购合同", "review_role": "乙方", "contract_subject": "智能设备采购", "party_a_identity": "采购方", "party_b_identity": "供应及安装调试方", "confidence": 0.92}
    r = value(spark, base_info.base_info(F.lit("")))
    assert (r.contract_type, r.contract_subject, r.party_a_identity, r.confidence) == ("通用合同", "通用合同事项", None, 0.29)
    p = spark.createDataFrame([(None, "合作", "甲方", "")], "before_text string, after_text string, review_role string, contract_type string")
    got = base_info.pair_info(p).first().base_info
    assert (got.review_role, got.contract_type) == ("甲方", "合作协议")


def test_change_direction(spark):
    d = lambda b, a: value(spark, base_info.change_direction(F.lit(b), F.lit(a)))
    assert d("10日内付款", "15 日内付款") == "10日改15日"
    assert d("故障2天", "故障3天") == "SLA响应时间恢复时间未达标扣减 2天改3天"
    assert d("可随时解除", "应当通知") == "随时解除改提前通知"
    assert d("提交法院", "提交仲裁") == "争议解决或管辖安排调整"
    assert d(None, "x") == "实质性修改"


def test_cases(spark):
    row = {c: "x" for c in cases.FILLED} | {"case_id": "pay_late_1", "contract_type": [" a ", "a"], "review_role": ["甲方"], "tags": ["t"]}
    bad = row | {"case_id": "Pay-1", "risk_name": " ", "tags": [""], "contract_type": []}
    got = cases.checked(spark.createDataFrame([row, bad])).collect()
    assert (got[0].errors, got[0].contract_type, len(got[1].errors)) == ([], ["a"], 4)
    m = lambda mod, typ, role: value(spark, cases.matches(F.lit("付款"), F.array(F.lit("采购合同")), F.array(F.lit("采购方")), F.lit(mod), F.lit(typ), F.lit(role)))
    assert [m(None, None, None), m("付款", "采购合同", "甲方"), m("付款", "采购合同", "乙方"), m("付款", "x", None), m("验收", None, None), m(None, None, "通用角色")] == [True, True, False, False, False, True]
    assert value(spark, cases.searchable(("a", F.lit("1")), ("b", F.lit(" ")), facets=[F.array(F.lit("u"), F.lit("v"))])) == "a: 1\nu v"
    first, second = spark.createDataFrame([("k", 1)], "key string, v int"), spark.createDataFrame([("k", 2), ("m", 3)], "key string, v int")
    assert sorted((r.key, r.v, r.source) for r in cases.standing_in(["key"], first, second).collect()) == [("k", 1, 0), ("m", 3, 1)]


def test_analysis_items(spark):
    rules = [{"rule_code": "R1", "rule_id": "", "risk_name": "付款", "check_point": "", "default_risk_level": "高", "suggestion_template": "改"}, {"rule_code": "R2", "rule_id": "", "risk_name": "保密", "check_point": "", "default_risk_level": "", "suggestion_template": ""}, {"rule_code": "R3", "rule_id": "", "risk_name": "无此", "check_point": "", "default_risk_level": "", "suggestion_template": ""}]
    kind = "array<struct<rule_code:string,rule_id:string,risk_name:string,check_point:string,default_risk_level:string,suggestion_template:string>>"
    text = "R1 查看\n- 原文“十日内付清”\n- 期限存在风险\n保密 一节 通过"
    got = analysis.items(spark.createDataFrame([(text, rules)], f"text string, rules {kind}")).orderBy("rule_index").collect()
    assert [r.section for r in got] == [text[: text.index("保密")], text[text.index("保密") :], ""]
    assert (got[0].risk, got[0].tip, got[0].content, got[0].advice) == ("高风险", "期限存在风险", "十日内付清", "改")
    assert [(r.risk, r.tip) for r in got[1:]] == [("通过", "无"), ("通过", "无")]


def test_docx_round_trip_and_template(spark):
    text = "第一章 总则\n甲方应当付款 & <验收>\n\n1. 期限"
    df = docx.with_docx(spark.createDataFrame([(text,), (None,)], "text string"), title=F.lit("标题"))
    made = [bytes(r.docx) for r in df.collect()]
    assert files.docx_text(made[0]) == "第一章 总则\n甲方应当付款 & <验收>\n1. 期限" and files.docx_text(made[1]) == ""
    new = "第一章 总则\n甲方应当按时付款 & <验收>\n全新的末段内容与旧文毫无相同\n另一段"
    t = spark.createDataFrame([(bytearray(made[0]), new), (None, "x")], "t binary, text string")
    got = [r.docx for r in docx.with_filled(t, "t").collect()]
    assert files.docx_text(bytes(got[0])).split("\n") == new.split("\n") and got[1] is None


def test_tables_of_a_template_are_filled(spark):
    lines = [("采购合同", 1), ("甲方应当付款", 0)]
    table = [["名称", "数量"], ["旧", "1"]]
    parts = {}
    with zipfile.ZipFile(io.BytesIO(docx.docx_bytes(lines))) as z:
        parts = {i.filename: z.read(i) for i in z.infolist()}
    parts["word/document.xml"] = parts["word/document.xml"].replace("</w:body>".encode(), (docx._table(table) + "</w:body>").encode())
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, part in parts.items():
            z.writestr(name, part)
    text = "采购合同\n甲方应当及时付款\n名称\t数量\n新\t2\n\n【表格】\n名称 | 数量\n新 | 2\n\n另 | 3\n再 | 4\n末段甲乙丙丁\n[表格]\na | b\nc | d\n【表格】\nonly | one row\n[表格]\nx | y\nz | too | wide\n"
    plain, tables = docx.table_blocks(text)
    assert [x for x in plain.split("\n") if x.strip()] == ["采购合同", "甲方应当及时付款", "末段甲乙丙丁"]
    assert tables == [[["名称", "数量"], ["新", "2"], ["另", "3"], ["再", "4"]], [["a", "b"], ["c", "d"]]]
    made = files.docx_text(docx.filled(buffer.getvalue(), text))
    assert made.split("\n") == ["采购合同", "甲方应当及时付款", files.TABLE_MARK, "名称 | 数量", "新 | 2", "另 | 3", "再 | 4", "末段甲乙丙丁", files.TABLE_MARK, "a | b", "c | d"]
    # fewer rows than the template has: the rest is emptied
    short = files.docx_text(docx.filled(docx.filled(buffer.getvalue(), text), "采购合同\n甲方应当付款\n【表格】\nq | r\ns | t"))
    assert "新" not in short and "q | r" in short and "s | t" in short


def test_heading_levels(spark):
    h = lambda x: value(spark, docx.heading_level(F.lit(x)))
    assert [h(x) for x in ("第二条 内容", "三、事项", "1. 期限", "附件：", "【重要】", "签于2024年度的某某合同里", "签于2024年", "普通的一段", "")] == [1, 2, 2, 2, 2, 3, 0, 0, 0]  # 4 digits of 14, of 7
