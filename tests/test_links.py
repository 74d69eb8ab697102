import pytest
from pyspark.sql import functions as F
from vellum.operators import answers, link


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_item_to_diff_takes_the_first(spark):
    d = spark.createDataFrame([("p", "modified", 0, "甲付款", "甲支付"), ("p", "modified", 1, "乙交货", "乙交付"), ("p", "added", 2, None, "乙交付")], "pair_id string, change_type string, diff_index int, old_text string, new_text string")
    i = spark.createDataFrame([(1, "p", "modified", "", "交付", ""), (2, "p", "modified", "", "", "甲"), (3, "p", "deleted", "x", "", "")], "item_id int, pair_id string, change_type string, old_quote string, new_quote string, original string")
    assert {r.item_id: r.diff_index for r in link.item_to_diff(i, d).collect()} == {1: 1, 2: 0, 3: None}


def test_sentences_neighbours_and_segments(spark):
    s = spark.createDataFrame([("d", i, t) for i, t in enumerate(["a", "b", "a", "c"])], "doc string, sentence_index int, text string")
    q = spark.createDataFrame([("d", "a"), ("d", "z")], "doc string, text string")
    assert {r.text: r.sentence_index for r in link.text_to_sentence(q, s, "text", "doc").collect()} == {"a": 0, "z": None}
    seg = s.withColumnRenamed("sentence_index", "order")
    hits = spark.createDataFrame([("d", 0)], "doc string, order int")
    assert sorted(r.order for r in link.neighbours(seg, hits, "doc").collect()) == [0, 1]
    w = spark.createDataFrame([(1, "d", "c"), (2, "d", "xax"), (3, "d", "q")], "text_id int, doc string, wanted string")
    assert {r.text_id: r.order for r in link.segment_of(w, seg, "doc").collect()} == {1: 3, 2: 0, 3: None}


def test_accounts(spark):
    u = spark.createDataFrame([(1, "o1", None, "a@b", None), (2, None, "u2", None, "9")], "user_id int, open_id string, union_id string, email string, phone string")
    l = spark.createDataFrame([(1, "o1", "u2", None, None), (2, "ox", "u2", "a@b", None), (3, "ox", None, "a@b", "9"), (4, "ox", "", None, None)], "n int, open_id string, union_id string, email string, mobile string")  # noqa: E741
    assert {r.n: r.user_id for r in link.link_accounts(l, u).collect()} == {1: 1, 2: 2, 3: 1, 4: None}


def test_context_scores(spark):
    assert value(spark, link.overlap_score(F.array(F.lit("付款"), F.lit("x"), F.lit("123456789")), F.lit("付 款 123456789"))) == 5.0
    seg = spark.createDataFrame([("d", 1, "t", "付款期限三十日"), ("d", 2, "t", "无关"), ("d", 3, "t", "付款期限三十日")], "doc string, order int, title string, text string")
    q = spark.createDataFrame([("d", 1, "付款期限")], "doc string, query_id int, query string")
    assert [(r.order, r.rank) for r in link.context(seg, q, "doc").collect()] == [(1, 1)]


@pytest.mark.parametrize(("body", "error", "data"), [('{"code": 0, "data": "{\\"a\\": 1}"}', None, '{"a": 1}'), ('{"code": 5, "msg": "no"}', "no", None), ('{"a": 1}', None, '{"a": 1}'), ('{"code": 0, "data": "oops{"}', "data is no JSON", None)])
def test_envelope(spark, body, error, data):
    got = value(spark, answers.envelope(F.lit(body)))
    assert (got.error, got.data) == (error, data)


def test_answers(spark):
    assert [value(spark, answers.risk_total(F.lit(x))) for x in ("3", "4.0", "-1", "2.5", "true")] == [3, 4, None, None, None]
    null = F.lit(None).cast("int")
    assert value(spark, answers.diff_count(null, F.lit(1), null, F.lit("2"), null, null)) == 3
    assert value(spark, answers.diff_count(null, F.lit(0), F.lit("x"), null, null, F.lit(7))) == 7
    assert value(spark, answers.quote_in(F.lit("条款“甲方应付款”有误"))) == "甲方应付款" and value(spark, answers.quote_in(F.lit("未约定“甲方应付款”"))) == answers.NO_QUOTE_ZH
    assert value(spark, answers.rule_code(F.lit("付款条款"), F.lit("a"))).startswith("RULE-PAY-") and value(spark, answers.rule_code(F.lit("x"), F.lit("a"))).startswith("RULE-GEN-")
    f = spark.createDataFrame([("pairs[1][a]", "x"), ("pairs[0][a]", "y"), ("pairs[0][b]", "z"), ("other", "q")], "key string, value string").withColumn("req", F.lit(1))
    assert [(r.i, r.a, r.b) for r in answers.form_rows(f, ["a", "b"], ["req"]).collect()] == [(0, "y", "z"), (1, "x", None)]
    d = spark.createDataFrame([("付款改了", "odd", "甲", "乙")], "original string, change_type string, old_quote string, new_quote string")
    r = answers.default_item(d).first()
    assert (r.change_type, r.category, r.risk_level, r.evidence) == ("modified", "付款条款", "medium", "旧合同约定：甲；新合同约定：乙")


def test_template_fill(spark):
    from vellum.operators import diff

    df = spark.createDataFrame([(1, ["合同标题", "甲方付款三十日", "作废条款一二", "乙方交货地点"], ["合同标题", "甲方付款六十日", "乙方交货地点", "新增xyz条"]), (2, [], ["a"]), (3, ["a"], None), (4, ["共同"], ["插入段", "共同"])], "pair_id int, old_paragraphs array<string>, new_paragraphs array<string>")
    got = {}
    for r in diff.template_fill(df).orderBy("pair_id", "step").collect():
        got.setdefault(r.pair_id, []).append((r.action, r.old_index, r.new_index))
    assert got[1] == [("replace", 0, 0), ("replace", 1, 1), ("clear", 2, None), ("replace", 3, 2), ("append", None, 3)]
    assert got[2] == [("append", None, 0)] and got[3] == [("clear", 0, None)] and got[4] == [("replace", 0, 1), ("append", None, 0)]


def test_template_fill_clears_the_cover(spark):
    from vellum.operators import diff

    old, new = ["封面", "\t编号：", "设备采购合同", "甲方付款三十日"], ["设备采购合同书", "甲方付款六十日"]
    assert diff.fill_template(old, new) == [("clear", 0, None), ("clear", 1, None), ("replace", 2, 0), ("replace", 3, 1)]
    assert diff.fill_template(["甲", "乙"], ["完全不同"]) == [("replace", 0, 0), ("clear", 1, None)]


def test_references_and_outline(spark):
    seg = spark.createDataFrame([("c", 1, "总则", "附件一为设备清单"), ("c", 2, "付款", "服务费按月支付"), ("c", 3, "付款", "服务费以附件为准"), ("c", 4, "", "无关内容"), ("d", 1, "总则", "附件二")], "doc string, `order` int, title string, text string")
    diffs = spark.createDataFrame([("c", 7, "见附件", "服务费调整"), ("c", 8, "如上述", ""), ("d", 9, "没有词", None)], "doc string, diff_id int, before string, after string")
    got = sorted((r.diff_id, r.order) for r in link.references(seg, diffs, "doc").collect())
    assert got == [(7, 1), (7, 2), (7, 3)]
    terms = {r.diff_id: r.t for r in diffs.select("diff_id", link.reference_terms(F.col("before"), F.col("after")).alias("t")).collect()}
    assert terms == {7: ["附件", "服务费"], 8: ["上述"], 9: []}
    assert [(r.doc, r.title, r.place) for r in link.outline(seg, "doc").orderBy("doc", "place").collect()] == [("c", "总则", 1), ("c", "付款", 2), ("d", "总则", 1)]


def test_best_match_equals_plain_maximum():
    import random

    from vellum.operators import diff

    r = random.Random(9)
    for _ in range(200):
        text, *others = ("".join(r.choice("abc") for _ in range(r.randint(0, 12))) for _ in range(7))
        best = max(range(6), key=lambda j: (diff.ratio(text, others[j]), -j))
        want = best if diff.ratio(text, others[best]) >= 0.22 else None
        assert diff._best(text, others, dict.fromkeys(range(6)), 0.22, {}) == want
