"""Operators on small invented reports and documents, with figures worked out by hand."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import amounts, dates, texts
from ledgerloom.operators import debt, derive, documents, folds, institutions, intake, labels, profile, quality, regions, segments, statements, stores, validation

LOAN = "report_id long, ord long, category string, org string, open_date string, credit_amount double, balance double, monthly_payment double, status string, business_type string, overdue_count long"
CARD = "report_id long, ord long, org string, open_date string, credit_limit double, used_amount double, balance double, monthly_payment double, status string, currency string, overdue_count long"


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).head()


@pytest.fixture(scope="module")
def loans(spark):
    rows = [
        (1, 1, "nonRevolvingLoan", "甲银行", "2020.03.01", 500000.0, 230868.0, 1000.0, "正常", "个人住房贷款", 0), (1, 2, "revolvingLoan1", "乙银行", "2026.01.05", 500000.0, 408000.0, 2000.0, "正常", "其他个人消费贷款", 1),
        (1, 3, "revolvingLoan2", "丙银行", "2024.13.40", 700000.0, 675000.0, 2197.0, "正常", "个人经营性贷款", 0), (1, 4, "nonRevolvingLoan", "丁银行", None, 1.0, 999999.0, 9999.0, "结清", "已结清消费贷款", None)]
    return spark.createDataFrame(rows, LOAN)


@pytest.fixture(scope="module")
def cards(spark):
    rows = [(2, 1, "广发银行", "2020.01.01", 50000.0, 12000.0, None, 1200.0, "正常", "人民币", 0), (2, 2, "招商银行", "2021.01.01", 100000.0, 40000.0, None, 4000.0, "其他", "人民币", 0)]
    return spark.createDataFrame(rows, CARD)


@pytest.fixture(scope="module")
def reports(spark):
    return spark.createDataFrame([(1, "甲", "2026.04.28", "2026.04.28", "1980.06.01", "已婚", "在职"), (2, "乙", "2026.04.28", "2026.04.28", None, None, None)], "report_id long, name string, report_time string, query_time string, birth_date string, marriage string, employment string")


def test_rounding_is_half_up_on_doubles(spark):
    got = one(spark, *[amounts.half_up(F.lit(x), 2) for x in (1.005, 0.285, -0.125)], amounts.half_up(F.lit(-2.5)))
    assert list(got) == [1.0, 0.28, -0.12, -2.0]


def test_numbers_and_formats(spark):
    got = one(spark, *[amounts.parse_number(F.lit(x)) for x in ("150,000\n人民币元", "9.000", "1.2345", "1.234.567", "--", "", "12期")], amounts.percent_text(F.lit(0.8243)), amounts.percent_text(F.lit(0.5)), amounts.amount_text(F.lit(1234567.5)))
    assert list(got) == [150000.0, 9000.0, 1.2345, 1234567.0, 0.0, 0.0, 12.0, "82.4%", "50%", "1,234,568"]


def test_dates_roll_over(spark):
    got = one(spark, dates.parse_loose(F.lit("2026.13.40")), dates.months_before(F.to_date(F.lit("2026-03-31")), 1), dates.parse_loose(F.lit("无")), dates.age_at(F.lit("1980-06-01"), F.to_date(F.lit("2026-05-31"))))
    assert list(got) == [datetime.date(2027, 2, 9), datetime.date(2026, 3, 3), None, 45]


def test_texts(spark):
    got = one(
        spark, texts.dice(F.lit("aaaa"), F.lit("aa")), texts.lcs_length(F.lit("abcde"), F.lit("xbdy")), texts.lcs_length(F.lit(""), F.lit("a")), texts.clean_status(F.lit("结清2025 正常")), texts.trim_all(F.lit("　 甲﻿")),
        texts.clean_reason(F.lit(" 货后管理。")), texts.clean_query_date(F.lit("2026 04:02")), texts.org_differs(F.lit("甲乙丙丁银行"), F.lit("戊己庚辛银行")), texts.url_part(F.lit("a b(c)!~")))
    assert list(got) == [0.5, 2, 0, "结清", "甲", "贷后管理", "2026.04.02", True, "a%20b(c)!~"]


def test_debt_analysis(loans, cards):
    found = debt.buckets(debt.active_debts(loans, cards))
    wide = {r.report_id: r for r in debt.metrics(found, loans, cards).collect()}
    assert (wide[1].debt_total, wide[1].debt_count, wide[1].payment) == (1313868.0, 3, 5197.0)
    assert round(wide[1].non_mortgage_share * 1000) / 10 == 82.4 and wide[1].overdue_accounts == 1
    assert (wide[2].debt_total, wide[2].card_limit, wide[2].card_usage_rate) == (12000.0, 50000.0, 0.24)
    cards_left = debt.installment_cards(cards)
    assert [(r.available, r.usage_rate, r.reason) for r in cards_left.collect()] == [(38000.0, 0.24, "机构在可重点核查名单内")]
    plans = {(r.report_id, r.key): r for r in debt.plans(debt.metrics(found, loans, cards), cards_left).collect()}
    assert (plans[1, "normal-optimization"].target, plans[1, "normal-optimization"].released) == (4861.0, 336.0)
    keys = {(r.report_id, r.key) for r in debt.insights(debt.breakdown(found), debt.metrics(found, loans, cards), cards_left).collect()}
    assert (1, "non-mortgage-share") in keys and (1, "current-overdue") in keys and (1, "card-installment-gap") in keys and (2, "debt-concentration") in keys


def test_profile(reports, loans, cards, spark):
    debt_rows = {r.report_id: r for r in profile.debt_status(reports, loans, cards).collect()}
    assert (debt_rows[1].active_loans, debt_rows[1].new_loans_6m) == (3, 1) and debt_rows[2].card_usage_rate == 0.24
    history = {r.report_id: r for r in profile.credit_history(reports, loans, cards).collect()}
    assert (history[1].earliest_open_date, history[1].credit_years, history[1].settled_loans) == ("2020.03.01", 6, 1)
    codes = spark.createDataFrame([(1, 1, k, c) for k, c in enumerate(["1", None, "2", "N", "3", "*", "1", "1", "1"])], "report_id long, ord long, seq int, code string")
    assert profile.repay_history(codes).head().asDict() == {"report_id": 1, "longest": 3, "total": 6}
    asked = spark.createDataFrame([(1, k, d, "", r) for k, (d, r) in enumerate([("2026.04.01", "贷款审批"), ("2026.02.01", "信用卡审批"), ("2026.04.20", "贷后管理"), ("2027.01.01", "担保资格审查")])], "report_id long, ord long, query_date string, query_org string, query_reason string")
    assert {r.report_id: (r.query_1m, r.query_3m, r.query_6m) for r in profile.query_frequency(reports, asked).collect()} == {1: (2, 3, 3), 2: (0, 0, 0)}
    levels = {(r.report_id, r.dimension): r.level for r in profile.assess(profile.profiles(reports, loans, cards, asked, codes)).collect()}
    assert levels[1, "injury"] == "危险" and levels[1, "basic"] == "正常" and levels[2, "basic"] == "关注"


def test_validation(reports, spark):
    loans = spark.createDataFrame([(1, 1, "nonRevolvingLoan", "", "", 100000.0, 150000.0, 0.0, "正常", "", 0), (1, 2, "revolvingLoan1", "某行", "", 10000.0, 787.0, 2713.0, "正常", "", 0)], LOAN)
    cards = spark.createDataFrame([(1, 3, "某行", "", 10000.0, 20000.0, None, 0.0, "正常", "", 0)], CARD)
    expected = spark.createDataFrame([(1, "nonRevolvingLoan", 2)], "report_id long, category string, accounts long")
    none = spark.createDataFrame([], "report_id long")
    found = validation.issues(reports.withColumn("report_no", F.lit("R1")), loans, cards, none, expected)
    first = [r.issue_id for r in found.filter("report_id = 1").orderBy("number").collect()]
    assert first == [
        "非循环贷账户:nonRevolvingLoans[0].org:1", "非循环贷账户:nonRevolvingLoans[0].balance:2", "非循环贷账户:nonRevolvingLoans[0].monthlyPayment:3", "循环贷账户一:revolvingLoansType1[0].monthlyPayment:4",
        "贷记卡账户:creditCards[0].usedAmount:5", "账户数量:accountDerived.nonRevolvingLoan.accountCount:6", "查询记录:queryRecord:7"]
    rolled = {r.report_id: r for r in validation.rollup(reports, found).collect()}
    assert (rolled[1].critical, rolled[1].warning, rolled[1].info, rolled[1].score, rolled[1].requires_review) == (3, 3, 1, 0.34, True)
    ready = {r.report_id: r for r in validation.readiness(reports, found, found.filter("severity = 'critical'").select("report_id", "issue_id")).collect()}
    assert (ready[1].critical, ready[1].warning, ready[1].blocked, ready[1].hidden) == (0, 3, True, 0) and not ready[2].blocked


def test_balance_repair_takes_a_single_candidate(spark):
    loans = spark.createDataFrame([(1, k, "nonRevolvingLoan", "甲", "", 20000.0, b, p, "正常", "", 0) for k, b, p in ((1, 787.0, 2713.0), (2, 5000.0, 100.0))], LOAN)
    stated = spark.createDataFrame([(1, "nonRevolvingLoan", 2, 12871.0)], "report_id long, category string, stated_accounts long, stated_balance double")
    assert [(r.ord, r.repaired) for r in derive.repair_balances(loans, stated).collect()] == [(1, 7871.0)]


def test_markdown_and_pages(spark):
    text = "| 汇总 | 汇总 | 汇总 |\n| --- | --- | --- |\n| 机构数 | 账户数 | 余额 |\n| 2 | 3 | 201,667 |\nno table"
    rows = documents.markdown_rows(F.lit(text))
    got = one(spark, documents.value_below(rows, F.lit("账户数")), documents.plain_lines(F.lit(text)), documents.html_to_markdown(F.lit("<tr><th colspan=2>a</th></tr><tr><td>b<br>c</td><td></td></tr>")), documents.table_signature(F.lit("| a | b-c |")))
    assert list(got) == ["3", "汇总\n机构数\n账户数\n余额\n2\n3\n201,667", "| a | a |\n| --- | --- |\n| b c |  |", "abc"]
    pages = spark.createDataFrame([(1, 0, "乙\n第2页，共2页"), (1, 1, "甲\n第1页，共2页"), (2, 0, "第2页 共3页"), (2, 1, "x"), (2, 2, "y")], "doc_id long, page_num int, text string")
    assert sorted((r.doc_id, r.page_num, r.place) for r in documents.reorder_pages(pages).collect()) == [(1, 0, 2), (1, 1, 1), (2, 0, 1), (2, 1, 2), (2, 2, 3)]
    assert {r.doc_id: r.missing for r in documents.missing_pages(pages).collect()} == {1: "", 2: "1,3"}


def test_row_clusters_hang_on_their_first_word(spark):
    words = [(1, 10.0, 5.0, 10.0, "b"), (1, 12.0, 1.0, 10.0, "a"), (1, 16.0, 2.0, 10.0, "c"), (1, 20.0, 0.0, 10.0, "d")]
    got = documents.row_clusters(spark.createDataFrame(words, "doc_id long, top double, left double, height double, text string")).orderBy("row").collect()
    assert [r.text for r in got] == ["a\tb", "d\tc"]


def test_chunks_start_over(spark):
    lines = spark.createDataFrame([(1, k, "x" * n) for k, n in enumerate((4, 4, 4, 20, 1))], "doc_id long, line int, text string")
    assert [(r.lines, r.size) for r in documents.chunk_lines(lines, 10).orderBy("chunk").collect()] == [(2, 10), (1, 5), (1, 21), (1, 2)]


def test_fragments(spark):
    head, body = [["管理机构", "借款金额"], ["甲", "1"]], [["余额", "9"]]
    rows = [(1, 1, 10.0, 0.0, 1, "账户1", False, head), (1, 1, 90.0, 0.0, 2, "", False, body), (1, 2, 10.0, 0.0, 3, "账户2", False, head), (1, 2, 12.0, 300.0, 4, "", False, [["余额", "x"], ["8", "y"]]), (1, 5, 0.0, 0.0, 5, "", False, body)]
    tables = spark.createDataFrame(rows, "doc_id long, page int, y double, x double, ord long, preceding string, hint boolean, rows array<array<string>>")
    got = segments.merge_fragments(tables).orderBy("part").collect()
    assert [(r.fragments, r.rows) for r in got] == [(2, head + body), (2, [["管理机构", "借款金额", "余额", "x"], ["甲", "1", "8", "y"]]), (1, body)]


def test_fragments_across_batches(spark):
    """Batches of two pieces: tables go on over their borders, and a piece without a place joins nothing on its page."""
    row = lambda k, page, y, x, rows, doc=1, text="", hint=False: (doc, page, y, x, k, text, hint, rows)
    head = ["管理机构", "借款金额"]
    rows = [
        row(1, 1, 0.0, 0.0, [["a"], ["1"]]), row(2, 1, 5.0, 9.0, [["b"], ["2"]]), row(3, 1, 5.0, 12.0, [["c"], None]), row(4, 2, 0.0, 0.0, [["a", "b", "c"], ["4", "5", "6"]]), row(5, 3, 0.0, 0.0, [["a", "b", "c"]]),
        row(6, 4, 0.0, 0.0, [[], ["7"]], hint=True), row(7, 4, 50.0, 0.0, [head, ["8", "9"]]), row(8, 4, None, 0.0, [["x"]], hint=True), row(9, None, 90.0, 0.0, [["y"]], hint=True), row(1, 1, 0.0, 0.0, [head], doc=2), row(2, 1, 90.0, None, [["z"]], doc=2)]
    tables = spark.createDataFrame(rows, "doc_id long, page int, y double, x double, ord long, preceding string, hint boolean, rows array<array<string>>").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = segments.merge_fragments(tables).orderBy("doc_id", "part").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [(r.doc_id, r.part, r.fragments, r.rows) for r in got] == [
        (1, 0, 6, [["a", "b", "c"], None, ["4", "5", "6"], [], ["7"]]), (1, 1, 1, [head, ["8", "9"]]), (1, 2, 1, [["x"]]), (1, 3, 1, [["y"]]), (2, 0, 2, [head, ["z"]])]


def test_fragments_are_dealt_out_once(spark):
    """Pieces are read, shuffled and sorted once; no piece meets its rows or its table again by a join or a further shuffle."""
    tables = spark.range(9).selectExpr("id AS doc_id", "0 AS page", "0d AS y", "0d AS x", "id AS ord", "'' AS preceding", "true AS hint", "array(array('a')) AS rows")
    plan = segments.merge_fragments(tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1 and plan.count("Range") == 1
    assert "Join" not in plan and "Aggregate" not in plan and "Window" not in plan


def test_segments_and_titles(spark):
    events = ["(一)非循环贷账户", "账户1", "T 管理机构", "T 还款记录", "T 管理机构", "账户2", "T 管理机构", "四查询记录", "T 管理机构", "（四）贷记卡账户", "T 发卡机构"]
    rows = spark.createDataFrame([(1, k, t, t.startswith("T")) for k, t in enumerate(events)], "doc_id long, ord long, text string, is_table boolean")
    got = [(r.category, r.anchor, r.tables) for r in segments.account_segments(rows).orderBy("segment").collect()]
    assert got == [("nonRevolvingLoan", "账户1", 2), ("nonRevolvingLoan", "账户1", 1), ("nonRevolvingLoan", "账户2", 1), ("creditCard", None, 1)]
    assert [r.category for r in segments.running_category(rows).orderBy("ord").collect()] == ["nonRevolvingLoan"] * 4 + [None, "creditCard"]


def test_records(spark):
    rows = spark.createDataFrame([(1, 1, ["2025", "N", "1", "x", "*", "C", "N", "N", "N"]), (1, 2, ["2024", "N"]), (1, 3, ["序", "2026 04.02", "本人", "本人查询、"])], "doc_id long, ord long, cells array<string>")
    assert [(r.year, r.months[:7], len(r.months)) for r in segments.repayment_records(rows).collect()] == [(2025, ["N", "1", "*", "C", "N", "N", "N"], 12)]
    assert [(r.kind, r.date, r.reason) for r in segments.query_rows(rows).collect()] == [("self", "2026.04.02", "本人查询")]


def test_institutions(spark):
    names = spark.createDataFrame([("■京银行股份有限公司",), ("中国光大银行股份有限公司信用卡中心",), ("信用卡中心",), ("无此机构",), ("招行股份",)], "name string")
    got = {r.original: r for r in institutions.normalize_names(names, institutions.dimension(spark)).collect()}
    assert got["■京银行股份有限公司"].status == "review" and "北京银行股份有限公司" in got["■京银行股份有限公司"].candidates
    assert (got["中国光大银行股份有限公司信用卡中心"].normalized, got["中国光大银行股份有限公司信用卡中心"].status) == ("中国光大银行股份有限公司", "matched")
    assert got["信用卡中心"].status == "review" and got["无此机构"].status == "unlisted"


def test_a_name_meets_few_keys(spark):
    """Of the keys of the dimension those are left that can be part of a name or alike, a few tens at most."""
    keys = institutions.dimension(spark).select(institutions.comparable(F.col("alias")).alias("key")).distinct()
    names = spark.createDataFrame([(n,) for n in ("招商银行股份有限公司上海分行", "北京银很股份有限公司", "某市农村商业银行", "通用小额贷款有限公司", "测试消费金融有限公司", "天津银行", "甲乙丙丁")], "name string")
    names = names.select(institutions.comparable(F.col("name")).alias("c")).withColumn("grams", texts.bigrams(F.col("c")))
    pairs = names.crossJoin(keys).withColumn("like", texts.similarity(F.col("c"), F.col("key"))).withColumn("may", institutions.may_be_alike(F.col("c"), F.col("grams"), F.col("key")))
    assert pairs.filter("NOT may AND (like >= 0.72 OR contains(c, key) OR contains(key, c))").count() == 0
    most = pairs.filter("may").groupBy("c").count().agg(F.max("count")).head()[0]
    assert most <= 40 and keys.count() > 140
    with pytest.raises(ValueError):
        institutions.normalize_names(names.withColumnRenamed("c", "name"), institutions.dimension(spark).crossJoin(spark.range(20)))


def test_robust_line_drops_outliers(spark):
    points = [(1, float(x), 2.0 * x + 1) for x in range(20)] + [(1, 5.0, 500.0), (1, 12.0, -400.0), (2, 1.0, 1.0)]
    got = {r.line_id: r for r in quality.robust_line(spark.createDataFrame(points, "line_id long, x double, y double")).collect()}
    assert set(got) == {1}


def test_stores(spark):
    events = spark.createDataFrame([("a", 1, "review", "x"), ("a", 2, "edit", ""), ("a", 3, "review", "y"), ("b", 1, "review", "z")], "key string, seq long, kind string, item string")
    assert {r.key: r.reviewed for r in stores.review_state(events).collect()} == {"a": "y", "b": "z"}
    empty = spark.createDataFrame([], "id long, value string")
    assert stores.evaluate_fields(empty, empty).head().accuracy == 1.0


def test_lcs_against_table(spark):
    """Lengths around the words of 62 bits, equal to the plain table's."""
    def table(a, b):
        above = [0] * (len(b) + 1)
        for c in a:
            row = [0]
            for j, d in enumerate(b):
                row.append(above[j] + 1 if c == d else max(above[j + 1], row[-1]))
            above = row
        return above[-1]

    draw = random.Random(3)
    word = lambda n: "".join(draw.choices("ab银行", k=n))
    pairs = [(word(n), word(m)) for n in (1, 5, 61, 62, 63, 130) for m in (1, 61, 62, 63, 124, 125)] + [("a" * 62, "a" * 62), ("a" * 63, "a" * 124), ("", "a")]
    rows = spark.createDataFrame([*pairs, (None, "a")], "a string, b string").select(texts.lcs_length(F.col("a"), F.col("b")).alias("n")).collect()
    assert [r.n for r in rows] == [*(table(a, b) for a, b in pairs), None]


def test_folds_are_linear_in_a_document(spark):
    """One document of 100,000 rows in each: a second or two a fold, where copying what is done would take hours."""
    n = 100_000
    words = spark.range(n).select(F.lit(1).alias("doc_id"), (F.col("id") / 2).cast("long").cast("double").alias("top"), (F.col("id") % 2).cast("double").alias("left"), F.lit(1.0).alias("height"), F.col("id").cast("string").alias("text"))
    rows = documents.row_clusters(words)
    assert rows.count() == n // 2 and rows.filter("row = 7").head().text == "14\t15"
    lines = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("line"), F.lit("x" * 9).alias("text"))
    chunks = documents.chunk_lines(lines, 100)
    assert chunks.count() == n // 10 and chunks.agg(F.sum("lines"), F.max("size")).head()[:] == (n, 100)
    head = F.when(F.col("id") % 100 == 0, F.array(F.lit("管理机构"), F.lit("借款金额"))).otherwise(F.array(F.lit("余额"), F.lit("9")))
    pieces = spark.range(n).select(
        F.lit(1).alias("doc_id"), (F.col("id") / 50).cast("int").alias("page"), (F.col("id") % 50 * 40).cast("double").alias("y"), F.lit(0.0).alias("x"), F.col("id").alias("ord"), F.lit("").alias("preceding"),
        F.lit(True).alias("hint"), F.array(head, F.array(F.lit("a"), F.col("id").cast("string"))).alias("rows"))
    merged = segments.merge_fragments(pieces)
    assert merged.agg(F.count("*"), F.sum("fragments"), F.sum(F.size("rows"))).head()[:] == (n // 100, n, 2 * n)
    assert [r[1] for r in merged.filter("part = 3").head().rows if r[0] == "a"] == [str(300 + k) for k in range(100)]


def test_fold_rows_keeps_keys_apart(spark):
    rows = spark.createDataFrame([(k, n) for k in (None, 1, 2) for n in (3, 1, 2)], "k long, n long").repartition(3)
    got = folds.fold_rows(rows, "k", ["n"], "total long", lambda: 0, lambda s, r: (s + r["n"], (s + r["n"],))).collect()
    assert sorted((r.k or 0, r.n, r.total) for r in got) == [(k, n, t) for k in (0, 1, 2) for n, t in ((1, 1), (2, 3), (3, 6))]


def test_overlaps_in_a_band(spark):
    """A page of 50,000 boxes on one line: pairs are counted once each, and only neighbours meet."""
    n = 25_000
    boxes = lambda shift: spark.range(n).select(F.lit(1).alias("page_id"), F.col("id").alias("ord"), (F.col("id") * 10.0 + shift).alias("x"), F.lit(5.0).alias("y"), F.lit(8.0).alias("w"), F.lit(9.0).alias("h"))
    found = documents.best_overlap(boxes(0.0), boxes(2.0))
    assert found.agg(F.count("*"), F.sum((F.col("ord") == F.col("new_ord")).cast("int")), F.min("overlap"), F.max("overlap")).head()[:] == (n, n, 0.75, 0.75)


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(4)
    made = lambda k: [(p, k + i, rng.uniform(-50, 400), rng.uniform(-50, 400), rng.choice([0.0, 5.0, 60.0, 500.0]), rng.choice([3.0, 40.0, 300.0])) for p in (1, 2) for i in range(60)]
    held, new = made(0), made(100)
    schema = "page_id long, ord long, x double, y double, w double, h double"

    def pair(a, b):
        ix, iy = max(0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])), max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]))
        small = min(a[4] * a[5], b[4] * b[5])
        near = all(abs(a[k] + a[k + 2] / 2 - b[k] - b[k + 2] / 2) <= max(a[k + 2], b[k + 2]) * 0.35 for k in (2, 3))
        return ix * iy / small if small > 0 else 0.0, near

    want = {}
    for b in new:
        hits = [(v, -a[1]) for a in held if a[0] == b[0] for v, near in [pair(a, b)] if v >= 0.35 or near]
        if hits:
            want[b[0], b[1]] = -max(hits)[1], max(hits)[0]
    got = documents.best_overlap(spark.createDataFrame(held, schema), spark.createDataFrame(new, schema)).collect()
    assert {(r.page_id, r.new_ord): (r.ord, r.overlap) for r in got} == want


TABLE = "doc_id long, ord long, headers array<string>, rows array<array<string>>"


def test_agreements_in_one_table_or_two(spark):
    head, first = ["管理机构", "授信协议标识", "生效日期", "到期日期", "授信额度用途"], ["甲银行", "B1", "d", "d", "其他"]
    labels, values = ["授信额度", "授信限额", "已用额度"], ["50,000\n元", "9", "1200"]
    rows = [(1, 1, head, [first, labels, values]), (1, 2, head, []), (1, 3, ["乙公司", "", "", "", "循环"], [labels, ["7", "8", ""]]), (1, 4, head, [first]), (1, 5, head, []), (2, 1, ["x"], []), (2, 2, head, None), (3, 1, None, None)]
    got = statements.credit_agreements(spark.createDataFrame(rows, TABLE)).orderBy("doc_id", "ord").collect()
    assert [tuple(r) for r in got] == [(1, 1, "甲银行", "其他", 50000.0, 1200.0), (1, 2, "乙公司", "循环", 7.0, 0.0)]


@pytest.mark.parametrize("seed", range(4))
def test_responsibilities_take_the_next_table_once(spark, seed):
    """Against a walk through the tables one by one: runs of headers without rows of every length, and ends of documents."""
    rng = random.Random(seed)
    tables = []
    for doc in range(12):
        for k in range(rng.randint(0, 9)):
            kind = rng.choice("hhhto")
            tables.append((doc, k, ["管理机构", "币种"] if kind in "ht" else ["甲银行", "元"], [] if kind == "h" else [[f"机构{k}公司", "元"]]))
    want = []
    for doc in range(12):
        own, k = [t for t in tables if t[0] == doc], 0
        while k < len(own):
            if own[k][2][0] == "管理机构":
                if own[k][3]:
                    want.append((doc, k, own[k][3][0][0]))
                elif k + 1 < len(own):
                    want.append((doc, k, own[k + 1][2][0]))
                    k += 1
            k += 1
    got = statements.repay_responsibilities(spark.createDataFrame(tables, TABLE)).select("doc_id", "ord", "org").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_responsibility_fields(spark):
    rows = [(1, 1, ["管理机构", "责任人类型", "还款责任金额"], [["甲银行", "保证人", "1,000"], ["主业务借款人", "主业务借款人证件号码"], ["某人", "ID1"], ["五级分类", "余额"], ["正常", "88"]]), (2, 1, ["还款责任"], [["保证人/反担保人", "乙消费金融有限公司", "23,000"]])]
    got = statements.repay_responsibilities(spark.createDataFrame(rows, TABLE)).orderBy("doc_id").collect()
    assert (got[0].org, got[0].kind, got[0].amount, got[0].borrower, got[0].cert_no, got[0].balance, got[0].five_category) == ("甲银行", "保证人", 1000.0, "某人", "ID1", 88.0, "正常")
    assert (got[1].org, got[1].kind, got[1].amount, got[1].balance) == ("乙消费金融有限公司", "保证人/反担保人", 23000.0, None)


def test_payments_by_place(spark):
    loan = ["账户状态", "五级分类", "余额", "本月应还款", "应还款日", "本月实还款", "正常", "1", "2", "3,000", "4", "5.5", "6"]
    card = ["账单日", "本月应还款", "本月实还款", "当前途期总额", "x", "12", "340", "9"]
    rows = [(1, False, k, v) for k, v in enumerate(loan)] + [(2, True, k, v) for k, v in enumerate(card)] + [(3, True, 0, "本月应还款"), (4, False, 0, None)]
    got = statements.line_payments(spark.createDataFrame(rows, "account_id long, is_card boolean, line int, text string")).collect()
    assert {r.account_id: r.payment for r in got} == {1: 5.5, 2: 340.0, 3: 0.0, 4: 0.0}


def test_changes_fold_by_field(spark):
    rows = [
        (1, 1, "add", "a", 5), (1, 2, "update", None, 7), (1, 3, "update", "b", None), (2, 1, "add", "c", 1), (2, 2, "delete", None, None), (2, 3, "update", "lost", 9),
        (3, 1, "add", "d", 1), (3, 2, "delete", None, None), (3, 3, "update", "lost", 2), (3, 4, "add", None, 3), (4, 1, "update", "never", 1)]
    got = statements.fold_changes(spark.createDataFrame(rows, "id long, seq long, op string, name string, weight long"), ["name", "weight"]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "b", 7, 3), (3, None, 3, 4)]


@pytest.mark.parametrize("seed", range(5))
def test_regions_equal_a_flood(spark, seed):
    """Random images of all densities, spirals and empty lines, against filling pixel by pixel."""
    rng = random.Random(seed)
    runs, want = [], []
    for image in range(8):
        w, h, part = rng.randint(1, 24), rng.randint(1, 24), rng.choice([0.2, 0.5, 0.6, 0.8])
        on = {(x, y) for x in range(w) for y in range(h) if rng.random() < part and (image or y % 5)}
        for y in range(h):
            x = 0
            while x < w:
                if (x, y) in on:
                    end = x
                    while (end + 1, y) in on and rng.random() < 0.9:  # now and then a run is cut, and its parts touch
                        end += 1
                    runs.append((image, y, x, end))
                    x = end
                x += 1
        left = set(on)
        while left:
            todo, own = [min(left, key=lambda p: (p[1], p[0]))], set()
            first = todo[0]
            while todo:
                x, y = p = todo.pop()
                if p in left:
                    left.discard(p)
                    own.add(p)
                    todo += [(x - 1, y), (x + 1, y), (x, y - 1), (x, y + 1)]
            xs, ys = [p[0] for p in own], [p[1] for p in own]
            want.append((image, first[1], first[0], len(own), min(xs), min(ys), max(xs), max(ys)))
    found = regions.regions(spark.createDataFrame(runs, "image_id long, y int, x0 int, x1 int").repartition(5))
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_regions_of_a_large_image(spark):
    """A comb of 200,000 runs, joined by its last line only: one region, in linear time."""
    teeth = spark.range(200_000).select(F.lit(1).alias("image_id"), (F.col("id") / 100).cast("int").alias("y"), (F.col("id") % 100 * 4).cast("int").alias("x0"), (F.col("id") % 100 * 4).cast("int").alias("x1"))
    comb = teeth.union(spark.createDataFrame([(1, 2000, 0, 399), (2, 0, 5, 4), (None, 1, 1, 1)], "image_id long, y int, x0 int, x1 int"))
    assert [tuple(r) for r in regions.regions(comb).collect()] == [(1, 0, 0, 200_400, 0, 0, 399, 2000)]


def test_category_of_misread_tables(spark):
    """Forms that the rule lists: marks and spaces, misread managers and loans, limits in several wrong spellings, labels apart."""
    rows = [
        ("", ["发卡机构", "投信额度"], [], "nonRevolvingLoan", None, "creditCard"), ("", ["发 卡", "x机构"], [["账户", "信用额度"], ["账单日", ""]], "nonRevolvingLoan", "revolvingLoan1", "creditCard"),
        ("循环贷账户二", ["余额"], [], "creditCard", "nonRevolvingLoan", "revolvingLoan2"), ("贷记■卡账户", ["余额"], [], "nonRevolvingLoan", None, "nonRevolvingLoan"), ("贷记卡账户", ["余额"], [], "creditCard", "revolvingLoan1", "revolvingLoan1"),
        ("", ["管机构", "受信额度"], [["a", "b"], ["管理机构", "账户授信额度"]], "creditCard", None, "revolvingLoan2"), ("", ["管理机构", "借款金额"], [], None, None, "nonRevolvingLoan"),
        ("", ["甲"], [["1"]] * 6 + [["相关还款责任信息"]], None, None, None), ("", ["责任人类型"], [], "creditCard", "creditCard", "repayResponsibility"), (None, ["授信协议标识"], [], "creditCard", None, "creditAgreement")]
    frame = spark.createDataFrame(rows, "b string, h array<string>, r array<array<string>>, now string, place string, want string")
    got = frame.select("want", labels.choose_category(F.col("b"), F.col("h"), F.col("r"), F.col("now"), F.col("place")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_preceding_text_of_one_table_on_two_pages_and_of_texts_at_one_place(spark):
    above = spark.createDataFrame([(1, 0, 10.0, 5.0, "b"), (1, 0, 10.0, 5.0, "a"), (1, 1, 20.0, 1.0, "lower"), (1, 1, 25.0, 1.0, None), (2, 0, 9.0, 1.0, "below")], "doc_id long, logical_page int, y double, x double, text string")
    tables = spark.createDataFrame([(1, 0, 30.0, 7), (1, 1, 30.0, 7), (1, 0, 30.0, 8), (1, 0, 1.0, 9), (2, 0, 3.0, 1)], "doc_id long, logical_page int, y double, ord long")
    got = sorted(tuple(r) for r in documents.preceding_text(above, tables).collect())
    assert got == [(1, 7, "lower"), (1, 8, "a"), (1, 9, ""), (2, 1, "")]


def test_values_by_label_in_odd_grids_and_of_one_id_in_pieces(spark):
    rows = [
        (1, [["管利机构", "开立日期"], ["甲银行", "2020年3月5日"], ["余额", None], ["1,203元", ""]]), (1, [["备注"], None, ["余额：88"]]), (2, None), (3, []),
        (4, [["借款金额", "B10X123456789"], ["--"]]), (5, [["应还款日\n本月应还款"], ["12\n300"]]), (6, [["账户授信额度"], ["B1017X0001"]])]
    got = {(r.table_id, r.field): (r.value, r.score) for r in labels.find_values(spark.createDataFrame(rows, "table_id long, grid array<array<string>>"), labels.LOAN_FIELDS).collect()}
    assert {k: v for k, (v, _) in got.items()} == {(1, "org"): "甲银行", (1, "open_date"): "2020.3.5", (1, "balance"): "1,203", (4, "amount"): "0", (5, "monthly_payment"): "12", (5, "due_date"): "12"}
    assert got[1, "org"][1] == 120 + 20 + 54 + 8 and got[1, "balance"][1] == 120 + 20 + 54 + 8 + 12 + 8
    # rows of one id are one table, as in SQL
    wide = labels.extract_loans(spark.createDataFrame(rows, "table_id long, grid array<array<string>>")).collect()
    assert [(r.table_id, r.org) for r in wide] == [(1, "甲银行")]


def test_labels_as_plain_texts_and_as_columns_agree(spark):
    words = sorted({w for _, _, own in labels.LOAN_FIELDS + labels.CARD_FIELDS for w in own} | {"查询机构", "管机构", "剩余还款期", "本月应还1234", "账户状识", "到日期", "x", ""})
    pairs = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string").select("a", "b", labels.label_matches(F.col("a"), F.col("b")).alias("m")).collect()
    assert [labels.is_label(r.a, r.b) for r in pairs] == [r.m for r in pairs]


def _fused(held, new):
    """The fold as the SQL states it, a list of tables rewritten at each step; rows are (page, ord, x, y, w, h, score, signature, markdown), of ``new`` with cand in front."""
    tables = [r[:1] + r[2:] for r in sorted(held, key=lambda r: r[:2])]
    seen, pages = {t[6] for t in tables}, {t[0] for t in tables}
    for _, page, _, *c in sorted(new, key=lambda r: r[:3]):
        if page not in pages or c[4] < intake.REPLACE:
            continue
        found = []
        for i, (p, x, y, w, h, score, *_) in enumerate(tables):
            small = min(w * h, c[2] * c[3])
            shared = max(0, min(x + w, c[0] + c[2]) - max(x, c[0])) * max(0, min(y + h, c[1] + c[3]) - max(y, c[1]))
            ratio = shared / small if small > 0 else 0
            near = abs(x + w / 2 - c[0] - c[2] / 2) <= max(w, c[2]) * 0.35 and abs(y + h / 2 - c[1] - c[3] / 2) <= max(h, c[3]) * 0.35
            if p == page and (ratio >= 0.35 or near):
                found.append((ratio, -1 if score is None else score, -i))
        if not found and c[4] >= intake.APPEND and c[5] is not None and c[5] not in seen:
            tables.append((page, *c))
            seen.add(c[5])
        elif found and max(found)[1] >= 0 and c[4] >= max(found)[1] + intake.MARGIN:
            tables[-max(found)[2]] = (page, *c)
            seen.add(c[5])
    return [(t[0], k, t[7], t[5]) for k, t in enumerate(tables)]


@pytest.mark.parametrize("seed", range(3))
def test_fused_candidates_equal_a_rewritten_list(seed, spark):
    """Boxes that many tables share and boxes of their own, missing signatures and scores; a page without tables takes none."""
    r = random.Random(seed)
    box = lambda: tuple(float(r.randrange(n)) for n in ((4, 4, 3, 3) if seed else (900, 900, 90, 90)))
    table = lambda k, page, low: (page, k, *box(), r.choice([None, *range(low, 45)] if low == 0 else range(low, 45)), r.choice([None, *"abcdefgh"]), f"t{k}")
    held, new = [table(k, r.randrange(3), 0) for k in range(60)], [(r.randrange(2), *table(100 + k, r.randrange(4), 10)) for k in range(150)]
    names = "doc_id long, {}page long, ord long, x double, y double, w double, h double, score int, signature string, markdown string"
    docs = [spark.createDataFrame([(d, *t) for d in (1, None) for t in rows], names.format(more)).repartition(3) for rows, more in ((held, ""), (new, "cand long, "))]
    got = intake.fuse_candidates(docs[0], docs[1].filter("doc_id = 1")).collect()
    assert sorted((t.page, t.place, t.markdown, t.score) for t in got if t.doc_id) == sorted(_fused(held, new), key=lambda t: t[:2])
    assert sorted((t.page, t.place, t.markdown, t.score) for t in got if not t.doc_id) == sorted(_fused(held, []), key=lambda t: t[:2])


def test_a_paths_sources_are_looked_up_once_a_path(spark):
    """Repeated paths come together before they are expanded, and are read once."""
    fields = spark.createDataFrame([("a[0].b",)] * 50 + [("a[1].c",), ("x",), (None,)], "field string")
    sources = spark.createDataFrame([("a[0].b", None), ("a", "A")], "field string, label string")
    found = stores.prefix_lookup(fields, sources)
    assert sorted(map(tuple, found.collect()), key=str) == [("a[0].b", None), ("a[1].c", "A"), ("x", None), (None, None)]
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    explode = next(k for k, line in enumerate(lines) if "Generate" in line)
    assert sum("Generate" in line for line in lines) == 1 and any("Aggregate" in line for line in lines[explode:]) and sum("LogicalRDD" in line for line in lines) == 2


@pytest.mark.parametrize("name", ["credit_agreements", "repay_responsibilities"])
def test_no_grids_are_sorted(name, spark):
    """Tables tell what they hold before they are dealt out, and are sorted once."""
    found = getattr(statements, name)(spark.createDataFrame([(1, 1, ["管理机构"], [])], TABLE))
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    dealt = re.findall(r"\) Exchange\nInput \[\d+\]: (.*)", plan)
    assert len(dealt) == 1 and "rows#" not in dealt[0] and "headers#" not in dealt[0] and plan.count(") Sort\n") == 1


def test_responsibilities_with_missing_rows_and_cells(spark):
    rows = [(1, 1, ["管理机构", None, "币种"], [None, ["主业务借款人", None]]), (1, 2, ["管理机构"], None), (1, 3, None, [["主业务借款人"], [None], ["余额"], ["7"]]), (1, 4, ["责任人类型"], []), (2, 1, None, None)]
    got = statements.repay_responsibilities(spark.createDataFrame(rows, TABLE)).orderBy("ord").select("ord", "org", "kind", "amount", "currency", "borrower", "balance").collect()
    assert list(map(tuple, got)) == [(1, "", "", 0.0, "", None, None), (2, "", "", 0.0, "", None, 7.0)]


def test_segments_are_dealt_once_and_read_texts_once(spark):
    events = spark.createDataFrame([(1, 1, "(四)贷记卡账户", False), (1, 2, "账户1", False), (1, 3, "余额", True), (1, 4, None, True), (1, 5, None, False), (1, 6, "发卡机构", True), (1, 7, "查询记录", False), (1, 8, "余额", True)], "doc_id long, ord long, text string, is_table boolean")
    found = segments.account_segments(events)
    assert sorted(map(tuple, found.collect())) == [(1, 1, "creditCard", "账户1", 2), (1, 2, "creditCard", "账户1", 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("\\s+") == 1 and "min_by" not in plan
