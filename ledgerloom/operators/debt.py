"""Debt analysis of many reports: active debt, breakdown, metrics, insights, relief plans.

Inputs are account tables keyed by report_id and ord; every step aggregates by report,
so that a report's accounts meet in one shuffle that the later steps reuse.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import amount_text, half_up, money_sum, percent_text, ratio, sanitize

#: Categories in order with their labels, and the patterns of loan kinds in order.
CATEGORIES = {"mortgage": "房贷", "business": "经营贷", "consumer": "消费贷", "auto": "车贷", "other": "其他贷款", "creditCard": "信用卡已用额度"}
LOAN_KINDS = {"mortgage": "住房|房贷|公积金|按揭|个人住房", "business": "经营|经营性|小微|商户|企业主", "auto": "汽车|车贷|购车", "consumer": "消费|个人消费|装修|教育|旅游|购物"}
CLOSED, NORMAL = "结清|销户|未激活|关闭|注销", "正常|尚未逾期|未逾期"
INSTALLMENT_BANKS = ["广发", "招商", "招行", "民生", "广州", "平安", "光大", "华夏"]
#: Plans in order: key, name, impact, whether card relief counts, and lines of categories with a ratio.
PLANS = [
    ("normal-optimization", "不影响征信方案", "低", True, [("business consumer auto other creditCard", 0.08)]),
    ("mild-negotiation", "减轻影响征信方案", "中", True, [("consumer", 0.30), ("business", 0.25), ("auto other", 0.20)]),
    ("term-extension", "延长还款方案", "高", False, [("mortgage", 0.15), ("business consumer auto other creditCard", 0.55)]),
    ("high-risk-resolution", "全案定制（高风险处置）", "极高", False, [("mortgage", 0.35), ("business consumer auto other creditCard", 0.78)]),
]


def classify_loan(business_type: Column) -> Column:
    """The first kind whose pattern a business type holds."""
    out = F
    for kind, pattern in LOAN_KINDS.items():
        out = out.when(business_type.rlike(pattern), kind)
    return out.otherwise("other")


def card_status(status: Column, currency: Column | None = None) -> Column:
    """正常 for a normal card in yuan, else 其他."""
    plain = F.when(F.regexp_replace(status, r"\s+", "").rlike("正常"), "正常").otherwise("其他")
    if currency is None:
        return plain
    money = F.regexp_replace(F.coalesce(currency, F.lit("")), r"\s+", "")
    return F.when((money != "") & ~money.rlike("(?i)^(?:人民币|人民币元|CNY|RMB|156|元)?$"), "其他").otherwise(plain)


def is_active_debt(status: Column, balance: Column, payment: Column) -> Column:
    """Not closed, and owing something or in a normal state."""
    return ~status.rlike(CLOSED) & ((sanitize(F.coalesce(balance, F.lit(0.0))) > 0) | (sanitize(F.coalesce(payment, F.lit(0.0))) > 0) | status.rlike(NORMAL))


def card_used(used: Column, balance: Column) -> Column:
    return F.coalesce(used, balance, F.lit(0.0))


def active_debts(loans: DataFrame, cards: DataFrame) -> DataFrame:
    """report_id, ord, category, balance, payment of each account that counts as debt."""
    loan = loans.filter(is_active_debt(F.col("status"), F.col("balance"), F.col("monthly_payment"))).select(
        "report_id", "ord", classify_loan(F.col("business_type")).alias("category"), sanitize(F.col("balance")).alias("balance"), sanitize(F.col("monthly_payment")).alias("payment"))
    used = sanitize(card_used(F.col("used_amount"), F.col("balance")))
    card = cards.filter((card_status(F.col("status")) == "正常") & ((used > 0) | (sanitize(F.col("monthly_payment")) > 0))).select(
        "report_id", "ord", F.lit("creditCard").alias("category"), used.alias("balance"), sanitize(F.col("monthly_payment")).alias("payment"))
    return loan.unionByName(card)


def buckets(debts: DataFrame) -> DataFrame:
    """report_id, category, count, balance, payment."""
    return debts.groupBy("report_id", "category").agg(F.count("*").alias("accounts"), money_sum(F.col("balance")).alias("balance"), money_sum(F.col("payment")).alias("payment"))


def with_derived(found: DataFrame, derived: DataFrame, cards: DataFrame) -> DataFrame:
    """Buckets completed by derived totals: loans where their details have no balance, cards where a report has no card rows.

    ``derived`` has report_id, category (loan or creditCard), accounts, balance, payment.
    """
    loan_total = found.filter("category <> 'creditCard'").groupBy("report_id").agg(F.sum("balance").alias("have"))
    loan = derived.filter("category = 'loan' AND balance > 0").join(loan_total, "report_id", "left").filter("coalesce(have, 0) = 0").select("report_id", F.lit("other").alias("category"), "accounts", "balance", "payment")
    card = derived.filter("category = 'creditCard' AND balance > 0").join(cards.select("report_id").distinct(), "report_id", "left_anti").select("report_id", "category", "accounts", "balance", "payment")
    extra = loan.unionByName(card)
    return found.join(extra, ["report_id", "category"], "left_anti").unionByName(extra)


def breakdown(found: DataFrame) -> DataFrame:
    """Buckets with labels, order, shares of balance and payment, and the payment rate."""
    totals = found.groupBy("report_id").agg(F.sum(F.col("balance").cast("decimal(18,2)")).cast("double").alias("debt"), half_up(F.sum(F.col("payment").cast("decimal(18,2)")).cast("double")).alias("due"))
    names = F.create_map(*[F.lit(x) for k, (c, label) in enumerate(CATEGORIES.items()) for x in (c, f"{k}{label}")])
    name = names[F.col("category")]
    return found.join(totals, "report_id").select(
        "report_id", "category", F.substring(name, 2, 20).alias("label"), F.substring(name, 1, 1).cast("int").alias("place"), "accounts", "balance", "payment",
        ratio(F.col("balance"), F.col("debt")).alias("balance_share"), ratio(F.col("payment"), F.col("due")).alias("payment_share"), ratio(F.col("payment"), F.col("balance")).alias("payment_rate"))


def pivoted(found: DataFrame) -> DataFrame:
    """A row for each report: balance and payment of each category, totals and counts."""
    part = lambda c, v: money_sum(F.when(F.col("category") == c, F.col(v)))
    return found.groupBy("report_id").agg(
        *[part(c, v).alias(f"{c}_{v}") for c in CATEGORIES for v in ("balance", "payment")], F.sum("accounts").alias("debt_count"), money_sum(F.col("balance")).alias("debt_total"),
        half_up(money_sum(F.col("payment"))).alias("payment"), F.sum(F.when(F.col("category") == "creditCard", F.col("accounts")).otherwise(0)).alias("card_count"))


def card_limits(cards: DataFrame) -> DataFrame:
    return cards.filter(card_status(F.col("status")) == "正常").groupBy("report_id").agg(money_sum(sanitize(F.col("credit_limit"))).alias("card_limit"))


def overdue_counts(loans: DataFrame, cards: DataFrame) -> DataFrame:
    both = loans.select("report_id", "overdue_count").unionByName(cards.select("report_id", "overdue_count"))
    return both.filter("overdue_count > 0").groupBy("report_id").agg(F.count("*").alias("overdue_accounts"))


_OTHERS = ("business", "consumer", "auto", "other", "creditCard")


def _total(categories, value: str) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f"{c}_{value}") for c in categories])


def metrics(found: DataFrame, loans: DataFrame, cards: DataFrame) -> DataFrame:
    """Pressure metrics of each report with debt, next to the pivoted buckets."""
    wide = pivoted(found).join(card_limits(cards), "report_id", "left").join(overdue_counts(loans, cards), "report_id", "left").fillna(0, ["card_limit", "overdue_accounts"])
    return _pressure(wide)


def _pressure(wide: DataFrame) -> DataFrame:
    return wide.withColumns({
        "monthly_payment_rate": ratio(F.col("payment"), F.col("debt_total")), "card_usage_rate": ratio(F.col("creditCard_balance"), F.col("card_limit")),
        "non_mortgage_share": ratio(_total(_OTHERS, "balance"), F.col("debt_total")), "business_share": ratio(F.col("business_balance"), F.col("debt_total")), "non_mortgage_payment": _total(_OTHERS, "payment")})


def leading(parts: DataFrame) -> DataFrame:
    """The categories with the largest balance and payment of each report; the first in order on ties."""
    top = lambda v: F.max_by(F.struct("label", "balance", "balance_share", "payment", "payment_share"), F.struct(F.col(v), -F.col("place")))
    return parts.groupBy("report_id").agg(top("balance").alias("by_balance"), top("payment").alias("by_payment"))


def debts_at_once(accounts: DataFrame) -> DataFrame:
    """A row for each report with debt, from one table of accounts (see ``tables.accounts``) that is aggregated once.

    What :func:`metrics` gives, with parts (the categories' figures), by_balance and by_payment (:func:`leading`),
    cards (how many :func:`installment_cards`, null for none) and relief (:func:`card_relief`).
    """
    c = F.col
    balance, due = sanitize(F.coalesce("balance", F.lit(0.0))), sanitize(F.coalesce("monthly_payment", F.lit(0.0)))
    normal = c("is_card") & (card_status(c("status")) == "正常")
    owing = F.when(c("is_card"), normal & ((balance > 0) | (due > 0))).otherwise(is_active_debt(c("status"), c("balance"), c("monthly_payment")))
    rows = accounts.select(
        "report_id", "overdue_count", F.when(owing, F.when(c("is_card"), "creditCard").otherwise(classify_loan(c("business_type")))).alias("category"), balance.alias("balance"), due.alias("payment"),
        F.when(normal, sanitize(c("credit_amount"))).alias("limit"), (owing & c("is_card")).alias("instalments"))
    of = lambda k, v: F.when(c("category") == k, c(v))
    less = F.when(c("instalments") & (c("balance") > 0) & (c("payment") > 0), F.greatest(F.lit(0.0), c("payment") - F.ceil(c("balance") / 12))).otherwise(0.0)
    wide = rows.groupBy("report_id").agg(
        *[F.count(of(k, "category")).alias(f"{k}_accounts") for k in CATEGORIES], *[money_sum(of(k, v)).alias(f"{k}_{v}") for k in CATEGORIES for v in ("balance", "payment")], F.count("category").alias("debt_count"),
        money_sum(F.when(c("category").isNotNull(), c("balance"))).alias("debt_total"), half_up(money_sum(F.when(c("category").isNotNull(), c("payment")))).alias("payment"), money_sum(c("limit")).alias("card_limit"),
        F.count_if(c("overdue_count") > 0).alias("overdue_accounts"), F.nullif(F.count_if("instalments"), F.lit(0)).alias("cards"), half_up(money_sum(less)).alias("relief"))
    wide = wide.filter("debt_count > 0").withColumn("card_count", c("creditCard_accounts"))
    part = lambda place, k, label: F.struct(
        F.lit(k).alias("category"), F.lit(label).alias("label"), F.lit(place).alias("place"), c(f"{k}_accounts").alias("accounts"), c(f"{k}_balance").alias("balance"), c(f"{k}_payment").alias("payment"),
        ratio(c(f"{k}_balance"), c("debt_total")).alias("balance_share"), ratio(c(f"{k}_payment"), c("payment")).alias("payment_share"), ratio(c(f"{k}_payment"), c(f"{k}_balance")).alias("payment_rate"))
    parts = F.filter(F.array(*[part(n, k, label) for n, (k, label) in enumerate(CATEGORIES.items())]), lambda p: p["accounts"] > 0)
    wide = _pressure(wide).withColumn("parts", parts)
    top = lambda v: F.array_max(F.transform("parts", lambda p: F.struct(p[v].alias("v"), (-p["place"]).alias("place"), p.alias("part"))))["part"]
    return wide.withColumns({"by_balance": top("balance"), "by_payment": top("payment")}).drop(*[f"{k}_accounts" for k in CATEGORIES])


def insights(parts: DataFrame, wide: DataFrame, installments: DataFrame) -> DataFrame:
    """report_id, place, key, level, figure: one row for each insight that a report's figures trigger."""
    many = installments.groupBy("report_id").agg(F.count("*").alias("cards"))
    return triggered(wide.join(leading(parts), "report_id", "left").join(many, "report_id", "left"))


def triggered(rows: DataFrame) -> DataFrame:
    """The insights of reports' metrics with by_balance, by_payment and cards."""
    share, pay = F.coalesce("by_balance.balance_share", F.lit(0.0)), F.coalesce("by_payment.payment_share", F.lit(0.0))
    rest = F.coalesce("non_mortgage_share", F.lit(0.0))
    rules = [
        ("current-overdue", F.col("overdue_accounts") > 0, F.lit("高风险"), F.col("overdue_accounts").cast("double")),
        ("debt-concentration", share >= 0.45, F.when(share >= 0.65, "预警").otherwise("关注"), share),
        ("non-mortgage-share", rest >= 0.6, F.when(rest >= 0.8, "预警").otherwise("关注"), rest),
        ("card-usage", F.coalesce(F.col("card_usage_rate") >= 0.75, F.lit(False)), F.when(F.col("card_usage_rate") >= 0.9, "预警").otherwise("关注"), F.col("card_usage_rate")),
        ("card-installment-gap", F.col("cards").isNull(), F.lit("关注"), F.lit(0.0)),
        ("payment-concentration", pay >= 0.45, F.lit("关注"), pay),
    ]
    found = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(k).alias("place"), F.lit(key).alias("key"), level.alias("level"), figure.alias("figure"))) for k, (key, when, level, figure) in enumerate(rules, 1)]))
    stable = F.array(F.struct(F.lit(7).alias("place"), F.lit("stable-structure").alias("key"), F.lit("正常").alias("level"), F.lit(0.0).alias("figure")))
    return rows.select("report_id", F.explode(F.when(F.size(found) > 0, found).otherwise(stable)).alias("i")).select("report_id", "i.*")


def installment_cards(cards: DataFrame) -> DataFrame:
    """Cards with debt: limits, usage, and whether the bank is on the list to look at first."""
    used, limit = sanitize(card_used(F.col("used_amount"), F.col("balance"))), sanitize(F.col("credit_limit"))
    listed = F.col("org").rlike("|".join(INSTALLMENT_BANKS))
    return cards.filter((card_status(F.col("status")) == "正常") & ((used > 0) | (sanitize(F.col("monthly_payment")) > 0))).select(
        "report_id", "ord", F.coalesce(F.nullif("org", F.lit("")), F.lit("未知发卡机构")).alias("org"), limit.alias("credit_limit"), used.alias("used_amount"), F.greatest(F.lit(0.0), limit - used).alias("available"),
        sanitize(F.col("monthly_payment")).alias("monthly_payment"), ratio(used, limit).alias("usage_rate"), F.when(listed, "机构在可重点核查名单内").otherwise("需结合发卡机构政策人工核查").alias("reason"))


def card_relief(installments: DataFrame) -> DataFrame:
    """What twelve instalments would take off each report's card payments."""
    less = F.when((F.col("used_amount") > 0) & (F.col("monthly_payment") > 0), F.greatest(F.lit(0.0), F.col("monthly_payment") - F.ceil(F.col("used_amount") / 12))).otherwise(0.0)
    return installments.groupBy("report_id").agg(half_up(money_sum(less)).alias("relief"))


def plans(wide: DataFrame, installments: DataFrame | None = None) -> DataFrame:
    """report_id, place, key, impact, payment, released, target: four plans for each report. Without ``installments``, ``wide`` has relief."""
    rows = wide if installments is None else wide.join(card_relief(installments), "report_id", "left").fillna(0, ["relief"])
    made = []
    for place, (key, name, impact, by_card, lines) in enumerate(PLANS, 1):
        parts = ([F.col("relief")] if by_card else []) + [half_up(_total(c.split(), "payment") * r) for c, r in lines]
        total = reduce(lambda a, b: a + b, [F.greatest(p, F.lit(0.0)) for p in parts])
        released = F.least(F.col("payment"), total)
        n = reduce(lambda a, b: a + b, [(p > 0).cast("int") for p in parts])
        made.append(F.struct(F.lit(place).alias("place"), F.lit(key).alias("key"), F.lit(name).alias("name"), F.lit(impact).alias("impact"), F.col("payment"), released.alias("released"), F.greatest(F.lit(0.0), F.col("payment") - released).alias("target"), F.greatest(n, F.lit(1)).alias("lines")))
    return rows.select("report_id", F.explode(F.array(*made)).alias("p")).select("report_id", "p.*")


def summary_lines(wide: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """report_id, lines: the summary's sentences in order. Without ``parts``, ``wide`` has by_balance."""
    rows = wide if parts is None else wide.join(leading(parts), "report_id", "left")
    top = F.col("by_balance")
    lines = F.array_compact(F.array(
        F.concat(F.lit("当前识别在贷余额合计 "), amount_text(F.col("debt_total")), F.lit(" 元，其中贷款账户 "), (F.col("debt_count") - F.col("card_count")).cast("string"), F.lit(" 笔，信用卡有用额账户 "), F.col("card_count").cast("string"), F.lit(" 笔。")),
        F.concat(F.lit("当前月供合计 "), amount_text(F.col("payment")), F.lit(" 元，是后续降低月供测算的基准。")),
        F.when(top.balance > 0, F.concat(F.lit("余额占比最高的类别为"), top.label, F.lit("，余额 "), amount_text(top.balance), F.lit(" 元，占比 "), percent_text(top.balance_share), F.lit("。"))),
        F.when(F.col("non_mortgage_share").isNotNull(), F.concat(F.lit("非房贷余额占比 "), percent_text(F.col("non_mortgage_share")), F.lit("，对应月供 "), amount_text(F.col("non_mortgage_payment")), F.lit(" 元，是优先分析的现金流调节区。")))))
    none = F.array(F.lit("当前未识别到有效债务余额或月供数据，请先核对 OCR 结果中的贷款账户、信用卡账户和本月应还字段。"))
    return rows.select("report_id", F.when((F.col("debt_total") <= 0) & (F.col("payment") <= 0), none).otherwise(lines).alias("lines"))


def derived_totals(loans: DataFrame, cards: DataFrame) -> DataFrame:
    """report_id, category, orgs, accounts, total_credit, balance, payment: credit and count over all loans, the rest over open ones; of cards, sums over active ones."""
    open_ = ~F.col("status").rlike("结清|销户")
    loan = loans.groupBy("report_id", "category").agg(
        F.count_distinct(F.nullif("org", F.lit(""))).alias("orgs"), F.count("*").alias("accounts"), money_sum(F.col("credit_amount")).alias("total_credit"),
        money_sum(F.when(open_, F.col("balance"))).alias("balance"), money_sum(F.when(open_, F.col("monthly_payment"))).alias("payment"))
    active = card_status(F.col("status")) == "正常"
    card = cards.groupBy("report_id").agg(
        F.count_distinct(F.nullif("org", F.lit(""))).alias("orgs"), F.count("*").alias("accounts"), money_sum(F.when(active, F.col("credit_limit"))).alias("total_credit"),
        money_sum(F.when(active, F.col("used_amount"))).alias("balance"), money_sum(F.when(active, F.col("monthly_payment"))).alias("payment"))
    return loan.unionByName(card.withColumn("category", F.lit("creditCard")))


def category_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, c, label) for k, (c, label) in enumerate(CATEGORIES.items())], "place int, category string, label string")
