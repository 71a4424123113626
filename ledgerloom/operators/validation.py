"""Data checks over reports: issues with running ids, their rollup, and readiness for analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import half_up
from ledgerloom.operators.debt import card_status

#: Labels and field prefixes of the checked lists, in order, and tolerances.
LISTS = {"nonRevolvingLoan": ("非循环贷账户", "nonRevolvingLoans"), "revolvingLoan1": ("循环贷账户", "revolvingLoansType1"), "revolvingLoan2": ("循环贷账户二", "revolvingLoansType2")}
OVER_AMOUNT, OVER_BALANCE, OVER_LIMIT = 1.05, 1.2, 1.15
_CLOSED = "结清|销户|未激活"


def issues(reports: DataFrame, loans: DataFrame, cards: DataFrame, queries: DataFrame, expected: DataFrame) -> DataFrame:
    """report_id, issue_id, severity, category, field, numbered in the order of lists, accounts and rules.

    ``expected`` has report_id, category and accounts: what sections claim to hold. An
    account's rules are one array, so each list is read once.
    """
    c = F.col
    position = F.row_number().over(Window.partitionBy("report_id", "category").orderBy("ord")) - 1

    def account_rules(rows: DataFrame, rules) -> DataFrame:
        found = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(k).alias("rule"), F.lit(severity).alias("severity"), F.lit(name).alias("name"))) for k, (severity, name, when) in enumerate(rules)]))
        return rows.select("report_id", "list", "label", "prefix", "at", F.explode(found).alias("r")).select(
            "report_id", "list", c("at").cast("long").alias("at"), "r.rule", "r.severity", c("label").alias("category"), F.concat("prefix", F.lit("["), c("at").cast("string"), F.lit("]."), "r.name").alias("field"))

    place = F.create_map(*[F.lit(x) for k, n in enumerate(LISTS, 1) for x in (n, k)])
    label = F.create_map(*[F.lit(x) for n, (t, _) in LISTS.items() for x in (n, t + ("一" if n == "revolvingLoan1" else ""))])
    prefix = F.create_map(*[F.lit(x) for n, (_, p) in LISTS.items() for x in (n, p)])
    loan = loans.withColumns({"at": position, "list": place[c("category")], "label": label[c("category")], "prefix": prefix[c("category")]})
    active, plain = ~c("status").rlike(_CLOSED), c("category") != "revolvingLoan2"
    balance, payment = F.coalesce("balance", F.lit(0.0)), F.coalesce("monthly_payment", F.lit(0.0))
    loan_issues = account_rules(loan, [
        ("warning", "org", F.coalesce("org", F.lit("")) == ""),
        ("warning", "loanAmount", plain & active & (c("credit_amount") <= 0)),
        ("critical", "balance", active & c("balance").isNotNull() & (c("credit_amount") > 0) & (c("balance") > c("credit_amount") * OVER_AMOUNT)),
        ("warning", "monthlyPayment", active & (payment == 0) & (balance > 0)),
        ("critical", "monthlyPayment", active & (payment > 0) & (balance > 0) & (payment > balance * OVER_BALANCE)),
        ("warning", "balance", plain & ~active & (balance > 0))])
    card = cards.withColumn("category", F.lit("creditCard")).withColumns({"at": position, "list": F.lit(4), "label": F.lit("贷记卡账户"), "prefix": F.lit("creditCards")})
    normal = card_status(c("status")) == "正常"
    card_issues = account_rules(card, [
        ("warning", "org", F.coalesce("org", F.lit("")) == ""),
        ("warning", "creditLimit", normal & (c("credit_limit") <= 0)),
        ("critical", "usedAmount", normal & c("used_amount").isNotNull() & (c("credit_limit") > 0) & (c("used_amount") > c("credit_limit") * OVER_LIMIT)),
        ("warning", "usedAmount", ~normal & (F.coalesce("used_amount", F.lit(0.0)) > 0))])
    head = F.array_compact(F.array(*[F.when(F.coalesce(col, F.lit("")) == "", F.struct(F.lit(k).alias("rule"), F.lit(f).alias("field"))) for k, (col, f) in enumerate([("name", "header.name"), ("report_no", "header.reportNo"), ("report_time", "header.reportTime")])]))
    head_issues = reports.select("report_id", F.explode(head).alias("r")).select("report_id", F.lit(0).alias("list"), F.lit(0).cast("long").alias("at"), "r.rule", F.lit("warning").alias("severity"), F.lit("报告头").alias("category"), "r.field")
    held = loans.select("report_id", "category").unionByName(cards.select("report_id", F.lit("creditCard").alias("category"))).groupBy("report_id", "category").agg(F.count("*").alias("have"))
    kinds = F.create_map(*[F.lit(x) for k, n in enumerate([*LISTS, "creditCard"]) for x in (n, k)])
    count_issues = expected.join(held, ["report_id", "category"], "left").filter(c("accounts") != F.coalesce("have", F.lit(0))).select(
        "report_id", F.lit(5).alias("list"), F.lit(0).cast("long").alias("at"), kinds[c("category")].alias("rule"), F.lit("warning").alias("severity"), F.lit("账户数量").alias("category"), F.concat(F.lit("accountDerived."), "category", F.lit(".accountCount")).alias("field"))
    query_issues = reports.join(queries.select("report_id").distinct(), "report_id", "left_anti").select(
        "report_id", F.lit(6).alias("list"), F.lit(0).cast("long").alias("at"), F.lit(0).alias("rule"), F.lit("info").alias("severity"), F.lit("查询记录").alias("category"), F.lit("queryRecord").alias("field"))
    every = head_issues.unionByName(loan_issues).unionByName(card_issues).unionByName(count_issues).unionByName(query_issues)
    number = F.row_number().over(Window.partitionBy("report_id").orderBy("list", "at", "rule"))
    return every.withColumn("number", number).select("report_id", F.concat_ws(":", "category", "field", c("number").cast("string")).alias("issue_id"), "number", "severity", "category", "field")


def rollup(reports: DataFrame, found: DataFrame) -> DataFrame:
    """report_id, critical, warning, info, score, requires_review."""
    count = found.groupBy("report_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "warning", "info")])
    rows = reports.select("report_id").join(count, "report_id", "left").fillna(0)
    score = half_up(1 - F.col("critical") * 0.16 - F.col("warning") * 0.055 - F.col("info") * 0.015, 2)
    return rows.withColumns({"score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), "requires_review": (F.col("critical") > 0) | (F.col("warning") >= 3)})


def readiness(reports: DataFrame, found: DataFrame, reviewed: DataFrame) -> DataFrame:
    """report_id, critical, warning, blocked, shown (first five open issues), hidden. ``reviewed``: report_id, issue_id."""
    left = found.filter(F.col("severity").isin("critical", "warning")).join(reviewed, ["report_id", "issue_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("report_id").orderBy("number"))
    left = left.withColumn("place", place).groupBy("report_id").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "warning")], F.count("*").alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= 5, F.struct("place", "issue_id")))), lambda x: x.issue_id), "|").alias("shown"))
    rows = reports.select("report_id").join(left, "report_id", "left").fillna(0).fillna("")
    return rows.select("report_id", "critical", "warning", ((F.col("critical") > 0) | (F.col("warning") >= 3)).alias("blocked"), "shown", F.greatest(F.col("n") - 5, F.lit(0)).alias("hidden"))
