"""Credit profiles in six dimensions, their assessment by thresholds, and product matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import half_up, money_sum
from ledgerloom.functions.dates import age_at, months_before, parse_loose
from ledgerloom.operators.debt import card_status

#: Keywords, counted query reasons, threshold tables (inclusive upper bounds in order of 正常 关注 警告), levels by rank.
MORTGAGE, AUTO = "住房|房贷|公积金贷款|个人住房", "汽车|车贷|购车"
COUNTED_REASONS = "贷款审批|信用卡审批|担保资格审查"
THRESHOLDS = {
    "query_1m": (2, 4, 6), "query_3m": (4, 8, 12), "query_6m": (6, 12, 18), "card_usage_rate": (0.3, 0.5, 0.7), "active_loans": (3, 6, 10), "new_loans_6m": (1, 3, 5)}
CREDIT_YEARS = (1, 3, 5)
LEVELS = ("正常", "关注", "警告", "危险")
_ENDED = "结清|销户"


def match_level(value: Column, bounds: tuple[float, ...]) -> Column:
    """Rank of the first bound that a value does not exceed; 3 beyond all."""
    out = F
    for rank, bound in enumerate(bounds):
        out = out.when(value <= bound, rank)
    return out.otherwise(3)


def level_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LEVELS)), rank.cast("int") + 1)


def basic_access(reports: DataFrame) -> DataFrame:
    return reports.select("report_id", age_at(F.col("birth_date"), parse_loose(F.col("report_time"))).alias("age"), "marriage", "employment")


def hard_injury(loans: DataFrame, cards: DataFrame, responsibilities: DataFrame | None = None) -> DataFrame:
    """report_id, overdue_now, bad_debt, compensation (any repay responsibility)."""
    both = loans.select("report_id", "overdue_count", "status").unionByName(cards.select("report_id", "overdue_count", "status"))
    out = both.groupBy("report_id").agg(F.count_if(F.col("overdue_count") > 0).alias("overdue_now"), F.bool_or(F.col("status").rlike("呆账|呆帐")).alias("bad_debt"))
    if responsibilities is None:
        return out.withColumn("compensation", F.lit(False))
    held = responsibilities.select("report_id").distinct().withColumn("compensation", F.lit(True))
    return out.join(held, "report_id", "left").fillna(False, ["compensation"])


def repay_history(codes: DataFrame) -> DataFrame:
    """report_id, longest, total: the longest run of overdue codes within an account, and all of them. Months without a code are skipped, not breaks."""
    over = F.col("code").rlike("^[1-7]$")
    w = Window.partitionBy("report_id", "ord").orderBy("seq")
    runs = codes.filter("code IS NOT NULL").withColumn("breaks", F.sum((~over).cast("int")).over(w)).filter(over)
    runs = runs.groupBy("report_id", "ord", "breaks").agg(F.count("*").alias("n"))
    found = runs.groupBy("report_id").agg(F.max("n").alias("longest"), F.sum("n").alias("total"))
    return codes.select("report_id").distinct().join(found, "report_id", "left").fillna(0)


def debt_status(reports: DataFrame, loans: DataFrame, cards: DataFrame) -> DataFrame:
    """report_id, active_loans, loan_balance, new_loans_6m, card_used, card_limit, card_usage_rate, monthly_payment."""
    dates = reports.select("report_id", months_before(parse_loose(F.col("report_time")), 6).alias("since"))
    open_ = ~F.col("status").rlike(_ENDED)
    loan = loans.join(dates, "report_id").groupBy("report_id").agg(
        F.count_if(open_).alias("active_loans"), money_sum(F.when(open_, F.col("balance"))).alias("loan_balance"), money_sum(F.when(open_, F.col("monthly_payment"))).alias("loan_payment"),
        F.count_if(open_ & (parse_loose(F.col("open_date")) >= F.col("since"))).alias("new_loans_6m"))
    card = cards.filter(card_status(F.col("status")) == "正常").groupBy("report_id").agg(
        money_sum(F.col("used_amount")).alias("card_used"), money_sum(F.col("credit_limit")).alias("card_limit"), money_sum(F.col("monthly_payment")).alias("card_payment"))
    out = reports.select("report_id").join(loan, "report_id", "left").join(card, "report_id", "left").fillna(0)
    rate = F.when(F.col("card_limit") > 0, half_up(F.col("card_used") / F.col("card_limit"), 2))
    return out.select("report_id", "active_loans", "loan_balance", "new_loans_6m", "card_used", "card_limit", rate.alias("card_usage_rate"), half_up(F.col("loan_payment") + F.col("card_payment"), 2).alias("monthly_payment"))


def query_frequency(reports: DataFrame, queries: DataFrame, months: tuple[int, ...] = (1, 3, 6)) -> DataFrame:
    """report_id and the counted queries since so many months before the reference date; later ones count too."""
    day = parse_loose(F.col("query_time"))
    dates = reports.select("report_id", *[months_before(day, m).alias(f"since_{m}") for m in months])
    asked = parse_loose(F.col("query_date"))
    counted = queries.filter(F.col("query_reason").rlike(COUNTED_REASONS)).join(dates, "report_id").groupBy("report_id").agg(*[F.count_if(asked >= F.col(f"since_{m}")).alias(f"query_{m}m") for m in months])
    return reports.select("report_id").join(counted, "report_id", "left").fillna(0)


def asset_status(reports: DataFrame, loans: DataFrame, cards: DataFrame) -> DataFrame:
    loan = loans.groupBy("report_id").agg(F.bool_or(F.col("business_type").rlike(MORTGAGE)).alias("has_mortgage"), F.bool_or(F.col("business_type").rlike(AUTO)).alias("has_auto_loan"))
    card = cards.filter(card_status(F.col("status")) == "正常").groupBy("report_id").agg(money_sum(F.col("credit_limit")).alias("card_credit_limit"))
    return reports.select("report_id").join(loan, "report_id", "left").join(card, "report_id", "left").fillna(False).fillna(0.0)


def credit_history(reports: DataFrame, loans: DataFrame, cards: DataFrame) -> DataFrame:
    """report_id, earliest_open_date, credit_years, settled_loans."""
    both = loans.select("report_id", "open_date", "status", F.lit(0).alias("kind"), "ord").unionByName(cards.select("report_id", "open_date", F.lit("").alias("status"), F.lit(1).alias("kind"), "ord"))
    opened = parse_loose(F.col("open_date"))
    first = F.min_by(F.when(opened.isNotNull(), F.struct(F.col("open_date"), opened.alias("d"))), F.when(opened.isNotNull(), F.struct(opened.alias("d"), F.col("kind"), F.col("ord"))))
    out = both.groupBy("report_id").agg(first.alias("first"), F.count_if(F.col("status").rlike("结清")).alias("settled_loans"))
    joined = reports.select("report_id", parse_loose(F.col("report_time")).alias("day")).join(out, "report_id", "left")
    years = F.floor(F.datediff("day", F.col("first.d")) / 365.25)
    return joined.select("report_id", F.col("first.open_date").alias("earliest_open_date"), years.alias("credit_years"), F.coalesce("settled_loans", F.lit(0)).alias("settled_loans"))


def profiles(reports: DataFrame, loans: DataFrame, cards: DataFrame, queries: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """All six dimensions, a row for each report."""
    out = basic_access(reports).join(hard_injury(loans, cards), "report_id", "left").fillna(0, ["overdue_now"]).fillna(False, ["bad_debt", "compensation"])
    history = repay_history(codes) if codes is not None else reports.select("report_id", F.lit(None).cast("long").alias("longest"), F.lit(None).cast("long").alias("total"))
    for part in (history, debt_status(reports, loans, cards), query_frequency(reports, queries), asset_status(reports, loans, cards), credit_history(reports, loans, cards)):
        out = out.join(part, "report_id", "left")
    return out


def profiles_at_once(reports: DataFrame, accounts: DataFrame, queries: DataFrame) -> DataFrame:
    """What :func:`profiles` gives, from one table of accounts (see ``tables.accounts``) that is aggregated once.

    Accounts meet their report, whose dates some figures need, and are summed up by it in the
    same partitioning; so are the queries, which meet the one row that a report has by then.
    """
    day, asked_by, c = parse_loose(F.col("report_time")), parse_loose(F.col("query_time")), F.col
    base = reports.select(
        "report_id", age_at(c("birth_date"), day).alias("age"), "marriage", "employment", day.alias("day"), months_before(day, 6).alias("since"), *[months_before(asked_by, m).alias(f"since_{m}") for m in (1, 3, 6)])
    loan, card = ~c("is_card"), c("is_card") & (card_status(c("status")) == "正常")
    open_loan, opened = loan & ~c("status").rlike(_ENDED), parse_loose(c("open_date"))
    runs = F.transform(F.split("codes", "[^1-7]+"), lambda v: F.length(v))
    first = F.min_by(F.when(opened.isNotNull(), F.struct("open_date", opened.alias("d"))), F.when(opened.isNotNull(), F.struct(opened.alias("d"), "is_card", "ord")))
    found = base.join(accounts, "report_id", "left").groupBy(*base.columns).agg(
        F.count_if(c("overdue_count") > 0).alias("overdue_now"), F.coalesce(F.bool_or(c("status").rlike("呆账|呆帐")), F.lit(False)).alias("bad_debt"),
        F.max(F.array_max(runs)).cast("long").alias("longest"), F.sum(F.regexp_count("codes", F.lit("[1-7]"))).alias("total"), F.count_if(open_loan).alias("active_loans"), money_sum(F.when(open_loan, c("balance"))).alias("loan_balance"),
        money_sum(F.when(open_loan, c("monthly_payment"))).alias("loan_payment"), F.count_if(open_loan & (opened >= c("since"))).alias("new_loans_6m"), money_sum(F.when(card, c("balance"))).alias("card_used"),
        money_sum(F.when(card, c("credit_amount"))).alias("card_limit"), money_sum(F.when(card, c("monthly_payment"))).alias("card_payment"), F.coalesce(F.bool_or(loan & c("business_type").rlike(MORTGAGE)), F.lit(False)).alias("has_mortgage"),
        F.coalesce(F.bool_or(loan & c("business_type").rlike(AUTO)), F.lit(False)).alias("has_auto_loan"), first.alias("first"), F.count_if(loan & c("status").rlike("结清")).alias("settled_loans"))
    asked = queries.filter(c("query_reason").rlike(COUNTED_REASONS)).select("report_id", parse_loose(c("query_date")).alias("asked"))
    out = found.join(asked, "report_id", "left").groupBy(*found.columns).agg(*[F.count_if(c("asked") >= c(f"since_{m}")).alias(f"query_{m}m") for m in (1, 3, 6)])
    return out.select(
        "report_id", "age", "marriage", "employment", "overdue_now", "bad_debt", F.lit(False).alias("compensation"), "longest", "total", "active_loans", "loan_balance", "new_loans_6m", "card_used", "card_limit",
        F.when(c("card_limit") > 0, half_up(c("card_used") / c("card_limit"), 2)).alias("card_usage_rate"), half_up(c("loan_payment") + c("card_payment"), 2).alias("monthly_payment"), "query_1m", "query_3m", "query_6m", "has_mortgage",
        "has_auto_loan", c("card_limit").alias("card_credit_limit"), c("first.open_date").alias("earliest_open_date"), F.floor(F.datediff("day", c("first.d")) / 365.25).alias("credit_years"), "settled_loans")


def indicators() -> list[tuple[str, str, Column]]:
    """Dimension, indicator and rank, in order, over a profile row."""
    c = F.col
    level = lambda name: match_level(c(name), THRESHOLDS[name])
    worst_if = lambda x: F.when(x, 3).otherwise(0)
    years = match_level(c("credit_years"), CREDIT_YEARS)
    return [
        ("basic", "age", F.when(c("age").between(22, 55), 0).otherwise(1)),
        ("basic", "marriage", F.when(F.coalesce("marriage", F.lit("")) != "", 0).otherwise(1)),
        ("basic", "employment", F.when(~F.coalesce("employment", F.lit("")).isin("", "未知"), 0).otherwise(1)),
        ("injury", "overdue_now", worst_if(c("overdue_now") > 0)),
        ("injury", "bad_debt", worst_if(c("bad_debt"))),
        ("injury", "compensation", worst_if(c("compensation"))),
        ("injury", "longest", F.when(c("longest").isNull(), 1).when(c("longest") >= 3, 3).otherwise(0)),
        ("injury", "total", F.when(c("total").isNull(), 1).when(c("total") >= 6, 3).when(c("total") >= 3, 2).otherwise(0)),
        ("debt", "active_loans", level("active_loans")),
        ("debt", "card_usage_rate", F.when(c("card_usage_rate").isNull(), 1).otherwise(level("card_usage_rate"))),
        ("debt", "new_loans_6m", level("new_loans_6m")),
        *[("query", f"query_{m}m", level(f"query_{m}m")) for m in (1, 3, 6)],
        ("asset", "card_credit_limit", F.when(c("card_credit_limit") >= 50000, 0).when(c("card_credit_limit") >= 20000, 1).otherwise(2)),
        ("history", "credit_years", F.when(c("credit_years").isNull(), 1).otherwise(3 - years)),
    ]


def assess(found: DataFrame) -> DataFrame:
    """report_id, dimension, level, indicators: the worst level of each dimension, and each indicator's."""
    groups: dict[str, list] = {}
    for dimension, name, rank in indicators():
        groups.setdefault(dimension, []).append((name, rank))
    rows = []
    for place, (dimension, own) in enumerate(groups.items(), 1):
        ranks = [r for _, r in own]
        worst = F.greatest(*ranks) if len(ranks) > 1 else ranks[0]
        text = F.concat_ws(",", *[F.concat(F.lit(f"{n}="), level_name(r)) for n, r in own])
        rows.append(F.struct(F.lit(place).alias("place"), F.lit(dimension).alias("dimension"), level_name(worst).alias("level"), text.alias("indicators")))
    return found.select("report_id", F.explode(F.array(*rows)).alias("d")).select("report_id", "d.*")


#: Rules over profile fields: product, field, operator (range, bool, enum), weight, least, most, expected, values. The first product has the catalogue's defaults.
RULES = [
    (1, "age", "range", 10, 22.0, 55.0, None, None), (1, "marriage", "enum", 5, None, None, None, "已婚,未婚,离异,丧偶"), (1, "overdue_now", "range", 20, 0.0, 0.0, None, None),
    (1, "longest", "range", 10, 0.0, 2.0, None, None), (1, "total", "range", 10, 0.0, 5.0, None, None), (1, "bad_debt", "bool", 15, None, None, False, None), (1, "active_loans", "range", 10, 0.0, 8.0, None, None),
    (1, "card_usage_rate", "range", 10, 0.0, 0.7, None, None), (1, "query_1m", "range", 10, 0.0, 3.0, None, None), (1, "has_mortgage", "bool", 5, None, None, True, None), (1, "credit_years", "range", 5, 1.0, 30.0, None, None),
    (2, "card_usage_rate", "range", 30, None, 0.5, None, None), (2, "query_3m", "range", 30, None, 6.0, None, None), (2, "has_auto_loan", "bool", 15, None, None, True, None), (2, "monthly_payment", "range", 25, 0.0, 20000.0, None, None),
    (3, "settled_loans", "range", 0, 1.0, None, None, None)]
RULE_SCHEMA = "product int, field string, operator string, weight int, least double, most double, expected boolean, allowed string"
_NUMBERS = ("age", "overdue_now", "longest", "total", "active_loans", "card_usage_rate", "query_1m", "query_3m", "monthly_payment", "credit_years", "settled_loans")
_FLAGS = ("bad_debt", "has_mortgage", "has_auto_loan")


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, RULE_SCHEMA).withColumn("place", F.monotonically_increasing_id())


def match_products(found: DataFrame, rules: DataFrame) -> DataFrame:
    """report_id, product, success_rate, passed, failed, insufficient, place (1: best match of a report).

    Profiles are melted to (field, value) rows and meet the rules, a bounded dimension, on the field.
    """
    value = [F.struct(F.lit(n).alias("field"), F.col(n).cast("double").alias("number"), F.lit(None).cast("boolean").alias("flag"), F.lit(None).cast("string").alias("word")) for n in _NUMBERS]
    value += [F.struct(F.lit(n).alias("field"), F.lit(None).cast("double").alias("number"), F.col(n).alias("flag"), F.lit(None).cast("string").alias("word")) for n in _FLAGS]
    value.append(F.struct(F.lit("marriage").alias("field"), F.lit(None).cast("double").alias("number"), F.lit(None).cast("boolean").alias("flag"), F.col("marriage").alias("word")))
    melted = found.select("report_id", F.explode(F.array(*value)).alias("v")).select("report_id", "v.*")
    c = F.col
    state = F.when(c("operator") == "range", F.when(c("number").isNull(), "insufficient").when((c("number") < c("least")) | (c("number") > c("most")), "fail").otherwise("pass"))
    state = state.when(c("operator") == "bool", F.when(c("flag").isNull(), "insufficient").when(c("flag") == c("expected"), "pass").otherwise("fail"))
    state = state.otherwise(F.when(c("word").isNull(), "insufficient").when(F.array_contains(F.split("allowed", ","), c("word")), "pass").otherwise("fail"))
    # a null bound does not limit
    state = F.when((c("operator") == "range") & c("number").isNotNull(), F.when(F.coalesce(c("number") < c("least"), F.lit(False)) | F.coalesce(c("number") > c("most"), F.lit(False)), "fail").otherwise("pass")).otherwise(state)
    judged = melted.join(F.broadcast(rules), "field").withColumn("state", state)
    earned = F.sum(F.when(c("state") == "pass", c("weight").cast("double")).when(c("state") == "insufficient", c("weight") * 0.5).otherwise(0.0))
    out = judged.groupBy("report_id", "product").agg(
        F.when(F.sum("weight") > 0, half_up(earned / F.sum("weight") * 100)).otherwise(100.0).alias("success_rate"), *[F.count_if(c("state") == s).alias(n) for s, n in (("pass", "passed"), ("fail", "failed"), ("insufficient", "insufficient"))])
    return out.withColumn("place", F.row_number().over(Window.partitionBy("report_id").orderBy(F.desc("success_rate"), "product")))
