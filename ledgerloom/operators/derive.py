"""Derived figures: merging summaries, repairing balances, linking briefs, client profiles and their confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import money_sum, to_wan
from ledgerloom.functions.dates import age_at, parse_loose

SUMMARY = ("orgs", "accounts", "total_credit", "balance", "payment")


def merge_summaries(current: DataFrame, detail: DataFrame, brief: DataFrame) -> DataFrame:
    """Per report and category: what was stated, completed from details and briefs, then overridden by the first that has accounts.

    All three have report_id, category and the summary columns. Cards take the parsed
    amounts even where they are 0.
    """
    keys = ["report_id", "category"]
    named = lambda df, p: df.select(*keys, F.lit(True).alias(f"{p}_has"), *[F.col(c).alias(f"{p}_{c}") for c in SUMMARY])
    rows = named(current, "c").join(named(detail, "d"), keys, "full").join(named(brief, "b"), keys, "full")
    parsed = F.when(F.col("d_accounts") > 0, "d").when(F.col("b_accounts") > 0, "b")
    out = []
    for name in SUMMARY:
        c, d, b = (F.col(f"{p}_{name}") for p in "cdb")
        first = F.coalesce("c_has", "d_has", "b_has")
        base = F.when(F.col("c_has"), c).when(F.col("d_has"), d).otherwise(b)
        filled = F.when(first & (base <= 0) & (d > 0), d).otherwise(base)
        filled = F.when((filled <= 0) & (b > 0), b).otherwise(filled)
        own = F.when(parsed == "d", d).when(parsed == "b", b)
        always = F.lit(name == "accounts") | ((F.col("category") == "creditCard") & F.lit(name not in ("orgs", "accounts")))
        out.append(F.when(own.isNotNull() & (always | (own > 0)), own).otherwise(filled).alias(name))
    return rows.select(*keys, *out)


def repair_balances(loans: DataFrame, summary: DataFrame) -> DataFrame:
    """report_id, category, ord, repaired: the one balance of a group that a stated total can correct.

    A balance is suspicious where the payment exceeds 1.2 times of it. ``summary`` has
    report_id, category, stated_accounts, stated_balance.
    """
    c = F.col
    group = Window.partitionBy("report_id", "category")
    rows = loans.join(summary, ["report_id", "category"]).withColumn("size", F.count("*").over(group))
    rows = rows.filter((c("stated_balance") > 0) & ((c("stated_accounts") <= 0) | (c("stated_accounts") == c("size")))).filter(~c("status").rlike("结清|销户|未激活"))
    balance, payment = F.coalesce("balance", F.lit(0.0)), F.coalesce("monthly_payment", F.lit(0.0))
    rows = rows.withColumns({"active": F.count("*").over(group), "total": F.sum(balance.cast("decimal(18,2)")).over(group).cast("double"), "odd": (balance > 0) & (payment > balance * 1.2)})
    candidate = F.when(c("active") == 1, c("stated_balance")).when(c("stated_balance") > c("total"), (c("stated_balance").cast("decimal(18,2)") - (c("total").cast("decimal(18,2)") - balance.cast("decimal(18,2)"))).cast("double"))
    fits = (candidate > balance) & ((payment <= 0) | (candidate >= payment)) & ((c("credit_amount") <= 0) | (candidate <= c("credit_amount") * 1.05))
    rows = rows.filter("odd").withColumn("repaired", candidate).filter(F.coalesce(fits, F.lit(False)))
    return rows.withColumn("n", F.count("*").over(group)).filter("n = 1").select("report_id", "category", "ord", "repaired")


def link_briefs(briefs: DataFrame, accounts: DataFrame) -> DataFrame:
    """report_id, category, ord, brief: the brief that belongs to an account.

    A brief matches by organisation with date or amount (or without a date), or by date
    and amount. Matches are looked up by organisation and by date, two equi joins; one
    match decides, else the places in lists of equal length.
    """
    keys = ["report_id", "category"]
    group = Window.partitionBy(*keys)
    plain = lambda x: F.regexp_replace(F.regexp_replace(x, r"\s+", ""), "[■□�]", "")
    b = briefs.filter("trim(org) <> '' OR trim(open_date) <> ''").select(*keys, F.col("ord").alias("brief"), plain(F.col("org")).alias("b_org"), F.col("open_date").alias("b_date"), F.col("credit_amount").alias("b_amount"))
    b = b.withColumns({"b_size": F.count("*").over(group), "place": F.row_number().over(group.orderBy("brief"))})
    a = accounts.select(*keys, "ord", plain(F.col("org")).alias("a_org"), F.col("open_date").alias("a_date"), F.col("credit_amount").alias("a_amount"))
    a = a.withColumns({"a_size": F.count("*").over(group), "place": F.row_number().over(group.orderBy("ord"))})
    close = (F.col("a_amount") > 0) & (F.col("b_amount") > 0) & (F.abs(F.col("a_amount") - F.col("b_amount")) <= 1)
    by_org = a.filter("a_org <> ''").join(b.drop("place", "b_size").withColumnRenamed("b_org", "a_org"), [*keys, "a_org"]).filter((F.col("a_date") == F.col("b_date")) | close | (F.col("b_date") == ""))
    by_date = a.filter("a_date <> ''").join(b.drop("place", "b_size").withColumnRenamed("b_date", "a_date"), [*keys, "a_date"]).filter(close)
    found = by_org.select(*keys, "ord", "brief").union(by_date.select(*keys, "ord", "brief")).distinct()
    one = found.groupBy(*keys, "ord").agg(F.count("*").alias("n"), F.min("brief").alias("brief")).filter("n = 1").drop("n")
    rest = a.join(one, [*keys, "ord"], "left_anti").join(b, [*keys, "place"]).filter("a_size = b_size").select(*keys, "ord", "brief")
    return one.unionByName(rest)


def overdue_summary(loans: DataFrame, codes: DataFrame) -> DataFrame:
    """report_id, any_overdue, most_months, open_payment."""
    account = loans.groupBy("report_id").agg(F.bool_or(F.col("overdue_count") > 0).alias("any_overdue"), money_sum(F.when(~F.col("status").rlike("结清|销户"), F.col("monthly_payment"))).alias("open_payment"))
    months = codes.filter(F.col("code").rlike("^[1-7]$")).groupBy("report_id").agg(F.max(F.col("code").cast("int")).alias("most_months"))
    return account.join(months, "report_id", "left").select("report_id", "any_overdue", F.coalesce("most_months", F.lit(0)).alias("most_months"), "open_payment")


def marriage_kind(status: Column) -> Column:
    return F.when(status == "未婚", "single").when(status == "已婚", "married").when(status.isin("离异", "离婚"), "divorced")


def client_profiles(reports: DataFrame, derived: DataFrame, counted: DataFrame, overdue: DataFrame) -> DataFrame:
    """report_id, name, age, marriage, q1m, q2m, q6m, overdue_now, overdue_months, limit_wan, used_wan, repayment."""
    card = lambda c: money_sum(F.when(F.col("category") == "creditCard", F.col(c)))
    sums = derived.groupBy("report_id").agg(card("total_credit").alias("credit"), card("balance").alias("used"), money_sum(F.col("payment")).alias("repayment"))
    rows = reports.join(sums, "report_id", "left").join(counted, "report_id", "left").join(overdue, "report_id", "left").fillna(0, ["credit", "used", "repayment"])
    return rows.select(
        "report_id", "name", age_at(F.col("birth_date"), parse_loose(F.col("report_time"))).alias("age"), marriage_kind(F.col("marriage")).alias("marriage"), F.col("query_1m").alias("q1m"), F.col("query_2m").alias("q2m"), F.col("query_6m").alias("q6m"),
        F.col("any_overdue").alias("overdue_now"), F.col("most_months").alias("overdue_months"), to_wan(F.col("credit")).alias("limit_wan"), to_wan(F.col("used")).alias("used_wan"), "repayment")


#: Confidence of present fields by kind.
CONFIDENCE = {0.90: ("name", "age", "marriage"), 0.75: ("q1m", "q2m", "q6m", "repayment"), 0.80: ("overdue_now", "overdue_months", "limit_wan", "used_wan")}
SURE = 0.8


def confidences(clients: DataFrame) -> DataFrame:
    """report_id, field, confidence, low: 0 for missing fields."""
    rows = []
    for value, fields in CONFIDENCE.items():
        for f in fields:
            text = F.col(f).cast("string")
            rows.append(F.struct(F.lit(f).alias("field"), F.when(text.isNull() | (text == ""), 0.0).otherwise(value).alias("confidence")))
    return clients.select("report_id", F.explode(F.array(*rows)).alias("c")).select("report_id", "c.*").withColumn("low", F.col("confidence") < SURE)


def cross_check(clients: DataFrame) -> DataFrame:
    """report_id and the confidence of limits and query counts after contradictions took 0.2 off, down to 0.3."""
    less = lambda value, when: F.when(F.coalesce(when, F.lit(False)), F.greatest(value - 0.2, F.lit(0.3))).otherwise(value)
    over, first, second = F.col("used_wan") > F.col("limit_wan"), F.col("q1m") > F.col("q2m"), F.col("q2m") > F.col("q6m")
    base, count = F.lit(0.8), F.lit(0.75)
    return clients.select(
        "report_id", less(base, over).alias("limit_conf"), less(base, over).alias("used_conf"), less(count, first).alias("q1m_conf"), less(less(count, first), second).alias("q2m_conf"), less(count, second).alias("q6m_conf"))
