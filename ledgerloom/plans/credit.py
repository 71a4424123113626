"""Registered queries over report views: debt, profile, assessment, products, validation; with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import share6
from ledgerloom.operators import debt, profile, validation
from ledgerloom.operators.debt import CATEGORIES, LOAN_KINDS, PLANS
from ledgerloom.operators.profile import RULES
from ledgerloom.sources import tables as t
from ledgerloom.sources.tables import with_views

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with SQL if there is one."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _buckets(spark, sf_dir) -> DataFrame:
    return debt.buckets(debt.active_debts(t.loans(spark, sf_dir), t.cards(spark, sf_dir)))


def _wide(spark, sf_dir) -> DataFrame:
    return debt.debts_at_once(t.accounts(spark, sf_dir))


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: share6(F.col(n)) for n in names})


def _share(x: str) -> str:
    return f"floor(({x}) * 1000000.0::DOUBLE + 0.5::DOUBLE)::DOUBLE / 1000000.0::DOUBLE"


_KIND = "CASE " + " ".join(f"WHEN regexp_matches(business_type, '{p}') THEN '{k}'" for k, p in LOAN_KINDS.items()) + " ELSE 'other' END"
_DEBT = with_views("loan", "card") + f""", d AS (
    SELECT report_id, ord, {_KIND} AS category, greatest(balance, 0) AS balance, greatest(monthly_payment, 0) AS payment FROM loan WHERE NOT regexp_matches(status, '结清|销户|未激活|关闭|注销') AND (balance > 0 OR monthly_payment > 0 OR regexp_matches(status, '正常|尚未逾期|未逾期'))
    UNION ALL SELECT report_id, ord, 'creditCard', used_amount, monthly_payment FROM card WHERE status = '正常' AND (used_amount > 0 OR monthly_payment > 0)),
b AS (SELECT report_id, category, count(*) AS accounts, sum(balance::DECIMAL(18,2))::DOUBLE AS balance, sum(payment::DECIMAL(18,2))::DOUBLE AS payment FROM d GROUP BY 1, 2),
tot AS (SELECT report_id, sum(balance::DECIMAL(18,2))::DOUBLE AS debt, floor(sum(payment::DECIMAL(18,2))::DOUBLE + 0.5) AS due FROM b GROUP BY 1),
place AS (SELECT unnest(['{"', '".join(CATEGORIES)}']) AS category, unnest(['{"', '".join(CATEGORIES.values())}']) AS label, unnest(range({len(CATEGORIES)})) AS place),
parts AS (SELECT b.*, label, place, CASE WHEN debt > 0 THEN balance / debt END AS balance_share, CASE WHEN due > 0 THEN payment / due END AS payment_share, CASE WHEN balance > 0 THEN payment / balance END AS payment_rate, debt, due
    FROM b JOIN tot USING (report_id) JOIN place USING (category)),
lim AS (SELECT report_id, sum(credit_limit::DECIMAL(18,2))::DOUBLE AS card_limit FROM card WHERE status = '正常' GROUP BY 1),
od AS (SELECT report_id, count(*) AS overdue_accounts FROM (SELECT report_id, overdue_count FROM loan UNION ALL SELECT report_id, overdue_count FROM card) WHERE overdue_count > 0 GROUP BY 1),
wide AS (SELECT b.report_id, {", ".join(f"coalesce(sum(CASE WHEN category = '{c}' THEN {v}::DECIMAL(18,2) END), 0)::DOUBLE AS {c}_{v}" for c in CATEGORIES for v in ("balance", "payment"))},
    sum(accounts)::BIGINT AS debt_count, sum(balance::DECIMAL(18,2))::DOUBLE AS debt_total, floor(sum(payment::DECIMAL(18,2))::DOUBLE + 0.5) AS payment, coalesce(sum(CASE WHEN category = 'creditCard' THEN accounts END), 0)::BIGINT AS card_count FROM b GROUP BY 1),
m AS (SELECT wide.*, coalesce(card_limit, 0) AS card_limit, coalesce(overdue_accounts, 0) AS overdue_accounts, CASE WHEN debt_total > 0 THEN payment / debt_total END AS monthly_payment_rate,
    CASE WHEN card_limit > 0 THEN creditCard_balance / card_limit END AS card_usage_rate, CASE WHEN debt_total > 0 THEN (business_balance + consumer_balance + auto_balance + other_balance + creditCard_balance) / debt_total END AS non_mortgage_share,
    CASE WHEN debt_total > 0 THEN business_balance / debt_total END AS business_share, business_payment + consumer_payment + auto_payment + other_payment + creditCard_payment AS non_mortgage_payment
    FROM wide LEFT JOIN lim USING (report_id) LEFT JOIN od USING (report_id)),
top AS (SELECT report_id, arg_max(label, struct_pack(x := balance, y := -place)) AS b_label, max(balance) AS b_balance, arg_max(balance_share, struct_pack(x := balance, y := -place)) AS b_share,
    arg_max(label, struct_pack(x := payment, y := -place)) AS p_label, max(payment) AS p_payment, arg_max(payment_share, struct_pack(x := payment, y := -place)) AS p_share FROM parts GROUP BY 1),
ic AS (SELECT report_id, ord, org, credit_limit, used_amount, greatest(0, credit_limit - used_amount)::DOUBLE AS available, monthly_payment, CASE WHEN credit_limit > 0 THEN used_amount / credit_limit END AS usage_rate FROM card WHERE status = '正常' AND (used_amount > 0 OR monthly_payment > 0))
"""


@query(with_views("loan", "card") + ", u AS (SELECT report_id, status, overdue_count FROM loan UNION ALL SELECT report_id, status, overdue_count FROM card) SELECT status, count(*) AS accounts, sum(overdue_count)::BIGINT AS overdue FROM u GROUP BY 1")
def q_account_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["report_id", "status", "overdue_count"]
    return t.loans(spark, sf_dir).select(cols).unionByName(t.cards(spark, sf_dir).select(cols)).groupBy("status").agg(F.count("*").alias("accounts"), F.sum("overdue_count").alias("overdue"))


@query(_DEBT + "SELECT category, count(*) AS accounts, sum(balance::DECIMAL(18,2))::DOUBLE AS balance FROM d GROUP BY 1")
def q_debt_active_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debt.active_debts(t.loans(spark, sf_dir), t.cards(spark, sf_dir)).groupBy("category").agg(F.count("*").alias("accounts"), F.sum(F.col("balance").cast("decimal(18,2)")).cast("double").alias("balance"))


@query(_DEBT + f"SELECT report_id, category, label, accounts, balance, payment, {_share('balance_share')} AS balance_share, {_share('payment_share')} AS payment_share, {_share('payment_rate')} AS payment_rate FROM parts")
def q_debt_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = debt.debts_at_once(t.accounts(spark, sf_dir)).select("report_id", F.inline("parts"))
    return _round(parts.drop("place"), "balance_share", "payment_share", "payment_rate")


@query(with_views("loan") + f" SELECT business_type, {_KIND} AS category, count(*) AS accounts FROM loan GROUP BY 1, 2")
def q_classify_loan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.loans(spark, sf_dir).groupBy("business_type", debt.classify_loan(F.col("business_type")).alias("category")).agg(F.count("*").alias("accounts"))


@query(with_views("card") + ", c AS (SELECT status AS raw, currency, CASE WHEN currency <> '人民币' THEN '其他' WHEN status = '正常' THEN '正常' ELSE '其他' END AS normal FROM card) SELECT raw, currency, normal, count(*) AS cards FROM c GROUP BY 1, 2, 3")
def q_card_status_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.cards(spark, sf_dir).groupBy(F.col("status").alias("raw"), "currency", debt.card_status(F.col("status"), F.col("currency")).alias("normal")).agg(F.count("*").alias("cards"))


@query(_DEBT + ", dt AS (SELECT report_id, count(*) AS accounts, sum(balance::DECIMAL(18,2))::DOUBLE AS balance, sum(monthly_payment::DECIMAL(18,2))::DOUBLE AS payment FROM loan WHERE ord % 4 = 0 GROUP BY 1), have AS (SELECT report_id, sum(balance) AS h FROM b WHERE category <> 'creditCard' AND report_id % 3 <> 0 GROUP BY 1), b2 AS (SELECT * FROM b WHERE report_id % 3 <> 0 OR category = 'creditCard'), x AS (SELECT dt.report_id, 'other' AS category, dt.accounts, dt.balance, dt.payment FROM dt LEFT JOIN have USING (report_id) WHERE dt.balance > 0 AND coalesce(h, 0) = 0) SELECT report_id, category, accounts, balance, payment FROM b2 WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.report_id = b2.report_id AND x.category = b2.category) UNION ALL SELECT * FROM x")
def q_debt_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the reports lose their loan details; derived totals come from a quarter of the accounts."""
    found = _buckets(spark, sf_dir).filter("report_id % 3 <> 0 OR category = 'creditCard'")
    part = t.loans(spark, sf_dir).filter("ord % 4 = 0").groupBy("report_id").agg(F.count("*").alias("accounts"), F.sum(F.col("balance").cast("decimal(18,2)")).cast("double").alias("balance"), F.sum(F.col("monthly_payment").cast("decimal(18,2)")).cast("double").alias("payment"))
    return debt.with_derived(found, part.withColumn("category", F.lit("loan")), t.cards(spark, sf_dir))


@query(_DEBT + "SELECT report_id, debt_total, debt_count, debt_count - card_count AS loan_count, card_count, creditCard_balance AS card_used, card_limit, payment FROM m")
def q_debt_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(spark, sf_dir).select("report_id", "debt_total", "debt_count", (F.col("debt_count") - F.col("card_count")).alias("loan_count"), "card_count", F.col("creditCard_balance").alias("card_used"), "card_limit", "payment")


@query(_DEBT + f"SELECT report_id, {_share('monthly_payment_rate')} AS monthly_payment_rate, {_share('card_usage_rate')} AS card_usage_rate, {_share('non_mortgage_share')} AS non_mortgage_share, {_share('business_share')} AS business_share, mortgage_payment, floor(non_mortgage_payment * 100 + 0.5) / 100 AS non_mortgage_payment, overdue_accounts FROM m")
def q_debt_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _wide(spark, sf_dir).select("report_id", "monthly_payment_rate", "card_usage_rate", "non_mortgage_share", "business_share", "mortgage_payment", debt.half_up(F.col("non_mortgage_payment"), 2).alias("non_mortgage_payment"), "overdue_accounts")
    return _round(out, "monthly_payment_rate", "card_usage_rate", "non_mortgage_share", "business_share")


@query(_DEBT + f"SELECT report_id, b_label, b_balance, {_share('b_share')} AS b_share, p_label, p_payment FROM top")
def q_top_debt(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = debt.debts_at_once(t.accounts(spark, sf_dir))
    return out.select("report_id", F.col("by_balance.label").alias("b_label"), F.col("by_balance.balance").alias("b_balance"), share6(F.col("by_balance.balance_share")).alias("b_share"), F.col("by_payment.label").alias("p_label"), F.col("by_payment.payment").alias("p_payment"))


@query(_DEBT + f""", r AS (SELECT m.*, b_share, p_share, coalesce(non_mortgage_share, 0) AS rest, ic.n FROM m LEFT JOIN top USING (report_id) LEFT JOIN (SELECT report_id, count(*) AS n FROM ic GROUP BY 1) ic USING (report_id)),
i AS (SELECT report_id, 1 AS place, 'current-overdue' AS key, '高风险' AS level, overdue_accounts::DOUBLE AS figure FROM r WHERE overdue_accounts > 0
    UNION ALL SELECT report_id, 2, 'debt-concentration', CASE WHEN b_share >= 0.65 THEN '预警' ELSE '关注' END, b_share FROM r WHERE b_share >= 0.45
    UNION ALL SELECT report_id, 3, 'non-mortgage-share', CASE WHEN rest >= 0.8 THEN '预警' ELSE '关注' END, rest FROM r WHERE rest >= 0.6
    UNION ALL SELECT report_id, 4, 'card-usage', CASE WHEN card_usage_rate >= 0.9 THEN '预警' ELSE '关注' END, card_usage_rate FROM r WHERE card_usage_rate >= 0.75
    UNION ALL SELECT report_id, 5, 'card-installment-gap', '关注', 0 FROM r WHERE n IS NULL
    UNION ALL SELECT report_id, 6, 'payment-concentration', '关注', p_share FROM r WHERE p_share >= 0.45)
SELECT report_id, place, key, level, {_share('figure')} AS figure FROM (SELECT * FROM i UNION ALL SELECT report_id, 7, 'stable-structure', '正常', 0 FROM r WHERE report_id NOT IN (SELECT report_id FROM i))""")
def q_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(debt.triggered(debt.debts_at_once(t.accounts(spark, sf_dir))), "figure")


@query(_DEBT + f"SELECT report_id, ord, org, credit_limit, used_amount, floor(available * 100 + 0.5) / 100 AS available, monthly_payment, {_share('usage_rate')} AS usage_rate, CASE WHEN regexp_matches(org, '广发|招商|招行|民生|广州|平安|光大|华夏') THEN '机构在可重点核查名单内' ELSE '需结合发卡机构政策人工核查' END AS reason FROM ic")
def q_installment_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(debt.installment_cards(t.cards(spark, sf_dir)), "usage_rate").withColumn("available", debt.half_up(F.col("available"), 2))


def _plan_sql() -> str:
    out = []
    for place, (key, name, impact, by_card, lines) in enumerate(PLANS, 1):
        parts = (["coalesce(relief, 0)"] if by_card else []) + ["floor(({}) * {!r}::DOUBLE + 0.5)".format(" + ".join(f"{c}_payment" for c in own.split()), r) for own, r in lines]
        total, n = " + ".join(f"greatest({p}, 0)" for p in parts), " + ".join(f"({p} > 0)::INT" for p in parts)
        out.append(f"SELECT report_id, {place} AS place, '{key}' AS key, '{name}' AS name, '{impact}' AS impact, payment, least(payment, {total}) AS released, greatest(0, payment - least(payment, {total}))::DOUBLE AS target, greatest({n}, 1) AS lines FROM m LEFT JOIN rel USING (report_id)")
    return " UNION ALL ".join(out)


_PLANS_SQL = _DEBT + ", rel AS (SELECT report_id, floor(sum(CASE WHEN used_amount > 0 AND monthly_payment > 0 THEN greatest(0, monthly_payment - ceil(used_amount / 12)) ELSE 0 END::DECIMAL(18,2))::DOUBLE + 0.5) AS relief FROM ic GROUP BY 1) " + _plan_sql()


def _plan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debt.plans(debt.debts_at_once(t.accounts(spark, sf_dir)))


@query(_PLANS_SQL)
def q_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan_rows(spark, sf_dir)


def _comma(x: str) -> str:
    return f"format('{{:,}}', CAST(floor({x} + 0.5) AS BIGINT))"


def _percent(x: str) -> str:
    return f"regexp_replace(printf('%.1f', floor(({x}) * 1000 + 0.5) / 10), '\\.0$', '') || '%'"


@query(_DEBT + f""", s AS (SELECT report_id, list_filter(['当前识别在贷余额合计 ' || {_comma('debt_total')} || ' 元，其中贷款账户 ' || (debt_count - card_count) || ' 笔，信用卡有用额账户 ' || card_count || ' 笔。',
    '当前月供合计 ' || {_comma('payment')} || ' 元，是后续降低月供测算的基准。', CASE WHEN b_balance > 0 THEN '余额占比最高的类别为' || b_label || '，余额 ' || {_comma('b_balance')} || ' 元，占比 ' || {_percent('b_share')} || '。' END,
    CASE WHEN non_mortgage_share IS NOT NULL THEN '非房贷余额占比 ' || {_percent('non_mortgage_share')} || '，对应月供 ' || {_comma('non_mortgage_payment')} || ' 元，是优先分析的现金流调节区。' END], lambda x: x IS NOT NULL) AS l, debt_total, payment FROM m LEFT JOIN top USING (report_id))
    SELECT report_id, array_to_string(CASE WHEN debt_total <= 0 AND payment <= 0 THEN ['当前未识别到有效债务余额或月供数据，请先核对 OCR 结果中的贷款账户、信用卡账户和本月应还字段。'] ELSE l END, '|') AS lines FROM s""")
def q_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debt.summary_lines(_wide(spark, sf_dir)).withColumn("lines", F.array_join("lines", "|"))


_DERIVED = with_views("loan", "card") + """, dv AS (SELECT report_id, category, count(DISTINCT org) AS orgs, count(*) AS accounts, sum(credit_amount::DECIMAL(18,2))::DOUBLE AS total_credit,
    coalesce(sum(CASE WHEN status <> '结清' THEN balance::DECIMAL(18,2) END), 0)::DOUBLE AS balance, coalesce(sum(CASE WHEN status <> '结清' THEN monthly_payment::DECIMAL(18,2) END), 0)::DOUBLE AS payment FROM loan GROUP BY 1, 2
    UNION ALL SELECT report_id, 'creditCard', count(DISTINCT org), count(*), coalesce(sum(CASE WHEN status = '正常' THEN credit_limit::DECIMAL(18,2) END), 0)::DOUBLE,
    coalesce(sum(CASE WHEN status = '正常' THEN used_amount::DECIMAL(18,2) END), 0)::DOUBLE, coalesce(sum(CASE WHEN status = '正常' THEN monthly_payment::DECIMAL(18,2) END), 0)::DOUBLE FROM card GROUP BY 1)
"""


@query(_DERIVED + "SELECT report_id, category, orgs, accounts, total_credit, balance, payment FROM dv")
def q_account_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debt.derived_totals(t.loans(spark, sf_dir), t.cards(spark, sf_dir))


_AGE = """CASE WHEN 2001 - b_y - ((8 < bm) OR (8 = bm AND 1 < bd))::INT BETWEEN 0 AND 120 THEN 2001 - b_y - ((8 < bm) OR (8 = bm AND 1 < bd))::INT END"""


@query(with_views("report") + f", p AS (SELECT *, substr(birth_date, 1, 4)::INT AS b_y, substr(birth_date, 6, 2)::INT AS bm, substr(birth_date, 9, 2)::INT AS bd FROM report) SELECT report_id, {_AGE} AS age, marriage, employment FROM p")
def q_age_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.basic_access(t.reports(spark, sf_dir))


_PROFILE = with_views("report", "loan", "card", "query", "code") + f""", p AS (SELECT *, substr(birth_date, 1, 4)::INT AS b_y, substr(birth_date, 6, 2)::INT AS bm, substr(birth_date, 9, 2)::INT AS bd FROM report),
basic AS (SELECT report_id, {_AGE} AS age, marriage, employment FROM p),
hi AS (SELECT report_id, sum((overdue_count > 0)::INT)::BIGINT AS overdue_now, false AS bad_debt, false AS compensation FROM (SELECT report_id, overdue_count FROM loan UNION ALL SELECT report_id, overdue_count FROM card) GROUP BY 1),
rc AS (SELECT *, sum((code NOT SIMILAR TO '[1-7]')::INT) OVER (PARTITION BY report_id, ord ORDER BY seq) AS brk FROM code WHERE code IS NOT NULL),
rn AS (SELECT report_id, ord, brk, count(*) AS n FROM rc WHERE code SIMILAR TO '[1-7]' GROUP BY ALL),
rh AS (SELECT c.report_id, coalesce(max(n), 0)::BIGINT AS longest, coalesce(sum(n), 0)::BIGINT AS total FROM (SELECT DISTINCT report_id FROM code) c LEFT JOIN rn USING (report_id) GROUP BY 1),
dl AS (SELECT report_id, sum((status <> '结清')::INT)::BIGINT AS active_loans, coalesce(sum(CASE WHEN status <> '结清' THEN balance::DECIMAL(18,2) END), 0)::DOUBLE AS loan_balance, coalesce(sum(CASE WHEN status <> '结清' THEN monthly_payment::DECIMAL(18,2) END), 0)::DOUBLE AS lp,
    sum((status <> '结清' AND open_date >= '2001.02.01')::INT)::BIGINT AS new_loans_6m FROM loan GROUP BY 1),
dc AS (SELECT report_id, sum(used_amount::DECIMAL(18,2))::DOUBLE AS card_used, sum(credit_limit::DECIMAL(18,2))::DOUBLE AS card_limit, sum(monthly_payment::DECIMAL(18,2))::DOUBLE AS cp FROM card WHERE status = '正常' GROUP BY 1),
ds AS (SELECT report_id, coalesce(active_loans, 0) AS active_loans, coalesce(loan_balance, 0) AS loan_balance, coalesce(new_loans_6m, 0) AS new_loans_6m, coalesce(card_used, 0) AS card_used, coalesce(card_limit, 0) AS card_limit,
    CASE WHEN card_limit > 0 THEN floor(card_used / card_limit * 100 + 0.5) / 100 END AS card_usage_rate, floor((coalesce(lp, 0) + coalesce(cp, 0)) * 100 + 0.5) / 100 AS monthly_payment FROM report LEFT JOIN dl USING (report_id) LEFT JOIN dc USING (report_id)),
qf AS (SELECT r.report_id, count(CASE WHEN query_date >= '2024.01.20' THEN 1 END) AS query_1m, count(CASE WHEN query_date >= '2023.11.20' THEN 1 END) AS query_3m, count(CASE WHEN query_date >= '2023.08.20' THEN 1 END) AS query_6m
    FROM report r LEFT JOIN query q ON q.report_id = r.report_id AND query_reason IN ('贷款审批', '信用卡审批', '担保资格审查') GROUP BY 1),
ast AS (SELECT r.report_id, coalesce(hm, false) AS has_mortgage, coalesce(ha, false) AS has_auto_loan, coalesce(dc.card_limit, 0) AS card_credit_limit FROM report r LEFT JOIN (SELECT report_id, bool_or(business_type LIKE '%住房%') AS hm, bool_or(business_type LIKE '%汽车%') AS ha FROM loan GROUP BY 1) USING (report_id) LEFT JOIN dc USING (report_id)),
ch AS (SELECT r.report_id, e AS earliest_open_date, floor(date_diff('day', strptime(e, '%Y.%m.%d')::DATE, DATE '2001-08-01') / 365.25)::BIGINT AS credit_years, coalesce(settled, 0)::BIGINT AS settled_loans FROM report r
    LEFT JOIN (SELECT report_id, min(open_date) AS e, sum(s) AS settled FROM (SELECT report_id, open_date, (status = '结清')::INT AS s FROM loan UNION ALL SELECT report_id, open_date, 0 FROM card) GROUP BY 1) USING (report_id)),
pf AS (SELECT basic.*, coalesce(overdue_now, 0) AS overdue_now, coalesce(bad_debt, false) AS bad_debt, coalesce(compensation, false) AS compensation, longest, total, ds.* EXCLUDE (report_id), qf.* EXCLUDE (report_id), ast.* EXCLUDE (report_id), ch.* EXCLUDE (report_id)
    FROM basic LEFT JOIN hi USING (report_id) LEFT JOIN rh USING (report_id) JOIN ds USING (report_id) JOIN qf USING (report_id) JOIN ast USING (report_id) JOIN ch USING (report_id))
"""


def _profiles(spark, sf_dir) -> DataFrame:
    return profile.profiles_at_once(t.reports(spark, sf_dir), t.accounts(spark, sf_dir), t.queries(spark, sf_dir))


@query(_PROFILE + "SELECT report_id, overdue_now, bad_debt, compensation FROM hi")
def q_profile_injury(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.hard_injury(t.loans(spark, sf_dir), t.cards(spark, sf_dir))


@query(_PROFILE + "SELECT report_id, total FROM rh")
def q_repay_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.repay_history(t.repay_codes(spark, sf_dir)).select("report_id", "total")


@query(_PROFILE + "SELECT report_id, longest FROM rh")
def q_repay_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.repay_history(t.repay_codes(spark, sf_dir)).select("report_id", "longest")


@query(_PROFILE + "SELECT * FROM ds")
def q_profile_debt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.debt_status(t.reports(spark, sf_dir), t.loans(spark, sf_dir), t.cards(spark, sf_dir))


@query(_PROFILE + "SELECT * FROM qf")
def q_query_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.query_frequency(t.reports(spark, sf_dir), t.queries(spark, sf_dir))


@query(_PROFILE + "SELECT * FROM ast")
def q_profile_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.asset_status(t.reports(spark, sf_dir), t.loans(spark, sf_dir), t.cards(spark, sf_dir))


@query(_PROFILE + "SELECT * FROM ch")
def q_profile_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.credit_history(t.reports(spark, sf_dir), t.loans(spark, sf_dir), t.cards(spark, sf_dir))


@query(_PROFILE + "SELECT * FROM pf")
def q_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every report's full profile."""
    return _profiles(spark, sf_dir)


_NAMES = "['正常', '关注', '警告', '危险']"


def _rank(x: str, a, b, c) -> str:
    return f"CASE WHEN {x} <= {a} THEN 0 WHEN {x} <= {b} THEN 1 WHEN {x} <= {c} THEN 2 ELSE 3 END"


def _assess_sql() -> str:
    dims = {
        "basic": {"age": "CASE WHEN age BETWEEN 22 AND 55 THEN 0 ELSE 1 END", "marriage": "(marriage IS NULL)::INT", "employment": "0"},
        "injury": {"overdue_now": "CASE WHEN overdue_now > 0 THEN 3 ELSE 0 END", "bad_debt": "0", "compensation": "0", "longest": "CASE WHEN longest IS NULL THEN 1 WHEN longest >= 3 THEN 3 ELSE 0 END",
                   "total": "CASE WHEN total IS NULL THEN 1 WHEN total >= 6 THEN 3 WHEN total >= 3 THEN 2 ELSE 0 END"},
        "debt": {"active_loans": _rank("active_loans", 3, 6, 10), "card_usage_rate": f"CASE WHEN card_usage_rate IS NULL THEN 1 ELSE {_rank('card_usage_rate', 0.3, 0.5, 0.7)} END", "new_loans_6m": _rank("new_loans_6m", 1, 3, 5)},
        "query": {"query_1m": _rank("query_1m", 2, 4, 6), "query_3m": _rank("query_3m", 4, 8, 12), "query_6m": _rank("query_6m", 6, 12, 18)},
        "asset": {"card_credit_limit": "CASE WHEN card_credit_limit >= 50000 THEN 0 WHEN card_credit_limit >= 20000 THEN 1 ELSE 2 END"},
        "history": {"credit_years": f"CASE WHEN credit_years IS NULL THEN 1 ELSE 3 - ({_rank('credit_years', 1, 3, 5)}) END"},
    }
    name = lambda x: f"{_NAMES}[({x}) + 1]"
    return " UNION ALL ".join(f"SELECT report_id, {k} AS place, '{d}' AS dimension, {name('greatest(' + ', '.join(own.values()) + ')')} AS level, {" || ',' || ".join(f"'{n}=' || {name(x)}" for n, x in own.items())} AS indicators FROM pf" for k, (d, own) in enumerate(dims.items(), 1))


@query(_PROFILE + _assess_sql())
def q_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.assess(_profiles(spark, sf_dir))


@query(f"SELECT p_size, {_NAMES}[({_rank('p_size', 6, 12, 18)}) + 1] AS level, count(*) AS parts FROM part GROUP BY ALL")
def q_threshold_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = profile.level_name(profile.match_level(F.col("p_size"), profile.THRESHOLDS["query_6m"]))
    return t.read(spark, sf_dir, "part").groupBy("p_size", level.alias("level")).agg(F.count("*").alias("parts"))


def _rules_sql() -> str:
    text = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    rows = ", ".join(f"({p}, '{f}', '{o}', {w}, {text(a)}, {text(b)}, {text(e)}, {text(x)})" for p, f, o, w, a, b, e, x in RULES)
    return f"rule(product, field, operator, weight, least, most, expected, allowed) AS (SELECT * FROM (VALUES {rows}))"


def _melted() -> str:
    numbers = " UNION ALL ".join(f"SELECT report_id, '{n}' AS field, {n}::DOUBLE AS number, NULL::BOOLEAN AS flag, NULL::VARCHAR AS word FROM pf" for n in profile._NUMBERS)
    flags = " UNION ALL ".join(f"SELECT report_id, '{n}', NULL, {n}, NULL FROM pf" for n in profile._FLAGS)
    return f"melt AS ({numbers} UNION ALL {flags} UNION ALL SELECT report_id, 'marriage', NULL, NULL, marriage FROM pf)"


@query(_PROFILE + f""", {_rules_sql()}, {_melted()},
    j AS (SELECT melt.report_id, rule.product, weight, CASE operator WHEN 'range' THEN CASE WHEN number IS NULL THEN 'i' WHEN coalesce(number < least::DOUBLE, false) OR coalesce(number > most::DOUBLE, false) THEN 'f' ELSE 'p' END
        WHEN 'bool' THEN CASE WHEN flag IS NULL THEN 'i' WHEN flag = expected THEN 'p' ELSE 'f' END ELSE CASE WHEN word IS NULL THEN 'i' WHEN list_contains(string_split(allowed, ','), word) THEN 'p' ELSE 'f' END END AS s FROM melt JOIN rule USING (field)),
    g AS (SELECT report_id, product, CASE WHEN sum(weight) > 0 THEN floor(sum(CASE s WHEN 'p' THEN weight::DOUBLE WHEN 'i' THEN weight * 0.5::DOUBLE ELSE 0 END) / sum(weight) * 100 + 0.5) ELSE 100.0::DOUBLE END AS success_rate,
        count(CASE WHEN s = 'p' THEN 1 END) AS passed, count(CASE WHEN s = 'f' THEN 1 END) AS failed, count(CASE WHEN s = 'i' THEN 1 END) AS insufficient FROM j GROUP BY 1, 2)
    SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY success_rate DESC, product)::INT AS place FROM g""")
def q_product_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.match_products(_profiles(spark, sf_dir), profile.rules(spark))


_ISSUES = _DERIVED.rstrip().replace("WITH ", "WITH " + with_views("report", "query").removeprefix("WITH ") + ", ", 1) + """, n AS (SELECT *, row_number() OVER (PARTITION BY report_id, category ORDER BY ord) - 1 AS idx FROM loan), cn AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY ord) - 1 AS idx FROM card),
lst AS (SELECT * FROM (VALUES ('nonRevolvingLoan', 1, '非循环贷账户', 'nonRevolvingLoans'), ('revolvingLoan1', 2, '循环贷账户一', 'revolvingLoansType1'), ('revolvingLoan2', 3, '循环贷账户二', 'revolvingLoansType2')) v(category, list, label, prefix)),
x AS (SELECT n.*, list, label, prefix, status <> '结清' AS active, n.category <> 'revolvingLoan2' AS plain FROM n JOIN lst USING (category)),
e AS (SELECT report_id, category, accounts + (report_id % 10 = 0)::INT AS accounts FROM dv),
i AS (SELECT report_id, 0 AS list, 0 AS idx, 1 AS rule, 'warning' AS severity, '报告头' AS category, 'header.reportNo' AS field FROM report WHERE report_id % 5 = 0
    UNION ALL SELECT report_id, list, idx, 1, 'warning', label, prefix || '[' || idx || '].loanAmount' FROM x WHERE plain AND active AND credit_amount <= 0
    UNION ALL SELECT report_id, list, idx, 2, 'critical', label, prefix || '[' || idx || '].balance' FROM x WHERE active AND credit_amount > 0 AND balance > credit_amount * 1.05::DOUBLE
    UNION ALL SELECT report_id, list, idx, 3, 'warning', label, prefix || '[' || idx || '].monthlyPayment' FROM x WHERE active AND monthly_payment = 0 AND balance > 0
    UNION ALL SELECT report_id, list, idx, 4, 'critical', label, prefix || '[' || idx || '].monthlyPayment' FROM x WHERE active AND monthly_payment > 0 AND balance > 0 AND monthly_payment > balance * 1.2::DOUBLE
    UNION ALL SELECT report_id, list, idx, 5, 'warning', label, prefix || '[' || idx || '].balance' FROM x WHERE plain AND NOT active AND balance > 0
    UNION ALL SELECT report_id, 4, idx, 1, 'warning', '贷记卡账户', 'creditCards[' || idx || '].creditLimit' FROM cn WHERE status = '正常' AND credit_limit <= 0
    UNION ALL SELECT report_id, 4, idx, 2, 'critical', '贷记卡账户', 'creditCards[' || idx || '].usedAmount' FROM cn WHERE status = '正常' AND credit_limit > 0 AND used_amount > credit_limit * 1.15::DOUBLE
    UNION ALL SELECT report_id, 4, idx, 3, 'warning', '贷记卡账户', 'creditCards[' || idx || '].usedAmount' FROM cn WHERE status <> '正常' AND used_amount > 0
    UNION ALL SELECT e.report_id, 5, 0, list_position(['nonRevolvingLoan', 'revolvingLoan1', 'revolvingLoan2', 'creditCard'], e.category) - 1, 'warning', '账户数量', 'accountDerived.' || e.category || '.accountCount' FROM e JOIN dv USING (report_id, category) WHERE e.accounts <> dv.accounts
    UNION ALL SELECT report_id, 6, 0, 0, 'info', '查询记录', 'queryRecord' FROM report WHERE report_id NOT IN (SELECT report_id FROM query)),
issue AS (SELECT report_id, category || ':' || field || ':' || number AS issue_id, number, severity, category, field FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY list, idx, rule)::INT AS number FROM i)),
roll AS (SELECT report_id, count(CASE WHEN severity = 'critical' THEN 1 END) AS critical, count(CASE WHEN severity = 'warning' THEN 1 END) AS warning, count(CASE WHEN severity = 'info' THEN 1 END) AS info FROM report LEFT JOIN issue USING (report_id) GROUP BY 1)
"""


def _checked(spark, sf_dir) -> DataFrame:
    """Reports whose number is missing for each fifth one, with section counts that are one too high for each tenth."""
    return t.reports(spark, sf_dir).withColumn("report_no", F.when(F.col("report_id") % 5 != 0, F.col("report_id").cast("string")))


def _issues(spark, sf_dir) -> DataFrame:
    expected = debt.derived_totals(t.loans(spark, sf_dir), t.cards(spark, sf_dir)).select("report_id", "category", (F.col("accounts") + (F.col("report_id") % 10 == 0).cast("int")).alias("accounts"))
    return validation.issues(_checked(spark, sf_dir), t.loans(spark, sf_dir), t.cards(spark, sf_dir), t.queries(spark, sf_dir), expected)


@query(_ISSUES + "SELECT * FROM issue")
def q_validation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir)


@query(_ISSUES + "SELECT *, greatest(0::DOUBLE, least(1::DOUBLE, floor((1 - critical * 0.16::DOUBLE - warning * 0.055::DOUBLE - info * 0.015::DOUBLE) * 100 + 0.5) / 100)) AS score, critical > 0 OR warning >= 3 AS requires_review FROM roll")
def q_validation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.rollup(_checked(spark, sf_dir), _issues(spark, sf_dir))


@query(_ISSUES + """, l AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY number) AS place FROM issue WHERE severity IN ('critical', 'warning') AND number % 3 <> 0),
    g AS (SELECT report_id, count(CASE WHEN severity = 'critical' THEN 1 END) AS critical, count(CASE WHEN severity = 'warning' THEN 1 END) AS warning, count(*) AS n, string_agg(issue_id, '|' ORDER BY place) FILTER (place <= 5) AS shown FROM l GROUP BY 1)
    SELECT report_id, coalesce(critical, 0) AS critical, coalesce(warning, 0) AS warning, coalesce(critical, 0) > 0 OR coalesce(warning, 0) >= 3 AS blocked, coalesce(shown, '') AS shown, greatest(coalesce(n, 0) - 5, 0) AS hidden FROM report LEFT JOIN g USING (report_id)""")
def q_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third issue has been reviewed."""
    found = _issues(spark, sf_dir)
    return validation.readiness(_checked(spark, sf_dir), found, found.filter("number % 3 = 0").select("report_id", "issue_id"))
