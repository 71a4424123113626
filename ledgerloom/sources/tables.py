"""Reading tables, and the deterministic report views over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import half_up

#: Reference dates of the views: of account measures, and of query measures.
REPORT_TIME, QUERY_TIME = "2001.08.01", "2024.02.20"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def distinct_by(rows: DataFrame, key: str) -> DataFrame:
    """Distinct rows, of which those of a key stay together in the order of their columns; no table of all rows is held, and windows of the key need no further shuffle."""
    same = Window.partitionBy(key, *[c for c in rows.columns if c != key]).orderBy(F.lit(0))
    return rows.repartition(key).withColumn("nth_", F.row_number().over(same)).filter("nth_ = 1").drop("nth_")


def _by(key, *values: str):
    """One of ``values``, by the remainder of ``key``."""
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """report_id, name, report_time, query_time, birth_date, marriage, employment."""
    key = F.col("c_custkey")
    born = F.date_add(F.lit("1945-01-01").cast("date"), (key * 37 % 21000).cast("int"))
    return read(spark, sf_dir, "customer").select(
        key.alias("report_id"), F.col("c_name").alias("name"), F.lit(REPORT_TIME).alias("report_time"), F.lit(QUERY_TIME).alias("query_time"),
        F.date_format(born, "yyyy.MM.dd").alias("birth_date"), F.nullif(_by(key, "已婚", "未婚", "离婚", "丧偶", ""), F.lit("")).alias("marriage"), F.col("c_mktsegment").alias("employment"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with what their open lines amount to."""
    line = read(spark, sf_dir, "lineitem")
    net = half_up(F.col("l_extendedprice") * (1 - F.col("l_discount")), 2).cast("decimal(18,2)")
    lines = line.groupBy("l_orderkey").agg(
        F.sum(F.when(F.col("l_linestatus") == "O", net)).cast("double").alias("balance"), F.sum((F.col("l_returnflag") == "R").cast("long")).alias("overdue"))
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("org"))
    orders = read(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey") % 25)
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(F.broadcast(nation), "k", "left").select(  # 25 nations
        F.col("o_custkey").alias("report_id"), F.col("o_orderkey").alias("ord"), F.concat(F.col("org"), F.lit("银行")).alias("org"), F.date_format("o_orderdate", "yyyy.MM.dd").alias("open_date"),
        F.col("o_totalprice").alias("amount"), F.coalesce("balance", F.lit(0.0)).alias("balance"), F.coalesce("overdue", F.lit(0)).alias("overdue_count"), "o_orderstatus", "o_orderpriority")


def _kinds():
    return F.create_map(*[F.lit(x) for pair in {"1-URGENT": "个人住房贷款", "2-HIGH": "个人经营性贷款", "3-MEDIUM": "个人汽车贷款"}.items() for x in pair])


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """report_id, ord, category, org, open_date, credit_amount, balance, monthly_payment, status, business_type, overdue_count."""
    status = F.when(F.col("o_orderstatus") == "F", "结清").when(F.col("o_orderstatus") == "O", "正常").otherwise("逾期")
    return _orders(spark, sf_dir).filter("NOT startswith(o_orderpriority, '5')").select(
        "report_id", "ord", _by(F.col("ord"), "nonRevolvingLoan", "revolvingLoan1", "revolvingLoan2").alias("category"), "org", "open_date", F.col("amount").alias("credit_amount"), "balance",
        half_up(F.col("balance") / 12, 2).alias("monthly_payment"), status.alias("status"), F.coalesce(F.try_element_at(_kinds(), F.col("o_orderpriority")), F.lit("其他个人消费贷款")).alias("business_type"), "overdue_count")


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """report_id, ord, org, open_date, credit_limit, used_amount, balance, monthly_payment, status, currency, overdue_count."""
    return _orders(spark, sf_dir).filter("startswith(o_orderpriority, '5')").select(
        "report_id", "ord", "org", "open_date", F.col("amount").alias("credit_limit"), F.col("balance").alias("used_amount"), "balance", half_up(F.col("balance") / 10, 2).alias("monthly_payment"),
        F.when(F.col("o_orderstatus") == "P", "其他").otherwise("正常").alias("status"), F.when(F.col("ord") % 7 == 0, "美元").otherwise("人民币").alias("currency"), "overdue_count")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loans and cards in one table, each order and line read once: report_id, ord, is_card, org, open_date, credit_amount (a card's limit), balance, monthly_payment, status, business_type, overdue_count, codes.

    ``codes`` are the line codes in order (of one line number those that are not overdue first), as one text; those that
    were not noted are left out, and an order without lines has null.
    """
    line = read(spark, sf_dir, "lineitem")
    net = half_up(F.col("l_extendedprice") * (1 - F.col("l_discount")), 2).cast("decimal(18,2)")
    code = F.when(F.col("l_returnflag") == "R", "1").when(F.col("l_returnflag") == "A", "N")
    lines = line.groupBy(F.col("l_orderkey").alias("ord")).agg(
        F.sum(F.when(F.col("l_linestatus") == "O", net)).cast("double").alias("balance"), F.sum((F.col("l_returnflag") == "R").cast("long")).alias("overdue_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", (code == "1").alias("over"), code.alias("code")))), lambda x: x["code"]), "").alias("codes"))
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.concat("n_name", F.lit("银行")).alias("org"))
    order = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("ord"), "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderpriority", (F.col("o_orderkey") % 25).alias("k"))
    rows = order.join(lines, "ord", "left").join(F.broadcast(nation), "k", "left").fillna(0, ["balance", "overdue_count"]).withColumn("is_card", F.startswith("o_orderpriority", F.lit("5")))  # 25 nations
    card, state = F.col("is_card"), F.col("o_orderstatus")
    status = F.when(card, F.when(state == "P", "其他").otherwise("正常")).when(state == "F", "结清").when(state == "O", "正常").otherwise("逾期")
    kind = F.when(~card, F.coalesce(F.try_element_at(_kinds(), F.col("o_orderpriority")), F.lit("其他个人消费贷款")))
    return rows.select(
        F.col("o_custkey").alias("report_id"), "ord", "is_card", "org", F.date_format("o_orderdate", "yyyy.MM.dd").alias("open_date"), F.col("o_totalprice").alias("credit_amount"), "balance",
        half_up(F.col("balance") / F.when(card, 10).otherwise(12), 2).alias("monthly_payment"), status.alias("status"), kind.alias("business_type"), "overdue_count", "codes")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """report_id, ord, query_date, query_org, query_reason."""
    reason = F.when(F.col("event_type") == "purchase", "贷款审批").when(F.col("event_type") == "signup", "信用卡审批").when(F.col("event_type") == "click", "担保资格审查").when(F.col("event_type") == "view", "贷后管理").otherwise("本人查询")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("report_id"), F.col("event_id").alias("ord"), F.date_format("ts", "yyyy.MM.dd").alias("query_date"),
        F.concat(F.lit("机构"), (F.col("event_id") % 17).cast("string")).alias("query_org"), reason.alias("query_reason"))


def repay_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """report_id, ord, seq, code: a code for each order line, in line order; null where none was noted."""
    code = F.when(F.col("l_returnflag") == "R", "1").when(F.col("l_returnflag") == "A", "N")
    line = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("seq"), code.alias("code"))
    return line.join(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("report_id")), "ord")


#: The same views for SQL, as common table expressions.
_ORDER_SQL = """
ord AS (SELECT o.o_custkey AS report_id, o.o_orderkey AS ord, n.n_name || '银行' AS org, strftime(o.o_orderdate, '%Y.%m.%d') AS open_date, o.o_totalprice AS amount,
    coalesce(l.balance, 0)::DOUBLE AS balance, coalesce(l.overdue, 0)::BIGINT AS overdue_count, o.o_orderstatus, o.o_orderpriority
    FROM orders o LEFT JOIN (SELECT l_orderkey, (sum(CASE WHEN l_linestatus = 'O' THEN CAST(floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) / 100 AS DECIMAL(18,2)) END))::DOUBLE AS balance,
        sum((l_returnflag = 'R')::INT) AS overdue FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey LEFT JOIN nation n ON n.n_nationkey = o.o_orderkey % 25)"""
VIEW_SQL = {
    "report": f"""report AS (SELECT c_custkey AS report_id, c_name AS name, '{REPORT_TIME}' AS report_time, '{QUERY_TIME}' AS query_time,
        strftime(DATE '1945-01-01' + (c_custkey * 37 % 21000)::INT, '%Y.%m.%d') AS birth_date, ['已婚', '未婚', '离婚', '丧偶', NULL][(c_custkey % 5 + 1)::INT] AS marriage, c_mktsegment AS employment FROM customer)""",
    "loan": """loan AS (SELECT report_id, ord, ['nonRevolvingLoan', 'revolvingLoan1', 'revolvingLoan2'][(ord % 3 + 1)::INT] AS category, org, open_date, amount AS credit_amount, balance,
        floor(balance / 12 * 100 + 0.5) / 100 AS monthly_payment, CASE o_orderstatus WHEN 'F' THEN '结清' WHEN 'O' THEN '正常' ELSE '逾期' END AS status,
        CASE o_orderpriority WHEN '1-URGENT' THEN '个人住房贷款' WHEN '2-HIGH' THEN '个人经营性贷款' WHEN '3-MEDIUM' THEN '个人汽车贷款' ELSE '其他个人消费贷款' END AS business_type, overdue_count
        FROM ord WHERE o_orderpriority NOT LIKE '5%')""",
    "card": """card AS (SELECT report_id, ord, org, open_date, amount AS credit_limit, balance AS used_amount, balance, floor(balance / 10 * 100 + 0.5) / 100 AS monthly_payment,
        CASE WHEN o_orderstatus = 'P' THEN '其他' ELSE '正常' END AS status, CASE WHEN ord % 7 = 0 THEN '美元' ELSE '人民币' END AS currency, overdue_count FROM ord WHERE o_orderpriority LIKE '5%')""",
    "query": """query AS (SELECT user_id AS report_id, event_id AS ord, strftime(ts, '%Y.%m.%d') AS query_date, '机构' || (event_id % 17) AS query_org,
        CASE event_type WHEN 'purchase' THEN '贷款审批' WHEN 'signup' THEN '信用卡审批' WHEN 'click' THEN '担保资格审查' WHEN 'view' THEN '贷后管理' ELSE '本人查询' END AS query_reason FROM events)""",
    "code": """code AS (SELECT o_custkey AS report_id, l_orderkey AS ord, l_linenumber AS seq, CASE l_returnflag WHEN 'R' THEN '1' WHEN 'A' THEN 'N' END AS code FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
}


def with_views(*names: str) -> str:
    """The head of a statement over the named views; the caller goes on with a comma or SELECT."""
    parts = [_ORDER_SQL] if {"loan", "card"} & set(names) else []
    return "WITH " + ", ".join(parts + [VIEW_SQL[n] for n in names])
