"""Registered queries of agreements, responsibilities, employers, line payments, rule changes and image regions, over tables made of the driver's; with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import share6
from ledgerloom.operators import regions
from ledgerloom.operators import statements as x
from ledgerloom.plans.labels import _label_sql, _match_sql
from ledgerloom.sources import tables as t

QUERIES, SQL = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


_N = "CAST({} AS STRING)".format
_ORG = "CASE k % 4 WHEN 0 THEN '招商银行股份有限公司；' WHEN 1 THEN '某消费金融有限公司123456' WHEN 2 THEN '' ELSE '测试银行' END"
#: Tables by form: headers and rows of cells, each an expression of k (an order's key) that both engines read alike.
_AGREEMENT = ["'管理机构'", "'授信协议标识'", "'生效日期'", "'到期日期'", "'授信额度用途'"]
_LIMITS = ["'授信限额'", "CASE WHEN k % 3 = 0 THEN '授信额度(元)' ELSE '授信额度' END", "'授信额度用途'", "'已用额度'", "'币种'"]
_LIMIT_VALUES = ["''", _N("k * 7 % 90000") + " || ',000'", "'x'", f"CASE WHEN k % 5 = 0 THEN '' ELSE {_N('k % 777')} END", "'人民币'"]
AGREEMENTS = [
    (_AGREEMENT, [[_ORG, "'B1'", "'2020.01.01'", "'--'", "'其他贷款'"], _LIMITS, _LIMIT_VALUES]), (_AGREEMENT, []), ([_ORG, "'B2'", "'2021.01.01'", "'--'", "'循环'"], [_LIMITS, _LIMIT_VALUES]), (["'账户'", "'余额'"], [["'1'", "'2'"]]),
    (_AGREEMENT, [[_ORG]])]
_DUTY = ["'管理机构'", "CASE WHEN k % 3 = 0 THEN '业务神类' ELSE '业务种类' END", "'开立日期'", "'到期日期'", "CASE WHEN k % 5 = 0 THEN '类别' ELSE '责任人类型' END", "CASE WHEN k % 7 = 0 THEN '数' ELSE '还款责任金额' END", "'币种'", "'保证合同编号'"]
_DUTY_VALUES = [_ORG, "'个人经营性贷款'", "'2019.05.06'", "CASE WHEN k % 2 = 0 THEN '' ELSE '2024.05.06' END", "CASE WHEN k % 2 = 0 THEN '保证人/反担保人' ELSE '共同借款人' END", _N("k % 999") + " || ',000'", "'人民币元'", f"'C' || {_N('k')}"]
_WHO = [["'主业务借款人'", "'主业务借款人证件类型'", "'主业务借款人证件号码'"], [f"'某人' || {_N('k % 50')}", "'身份证'", f"'ID' || {_N('k')}"]]
_STATE = [["'五级分类'", "CASE WHEN k % 4 = 1 THEN '佘额' ELSE '余额' END", "'还款状态'"], ["'正常'", _N("k % 4444"), "'N'"]]
DUTIES = [(_DUTY, [_DUTY_VALUES, *_WHO, *_STATE]), (_DUTY, []), (_DUTY_VALUES, _WHO + _STATE), (["'余额'"], [["'1'"]]), (_DUTY, []), (_DUTY, [_DUTY_VALUES])]
JOBS = [
    (["'编号'", "CASE WHEN k % 3 = 0 THEN '工作单位名称' ELSE '工作单位' END", "'单位性质'"], [["'1'", f"CASE WHEN k % 6 = 1 THEN ' 甲 ' ELSE ' 某商贸有限公司' || {_N('k % 9')} || ' ' END", "'企业'"]]), (["'编号'", "'单位'"], [["'1'", "'x'"]]), (["'工作单位'"], [])]


def _forms(forms, arrays) -> tuple[str, str]:
    """Expressions for headers and rows of the table form that k // 3 chooses."""
    row = lambda cells: arrays(", ".join(cells))
    empty = "CAST({} AS {})".format(arrays(""), "array<array<string>>" if arrays("") == "array()" else "VARCHAR[][]")
    when = lambda parts: "CASE " + " ".join(f"WHEN k // 3 % {len(forms)} = {n} THEN {p}" for n, p in enumerate(parts)) + " END"
    return when([row(h) for h, _ in forms]), when([arrays(", ".join(map(row, r))) if r else empty for _, r in forms])


def _cte(forms) -> str:
    headers, rows = _forms(forms, "[{}]".format)
    return f"s AS (SELECT k % 400 AS doc_id, k AS ord, {headers} AS headers, {rows} AS rows FROM (SELECT o_orderkey AS k FROM orders)), n AS (SELECT *, lead(struct_pack(headers := headers, rows := rows)) OVER (PARTITION BY doc_id ORDER BY ord) AS nx FROM s)"


def _tables(spark: SparkSession, sf_dir: str, forms) -> DataFrame:
    headers, rows = (e.replace("//", "DIV") for e in _forms(forms, "array({})".format))
    return t.read(spark, sf_dir, "orders").selectExpr("o_orderkey AS k").selectExpr("k % 400 AS doc_id", "k AS ord", f"{headers} AS headers", f"{rows} AS rows")



def _org_sql(text: str) -> str:
    from ledgerloom.functions.texts import ORG_SUFFIXES

    part = lambda s: f"WHEN contains({text}, '{s}') THEN regexp_replace(regexp_replace(regexp_extract({text}, '^(.*{s})', 1, 's'), '[A-Za-z0-9]{{6,}}', '', 'g'), '[；;，,。.]', '', 'g')"
    return f"CASE {' '.join(map(part, ORG_SUFFIXES))} ELSE {text} END"


_NUM = "coalesce(TRY_CAST(nullif(replace({0}, ',', ''), '') AS DOUBLE), 0)".format
_AT = "coalesce(list_extract({1}, list_position(list_transform({0}, lambda c: {2}), true)), '')".format
_IS_AGREEMENT = "(contains(array_to_string({0}, ''), '管理机构') AND contains(array_to_string({0}, ''), '授信额度用途'))".format


@query(f"""WITH {_cte(AGREEMENTS)}, h AS (SELECT doc_id, ord, CASE WHEN len(rows) >= 2 THEN rows[1] ELSE nx.headers END AS f, CASE WHEN len(rows) >= 2 THEN rows[2] ELSE nx.rows[1] END AS l, CASE WHEN len(rows) >= 2 THEN rows[3] ELSE nx.rows[2] END AS v
    FROM n WHERE {_IS_AGREEMENT('headers')} AND (len(rows) >= 2 OR (nx IS NOT NULL AND NOT {_IS_AGREEMENT('nx.headers')})))
    SELECT doc_id, ord, {_org_sql("coalesce(f[1], '')")} AS org, coalesce(f[5], '') AS purpose, {_NUM(_AT('l', 'v', "contains(c, '授信额度') AND NOT contains(c, '用途') AND NOT contains(c, '限额')"))} AS credit_limit, {_NUM(_AT('l', 'v', "contains(c, '已用额度')"))} AS used_amount FROM h""")
def q_credit_agreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete tables, headers whose values stand in the next table, and headers without any."""
    return x.credit_agreements(_tables(spark, sf_dir, AGREEMENTS))


def _named_sql(labels: str, values: str, keyword: str) -> str:
    return f"coalesce((SELECT trim(list_extract({values}, i)) FROM (SELECT unnest({labels}) AS c, unnest(range(1, len({labels}) + 1)) AS i) WHERE {_match_sql(_label_sql('c'), _label_sql(chr(39) + keyword + chr(39)))} ORDER BY i LIMIT 1), '')"


_PAIR = lambda word: f"coalesce(list_position(list_transform(d[1:len(d) - 1], lambda r: list_bool_or(list_transform(r, lambda c: contains(c, '{word}')))), true), 0)"


@query(f"""WITH RECURSIVE {_cte(DUTIES).replace('n AS (SELECT *,', 'n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k, list_bool_or(list_transform(headers, lambda h: regexp_matches(h, ' + chr(39) + '管理机构|责任人|还款责任' + chr(39) + '))) AS header,')},
    w AS (SELECT doc_id, k, header AND len(rows) = 0 AS opens, false AS taken FROM n WHERE k = 1 UNION ALL SELECT n.doc_id, n.k, n.header AND len(n.rows) = 0 AND NOT w.opens, w.opens FROM w JOIN n ON n.doc_id = w.doc_id AND n.k = w.k + 1),
    a AS (SELECT n.doc_id, ord, headers AS l, CASE WHEN opens THEN nx.headers ELSE rows[1] END AS v, CASE WHEN opens THEN nx.rows ELSE rows[2:] END AS d FROM n JOIN w ON w.doc_id = n.doc_id AND w.k = n.k WHERE header AND NOT taken AND (len(rows) > 0 OR nx IS NOT NULL)),
    b AS (SELECT *, {_PAIR('主业务借款人')} AS p, CASE WHEN {_PAIR('余额')} > 0 THEN {_PAIR('余额')} ELSE {_PAIR('五级分类')} END AS q, list_position(list_transform(v, lambda z: regexp_matches(z, '{x.RESPONSIBLE}')), true) AS rp FROM a),
    c AS (SELECT *, list_filter(list_transform(v, lambda z: trim(z)), lambda z, i: i <> coalesce(rp, 0)) AS o, CASE WHEN p > 0 THEN d[p] ELSE []::VARCHAR[] END AS wl, CASE WHEN p > 0 THEN d[p + 1] ELSE []::VARCHAR[] END AS wv, CASE WHEN q > 0 THEN d[q] ELSE []::VARCHAR[] END AS sl, CASE WHEN q > 0 THEN d[q + 1] ELSE []::VARCHAR[] END AS sv FROM b),
    e AS (SELECT *, {_named_sql('l', 'v', '管理机构')} AS org_, {_named_sql('l', 'v', '责任人类型')} AS kind_, {_named_sql('l', 'v', '还款责任金额')} AS amount_, coalesce(list_reduce(list_concat([''], o), lambda s, z: CASE WHEN regexp_matches(z, '{x.ORGANISATION}') AND length(z) > length(s) THEN z ELSE s END), '') AS long_ FROM c),
    g AS (SELECT *, CASE WHEN org_ <> '' THEN org_ ELSE long_ END AS org0, {_named_sql('l', 'v', '业务种类')} AS business_type, {_named_sql('l', 'v', '开立日期')} AS open_date, nullif({_named_sql('l', 'v', '到期日期')}, '') AS end_date, {_named_sql('l', 'v', '币种')} AS currency, nullif({_named_sql('l', 'v', '保证合同编号')}, '') AS contract_no,
        nullif({_named_sql('wl', 'wv', '主业务借款人')}, '') AS borrower, nullif({_named_sql('wl', 'wv', '主业务借款人证件类型')}, '') AS cert_type, nullif({_named_sql('wl', 'wv', '主业务借款人证件号码')}, '') AS cert_no, nullif({_named_sql('sl', 'sv', '余额')}, '') AS bal, nullif({_named_sql('sl', 'sv', '五级分类')}, '') AS five_category, nullif({_named_sql('sl', 'sv', '还款状态')}, '') AS repay_status FROM e)
    SELECT doc_id, ord, {_org_sql('org0')} AS org, business_type, open_date, end_date, CASE WHEN kind_ <> '' THEN kind_ ELSE coalesce(trim(v[rp]), '') END AS kind,
        {_NUM("CASE WHEN amount_ <> '' THEN amount_ ELSE coalesce(list_filter(o, lambda z: regexp_matches(z, '^[0-9,]+(?:[.][0-9]+)?$'))[1], '') END")} AS amount, currency, contract_no, borrower, cert_type, cert_no, CASE WHEN bal IS NOT NULL THEN {_NUM('bal')} END AS balance, five_category, repay_status FROM g""")
def q_repay_responsibilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete tables, and runs of headers without rows, of which every second one is the values of the one before."""
    return x.repay_responsibilities(_tables(spark, sf_dir, DUTIES))


@query(f"""WITH {_cte(JOBS)}, f AS (SELECT doc_id, arg_min(headers, ord) AS l, arg_min(rows, ord) AS r FROM s GROUP BY 1), c AS (SELECT doc_id, trim({_AT('l', 'r[1]', "contains(c, '工作单位')")}) AS company FROM f) SELECT * FROM c WHERE length(company) >= 2""")
def q_latest_employer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.latest_employers(_tables(spark, sf_dir, JOBS))


#: Lines of an account: the text by (key + line) of its order lines, a label or a number.
_LINE = "CASE (l_partkey + l_linenumber) % 9 WHEN 0 THEN ' 本月应还款' WHEN 1 THEN '本月实还款' WHEN 2 THEN '当前途期总额' WHEN 3 THEN '账户状态' WHEN 4 THEN '' ELSE CAST(l_suppkey AS STRING) || ',' || CAST(l_partkey % 900 + 100 AS STRING) || CASE WHEN l_partkey % 4 = 0 THEN '.5' WHEN l_partkey % 11 = 3 THEN '元' ELSE '' END END"
_LINES_SQL = f"SELECT l_orderkey // 32 AS account_id, l_orderkey // 32 % 2 = 0 AS is_card, row_number() OVER (PARTITION BY l_orderkey // 32 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS line, {_LINE} AS text FROM lineitem"


@query(f"""WITH i AS ({_LINES_SQL}), z AS (SELECT account_id, is_card, line, trim(text) AS text FROM i), a AS (SELECT *, min(CASE WHEN text = '本月应还款' THEN line END) OVER (PARTITION BY account_id) AS first FROM z),
    b AS (SELECT *, coalesce(min(CASE WHEN line >= first AND CASE WHEN is_card THEN regexp_matches(text, '当前[途逾]期总额') AND line < first + 8 ELSE text = '本月实还款' AND line < first + 5 END THEN line END) OVER (PARTITION BY account_id), first) AS stop FROM a),
    c AS (SELECT account_id, replace(text, ',', '')::DOUBLE AS number, row_number() OVER (PARTITION BY account_id ORDER BY line) AS nth, is_card FROM b WHERE line > stop AND regexp_matches(replace(text, ',', ''), '^[0-9]+(?:[.][0-9]+)?$'))
    SELECT account_id, coalesce(max(CASE WHEN nth = CASE WHEN c.is_card THEN 2 ELSE 5 END THEN number END), 0) AS payment FROM (SELECT DISTINCT account_id FROM z) LEFT JOIN c USING (account_id) GROUP BY 1""")
def q_line_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    t.read(spark, sf_dir, "lineitem").createOrReplaceTempView("account_lines_")
    lines = spark.sql(_LINES_SQL.replace("l_orderkey // 32", "(l_orderkey DIV 32)").replace("FROM lineitem", "FROM account_lines_"))
    return x.line_payments(lines)


_CHANGE = {
    "id": "user_id % 300", "seq": "event_id", "op": "CASE WHEN event_id % 7 = 0 THEN 'add' WHEN event_id % 41 = 1 THEN 'delete' ELSE 'update' END",
    "name": "CASE WHEN event_id % 3 = 0 THEN event_type END", "weight": "CASE WHEN event_id % 4 = 1 THEN event_id % 100 END"}
_CHANGES = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _CHANGE.items()) + " FROM events"


@query(f"""WITH c AS ({_CHANGES}), g AS (SELECT *, coalesce(max(CASE WHEN op = 'delete' THEN seq END) OVER (PARTITION BY id), -1) AS gone FROM c), b AS (SELECT *, min(CASE WHEN op = 'add' THEN seq END) OVER (PARTITION BY id) AS born FROM g WHERE seq > gone)
    SELECT id, arg_max(name, seq) FILTER (name IS NOT NULL) AS name, arg_max(weight, seq) FILTER (weight IS NOT NULL) AS weight, max(seq) AS updated_at FROM b WHERE seq >= born GROUP BY 1""")
def q_rule_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = t.read(spark, sf_dir, "events").select(*[F.expr(e).alias(n) for n, e in _CHANGE.items()])
    return x.fold_changes(changes, ["name", "weight"])


#: Pixel runs of images of 100 x 40: eight places a line, of 12 pixels at most, some of them touching the next.
_RUN = {"image_id": "l_suppkey % 60", "y": "l_partkey % 40", "x0": "(l_orderkey % 8) * 12 + l_linenumber % 3", "x1": "(l_orderkey % 8) * 12 + 8 + l_linenumber % 4"}
_WIDTH, _HEIGHT = 100, 40
_RUNS = "SELECT image_id, y, min(x0) AS x0, max(x1) AS x1 FROM (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _RUN.items()) + ", l_orderkey % 8 AS place FROM lineitem) GROUP BY image_id, y, place"


@query(f"""WITH RECURSIVE r AS (SELECT row_number() OVER (ORDER BY image_id, y, x0) AS id, * FROM ({_RUNS})),
    e AS (SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.image_id = b.image_id AND ((abs(a.y - b.y) = 1 AND a.x0 <= b.x1 AND a.x1 >= b.x0) OR (a.y = b.y AND (a.x1 + 1 = b.x0 OR b.x1 + 1 = a.x0)))),
    c(id, low, n) AS (SELECT id, id, 0 FROM r UNION ALL SELECT c.id, least(min(c.low), min(d.low)), max(c.n) + 1 FROM c JOIN e ON e.a = c.id JOIN c d ON d.id = e.b WHERE c.n < 160 GROUP BY c.id),
    l AS (SELECT r.*, coalesce(low, r.id) AS low FROM r LEFT JOIN (SELECT id, min(low) AS low FROM c GROUP BY 1) USING (id)),
    g AS (SELECT image_id, low, sum(x1 - x0 + 1)::BIGINT AS area, min(x0)::INT AS min_x, min(y)::INT AS min_y, max(x1)::INT AS max_x, max(y)::INT AS max_y FROM l GROUP BY 1, 2),
    s AS (SELECT *, area * (1 - sqrt(pow((min_x + max_x) / 2 - {_WIDTH / 2}::DOUBLE, 2) + pow((min_y + max_y) / 2 - {_HEIGHT / 2}::DOUBLE, 2)) / {(_WIDTH**2 / 4 + _HEIGHT**2 / 4) ** 0.5!r}::DOUBLE * {regions.OFF_CENTER}::DOUBLE) * least({regions.MOST_SOLID}::DOUBLE, {regions.SOLID}::DOUBLE + area / ((max_x - min_x + 1) * (max_y - min_y + 1))) AS score
        FROM g WHERE area / {_WIDTH * _HEIGHT} >= {regions.LEAST_COVERAGE}::DOUBLE)
    SELECT image_id, area, min_x, min_y, max_x, max_y, floor(score * 1000000 + 0.5) / 1000000 AS score FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, low) AS k FROM s) WHERE k = 1""")
def q_document_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = t.read(spark, sf_dir, "lineitem").select(*[F.expr(e).alias(n) for n, e in _RUN.items()], F.expr("l_orderkey % 8").alias("place"))
    runs = runs.groupBy("image_id", "y", "place").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    return regions.document_region(runs, _WIDTH, _HEIGHT).withColumn("score", share6(F.col("score")))
