"""Registered queries of value lookup by label and of accounts read from tables, over tables made of orders; with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import labels as x
from ledgerloom.sources import tables as t

QUERIES, SQL = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


# Tables as rows of cells; each cell is an expression that both engines read alike, of k (an order's key) and p (its price in whole units).
def _one_of(step: int, *values: str) -> str:
    return "CASE " + " ".join(f"WHEN k // {step} % {len(values)} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_TEXT = "CAST({} AS STRING)".format
_DAY = lambda n: f"'20' || lpad({_TEXT(f'k % {n}')}, 2, '0') || '.' || lpad({_TEXT('k % 12 + 1')}, 2, '0') || '.' || lpad({_TEXT(f'(k + {n}) % 28 + 1')}, 2, '0')"
_ORG = _one_of(1, "招商银行股份有限公司", "测试消费金融有限公司", "某市农村商业银行", "通用小额贷款有限公司", "")
LOAN_GRID = [
    [_one_of(2, "管理机构", "管利机构", "管机构", "管理机构"), "'账户标识'", "'开立日期'", _one_of(3, "到期日期", "到日期"), _one_of(5, "借款金额", "僧款金额", "账户授信额度"), "'账户币种'"],
    [_ORG, f"'B10' || {_TEXT('k')} || 'X0001'", _DAY(19), _DAY(23), _TEXT("p"), "'人民币元'"],
    ["'业务种类'", _one_of(4, "担保方式", "担保方武"), "'还款期数'", "'还款频率'", "'还款方式'", "'共同借款标志'"],
    [_one_of(3, "个人住房贷款", "其他个人消费贷款"), "'信用/免担保'", _TEXT("k % 36 + 1"), "'月'", "'按期还本付息'", "'无'"],
    [_one_of(6, "账户状态", "账户状识"), "'五级分类'", _one_of(7, "余额", "佘额", "余额(元)"), "'剩余还款期数'", _one_of(5, "本月应还款", "本月应还"), "'应还款日'"],
    [_one_of(4, "正常", "结清", "逾期"), "'正常'", _one_of(2, "46,200元", "--", "1203"), _TEXT("k % 24"), _TEXT("p // 12"), _TEXT("k % 31 + 1")],
    ["'当前逾期期数'", "'当前逾期总额'", "'本月实还款：' || " + _TEXT("p // 13"), "''", "'备注'", "'无'"],
    [_TEXT("k % 4"), _TEXT("k % 4 * 700"), "''", "''", "''", "''"]]
CARD_GRID = [
    [_one_of(3, "发卡机构", "卡机构", "发卡行", "主业务借款人"), "'账户标识'", _one_of(5, "开立日期", "日期"), "'账户授信额度'", "'共享授信额度'", "'币种'"],
    [_ORG, f"'C20' || {_TEXT('k')} || 'Y0002'", _DAY(17), f"CASE WHEN k % 6 = 0 THEN '50' ELSE {_TEXT('p')} END", _TEXT("p + 60000"), _one_of(4, "人民币", "人民币", "美元")],
    [_one_of(7, "账户状态", "户状态"), "'余额'", _one_of(2, "已用额度", "巳用额度"), "'账单日'", "'本月应还款'", "'本月实还款'"],
    [_one_of(3, "正常", "销户", "正常", "未激活"), _TEXT("p // 5"), _TEXT("p // 4"), _TEXT("k % 28 + 1"), _TEXT("p // 40"), _TEXT("p // 41")]]


def _spark_grid(grid: list[list[str]]) -> str:
    return ("array(" + ", ".join("array(" + ", ".join(row) + ")" for row in grid) + ")").replace("//", "DIV")


def _sql_grid(grid: list[list[str]]) -> str:
    return "[" + ", ".join("[" + ", ".join(row) + "]" for row in grid) + "]"


_KEYS = "SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS p, o_orderpriority FROM orders"


def _tables(spark: SparkSession, sf_dir: str, grid: list[list[str]], where: str = "TRUE") -> DataFrame:
    rows = t.read(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "CAST(floor(o_totalprice) AS BIGINT) AS p", "o_orderpriority").filter(where)
    # narrow keys are dealt out before each grows into a table
    return rows.repartition(spark.sparkContext.defaultParallelism).selectExpr("k AS table_id", f"{_spark_grid(grid)} AS grid")


_LOANS, _CARDS = "o_orderpriority < '4'", "o_orderpriority >= '4'"
_LOAN_CTE = f"g AS (SELECT k AS table_id, {_sql_grid(LOAN_GRID)} AS grid FROM ({_KEYS}) WHERE {_LOANS})"
_CARD_CTE = f"g AS (SELECT k AS table_id, {_sql_grid(CARD_GRID)} AS grid FROM ({_KEYS}) WHERE {_CARDS} AND NOT list_bool_or(list_transform({_sql_grid(CARD_GRID)}[1], lambda h: contains(h, '主业务借款人'))))"


def _label_sql(text: str) -> str:
    text = f"regexp_replace(regexp_replace({text}, '\\s+', '', 'g'), '[■□�：:()（）]', '', 'g')"
    for wrong, right in x.MISREAD:
        text = f"replace({text}, '{wrong}', '{right}')"
    return f"regexp_replace({text}, '[^\\x{{4e00}}-\\x{{9fa5}}A-Za-z0-9]', '', 'g')"


def lcs_sql(a: str, b: str) -> str:
    """Longest common subsequence: rows of the table as lists, each from the one before and the places where a character occurs."""
    row = "list_transform(range(1, len(s) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda i: greatest(s[i], CASE WHEN e[i] = 1 THEN coalesce(s[i - 1], 0) + 1 ELSE 0 END))))"
    marks = f"list_transform(string_split({a}, ''), lambda h: list_transform(string_split({b}, ''), lambda o: (h = o)::BIGINT))"
    zero = f"[list_transform(string_split({b}, ''), lambda o: 0::BIGINT)]"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE list_reduce(list_concat({zero}, {marks}), lambda s, e: {row})[-1] END"


def _match_sql(value: str, target: str) -> str:
    n, m = f"length({value})", f"length({target})"
    conflict = " OR ".join(f"(contains({value}, '{p}') AND contains({target}, '{q}')) OR (contains({value}, '{q}') AND contains({target}, '{p}'))" for p, q in x.CONFLICTS)
    least = f"(CASE WHEN {m} <= 4 THEN {x.SIMILAR[0]}::DOUBLE WHEN {m} <= 6 THEN {x.SIMILAR[1]}::DOUBLE ELSE {x.SIMILAR[2]}::DOUBLE END)"
    return f"""CASE WHEN {value} = '' OR {target} = '' OR {conflict} THEN false WHEN contains({value}, {target}) THEN true
        WHEN contains({target}, {value}) AND {m} - {n} <= 1 AND {n} >= least(3, {m}) THEN true WHEN {m} <= 2 OR ({target} = '管理机构' AND contains({value}, '查询机构')) THEN false
        ELSE ({lcs_sql(value, target)})::DOUBLE / greatest({n}, {m}) >= {least} END"""


_DATE_LIKE = "(regexp_matches({0}, '\\d{{4}}[.\\-/年]\\d{{1,2}}[.\\-/月]\\d{{1,2}}日?') OR regexp_matches({0}, '\\d{{4}}\\s*年'))".format
_ID_LIKE = lambda v: f"(regexp_matches({v}, '[A-Za-z]') AND regexp_matches({v}, '[0-9]') AND length(regexp_replace({v}, '[^A-Za-z0-9]', '', 'g')) >= 8)"
_LABEL_LIKE = lambda v: f"(NOT regexp_matches({v}, '^[-—－\\d,.\\s￥¥元]+$') AND regexp_matches({v}, '{x.LABEL_WORDS}'))"
_AFTER = lambda v: f"coalesce(list_filter(list_transform(labels, lambda w: CASE WHEN contains({v}, w) THEN trim(regexp_replace(substr({v}, strpos({v}, w) + length(w)), '^[：:\\s\\-]+', '')) ELSE '' END), lambda z: z <> '')[1], '')"


def _values_sql(fields: list[tuple[str, str, list[str]]], grid: str = "g", tag: str = "") -> str:
    """Common table expressions that end in best(table_id, field, value, score)."""
    known = ", ".join(f"('{n}', '{k}', ['" + "', '".join(w) + "'])" for n, k, w in fields)
    amount = f"""CASE WHEN a = '' OR {_DATE_LIKE('a')} THEN '' WHEN regexp_matches(a, '^[-—－]+$') THEN '0' WHEN {_ID_LIKE('a')} OR {_DATE_LIKE("regexp_extract(a, '-?\\d[\\d,.]*')")} THEN '' ELSE regexp_extract(a, '-?\\d[\\d,.]*') END"""
    return f"""f{tag}(field, kind, labels) AS (VALUES {known}),
    c1{tag} AS (SELECT table_id, grid, unnest(range(1, len(grid) + 1)) AS r FROM {grid}), c2{tag} AS (SELECT *, grid[r] AS line, unnest(range(1, len(grid[r]) + 1)) AS c FROM c1{tag}),
    c3{tag} AS (SELECT *, line[c] AS cell, grid[r + 1] AS below FROM c2{tag} WHERE regexp_matches(line[c], '[\\x{{4e00}}-\\x{{9fa5}}]')),
    w1{tag} AS (SELECT cell, {_label_sql('cell')} AS label FROM (SELECT DISTINCT cell FROM c3{tag})), w2{tag} AS (SELECT w1{tag}.*, f{tag}.*, unnest(range(1, len(labels) + 1)) AS i FROM w1{tag}, f{tag}),
    w3{tag} AS (SELECT *, {_label_sql('labels[i]')} AS target FROM w2{tag}), w4{tag} AS (SELECT cell, field, min(i) AS i FROM w3{tag} WHERE {_match_sql('label', 'target')} GROUP BY 1, 2),
    w5{tag} AS (SELECT w3{tag}.* FROM w3{tag} JOIN w4{tag} USING (cell, field, i)),
    p1{tag} AS (SELECT table_id, r, c, field, kind, labels, label, target, unnest([{{'raw': {_AFTER('cell')}, 'source': 'inline', 'step': 0}}, {{'raw': line[c + 1], 'source': 'right', 'step': 1}}, {{'raw': line[c + 2], 'source': 'right', 'step': 2}},
        {{'raw': below[c], 'source': 'below', 'step': 0}}, {{'raw': below[c + 1], 'source': 'below', 'step': 1}}, {{'raw': below[c + 2], 'source': 'below', 'step': 2}}]) AS q FROM c3{tag} JOIN w5{tag} USING (cell)),
    p2{tag} AS (SELECT *, q.raw AS raw, q.source AS source, q.step AS step, unnest(range(1, len(string_split(q.raw, chr(10))) + 1)) AS ln FROM p1{tag} WHERE coalesce(q.raw, '') <> ''),
    p3{tag} AS (SELECT *, string_split(raw, chr(10))[ln] AS part FROM p2{tag}), p4{tag} AS (SELECT *, CASE WHEN {_AFTER('part')} <> '' THEN {_AFTER('part')} ELSE trim(part) END AS txt FROM p3{tag}),
    p5{tag} AS (SELECT *, regexp_replace(trim(txt), '[￥¥元]', '', 'g') AS a, regexp_extract(trim(txt), '\\d{{4}}[.\\-/年]\\d{{1,2}}[.\\-/月]\\d{{1,2}}日?') AS dt FROM p4{tag} WHERE txt <> '' AND len(list_filter(labels, lambda w: contains(txt, w))) = 0),
    p6{tag} AS (SELECT *, CASE kind WHEN 'date' THEN CASE WHEN dt <> '' THEN replace(regexp_replace(dt, '年|月', '.', 'g'), '日', '') ELSE regexp_extract(trim(txt), '^(?:[1-9]|[12][0-9]|3[01])$') END
        WHEN 'amount' THEN CASE WHEN {_LABEL_LIKE('txt')} THEN '' ELSE {amount} END ELSE CASE WHEN {_LABEL_LIKE('txt')} THEN '' ELSE txt END END AS value FROM p5{tag}),
    p7{tag} AS (SELECT *, row_number() OVER (PARTITION BY table_id, r, c, field, source, step ORDER BY ln) AS nth FROM p6{tag} WHERE value <> ''),
    p8{tag} AS (SELECT *, regexp_replace(raw, '\\s+', '', 'g') AS plain, CASE WHEN label = target THEN 120 ELSE 80 END + CASE WHEN contains(label, target) THEN 20 ELSE 0 END + CASE WHEN source = 'inline' THEN 18 WHEN source = 'right' THEN -6 WHEN step = 0 THEN 54 ELSE 0 END
        + CASE WHEN step = 0 THEN 8 WHEN step > 1 THEN -8 ELSE 0 END AS base FROM p7{tag} WHERE nth = 1),
    p9{tag} AS (SELECT *, CASE WHEN kind = 'amount' AND ({_ID_LIKE('plain')} OR regexp_matches(plain, '授信协议标识|账户标识|协议标识') OR regexp_matches(plain, '^[A-Za-z]')) THEN 0 WHEN kind = 'amount' THEN base + CASE WHEN regexp_matches(label, '账户授信额度|授信额度') THEN 40 ELSE 0 END
        + CASE WHEN regexp_matches(label, '金额|额度|余额|还款') THEN 12 ELSE 0 END + CASE WHEN regexp_matches(raw, '元|￥|¥|,') THEN 8 ELSE 0 END - CASE WHEN regexp_matches(value, '^[0-9]{{1,2}}$') THEN 20 ELSE 0 END
        WHEN kind = 'date' AND {_DATE_LIKE('value')} THEN base + 20 ELSE base END AS score FROM p8{tag}),
    best{tag} AS (SELECT table_id, field, value, score::INT AS score FROM (SELECT *, row_number() OVER (PARTITION BY table_id, field ORDER BY score DESC, r, c, step, (source = 'right')::INT DESC) AS rank FROM p9{tag} WHERE score > 0) WHERE rank = 1)"""


def _wide_sql(fields: list[tuple[str, str, list[str]]], best: str = "best") -> str:
    return ", ".join(f"coalesce(max(CASE WHEN field = '{n}' THEN value END), '') AS {n}" for n, _, _ in fields)


_NUMBER = "coalesce(TRY_CAST(replace(regexp_replace(string_split({0}, chr(10))[1], '\\.(\\d{{3}})$', '\\1'), ',', '') AS DOUBLE), 0)".format


_CELLS = [c for grid in (LOAN_GRID, CARD_GRID) for row in (grid[0], grid[2]) for c in row]


@query(f"""WITH g AS (SELECT [[{', '.join(_CELLS)}]] AS grid FROM ({_KEYS})), c AS (SELECT DISTINCT unnest(grid[1]) AS cell FROM g), n AS (SELECT cell, {_label_sql('cell')} AS v FROM c),
    l(word) AS (VALUES {', '.join(f"('{w}')" for w in sorted({w for _, _, own in x.LOAN_FIELDS + x.CARD_FIELDS for w in own}))}), m AS (SELECT *, {_label_sql('word')} AS tgt FROM l)
    SELECT cell, word, {_match_sql('v', 'tgt')} AS matches FROM n, m""")
def q_label_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = sorted({w for _, _, own in x.LOAN_FIELDS + x.CARD_FIELDS for w in own})
    cells = _tables(spark, sf_dir, [_CELLS]).select(F.explode(F.get("grid", F.lit(0))).alias("cell")).distinct()
    pairs = cells.select("cell", x.normal_label(F.col("cell")).alias("v"), F.explode(F.array(*map(F.lit, words))).alias("word"))
    return pairs.select("cell", "word", x.label_matches(F.col("v"), x.normal_label(F.col("word"))).alias("matches"))


@query(f"WITH {_LOAN_CTE}, {_values_sql(x.LOAN_FIELDS)} SELECT table_id, field, value, score FROM best")
def q_label_value_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.find_values(_tables(spark, sf_dir, LOAN_GRID, _LOANS), x.LOAN_FIELDS)


_STATUS = "coalesce(nullif(regexp_extract({0}, '逾期|结清|销户|正常|未激活|呆账|冻结|止付'), ''), '')".format


@query(f"""WITH {_LOAN_CTE}, {_values_sql(x.LOAN_FIELDS)}, w AS (SELECT table_id, {_wide_sql(x.LOAN_FIELDS)} FROM g LEFT JOIN best USING (table_id) GROUP BY 1),
    s AS (SELECT * REPLACE (coalesce(nullif({_STATUS('status')}, ''), '结清') AS status, {_NUMBER('amount')} AS amount) FROM w), o AS (SELECT *, NOT regexp_matches(status, '结清|销户') AS open FROM s)
    SELECT table_id, org, open_date, nullif(end_date, '') AS end_date, amount, currency, business_type, guarantee_type, nullif({_NUMBER('terms')}, 0) AS terms, repay_method, status, nullif(five_category, '') AS five_category,
        CASE WHEN open THEN {_NUMBER('balance')} END AS balance, CASE WHEN open THEN nullif({_NUMBER('remain_terms')}, 0) END AS remain_terms, CASE WHEN open THEN {_NUMBER('monthly_payment')} END AS monthly_payment,
        CASE WHEN open THEN nullif(due_date, '') END AS due_date, CASE WHEN open THEN {_NUMBER('actual_payment')} END AS actual_payment, CASE WHEN open THEN nullif({_NUMBER('overdue_terms')}, 0) END AS overdue_terms,
        CASE WHEN open THEN nullif({_NUMBER('overdue_amount')}, 0) END AS overdue_amount FROM o WHERE trim(org) <> '' OR amount > 0""")
def q_loan_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.extract_loans(_tables(spark, sf_dir, LOAN_GRID, _LOANS))


_ORG_LIKE = lambda v: f"(length({v}) >= 4 AND NOT regexp_matches({v}, '{x.NOT_AN_ORG}') AND NOT regexp_matches({v}, '^[A-Za-z0-9\\s.,\\-]+$') AND NOT {_DATE_LIKE(v)} AND regexp_matches({v}, '{x.ORG_WORDS}'))"


@query(f"""WITH {_CARD_CTE}, {_values_sql(x.CARD_FIELDS)}, w AS (SELECT table_id, any_value(list_filter(flatten(grid[1:3]), lambda v: v <> '')) AS cells, {_wide_sql(x.CARD_FIELDS)} FROM g LEFT JOIN best USING (table_id) GROUP BY 1),
    n AS (SELECT *, coalesce(list_filter(cells, lambda v: {_ORG_LIKE('v')})[1], '') AS org1, coalesce(list_filter(list_transform(cells, lambda v: regexp_extract(v, '\\d{{4}}[.\\-/年]\\d{{1,2}}[.\\-/月]\\d{{1,2}}日?')), lambda v: v <> '')[1], '') AS day1,
        coalesce(list_filter(list_transform(cells, lambda v: regexp_extract(v, '(?i)[A-Z][A-Z0-9][A-Z0-9\\s.\\-]{{8,}}')), lambda v: v <> '')[1], '') AS id1, {_NUMBER('credit_limit')} AS lim,
        coalesce(list_max(list_transform(cells, lambda v: CASE WHEN regexp_matches(v, '[A-Za-z]') OR {_DATE_LIKE('v')} THEN 0 ELSE {_NUMBER("regexp_extract(v, '[0-9][0-9,.]*')")} END)), 0) AS lim1, regexp_matches(currency, '美元|外币') AS foreign_ FROM w),
    s AS (SELECT *, CASE WHEN foreign_ THEN '其他' ELSE {_STATUS('status')} END AS state, NOT foreign_ AND NOT regexp_matches({_STATUS('status')}, '销户|未激活|结清|其他') AS active,
        CASE WHEN {_ORG_LIKE('org')} THEN org WHEN org1 <> '' THEN org1 WHEN NOT {_DATE_LIKE('org')} AND length(regexp_replace(org, '[^A-Za-z0-9]', '', 'g')) >= 8 THEN '' ELSE org END AS org2,
        CASE WHEN NOT {_DATE_LIKE('account_id')} AND length(regexp_replace(account_id, '[^A-Za-z0-9]', '', 'g')) >= 8 THEN account_id ELSE id1 END AS id2, CASE WHEN lim = 0 OR (lim < 100 AND lim1 > lim) THEN lim1 ELSE lim END AS lim2 FROM n)
    SELECT table_id, org2 AS org, id2 AS account_id, CASE WHEN open_date <> '' THEN open_date ELSE day1 END AS open_date, lim2::DOUBLE AS credit_limit, CASE WHEN shared_limit <> '' THEN {_NUMBER('shared_limit')} END AS shared_limit, currency, state AS status,
        CASE WHEN active AND used_amount <> '' THEN {_NUMBER('used_amount')} END AS used_amount, CASE WHEN active THEN nullif(bill_date, '') END AS bill_date, CASE WHEN active AND monthly_payment <> '' THEN {_NUMBER('monthly_payment')} END AS monthly_payment,
        CASE WHEN active AND actual_payment <> '' THEN {_NUMBER('actual_payment')} END AS actual_payment FROM s
    WHERE (trim(org2) <> '' OR length(regexp_replace(id2, '[^A-Za-z0-9]', '', 'g')) >= 8) AND (lim2 > 0 OR (active AND used_amount <> '') OR state <> '')""")
def q_card_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.extract_cards(_tables(spark, sf_dir, CARD_GRID, _CARDS))


_CARD_BRIEF = [(n, k, x.CARD_BRIEF.get(n, w)) for n, k, w in x.BRIEF_FIELDS]
_BRIEF_COLUMNS = ", ".join(n for n, _, _ in x.BRIEF_FIELDS)
_LOAN_KINDS = "CASE k % 3 WHEN 0 THEN 'nonRevolvingLoan' WHEN 1 THEN 'revolvingLoan1' ELSE 'revolvingLoan2' END"


@query(f"""WITH o AS ({_KEYS}), g AS (SELECT k AS table_id, {_LOAN_KINDS} AS category, {_sql_grid(LOAN_GRID)} AS grid FROM o WHERE {_LOANS} AND k % 8 <> 0), h AS (SELECT k AS table_id, 'creditCard' AS category, {_sql_grid(CARD_GRID)} AS grid FROM o WHERE {_CARDS} AND k % 8 <> 0),
    {_values_sql(x.BRIEF_FIELDS)}, {_values_sql(_CARD_BRIEF, 'h', '_h')}, a AS (SELECT table_id, category, {_wide_sql(x.BRIEF_FIELDS)} FROM g LEFT JOIN best USING (table_id) GROUP BY 1, 2 UNION ALL SELECT table_id, category, {_wide_sql(_CARD_BRIEF)} FROM h LEFT JOIN best_h USING (table_id) GROUP BY 1, 2)
    SELECT table_id, category, org, open_date, status, {_NUMBER('credit_amount')} AS credit_amount, {_NUMBER('balance')} AS balance, CASE WHEN regexp_matches(status, '结清|销户') THEN 0 ELSE {_NUMBER('monthly_payment')} END AS monthly_payment,
        CASE category {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in x.CATEGORY_LABELS.items())} END AS category_label, regexp_matches(status, '结清|销户') AS is_closed FROM a""")
def q_account_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.read(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "CAST(floor(o_totalprice) AS BIGINT) AS p", "o_orderpriority")
    rows = rows.repartition(spark.sparkContext.defaultParallelism)  # narrow keys are dealt out before each grows into a table
    card = F.expr(_CARDS)
    return x.account_briefs(rows.select(
        F.col("k").alias("table_id"), F.when(card, "creditCard").otherwise(F.expr(_LOAN_KINDS)).alias("category"), (F.col("k") % 8 == 0).alias("is_summary"),
        F.when(card, F.expr(_spark_grid(CARD_GRID))).otherwise(F.expr(_spark_grid(LOAN_GRID))).alias("grid")))


#: A table's texts for its category: before it, headers, rows; some misread, some only in later rows.
_BEFORE = _one_of(1, "", "", "", "循环贷账户 二 账户3", "非循环 贷账户", "贷记■卡账户", "授信协议信息", "非循环贷账户")
_HEADERS = [_one_of(3, "管利机构", "管理机构", "发卡机构", "卡 构 机构", "责任人类型", "机构", "管机构"), _one_of(5, "僧款金额", "账户授信额度", "余额", "投信额度", "授销 额度", "账户 信用额度")]
_BODY = [[_one_of(2, "甲", "循环贷账户一", "受信额度"), "'1'"], [_one_of(7, "循环贷账户二", "乙"), _one_of(3, "2", "卡机构")], ["'丙'", _one_of(4, "账单日", "3", "3")], ["'丁'", _one_of(9, "管理机构", "4")], [_one_of(6, "账户授信额度", "5"), "'借款金额'"], ["'己'", "'6'"], ["'庚'", "'相关还款责任信息'"]]
_NOW, _PLACE = _one_of(2, "creditCard", "nonRevolvingLoan", "none"), _one_of(7, "revolvingLoan1", "none")
_PLAIN = lambda text: f"replace(replace(replace(regexp_replace(regexp_replace({text}, '\\s+', '', 'g'), '[■□�]', '', 'g'), '管利', '管理'), '管机', '管理机'), '僧款', '借款')"


@query(f"""WITH b AS (SELECT k, {_BEFORE} AS bef, [{', '.join(_HEADERS)}] AS hd, {_sql_grid(_BODY)} AS rw, nullif({_NOW}, 'none') AS now, nullif({_PLACE}, 'none') AS place FROM ({_KEYS})),
    r AS (SELECT *, array_to_string([bef] || hd || flatten(rw[1:6]), ' ') AS txt, {_PLAIN("array_to_string([bef] || hd || flatten(rw[1:2]), ' ')")} AS nm, {_PLAIN("array_to_string(hd || flatten(rw[1:2]), ' ')")} AS mn FROM b),
    i AS (SELECT *, CASE WHEN contains(txt, '相关还款责任信息') OR contains(txt, '还款责任金额') OR contains(txt, '责任人类型') OR contains(txt, '主业务借款人') THEN 'repayResponsibility'
        WHEN contains(txt, '授信协议信息') OR contains(txt, '授信协议标识') OR contains(txt, '授信额度用途') THEN 'creditAgreement' WHEN contains(txt, '贷记卡账户') OR contains(txt, '发卡机构') OR contains(txt, '卡机构') OR contains(txt, '账单日') THEN 'creditCard'
        WHEN contains(txt, '循环贷账户二') THEN 'revolvingLoan2' WHEN contains(txt, '循环贷账户一') THEN 'revolvingLoan1' WHEN contains(txt, '非循环贷账户') THEN 'nonRevolvingLoan'
        WHEN contains(txt, '管理机构') AND contains(txt, '账户授信额度') THEN 'revolvingLoan2' WHEN contains(txt, '管理机构') AND contains(txt, '借款金额') THEN 'nonRevolvingLoan' END AS inferred,
        contains(mn, '管理机构') OR (contains(mn, '管') AND contains(mn, '机构')) AS manager, contains(mn, '发卡机构') OR contains(mn, '卡机构') OR (contains(mn, '卡') AND contains(mn, '机构')) AS issuer,
        contains(mn, '授信额度') OR contains(mn, '投信额度') OR contains(mn, '受信额度') OR contains(mn, '授销额度') OR (contains(mn, '账户') AND contains(mn, '额度')) AS lim FROM r)
    SELECT k, inferred, CASE WHEN inferred IS NOT NULL AND inferred IS DISTINCT FROM now AND (contains(nm, CASE inferred {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in x.CATEGORY_LABELS.items())} END)
        OR (inferred = 'revolvingLoan2' AND manager AND lim) OR (inferred = 'creditCard' AND issuer AND lim)
        OR (inferred = 'repayResponsibility' AND (contains(mn, '还款责任') OR contains(mn, '责任人类型'))) OR (inferred = 'creditAgreement' AND (contains(mn, '授信协议') OR contains(mn, '授信额度用途'))))
        THEN inferred ELSE coalesce(place, now, inferred) END AS category FROM i""")
def q_category_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    spell = lambda e: F.expr(e.replace("//", "DIV"))
    rows = t.read(spark, sf_dir, "orders").selectExpr("o_orderkey AS k").select(
        "k", spell(_BEFORE).alias("before"), F.array(*map(spell, _HEADERS)).alias("headers"), F.expr(_spark_grid(_BODY)).alias("rows"), F.nullif(spell(_NOW), F.lit("none")).alias("now"), F.nullif(spell(_PLACE), F.lit("none")).alias("place"))
    parts = [F.col(c) for c in ("before", "headers", "rows")]
    return rows.select("k", x.infer_category(x.category_text(*parts)).alias("inferred"), x.choose_category(*parts, F.col("now"), F.col("place")).alias("category"))


_PIECE = "CASE WHEN n % 3 = 0 THEN {0}({0}('管理机构', '余额'), {0}(CAST(part AS STRING), CAST(supp AS STRING))) WHEN n % 3 = 1 THEN {0}({0}('状态', '日期'), {0}('正常', CAST(n AS STRING))) ELSE {0}({0}('管理机构', '余额'), {0}(CAST(supp AS STRING), '7'), {0}('合计', CAST(n AS STRING))) END"


@query(f"""WITH l AS (SELECT l_orderkey AS segment_id, l_linenumber AS n, l_partkey AS part, l_suppkey AS supp FROM lineitem), q AS (SELECT DISTINCT segment_id, n, part, supp, {_PIECE.format('list_value')} AS grid FROM l),
    o AS (SELECT segment_id, list(grid ORDER BY n, part, supp) AS p FROM q GROUP BY 1)
    SELECT segment_id, array_to_string(list_transform(list_reduce(p, lambda a, b: CASE WHEN len(a) >= 2 AND len(a) = len(b) AND regexp_replace(array_to_string(a[1], ''), '\\s+', '', 'g') <> regexp_replace(array_to_string(b[1], ''), '\\s+', '', 'g')
        THEN list_transform(range(1, len(a) + 1), lambda i: list_concat(a[i], b[i])) WHEN regexp_replace(array_to_string(a[1], ''), '\\s+', '', 'g') = regexp_replace(array_to_string(b[1], ''), '\\s+', '', 'g') THEN list_concat(a, b[2:]) ELSE list_concat(a, b) END),
        lambda w: array_to_string(w, '|')), chr(10)) AS merged FROM o""")
def q_segment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS segment_id", "l_linenumber AS n", "l_partkey AS part", "l_suppkey AS supp").distinct()
    merged = x.merge_segment(rows.select("segment_id", F.struct("n", "part", "supp").alias("ord"), F.expr(_PIECE.format("array")).alias("grid")))
    return merged.select("segment_id", F.array_join(F.transform("grid", lambda w: F.array_join(w, "|")), "\n").alias("merged"))


#: Modules with their field, label and field of derived figures.
_MODULES = [
    ("header", "header", "报告基本信息", None), ("loan", "creditDetail.nonRevolvingLoans", "非循环贷账户", "accountDerived.nonRevolvingLoan"), ("card", "creditDetail.creditCards", "贷记卡账户", "accountDerived.creditCard"), ("agreement", "creditAgreements", "授信协议信息", None)]
_HEADS = ["报告编号", "管理机构 余额", "发卡机构 额度", "状态 日期"]


@query(f"""WITH m(i, module, field, label, derived) AS (VALUES {', '.join(f"({i}, '{a}', '{b}', '{c}', {'NULL' if d is None else repr(d)})" for i, (a, b, c, d) in enumerate(_MODULES))}),
    r AS (SELECT o_custkey AS report_id, o_orderkey AS ord, m.*, (o_orderkey % 30)::INT AS page, (o_orderkey % 60)::INT AS logical_page, (o_orderkey % 97)::DOUBLE AS y, '账户' || (o_orderkey % 9) AS preceding, {_one_of(3, *_HEADS).replace('k //', 'o_orderkey //')} AS headers FROM orders JOIN m ON m.i = o_orderkey % 4),
    n AS (SELECT *, row_number() OVER (PARTITION BY report_id, module ORDER BY ord) AS k FROM r), s AS (SELECT *, row_number() OVER (PARTITION BY report_id, module ORDER BY ord) AS k FROM r WHERE regexp_matches(headers, '管理机构|发卡机构|还款责任金额|授信协议标识'))
    SELECT report_id, page, logical_page, y, preceding, field, label, 'doc-table' AS source, 0.85::DOUBLE AS confidence FROM n WHERE k = 1 UNION ALL
    SELECT report_id, page, logical_page, y, preceding, derived, label || '汇总反算', 'derived', 0.8::DOUBLE FROM n WHERE k = 1 AND derived IS NOT NULL UNION ALL
    SELECT report_id, page, logical_page, y, preceding, field || '[' || (k - 1) || '].org', label || '第' || k || '笔机构', 'doc-table', 0.85::DOUBLE FROM s""")
def q_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    kinds = F.array(*[F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(("module", "field", "label", "derived"), m)]) for m in _MODULES])
    heads = F.expr(_one_of(3, *_HEADS).replace("k //", "o_orderkey DIV"))
    rows = t.read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("report_id"), key.alias("ord"), F.element_at(kinds, (key % 4 + 1).cast("int")).alias("m"), (key % 30).cast("int").alias("page"), (key % 60).cast("int").alias("logical_page"),
        (key % 97).cast("double").alias("y"), F.concat(F.lit("账户"), (key % 9).cast("string")).alias("preceding"), heads.alias("headers"))
    return x.provenance(rows.select("*", "m.*").drop("m"))
