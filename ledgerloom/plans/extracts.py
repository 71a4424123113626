"""Registered queries of extraction operators over views of the driver's tables; with SQL for the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import extracts as x
from ledgerloom.plans.papers import _MD, _ORD, _markdown, _ord
from ledgerloom.sources import tables as t

QUERIES, SQL = {}, {}
_TABLES = "b AS (SELECT DISTINCT l_orderkey AS doc_id, " + _ORD + " AS ord FROM lineitem)"


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


def _some(words: list[str], key, step: int, parts: int):
    """Those of ``words`` that a key picks, a space between."""
    return F.concat_ws(" ", *[F.when(key * (k + step) % parts < 2, w) for k, w in enumerate(words)])


def _some_sql(words: list[str], key: str, step: int, parts: int) -> str:
    return "concat_ws(' ', " + ", ".join(f"CASE WHEN {key} * {k + step} % {parts} < 2 THEN '{w}' END" for k, w in enumerate(words)) + ")"


_ANCHORS, _WORDS = [w for _, a, _ in x.MODULES for w in a], [w for _, _, b in x.MODULES for w in b]


def _module_sql() -> str:
    bare = lambda w: re.sub(r"\s|[（）()、，,.:：;；]", "", w)
    many = lambda column, words: " + ".join(f"(length({column}) - length(replace({column}, '{bare(w)}', ''))) // {len(bare(w))}" for w in words)
    each = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS module, {many('a', anchors)} AS na, {many('b', words)} AS nb FROM p" for name, anchors, words in x.MODULES)
    return f"""WITH p AS (SELECT c_custkey AS doc_id, replace({_some_sql(_ANCHORS, 'c_custkey', 2, 7)}, ' ', '') AS a, replace({_some_sql(_WORDS, 'c_custkey', 3, 11)}, ' ', '') AS b FROM customer),
    m AS ({each}) SELECT doc_id, module, (na + nb)::INT AS hits, CASE WHEN na > 0 AND nb > 0 THEN 'mixed' WHEN na > 0 THEN 'anchor' ELSE 'table' END AS source FROM m WHERE na + nb > 0"""


@query(_module_sql())
def q_quality_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return x.recognized_modules(t.read(spark, sf_dir, "customer").select(key.alias("doc_id"), _some(_ANCHORS, key, 2, 7).alias("text"), _some(_WORDS, key, 3, 11).alias("table_text")))


@query(f"""WITH m AS (SELECT c_nationkey AS doc_id, CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE {_MD} END AS md FROM customer)
    SELECT doc_id, count(*) AS tables, sum(CASE WHEN trim(md) = '' THEN 0 ELSE len(list_filter(list_transform(string_split(md, chr(10)), lambda l: trim(l)), lambda l: regexp_matches(l, '^\\|.*\\|$') AND NOT regexp_matches(l, '^\\|[\\s\\-:|]+\\|$'))) END)::BIGINT AS markdown_rows,
        sum((trim(md) = '')::INT)::BIGINT AS empty FROM m GROUP BY 1""")
def q_quality_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _markdown(spark, sf_dir).join(t.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), "c_nationkey"), "doc_id")
    return x.table_summary(rows.select(F.col("c_nationkey").alias("doc_id"), F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.col("markdown")).alias("markdown")))


_SIGNALS = [*x.REPORT_SIGNALS, "授信协议"]
_HAS = lambda words: " + ".join(f"contains(plain, '{w}')::INT" for w in words)


@query(f"""WITH r AS (SELECT *, {_some_sql(_SIGNALS, 'o_orderkey', 3, 9)} || repeat('正文', (o_orderkey % 40)::INT) AS text, o_orderkey % 3 AS details, o_custkey % 4 > 0 AS parsed, o_custkey % 2 AS critical, o_orderkey % 7 < 3 AS review FROM orders),
    f AS (SELECT *, {_HAS(x.REPORT_SIGNALS)} AS found, {_HAS(x.DETAIL_SIGNALS)} AS detail_words FROM (SELECT *, replace(text, ' ', '') AS plain FROM r))
    SELECT o_orderkey AS doc_id, found::INT AS found, CASE WHEN length(trim(text)) < 50 THEN 'scan' WHEN found = 0 OR (found < 3 AND NOT parsed) OR (detail_words > 0 AND details = 0) OR (critical > 0 AND found < 4) OR (review AND details = 0 AND NOT parsed) THEN 'ocr' ELSE 'text' END AS route,
        (o_orderkey % 100) / 100.0 < 0.86 OR (o_custkey % 4 > 0 AND ((o_custkey % 100) / 100.0 < 0.86 OR o_custkey % 2 > 0)) AS enhance FROM f""")
def q_pdf_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    order, cust = F.col("o_orderkey"), F.col("o_custkey")
    text = F.concat(_some(_SIGNALS, order, 3, 9), F.expr("repeat('正文', CAST(o_orderkey % 40 AS INT))"))
    rows = t.read(spark, sf_dir, "orders").select(order, cust, text.alias("text"), (order % 3).alias("details"), (cust % 4 > 0).alias("parsed"), (cust % 2).alias("critical"), (order % 7 < 3).alias("review"))
    image = F.when(cust % 4 > 0, (cust % 100) / 100)
    return x.text_route(rows).select(order.alias("doc_id"), "found", "route", x.try_enhanced((order % 100) / 100, image, cust % 2).alias("enhance"))


@query("""WITH l AS (SELECT conv_id AS doc_id, turn AS line, text, nullif(regexp_extract(trim(text), '[a-z]{9,}', 0), '') AS own FROM conversations),
    n AS (SELECT *, first_value(own IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS nxt, row_number() OVER w AS k FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line, text)),
    a AS (SELECT doc_id, arg_min(nxt, k) FILTER (WHERE regexp_matches(text, '[?]|[A-Z][a-z]+') AND nxt IS NOT NULL) AS value FROM n GROUP BY 1),
    p AS (SELECT conv_id AS doc_id, nullif(regexp_extract(text, '[0-9]{3,}', 0), '') AS one, nullif(regexp_extract(text, '[0-9]+', 0), '') AS two FROM conversations)
    SELECT doc_id, value, count(coalesce(one, two)) AS found, max(CASE WHEN one IS NOT NULL THEN 0.95 WHEN two IS NOT NULL THEN 0.75 ELSE 0 END)::DOUBLE AS confidence FROM p JOIN a USING (doc_id) GROUP BY 1, 2""")
def q_regex_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = t.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("line"), "text")
    value, sure = x.by_patterns(F.col("text"), ["[0-9]{3,}", "[0-9]+"])
    direct = lines.groupBy("doc_id").agg(F.count(value).alias("found"), F.max(sure).alias("confidence"))
    return x.after_label(lines, "[?]|[A-Z][a-z]+", "[a-z]{9,}").join(direct, "doc_id")


_LAYOUTS = f"""{_TABLES}, l AS (SELECT doc_id, ord, ord % 3 = 0 AS is_table, ord % 2 AS page, ord % 7 AS y, ord AS x, ord % 5 = 0 AS blank FROM b)"""


@query(f"""WITH {_LAYOUTS}, p AS (SELECT a.doc_id, a.ord, max_by('t' || c.ord, c.y * 1e12 + c.x) AS preceding FROM l a JOIN l c ON c.doc_id = a.doc_id AND c.page = a.page AND c.y <= a.y AND NOT c.is_table WHERE a.is_table GROUP BY 1, 2)
    SELECT l.doc_id, l.ord, row_number() OVER (PARTITION BY l.doc_id ORDER BY page, y, x)::INT AS place, coalesce(preceding, '') AS preceding, 'h' || l.ord || ',b' AS headers, 1 AS n_rows FROM l LEFT JOIN p ON p.doc_id = l.doc_id AND p.ord = l.ord WHERE is_table AND NOT blank""")
def q_ctx_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    ord_ = F.col("ord")
    rows = t.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), _ord().alias("ord")).distinct()
    layouts = rows.select(
        "doc_id", ord_.alias("layout_id"), F.when(ord_ % 3 == 0, "table").otherwise("text").alias("type"), (ord_ % 2).alias("logical_page"), (ord_ % 7).cast("double").alias("y"),
        ord_.cast("double").alias("x"), "ord", F.concat(F.lit("t"), ord_.cast("string")).alias("text"))
    markdown = F.when(ord_ % 5 == 0, " ").otherwise(F.concat(F.lit("| h"), ord_.cast("string"), F.lit(" | b |\n| --- | --- |\n| 1 | 2 |")))
    return x.context_tables(layouts, rows.filter("ord % 3 = 0").select("doc_id", ord_.alias("layout_id"), markdown.alias("markdown")))


@query(f"""WITH {_TABLES}, a AS (SELECT *, ord % 3 = 0 AS is_header, list_transform(range(ord % 4), lambda i: 'r' || ord || '.' || i) AS rows FROM b),
    n AS (SELECT *, is_header AND len(rows) < 3 AND coalesce(NOT lead(is_header) OVER w, false) AS takes, lead(ord) OVER w AS no, lead(rows) OVER w AS nr FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
    k AS (SELECT *, coalesce(lag(takes) OVER (PARTITION BY doc_id ORDER BY ord), false) AS taken FROM n)
    SELECT doc_id, ord, takes AS merged, array_to_string(CASE WHEN takes THEN list_concat(rows, ['h' || no], nr) ELSE rows END, ',') AS cells FROM k WHERE NOT taken""")
def q_split_lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), _ord().alias("ord")).distinct()
    own = F.expr("IF(ord % 4 = 0, CAST(array() AS array<array<string>>), transform(sequence(0, CAST(ord % 4 AS INT) - 1), i -> array(concat('r', ord, '.', i))))")
    made = x.split_lookahead(rows.select("doc_id", "ord", (F.col("ord") % 3 == 0).alias("is_header"), F.array(F.concat(F.lit("h"), F.col("ord").cast("string"))).alias("headers"), own.alias("rows")), 3)
    return made.select("doc_id", "ord", "merged", F.array_join(F.flatten("rows"), ",").alias("cells"))
