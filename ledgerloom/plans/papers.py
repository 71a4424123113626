"""Registered queries of document operators over views of the driver's tables; with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import share6
from ledgerloom.operators import documents as d
from ledgerloom.sources import tables as t

QUERIES, SQL = {}, {}
#: Order lines repeat their numbers; with part and supplier they are told apart, and views drop what repeats as a whole.
_ORD = "(l_linenumber::BIGINT * 100000000 + l_partkey * 1000 + l_suppkey % 1000)"
TITLES = [("The ", "the"), ("Der ", "der"), ("Los ", "los"), ("Le ", "le")]


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _ord():
    return F.col("l_linenumber").cast("long") * 100000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000


def _lines(spark, sf_dir) -> DataFrame:
    """doc_id, line, text of all documents."""
    return t.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line", "text"))


_LINES = "lines AS (SELECT doc_id, unnest(range(len(l)))::INT AS line, unnest(l) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"


@query("WITH e AS (SELECT vec_id, list_transform(embedding[1:8], lambda v: v::DOUBLE) AS q FROM embeddings) SELECT vec_id, list_min(q[1:7:2]) AS x, list_min(q[2:8:2]) AS y, floor((list_max(q[1:7:2]) - list_min(q[1:7:2])) * 1000000 + 0.5) / 1000000 AS w, floor((list_max(q[2:8:2]) - list_min(q[2:8:2])) * 1000000 + 0.5) / 1000000 AS h FROM e")
def q_pos_to_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = d.bounding_box(F.slice(F.col("embedding").cast("array<double>"), 1, 8))
    return t.read(spark, sf_dir, "embeddings").select("vec_id", box.alias("b")).select("vec_id", F.col("b")[0].alias("x"), F.col("b")[1].alias("y"), share6(F.col("b")[2]).alias("w"), share6(F.col("b")[3]).alias("h"))


@query("""WITH c AS (SELECT l_orderkey AS doc_id, l_linenumber AS cell, l_linenumber % 3 AS r0, l_partkey % 3 AS c0, 1 + l_linenumber % 2 AS rs, 1 + l_suppkey % 2 AS cs FROM lineitem), r AS (SELECT *, unnest(range(r0, r0 + rs)) AS r FROM c), p AS (SELECT *, unnest(range(c0, c0 + cs)) AS c FROM r)
    SELECT doc_id, r::INT AS r, c::BIGINT AS c, max(cell) AS cell FROM p GROUP BY ALL""")
def q_cell_span_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    return d.span_matrix(t.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), n.alias("cell"), (n % 3).alias("row"), (F.col("l_partkey") % 3).alias("col"), (1 + n % 2).alias("row_span"), (1 + F.col("l_suppkey") % 2).alias("col_span")))


@query("""WITH c AS (SELECT DISTINCT conv_id AS doc_id, unnest([0, 1]) AS cell FROM conversations), w AS (SELECT doc_id, cell, unnest([cell + 1, 99, 0]) AS line, unnest([0, 1, 2]) AS place FROM c)
    SELECT c.doc_id, c.cell, coalesce(string_agg(text, chr(10) ORDER BY place), '') AS text FROM c LEFT JOIN w USING (doc_id, cell) LEFT JOIN conversations v ON v.conv_id = w.doc_id AND v.turn = w.line GROUP BY 1, 2""")
def q_line_lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = t.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("line"), "text")
    cells = turns.select("doc_id").distinct().select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("cell")).withColumn("ids", F.array(F.col("cell").cast("long") + 1, F.lit(99).cast("long"), F.lit(0).cast("long")))
    return d.cell_texts(cells, turns)


_MD = "'| 名称 |  余额| 分组 |' || chr(10) || '| --- | :---: | --- |' || chr(10) || '|' || c_name || ' | ' || c_nationkey || ' |' || chr(10) || 'no table' || chr(10) || '| ' || c_mktsegment || ' | | x |'"
_MD_ROWS = f"m AS (SELECT c_custkey AS doc_id, {_MD} AS md FROM customer), rw AS (SELECT doc_id, list_transform(list_filter(list_transform(string_split(md, chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '^\\|.*\\|$') AND NOT regexp_matches(x, '^\\|[\\s\\-:|]+\\|$')), lambda x: list_transform(string_split(x[2:-2], '|'), lambda c: trim(c))) AS rows FROM m)"


def _markdown(spark, sf_dir) -> DataFrame:
    text = F.concat(F.lit("| 名称 |  余额| 分组 |\n| --- | :---: | --- |\n|"), "c_name", F.lit(" | "), F.col("c_nationkey").cast("string"), F.lit(" |\nno table\n| "), "c_mktsegment", F.lit(" | | x |"))
    return t.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), text.alias("markdown"))


@query(f"WITH {_MD_ROWS}, e AS (SELECT doc_id, unnest(range(len(rows)))::INT AS r, unnest(rows) AS cells FROM rw) SELECT doc_id, r, unnest(range(len(cells)))::INT AS c, unnest(cells) AS v FROM e")
def q_md_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.markdown_cells(_markdown(spark, sf_dir))


@query(f"WITH {_MD_ROWS} SELECT doc_id, array_to_string(list_transform(rows[2:], lambda r: coalesce(r[2], '')), ',') AS balances, rows[2][1] AS below FROM rw")
def q_md_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _markdown(spark, sf_dir).withColumn("rows", d.markdown_rows(F.col("markdown")))
    return rows.select("doc_id", F.array_join(d.column_of(F.col("rows"), F.lit("余额")), ",").alias("balances"), d.value_below(F.col("rows"), F.lit("名称")).alias("below"))


@query(f"WITH {_MD_ROWS} SELECT doc_id, '名称' || chr(10) || '余额' || chr(10) || '分组' || chr(10) || rows[2][1] || chr(10) || rows[2][2] || chr(10) || rows[3][1] || chr(10) || 'x' AS text FROM rw")
def q_doc_fulltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _markdown(spark, sf_dir).select("doc_id", d.plain_lines(F.col("markdown")).alias("text"))


@query("""SELECT page_id, '| 项目 | 项目 | 值 |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || page_id || ' | ' || regexp_replace(url, '^https?://', '') || ' |' AS md FROM pages""")
def q_html_table_to_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages holds no tables, so they are built around its ids and addresses."""
    html = F.concat(F.lit('<table border="1"><tr><th colspan="2">项目</th><th>值</th></tr><TR><td rowspan=2>'), F.col("page_id").cast("string"), F.lit("</td><td><b>"), F.regexp_replace("url", "^https?://", ""), F.lit("</b></td></TR><tr></tr></table>"))
    return t.read(spark, sf_dir, "pages").select("page_id", d.html_to_markdown(html).alias("md"))


@query("""WITH o AS (SELECT *, conv_id % 50 AS set_id, dense_rank() OVER (PARTITION BY conv_id % 50 ORDER BY conv_id) AS k, row_number() OVER (PARTITION BY conv_id % 50 ORDER BY conv_id, turn) - 1 AS p FROM conversations)
    SELECT set_id, p::INT AS page_num, 'img' || k || ':p' || turn AS page_id, text FROM o""")
def q_doc_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.read(spark, sf_dir, "conversations").select((F.col("conv_id") % 50).alias("set_id"), F.col("conv_id").alias("doc_ord"), F.col("turn").alias("page_num"), F.concat(F.lit("p"), F.col("turn").cast("string")).alias("page_id"), "text")
    return d.merge_documents(rows)


_PAGES = f"pg AS (SELECT DISTINCT l_orderkey AS doc_id, {_ORD} AS page_num, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE ((l_partkey % 9) + 1)::INT END AS number, ((l_suppkey % 3) + 9)::INT AS total FROM lineitem)"


def _pages(spark, sf_dir) -> DataFrame:
    marked = lambda number: F.when(F.col("l_partkey") % 5 != 0, number)
    rows = t.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), _ord().alias("page_num"), marked(F.col("l_partkey") % 9 + 1).alias("n"), marked(F.col("l_suppkey") % 3 + 9).alias("of"))
    text = F.concat(F.lit("正文 第"), F.col("n").cast("string"), F.lit("页， 共"), F.col("of").cast("string"), F.lit("页"))
    return t.distinct_by(rows, "doc_id").select("doc_id", "page_num", F.coalesce(text, F.lit("正文")).alias("text"))  # numbers tell texts apart


@query(f"""WITH {_PAGES}, a AS (SELECT *, number < last_value(number IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS falls, count(number) OVER (PARTITION BY doc_id) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM pg),
    b AS (SELECT *, coalesce(bool_or(falls) OVER (PARTITION BY doc_id), false) AND k >= n / 2 AND n > 1 AS moved FROM a)
    SELECT doc_id, page_num, number, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN moved AND number IS NULL THEN 1 ELSE 0 END, CASE WHEN moved THEN coalesce(number, 0) ELSE 0 END, page_num)::INT AS place FROM b""")
def q_page_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.reorder_pages(_pages(spark, sf_dir))


@query(f"""WITH {_PAGES}, g AS (SELECT doc_id, list_sort(list_distinct(list(number))) AS have, max(total) AS total FROM pg WHERE number IS NOT NULL GROUP BY 1)
    SELECT doc_id, array_to_string(have, ',') AS found, total, array_to_string(list_filter(range(1, total + 1), lambda x: NOT list_contains(have, x)), ',') AS missing FROM g""")
def q_missing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.missing_pages(_pages(spark, sf_dir))


def _places(spark, sf_dir) -> DataFrame:
    return t.read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), _ord().alias("ord"), (F.col("l_linenumber") % 2).alias("logical_page"), (F.col("l_partkey") % 100).cast("double").alias("y"), F.col("l_suppkey").cast("double").alias("x"),
        F.concat(F.lit("t"), F.col("l_partkey").cast("string")).alias("text"), F.col("l_returnflag")).distinct()


_PLACES = f"pl AS (SELECT DISTINCT l_orderkey AS doc_id, {_ORD} AS ord, l_linenumber % 2 AS logical_page, (l_partkey % 100)::DOUBLE AS y, l_suppkey::DOUBLE AS x, 't' || l_partkey AS text, l_returnflag FROM lineitem)"


@query(f"WITH {_PLACES} SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY logical_page, y, x, ord)::INT AS place FROM pl")
def q_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.reading_order(_places(spark, sf_dir)).select("doc_id", "ord", "place")


@query(f"WITH {_PLACES} SELECT a.doc_id, a.ord, coalesce(arg_max(b.text, struct_pack(y := b.y, x := b.x)), '') AS preceding FROM pl a LEFT JOIN pl b ON a.doc_id = b.doc_id AND a.logical_page = b.logical_page AND b.y <= a.y AND b.l_returnflag <> 'R' WHERE a.l_returnflag = 'R' GROUP BY 1, 2")
def q_preceding_text_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _places(spark, sf_dir)
    return d.preceding_text(rows.filter("l_returnflag <> 'R'"), rows.filter("l_returnflag = 'R'"))


@query(f"WITH {_PLACES} SELECT a.doc_id, a.ord, arg_max(b.text, struct_pack(p := b.logical_page, y := b.y, t := b.text)) AS section FROM pl a LEFT JOIN pl b ON a.doc_id = b.doc_id AND (b.logical_page < a.logical_page OR (b.logical_page = a.logical_page AND b.y <= a.y)) AND b.l_returnflag = 'A' WHERE a.l_returnflag = 'N' GROUP BY 1, 2")
def q_interval_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _places(spark, sf_dir).withColumnRenamed("logical_page", "page")
    return d.section_of(rows.filter("l_returnflag = 'A'").withColumnRenamed("text", "section"), rows.filter("l_returnflag = 'N'"))


_MAP = f"""{_LINES}, h AS ({" UNION ALL ".join(f"SELECT doc_id, line, '{n}' AS section FROM lines WHERE contains(text, '{x}')" for x, n in TITLES)}), st AS (SELECT doc_id, section, min(line) AS start FROM h GROUP BY 1, 2),
    mp AS (SELECT *, lead(start) OVER (PARTITION BY doc_id ORDER BY start, section) - 1 AS "end" FROM st)"""


@query(f'WITH {_MAP} SELECT doc_id, section, start, "end" FROM mp')
def q_section_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.section_map(_lines(spark, sf_dir), TITLES)


@query(f"WITH {_MAP}, a AS (SELECT l.doc_id, l.line, arg_max(m.section, struct_pack(s := m.start, n := m.section)) AS section FROM lines l JOIN mp m ON m.doc_id = l.doc_id AND m.start <= l.line GROUP BY 1, 2) SELECT doc_id, section, count(*) AS lines FROM a GROUP BY 1, 2")
def q_block_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return d.lines_in(d.section_map(lines, TITLES), lines).groupBy("doc_id", "section").agg(F.count("*").alias("lines"))


@query(f"WITH {_MAP}, a AS (SELECT l.doc_id, l.line, l.text, arg_max(m.section, struct_pack(s := m.start, n := m.section)) AS section FROM lines l JOIN mp m ON m.doc_id = l.doc_id AND m.start <= l.line GROUP BY 1, 2, 3) SELECT doc_id, section, line FROM a WHERE regexp_matches(text, '[0-9]{{4,}}')")
def q_section_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    placed = d.lines_in(d.section_map(lines, TITLES), lines).withColumn("line", F.col("ord").cast("int"))
    return placed.join(lines.filter(F.col("text").rlike("[0-9]{4,}")), ["doc_id", "line"]).select("doc_id", "section", "line")


@query(f"WITH {_LINES}, h AS (SELECT doc_id, unnest(regexp_extract_all(text, '([0-9]{{3}})[0-9]+', 1)) AS n FROM lines) SELECT doc_id, count(DISTINCT n) AS accounts FROM h GROUP BY 1")
def q_section_account_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.account_numbers(_lines(spark, sf_dir), "([0-9]{3})[0-9]+")


@query(f"""WITH {_LINES}, n AS (SELECT *, CASE {" ".join(f"WHEN contains(text, '{x}') THEN '{k}'" for x, k in TITLES)} END AS name FROM lines WHERE trim(text) <> ''), p AS (SELECT *, sum((name IS NOT NULL)::INT) OVER (PARTITION BY doc_id ORDER BY line) AS part FROM n)
    SELECT doc_id, part::BIGINT AS part, coalesce(max(name), 'unknown') AS name, min(line) AS start, sha256(coalesce(string_agg(CASE WHEN name IS NULL THEN trim(text) END, chr(10) ORDER BY line), '')) AS content FROM p GROUP BY 1, 2""")
def q_section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.split_sections(_lines(spark, sf_dir), TITLES).withColumn("content", F.sha2("content", 256))


_BEFORE = ["", "账户3", "", "(一)身份信息", "授信协议2", "查询记录明细", "其他说明", "非循环贷账户", "本人版"]
_HEADS = ["性别 出生日期", "查询机构 原因", "管理机构 借款金额", "配偶姓名"]
_TABLES = f"tb AS (SELECT DISTINCT l_orderkey AS doc_id, {_ORD} AS ord, ['{"', '".join(_BEFORE)}'][(l_partkey % 9 + 1)::INT] AS preceding, ['{"', '".join(_HEADS)}'][(l_suppkey % 4 + 1)::INT] AS head, ['余额', '姓名'][(l_partkey % 2 + 1)::INT] AS first_column FROM lineitem)"


def _tables(spark, sf_dir) -> DataFrame:
    one = lambda values, key: F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))
    return t.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), _ord().alias("ord"), one(_BEFORE, "l_partkey").alias("preceding"), one(_HEADS, "l_suppkey").alias("head"), one(["余额", "姓名"], "l_partkey").alias("first_column")).distinct()


@query(f"""WITH {_TABLES}, o AS (SELECT *, CASE WHEN preceding = '' THEN NULL {" ".join(f"WHEN regexp_matches(preceding, '{p}') THEN '{b}'" for p, b in d.TABLE_RULES)}
    {" ".join(f"WHEN contains(head, '{one[0]}') OR (contains(head, '{other[0]}') AND contains(head, '{other[-1]}')) THEN '{b}'" for b, one, other in d.HEADER_RULES)} ELSE 'unclassified' END AS own FROM tb)
    SELECT doc_id, ord, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'unclassified') AS bucket FROM o""")
def q_table_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.classify_tables(_tables(spark, sf_dir))


@query(f"""WITH {_TABLES}, k AS (SELECT *, CASE WHEN contains(preceding, '账户') THEN 0 WHEN contains(head, '账户') THEN 1 WHEN contains(first_column, '账户') THEN 2 END AS rank FROM tb)
    SELECT doc_id, arg_min(ord, struct_pack(r := rank, o := ord)) AS ord, min(rank) AS rank FROM k WHERE rank IS NOT NULL GROUP BY 1""")
def q_keyword_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.keyword_table(_tables(spark, sf_dir), "账户")


@query("""WITH RECURSIVE w AS (SELECT l_orderkey AS doc_id, (l_partkey % 40)::DOUBLE AS y, l_suppkey::DOUBLE AS x, (10 + l_linenumber)::DOUBLE AS h, l_linenumber::VARCHAR AS text FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y, x, h, text) AS k FROM w),
    f AS (SELECT doc_id, k, 0 AS "row", y, h, x, text FROM k WHERE k = 1 UNION ALL SELECT k.doc_id, k.k, CASE WHEN abs(f.y - k.y) <= least(f.h, k.h) * 0.5 THEN f."row" ELSE f."row" + 1 END, CASE WHEN abs(f.y - k.y) <= least(f.h, k.h) * 0.5 THEN f.y ELSE k.y END, CASE WHEN abs(f.y - k.y) <= least(f.h, k.h) * 0.5 THEN f.h ELSE k.h END, k.x, k.text FROM f JOIN k ON k.doc_id = f.doc_id AND k.k = f.k + 1)
    SELECT doc_id, "row", string_agg(text, chr(9) ORDER BY x, text) AS text FROM f GROUP BY 1, 2""")
def q_row_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words at invented places, folded into rows."""
    rows = t.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 40).cast("double").alias("top"), F.col("l_suppkey").cast("double").alias("left"), (10 + F.col("l_linenumber")).cast("double").alias("height"), F.col("l_linenumber").cast("string").alias("text"))
    return d.row_clusters(rows)


_BOX = "(SELECT l_orderkey AS page_id, l_linenumber AS ord, (l_partkey % 300)::DOUBLE AS x, (l_suppkey % 97 * 7)::DOUBLE AS y, (40 + l_quantity * 6)::DOUBLE AS w, (30 + l_linenumber * 12)::DOUBLE AS h FROM lineitem)"


def _boxes(spark, sf_dir) -> DataFrame:
    c = F.col
    return t.read(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("page_id"), c("l_linenumber").alias("ord"), (c("l_partkey") % 300).cast("double").alias("x"), (c("l_suppkey") % 97 * 7).cast("double").alias("y"), (40 + c("l_quantity") * 6).alias("w"), (30 + c("l_linenumber") * 12).cast("double").alias("h"))


@query(f"""WITH p AS (SELECT a.page_id, b.ord AS new_ord, a.ord, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) / least(a.w * a.h, b.w * b.h) AS overlap,
    abs(a.x + a.w / 2 - b.x - b.w / 2) <= greatest(a.w, b.w) * 0.35 AND abs(a.y + a.h / 2 - b.y - b.h / 2) <= greatest(a.h, b.h) * 0.35 AS near FROM {_BOX} a JOIN {_BOX} b ON a.page_id = b.page_id AND a.ord % 2 = 1 AND b.ord % 2 = 0)
    SELECT page_id, new_ord, arg_max(ord, struct_pack(v := overlap, o := -ord)) AS ord, floor(max(overlap) * 1000000 + 0.5) / 1000000 AS overlap FROM p WHERE overlap >= 0.35 OR near GROUP BY 1, 2""")
def q_rect_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir)
    return d.best_overlap(rows.filter("ord % 2 = 1"), rows.filter("ord % 2 = 0")).withColumn("overlap", share6(F.col("overlap")))


#: Boxes of two-column pages, an expression for each that both engines read alike; in every third page some boxes reach over the gutter.
_COLUMNS = {
    "doc_id": "l_partkey", "ord": "l_orderkey * 10 + l_linenumber", "x": "l_orderkey % 2 * 460 + l_suppkey % 40", "w": "100 + l_quantity * 6 + CASE WHEN l_partkey % 3 = 0 AND l_linenumber = 1 THEN 120 ELSE 0 END"}


@query(f"""WITH f AS (SELECT {', '.join(f"({e})::{'DOUBLE' if n in 'xw' else 'BIGINT'} AS {n}" for n, e in _COLUMNS.items())}, 900.0::DOUBLE AS pw FROM lineitem), g AS (SELECT * FROM f WHERE w > pw * 0.015 AND w < pw * 0.55 AND x >= 0 AND x + w <= pw),
    k AS (SELECT *, max(x + w) OVER (PARTITION BY doc_id ORDER BY x, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS le, row_number() OVER (PARTITION BY doc_id ORDER BY x, ord) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM g)
    SELECT doc_id, arg_max((x + le) / 2, struct_pack(g := x - le, k := -k)) AS split_x FROM k WHERE n >= 4 AND k >= 2 AND n - k >= 2 AND x - le >= pw * 0.03 AND (x + le) / 2 BETWEEN pw * 0.25 AND pw * 0.75 GROUP BY 1""")
def q_gutter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = t.read(spark, sf_dir, "lineitem").select(*[F.expr(e).cast("double" if n in "xw" else "long").alias(n) for n, e in _COLUMNS.items()])
    return d.gutter(boxes.withColumn("page_width", F.lit(900.0)))


@query("""WITH s AS (SELECT p_partkey, '管理机构 ' || p_name || ' 授信额度' || p_size || CASE WHEN p_partkey % 3 = 0 THEN ' 2024.01.0' || (p_partkey % 9) ELSE '■' END AS text FROM part), c AS (SELECT *, regexp_replace(text, '\\s+', '', 'g') AS z FROM s)
    SELECT p_partkey, (10 + 8 + CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN regexp_matches(z, '[0-9]{4,}') THEN 2 ELSE 0 END - CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 4 END - CASE WHEN length(z) < 40 THEN 8 ELSE 0 END)::INT AS score, left(regexp_replace(z, '[|:：,，。.\\-—_]', '', 'g'), 180) AS signature FROM c""")
def q_table_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" 2024.01.0"), (F.col("p_partkey") % 9).cast("string"))).otherwise("■")
    text = F.concat(F.lit("管理机构 "), "p_name", F.lit(" 授信额度"), F.col("p_size").cast("string"), tail)
    return t.read(spark, sf_dir, "part").select("p_partkey", text.alias("text")).select("p_partkey", d.table_score(F.col("text"), F.array(F.lit("测试银行"))).alias("score"), d.table_signature(F.col("text")).alias("signature"))


@query("""WITH n AS (SELECT DISTINCT l_orderkey AS doc_id, (l_partkey % 40)::INT AS n FROM lineitem), g AS (SELECT doc_id, lag(n) OVER (PARTITION BY doc_id ORDER BY n) AS before, n AS after FROM n) SELECT * FROM g WHERE after - before > 1""")
def q_number_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.number_gaps(t.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 40).cast("int").alias("n")))


@query(f"""WITH RECURSIVE {_LINES}, n AS (SELECT doc_id, line, len(text)::INT AS n FROM lines), f AS (SELECT doc_id, line, 0 AS chunk, n + 1 AS size FROM n WHERE line = 0 UNION ALL
    SELECT n.doc_id, n.line, CASE WHEN f.size + n.n + 1 > 3000 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.size + n.n + 1 > 3000 THEN n.n + 1 ELSE f.size + n.n + 1 END FROM f JOIN n ON n.doc_id = f.doc_id AND n.line = f.line + 1)
    SELECT doc_id, chunk, count(*)::INT AS lines, max(size) AS size FROM f GROUP BY 1, 2""")
def q_chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.chunk_lines(_lines(spark, sf_dir), 3000)


_ANCHORS = ["token", "the ", "de ", "idiot"]


@query(f"""WITH c AS (SELECT doc_id, {", ".join(f"((length(text) - length(replace(text, '{a}', ''))) // {len(a)})::INT AS a{k}" for k, a in enumerate(_ANCHORS))} FROM documents)
    SELECT doc_id, {" || ',' || ".join(f"'{a}=' || a{k}" for k, a in enumerate(_ANCHORS))} AS found, array_to_string(list_filter([{", ".join(f"CASE WHEN a{k} = 0 THEN '{a}' END" for k, a in enumerate(_ANCHORS))}], lambda x: x IS NOT NULL), ',') AS missing FROM c""")
def q_quality_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.anchor_counts(t.read(spark, sf_dir, "documents"), _ANCHORS)
