"""Registered queries of document intake over responses, layouts and tables made of the driver's tables; with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import intake as x
from ledgerloom.sources import tables as t

QUERIES, SQL = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


def _pos(a: str, b: str) -> str:
    """A quadrilateral's JSON, of expressions for its left and upper edge."""
    at = lambda e, n: f"CAST({e} + {n} AS STRING)"
    return " || ',' || ".join(["'[' || " + at(a, 0), at(b, 0), at(a, 120), at(b, 0), at(a, 120), at(b, 30), at(a, 0), at(b, 30) + " || ']'"])


#: A response's JSON, as an expression of k that both engines read alike.
_K = "CAST(k AS STRING)"
_LINES = " || ',' || ".join(f"""'{{"type":"line","id":{i},"text":"' || {text} || '","pos":' || {_pos(f'{i * 10}', 'k % 300')} || '}}'""" for i, text in enumerate(["'管理机构'", f"'机构' || {_K}", "''", f"'第' || CAST(k % 30 + 1 AS STRING) || '页，共31页'", "'余额'"]))
_CELLS = ",".join(f'{{"row":{r},"col":{c},"row_span":1,"col_span":1,"content":[{{"content":[{ids}]}}]}}' for r, c, ids in ((0, 0, "0"), (0, 1, "4,2"), (1, 0, "1,0"), (1, 1, "99")))
_TABLE = f"""'{{"type":"table","text":"<table><tr><td>A ' || {_K} || '</td><td>B</td></tr><tr><td>1</td><td>' || CAST(k % 7 AS STRING) || '</td></tr></table>","pos":' || {_pos('k % 500', 'k % 800')} || ',"rows":2,"cols":2,"continue":' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END || ',"cells":[{_CELLS}]}}'"""
_PAGE = f"""'{{"height":1000' || CASE WHEN k % 3 = 0 THEN ',"width":800' WHEN k % 3 = 1 THEN ',"page_id":"q' || {_K} || '"' ELSE '' END || ',"structured":[{{"type":"header","text":"h"}},{{"type":"textblock","sub_type":"text_title","text":"标题' || {_K} || '","pos":' || {_pos('k % 90', '5')} || '}},'
    || {_TABLE} || ',{{"type":"textblock","text":"正文","pos":[1,2,3]}},' || {_TABLE} || '],"content":[{{"type":"image","id":0}},' || {_LINES} || ']}}'"""
_JSON = f"""CASE WHEN k % 11 = 0 THEN '{{"result":{{"pages":[{{}}]}}}}' WHEN k % 13 = 0 THEN 'not json' ELSE '{{"code":200,"result":{{"pages":[' || {_PAGE} || ',' || {_PAGE} || ']}}}}' END"""
_SHAPE = '{"result":{"pages":[{"page_id":"VARCHAR","height":"DOUBLE","width":"DOUBLE","structured":[{"type":"VARCHAR","sub_type":"VARCHAR","text":"VARCHAR","pos":["DOUBLE"],"continue":"BOOLEAN","cells":[{"content":[{"content":["BIGINT"]}]}]}],"content":[{"type":"VARCHAR","id":"BIGINT","text":"VARCHAR","pos":["DOUBLE"]}]}]}}'
_RECT = "CASE WHEN coalesce(len(pos), 0) < 8 THEN [0.0, 0.0, 0.0, 0.0]::DOUBLE[] ELSE [list_min(pos[1:7:2]), list_min(pos[2:8:2]), list_max(pos[1:7:2]) - list_min(pos[1:7:2]), list_max(pos[2:8:2]) - list_min(pos[2:8:2])] END"
_MD = "list_transform(regexp_extract_all(html, '<tr>(.*?)</tr>', 1), lambda r: '| ' || array_to_string(regexp_extract_all(r, '<td>(.*?)</td>', 1), ' | ') || ' |')"


@query(f"""WITH j AS (SELECT c_custkey AS doc_id, json_transform(json, '{_SHAPE}') AS j FROM (SELECT c_custkey, {_JSON} AS json FROM (SELECT *, c_custkey AS k FROM customer)) WHERE json_valid(json)),
    p0 AS (SELECT doc_id, j.result.pages AS ps, unnest(range(len(j.result.pages)))::INT AS page_num FROM j), p1 AS (SELECT doc_id, page_num, ps[page_num + 1] AS p FROM p0),
    p AS (SELECT doc_id, page_num, coalesce(p.page_id, page_num::VARCHAR) AS page_id, coalesce(p.height, {x.HEIGHT})::DOUBLE AS page_height, coalesce(p.width, floor(coalesce(p.height, {x.HEIGHT}) * {x.STRETCH}::DOUBLE + 0.5))::DOUBLE AS page_width,
        list_filter(coalesce(p.structured, []), lambda b: b.type = 'table') AS tb, list_filter(coalesce(p.structured, []), lambda b: coalesce(b.type, '') NOT IN ('table', 'header')) AS tx, list_filter(coalesce(p.content, []), lambda l: l.type = 'line') AS ln FROM p1),
    a AS (SELECT *, unnest(range(len(tb))) AS n FROM p), a2 AS (SELECT *, tb[n + 1] AS b, tb[n + 1].pos AS pos, coalesce(tb[n + 1].text, '') AS html FROM a),
    a3 AS (SELECT doc_id, page_num, page_id, page_height, page_width, 'p' || page_num || '_t' || n AS layout_id, 'table' AS type, '' AS sub_type, '' AS text, {_RECT} AS box, CASE WHEN b."continue" THEN 'begin' ELSE '' END AS merge_table,
        array_to_string(list_concat(list_concat(({_MD})[1:1], ['| --- | --- |']), ({_MD})[2:]), chr(10)) AS markdown,
        list_transform(b.cells, lambda c: array_to_string(list_filter(list_transform(flatten(list_transform(c.content, lambda q: q.content)), lambda i: list_filter(ln, lambda l: l.id = i)[-1].text), lambda v: coalesce(v, '') <> ''), chr(10))) AS cells FROM a2),
    c AS (SELECT *, unnest(range(len(tx))) AS n FROM p), c2 AS (SELECT *, tx[n + 1] AS b, tx[n + 1].pos AS pos FROM c),
    c3 AS (SELECT doc_id, page_num, page_id, page_height, page_width, 'p' || page_num || '_l' || n AS layout_id, CASE WHEN b.type = 'textblock' AND b.sub_type = 'text_title' THEN 'title' ELSE 'para' END AS type, coalesce(b.sub_type, '') AS sub_type, coalesce(b.text, '') AS text, {_RECT} AS box, NULL AS merge_table, NULL AS markdown, NULL AS cells FROM c2),
    f0 AS (SELECT *, list_filter(ln, lambda l: regexp_matches(coalesce(l.text, ''), '第(\\d+)页[，,。./\\s]*共(\\d+)页')) AS fs FROM p), f AS (SELECT *, unnest(range(len(fs))) AS n FROM f0), f2 AS (SELECT *, fs[n + 1] AS b, fs[n + 1].pos AS pos FROM f),
    f3 AS (SELECT doc_id, page_num, page_id, page_height, page_width, 'p' || page_num || '_footer' || (len(tx) + n) AS layout_id, 'para' AS type, 'footer' AS sub_type, b.text AS text, {_RECT} AS box, NULL AS merge_table, NULL AS markdown, NULL AS cells FROM f2),
    u AS (SELECT * FROM a3 UNION ALL SELECT * FROM c3 UNION ALL SELECT * FROM f3)
    SELECT doc_id, page_num, page_id, page_height, page_width, layout_id, type, sub_type, text, box[1] AS x, box[2] AS y, box[3] AS w, box[4] AS h, merge_table, markdown, array_to_string(cells, '|') AS cells FROM u""")
def q_doc_json_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = t.read(spark, sf_dir, "customer").selectExpr("c_custkey AS k").repartition(spark.sparkContext.defaultParallelism)  # before each grows into a response
    responses = keys.selectExpr("k AS doc_id", f"{_JSON} AS json")
    rows = x.ingest_documents(responses)
    return rows.select("doc_id", "page_num", "page_id", "page_height", "page_width", "layout_id", "type", "sub_type", "text", *[F.col("box")[i].alias(n) for i, n in enumerate("xywh")], "merge_table", "markdown", F.when(F.col("cells").isNotNull(), F.array_join("cells", "|")).alias("cells"))


_LAYOUT = """o_custkey AS page_id, o_custkey % 50 AS page_num, CASE WHEN o_custkey % 4 = 0 THEN 900D END AS page_width, o_orderkey AS ord, CAST(CASE WHEN o_custkey % 5 = 0 THEN o_orderkey * 37 % 800 ELSE o_orderkey % 2 * 500 + o_orderkey * 7 % 90 END AS DOUBLE) AS x,
    CAST(o_orderkey * 13 % 1100 AS DOUBLE) AS y, CAST(o_orderkey * 11 % 280 + 5 AS DOUBLE) AS w,
    CASE WHEN o_orderkey % 7 = 1 THEN '第' || CAST(o_custkey % 40 + o_orderkey % 2 AS STRING) || '页，共60页' WHEN o_orderkey % 31 = 2 THEN '第3页 共9页 第' || CAST(o_orderkey % 9 AS STRING) || '页/共9页' ELSE '正文' END AS text, o_orderkey % 7 = 1 AND o_orderkey % 3 <> 0 AS is_footer"""


@query(f"""WITH b AS (SELECT {_LAYOUT.replace('900D', '900::DOUBLE')} FROM orders), r AS (SELECT * REPLACE (coalesce(page_width, {x.WIDTH})::DOUBLE AS page_width) FROM b),
    h0 AS (SELECT *, regexp_extract_all(text, '第(\\d+)页[，,。./\\s]*共(\\d+)页', 1) AS ns FROM r), h1 AS (SELECT *, unnest(range(len(ns))) AS nth FROM h0),
    h2 AS (SELECT *, ns[nth + 1]::BIGINT AS number, coalesce(x - lag(x) OVER (PARTITION BY page_id ORDER BY x, ord, nth) > page_width * 0.05, true) AS apart FROM h1),
    h3 AS (SELECT *, sum(apart::INT) OVER w AS sets, min(x) OVER w AS low, max(CASE WHEN apart THEN x END) OVER w AS high FROM h2 WINDOW w AS (PARTITION BY page_id)),
    h4 AS (SELECT *, CASE WHEN x > CASE WHEN sets >= 2 THEN (low + high) / 2 ELSE page_width / 2 END THEN 'r' ELSE 'l' END AS side FROM h3),
    h5 AS (SELECT *, row_number() OVER (PARTITION BY page_id, side ORDER BY is_footer DESC, y DESC, ord, nth) AS rank FROM h4),
    s AS (SELECT page_id, max(CASE WHEN side = 'l' THEN number END) AS ln, max(CASE WHEN side = 'l' THEN x END) AS lx, max(CASE WHEN side = 'r' THEN number END) AS rn, max(CASE WHEN side = 'r' THEN x END) AS rx FROM h5 WHERE rank = 1 GROUP BY 1),
    g0 AS (SELECT * FROM r WHERE NOT is_footer AND w > page_width * 0.015 AND w < page_width * 0.55 AND x >= 0 AND x + w <= page_width),
    g1 AS (SELECT *, max(x + w) OVER (PARTITION BY page_id ORDER BY x, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS le, row_number() OVER (PARTITION BY page_id ORDER BY x, ord) - 1 AS k, count(*) OVER (PARTITION BY page_id) AS n FROM g0),
    g AS (SELECT page_id, arg_max((x + le) / 2, struct_pack(g := x - le, k := -k)) AS split FROM g1 WHERE n >= 4 AND k >= 2 AND n - k >= 2 AND x - le >= page_width * 0.03 AND (x + le) / 2 BETWEEN page_width * 0.25 AND page_width * 0.75 GROUP BY 1),
    j AS (SELECT r.*, ln, rn, x > coalesce(CASE WHEN abs(rx - lx) > page_width * 0.1 THEN (lx + rx) / 2 END, split, page_width / 2) AS is_right FROM r LEFT JOIN s USING (page_id) LEFT JOIN g USING (page_id))
    SELECT page_id, ord, CASE WHEN is_right THEN CASE WHEN ln IS NOT NULL AND rn > ln THEN rn WHEN ln IS NOT NULL THEN ln + 1 WHEN rn IS NOT NULL THEN rn ELSE page_num * 2 + 2 END
        ELSE CASE WHEN ln IS NOT NULL AND rn > ln THEN rn - 1 WHEN ln IS NOT NULL THEN ln WHEN rn IS NOT NULL THEN greatest(1, rn - 1) ELSE page_num * 2 + 1 END END AS logical_page,
        CASE WHEN ln IS NULL AND rn IS NULL THEN 'fallback' ELSE 'footer' END AS source FROM j""")
def q_logical_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.logical_pages(t.read(spark, sf_dir, "orders").selectExpr(*_split_top(_LAYOUT)))


def _split_top(text: str) -> list[str]:
    """A select list's expressions; commas inside quotes and brackets do not part them."""
    out, depth, quoted = [""], 0, False
    for c in text:
        quoted ^= c == "'"
        depth += 0 if quoted else (c == "(") - (c == ")")
        if c == "," and not depth and not quoted:
            out.append("")
        else:
            out[-1] += c
    return out


_N = len(x.TERMS)
#: A term with one of its characters changed, and one as it is, by the key of a part.
_PICKED = "p_partkey AS k, {term} AS t, {other} AS o, (p_partkey // 7) % 6 AS i, {wrong} AS z"
_BROKEN = "'甲' || substr(t, 1, CAST(i AS INT)) || z || substr(t, CAST(i AS INT) + 2) || '：12 ' || o || t"


def _fuzzy_sql(text: str) -> str:
    for term in x.TERMS:
        pattern, close = x.term_variants(term)
        for k, other in enumerate(close):
            text = f"replace({text}, '{other}', '{chr(0xE000 + k)}')"
        text = f"regexp_replace({text}, '{pattern}', '{term}', 'g')"
        for k, other in enumerate(close):
            text = f"replace({text}, '{chr(0xE000 + k)}', '{other}')"
    return text


_TERM_LIST, _WRONG = ", ".join(f"'{w}'" for w in x.TERMS), ["某", "己", "X", "查", "机"]


@query(f"""WITH r AS (SELECT {_PICKED.format(term=f'[{_TERM_LIST}][(p_partkey % {_N} + 1)::INT]', other=f'[{_TERM_LIST}][(p_partkey // 3 % {_N} + 1)::INT]', wrong=str(_WRONG) + f'[(p_partkey // 11 % {len(_WRONG)} + 1)::INT]')} FROM part),
    b AS (SELECT k, {_BROKEN} AS raw FROM r) SELECT k, raw, {_fuzzy_sql('raw')} AS fixed FROM b""")
def q_ocr_fuzzy_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda words, at: f"element_at(array({words}), CAST({at} % {len(words.split(', '))} + 1 AS INT))"
    picked = _PICKED.format(term=pick(_TERM_LIST, "p_partkey"), other=pick(_TERM_LIST, "p_partkey DIV 3"), wrong=pick(", ".join(f"'{w}'" for w in _WRONG), "p_partkey DIV 11")).replace("//", "DIV")
    rows = t.read(spark, sf_dir, "part").selectExpr(*_split_top(picked)).selectExpr("k", f"{_BROKEN} AS raw")
    return rows.select("k", "raw", F.get(x.correct_texts(F.array("raw")), F.lit(0)).alias("fixed"))


_BOXES = """{0} AS doc_id, {1} % 3 AS page, {1} AS ord, CAST({1} * 31 % 500 AS DOUBLE) AS x, CAST({1} * 17 % 900 AS DOUBLE) AS y, CAST({1} * 7 % 250 + 20 AS DOUBLE) AS w, CAST({1} * 5 % 200 + 20 AS DOUBLE) AS h,
    CAST({1} * 3 % 45 AS INT) AS score, 's' || CAST({1} % 40 AS STRING) AS signature, 't' || CAST({1} AS STRING) AS markdown"""
_HELD, _NEW = _BOXES.format("p_partkey % 40", "p_partkey"), _BOXES.format("s_suppkey % 40", "(s_suppkey + 1)") + ", s_suppkey % 2 AS cand"


@query(f"""WITH h AS (SELECT {_HELD} FROM part WHERE p_partkey % 5 <> 1), n0 AS (SELECT {_NEW} FROM supplier UNION ALL SELECT {_BOXES.format('p_partkey % 40', '(p_partkey + 2)')}, p_partkey % 3 FROM part WHERE p_partkey % 5 = 1),
    n AS (SELECT * FROM n0 WHERE score >= {x.REPLACE} AND (doc_id, page) IN (SELECT doc_id, page FROM h)),
    f AS (SELECT doc_id, list({{'page': page, 'x': x, 'y': y, 'w': w, 'h': h, 'score': score, 'signature': signature, 'markdown': markdown}} ORDER BY page, ord) AS ts FROM h GROUP BY 1),
    m AS (SELECT doc_id, list({{'tables': [{{'page': page, 'x': x, 'y': y, 'w': w, 'h': h, 'score': score, 'signature': signature, 'markdown': markdown}}], 'seen': []::VARCHAR[]}} ORDER BY cand, page, ord) AS cs FROM n GROUP BY 1),
    s AS (SELECT doc_id, list_reduce(list_concat([{{'tables': ts, 'seen': list_transform(ts, lambda v: v.signature)}}], coalesce(cs, [])), lambda s, e: list_transform([list_sort(list_filter(list_transform(range(1, len(s.tables) + 1), lambda i:
            CASE WHEN s.tables[i].page = e.tables[1].page AND ({{ratio}} >= 0.35 OR {{near}}) THEN {{{{'overlap': {{ratio}}, 'score': s.tables[i].score, 'neg': -i}}}} END), lambda v: v IS NOT NULL))[-1]],
            lambda b: CASE WHEN b IS NULL AND e.tables[1].score >= {x.APPEND} AND NOT list_contains(s.seen, e.tables[1].signature) THEN {{{{'tables': list_concat(s.tables, e.tables), 'seen': list_append(s.seen, e.tables[1].signature)}}}}
                WHEN b IS NOT NULL AND e.tables[1].score >= b.score + {x.MARGIN} THEN {{{{'tables': list_concat(list_concat(s.tables[1:-b.neg - 1], e.tables), s.tables[-b.neg + 1:]), 'seen': list_append(s.seen, e.tables[1].signature)}}}} ELSE s END)[1]).tables AS ts FROM f LEFT JOIN m USING (doc_id)),
    u AS (SELECT doc_id, ts, unnest(range(len(ts)))::INT AS place FROM s) SELECT doc_id, ts[place + 1].page AS page, place, ts[place + 1].markdown AS markdown, ts[place + 1].score AS score FROM u""".replace(
    "{ratio}", "(CASE WHEN least(s.tables[i].w * s.tables[i].h, e.tables[1].w * e.tables[1].h) > 0 THEN greatest(0, least(s.tables[i].x + s.tables[i].w, e.tables[1].x + e.tables[1].w) - greatest(s.tables[i].x, e.tables[1].x)) * greatest(0, least(s.tables[i].y + s.tables[i].h, e.tables[1].y + e.tables[1].h) - greatest(s.tables[i].y, e.tables[1].y)) / least(s.tables[i].w * s.tables[i].h, e.tables[1].w * e.tables[1].h) ELSE 0 END)").replace(
    "{near}", "(abs(s.tables[i].x + s.tables[i].w / 2 - e.tables[1].x - e.tables[1].w / 2) <= greatest(s.tables[i].w, e.tables[1].w) * 0.35 AND abs(s.tables[i].y + s.tables[i].h / 2 - e.tables[1].y - e.tables[1].h / 2) <= greatest(s.tables[i].h, e.tables[1].h) * 0.35)").replace("{{", "{").replace("}}", "}"))
def q_candidate_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = t.read(spark, sf_dir, "part")
    held = part.filter("p_partkey % 5 <> 1").selectExpr(*_split_top(_HELD))
    more = part.filter("p_partkey % 5 = 1").selectExpr(*_split_top(_BOXES.format("p_partkey % 40", "(p_partkey + 2)")), "p_partkey % 3 AS cand")
    return x.fuse_candidates(held, t.read(spark, sf_dir, "supplier").selectExpr(*_split_top(_NEW)).unionByName(more))


@query("""WITH o AS (SELECT o_custkey AS report_id, o_orderpriority AS kind, count(*) AS n, sum(floor(o_totalprice)::BIGINT)::BIGINT AS total FROM orders GROUP BY 1, 2), a AS (SELECT report_id, sum(n)::BIGINT AS n, sum(total)::BIGINT AS total FROM o GROUP BY 1),
    b AS (SELECT report_id, string_agg('- ' || kind || '，账户数' || n || '笔，余额' || total || '元', chr(10) ORDER BY kind) AS lines FROM o GROUP BY 1)
    SELECT a.report_id, '【客户】' || chr(10) || '- 客户姓名：' || coalesce(c_name, '未识别') || chr(10) || chr(10) || '【总览】' || chr(10) || '- 债务总额：' || total || '元' || chr(10) || '- 债务账户：' || n || '笔' || chr(10) || chr(10) || '【债务结构】' || chr(10) || lines AS prompt
    FROM a JOIN b USING (report_id) LEFT JOIN customer ON c_custkey = report_id""")
def q_prompt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = t.read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("report_id"), F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("n"), F.sum(F.floor("o_totalprice")).alias("total"))
    whole = orders.groupBy("report_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    names = t.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("report_id"), F.col("c_name").alias("name"))
    fact = lambda rows, place, title, order, text: rows.select("report_id", F.struct(F.lit(place).alias("place"), F.lit(title).alias("title")).alias("section"), order.alias("ord"), text.alias("text"))
    one = lambda text, k: (F.lit(str(k)), text)
    facts = [
        fact(whole.join(names, "report_id", "left"), 1, "客户", *one(F.concat(F.lit("客户姓名："), F.coalesce("name", F.lit("未识别"))), 1)),
        fact(whole, 2, "总览", *one(F.format_string("债务总额：%d元", "total"), 1)), fact(whole, 2, "总览", *one(F.format_string("债务账户：%d笔", "n"), 2)),
        fact(orders, 3, "债务结构", F.col("kind"), F.format_string("%s，账户数%d笔，余额%d元", "kind", "n", "total"))]
    out = facts[0]
    for more in facts[1:]:
        out = out.unionByName(more)
    return x.prompt_text(out)
