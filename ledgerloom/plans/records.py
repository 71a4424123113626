"""Registered queries of quality scores, institutions, segments and reviews; with SQL for the same rows where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import half_up, share6
from ledgerloom.functions.texts import FULL_WIDTH, HALF_WIDTH, KNOWN_REASONS
from ledgerloom.operators import institutions, quality, reviews, segments
from ledgerloom.operators.debt import PLANS
from ledgerloom.plans.credit import _ISSUES, _PLANS_SQL, _issues, _plan_rows
from ledgerloom.plans.papers import _ORD, _ord
from ledgerloom.sources import tables as t

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _pick(values: list[str], key):
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _pick_sql(values: list[str], key: str) -> str:
    return "['" + "', '".join(values) + f"'][({key} % {len(values)} + 1)::INT]"


_SHOTS = "s AS (SELECT p_partkey AS id, 800 + p_partkey % 1200 AS short_side, (p_size % 40) / 10.0::DOUBLE AS megapixels, (p_partkey % 150)::DOUBLE AS sharpness, (p_partkey * 7 % 256)::DOUBLE AS brightness, (p_partkey % 60) / 100.0::DOUBLE AS over, (p_size % 25) / 100.0::DOUBLE AS under FROM part)"


def _shots(spark, sf_dir) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    return t.read(spark, sf_dir, "part").select(k.alias("id"), (800 + k % 1200).alias("short_side"), ((s % 40) / 10).alias("megapixels"), (k % 150).cast("double").alias("sharpness"), (k * 7 % 256).cast("double").alias("brightness"), ((k % 60) / 100).alias("over"), ((s % 25) / 100).alias("under"))


@query(f"WITH {_SHOTS} SELECT id, floor((1 - CASE WHEN short_side < 1200 THEN 0.22::DOUBLE ELSE 0 END - CASE WHEN megapixels < 1.5 THEN 0.18::DOUBLE ELSE 0 END - CASE WHEN sharpness < 55 THEN 0.25::DOUBLE WHEN sharpness < 95 THEN 0.1::DOUBLE ELSE 0 END) * 100 + 0.5) / 100 AS score FROM s")
def q_image_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shots(spark, sf_dir).select("id", half_up(quality.image_score(F.col("short_side"), F.col("megapixels"), F.col("sharpness")), 2).alias("score"))


def _capture_sql() -> str:
    score, hard, soft = "100", [], []
    for name, side, reject, warn, most, some in quality.CAPTURE:
        score += f" - CASE WHEN {name} {side} {reject} THEN {most} WHEN {name} {side} {warn} THEN {some} ELSE 0 END"
        hard.append(f"{name} {side} {reject}")
        soft.append(f"{name} {side} {warn}")
    low, high, low2, high2, most, some = quality.BRIGHTNESS
    score += f" - CASE WHEN brightness < {low} OR brightness > {high} THEN {most} WHEN brightness < {low2} OR brightness > {high2} THEN {some} ELSE 0 END"
    hard.append(f"brightness < {low} OR brightness > {high}")
    soft.append(f"brightness < {low2} OR brightness > {high2}")
    return f"WITH {_SHOTS}, c AS (SELECT *, greatest(0, {score})::INT AS score FROM s) SELECT id, score, CASE WHEN score < 70 OR {' OR '.join(hard)} THEN 'reject' WHEN score < 85 OR {' OR '.join(soft)} THEN 'warn' ELSE 'pass' END AS level FROM c"


@query(_capture_sql())
def q_capture_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.capture_quality(_shots(spark, sf_dir)).select("id", "score", "level")


@query(f"WITH {_SHOTS} SELECT id, floor(greatest(0, least(100, 100.0::DOUBLE - CASE WHEN over < 0.26 THEN 36 WHEN over < 0.38 THEN 10 ELSE 0 END - least(20, under * 55::DOUBLE) - least(14, megapixels * 25::DOUBLE) - CASE WHEN id % 2 = 0 THEN 6 ELSE 0 END)) + 0.5) AS score FROM s")
def q_scan_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shots(spark, sf_dir).select("id", quality.scan_score(F.col("over"), F.col("under"), F.col("megapixels"), F.col("id") % 2 == 0).alias("score"))


@query("""WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber AS candidate, (l_quantity / 50 * 100 + (l_partkey % 9) * 1.2::DOUBLE) + (l_suppkey % 5) * 0.7::DOUBLE + (l_partkey % 4) * 1.5::DOUBLE - (l_suppkey % 3) * 1.8::DOUBLE AS rank FROM lineitem)
    SELECT doc_id, arg_max(candidate, struct_pack(r := rank, c := -candidate)) AS candidate, floor(max(rank) * 1000000 + 0.5) / 1000000 AS rank FROM r GROUP BY 1""")
def q_candidate_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = t.read(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("doc_id"), c("l_linenumber").alias("candidate"), (c("l_quantity") / 50).alias("score"), (c("l_partkey") % 9).alias("tables"), (c("l_suppkey") % 5).alias("anchors"), (c("l_partkey") % 4).alias("modules"), (c("l_suppkey") % 3).alias("issues"))
    return quality.rank_candidates(rows).withColumn("rank", share6(F.col("rank")))


@query("""WITH r AS (SELECT p_partkey AS doc_id, p_partkey % 3 AS scope, p_size % 4 AS tables, p_size % 3 AS modules, p_size % 7 AS empty, p_partkey % 20 AS anchors, p_size % 6 AS footers, 4 AS pages, p_partkey % 2 AS missing, (p_partkey % 5 = 0) AS pm, (p_partkey % 7 = 0) AS qg FROM part),
    s AS (SELECT doc_id, scope, 0.82::DOUBLE + CASE WHEN tables > 0 THEN 0.06::DOUBLE ELSE 0 END + CASE WHEN modules > 0 THEN 0.08::DOUBLE ELSE 0 END - least(0.12::DOUBLE, empty * 0.03::DOUBLE) - CASE WHEN pm THEN 0.05::DOUBLE ELSE 0 END - CASE WHEN qg THEN 0.05::DOUBLE ELSE 0 END AS f,
        CASE WHEN tables > 0 THEN 0.45::DOUBLE ELSE 0.2::DOUBLE END - least(0.15::DOUBLE, empty * 0.03::DOUBLE) AS u,
        1::DOUBLE - least(0.35::DOUBLE, anchors * 0.025::DOUBLE) - CASE WHEN tables = 0 THEN 0.25::DOUBLE ELSE 0 END - least(0.15::DOUBLE, empty * 0.02::DOUBLE) - CASE WHEN footers < pages THEN 0.1::DOUBLE ELSE 0 END - CASE WHEN missing > 0 THEN 0.08::DOUBLE ELSE 0 END - CASE WHEN pm THEN 0.05::DOUBLE ELSE 0 END - CASE WHEN qg THEN 0.05::DOUBLE ELSE 0 END AS c FROM r)
    SELECT doc_id, greatest(0, CASE scope WHEN 0 THEN least(0.95, floor(f * 100 + 0.5) / 100) WHEN 1 THEN floor(u * 100 + 0.5) / 100 ELSE floor(c * 100 + 0.5) / 100 END)::DOUBLE AS score FROM s""")
def q_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    rows = t.read(spark, sf_dir, "part").select(
        k.alias("doc_id"), _pick(["fragment", "unknown", "complete"], k).alias("scope"), (s % 4).alias("tables"), (s % 3).alias("modules"), (s % 7).alias("empty_tables"), (k % 20).alias("missing_anchors"), (s % 6).alias("footers"), F.lit(4).alias("pages"),
        (k % 2).alias("missing_pages"), (k % 5 == 0).alias("payment_missing"), (k % 7 == 0).alias("query_gaps"))
    return quality.quality_score(rows)


_HIST = "h AS (SELECT l_suppkey AS image_id, (l_partkey * 7 % 64)::BIGINT AS bin, sum(l_linenumber)::BIGINT AS n FROM lineitem GROUP BY 1, 2)"


def _histogram(spark, sf_dir) -> DataFrame:
    return t.read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("image_id"), (F.col("l_partkey") * 7 % 64).alias("bin")).agg(F.sum("l_linenumber").alias("n"))


@query(f"""WITH {_HIST}, c AS (SELECT *, sum(n) OVER w AS wb, sum(bin * n) OVER w AS sb, sum(n) OVER (PARTITION BY image_id) AS tot, sum(bin * n) OVER (PARTITION BY image_id) AS mean FROM h WINDOW w AS (PARTITION BY image_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    v AS (SELECT *, CASE WHEN wb > 0 AND tot - wb > 0 THEN wb::DOUBLE * (tot - wb)::DOUBLE * pow(sb::DOUBLE / wb::DOUBLE - (mean - sb)::DOUBLE / (tot - wb)::DOUBLE, 2) END AS v FROM c),
    p AS (SELECT image_id, min(bin) AS p10 FROM c WHERE wb >= tot * 0.1::DOUBLE GROUP BY 1)
    SELECT image_id, coalesce(arg_max(bin, struct_pack(v := v, b := -bin)) FILTER (v > 0), 150)::BIGINT AS threshold, min(p10) AS p10 FROM v JOIN p USING (image_id) GROUP BY 1""")
def q_otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _histogram(spark, sf_dir)
    return quality.otsu(rows).join(quality.percentile_bin(rows, 0.1).withColumnRenamed("bin", "p10"), "image_id")


@query("""WITH r AS (SELECT user_id AS line_id, event_id AS x, floor(value * 100) AS v FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY line_id) AS n FROM r),
    b AS (SELECT a.line_id, a.x, unnest(range(a.k - 2, a.k + 3)) AS j, a.n FROM k a), c AS (SELECT line_id, x, greatest(0, least(n - 1, j)) AS j FROM b)
    SELECT c.line_id, c.x, floor(sum(k.v) / 5 * 1000000 + 0.5) / 1000000 AS mean FROM c JOIN k ON k.line_id = c.line_id AND k.k = c.j GROUP BY 1, 2""")
def q_box_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.read(spark, sf_dir, "events").select(F.col("user_id").alias("line_id"), F.col("event_id").alias("x"), F.floor(F.col("value") * 100).cast("double").alias("v"))
    return quality.moving_mean(rows, 2).withColumn("mean", share6(F.col("mean")))


@query("""WITH p AS (SELECT user_id AS line_id, (event_id % 97)::DOUBLE AS x, floor(value * 10) AS y FROM events),
    f AS (SELECT line_id, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS a, sx, sy, n FROM (SELECT line_id, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM p GROUP BY 1) WHERE n >= 2 AND abs(n * sxx - sx * sx) >= 1e-6),
    r AS (SELECT p.*, abs(y - (a * x + (sy - a * sx) / n)) AS r FROM p JOIN f USING (line_id)), k AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY r) - 1 AS k, count(*) OVER (PARTITION BY line_id) AS many FROM r),
    c AS (SELECT line_id, greatest(3, max(r) FILTER (k = floor(many * 0.68))) AS cut FROM k GROUP BY 1), near AS (SELECT k.*, r <= cut AS near, count(*) FILTER (r <= cut) OVER (PARTITION BY line_id) AS left_over FROM k JOIN c USING (line_id)),
    g AS (SELECT line_id, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM near WHERE near OR left_over < 2 GROUP BY 1), h AS (SELECT *, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS a FROM g WHERE n >= 2 AND abs(n * sxx - sx * sx) >= 1e-6)
    SELECT line_id, floor(a * 10000 + 0.5) / 10000 AS a, floor((sy - a * sx) / n * 10000 + 0.5) / 10000 AS b FROM h""")
def q_robust_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.read(spark, sf_dir, "events").select(F.col("user_id").alias("line_id"), (F.col("event_id") % 97).cast("double").alias("x"), F.floor(F.col("value") * 10).cast("double").alias("y"))
    return quality.robust_line(rows).select("line_id", half_up(F.col("a"), 4).alias("a"), half_up(F.col("b"), 4).alias("b"))


@query("""WITH p AS (SELECT l_suppkey AS shape_id, l_orderkey * 10000000 + l_partkey * 100 + l_linenumber AS ord, (l_partkey % 101)::BIGINT AS x, (l_orderkey % 103)::BIGINT AS y FROM lineitem)
    SELECT shape_id, arg_min(ord, struct_pack(v := x + y, o := ord)) AS top_left, arg_max(ord, struct_pack(v := x + y, o := -ord)) AS bottom_right, arg_max(ord, struct_pack(v := x - y, o := -ord)) AS top_right, arg_min(ord, struct_pack(v := x - y, o := ord)) AS bottom_left FROM p GROUP BY 1""")
def q_extreme_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = t.read(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("shape_id"), (c("l_orderkey") * 10000000 + c("l_partkey") * 100 + c("l_linenumber")).alias("ord"), (c("l_partkey") % 101).alias("x"), (c("l_orderkey") % 103).alias("y"))
    return quality.extreme_points(rows)


def _comparable_sql(name: str) -> str:
    """The comparable form of a name in SQL, whose patterns have no look ahead."""
    out = f"replace(replace(regexp_replace({name}, '\\s+', '', 'g'), '（', '('), '）', ')')"
    for pattern, new in institutions._STRIP:
        out = f"regexp_replace({out}, '{pattern}', '{new.replace('$', chr(92))}', 'g')"
    out = f"translate({out}, '{FULL_WIDTH}', '{HALF_WIDTH}')"
    for pattern, new in institutions._FIXES:
        out = f"regexp_replace({out}, '{pattern.replace('(?!司)', '司?')}', '{new}', 'g')"
    return f"lower({out})"


_DIM = f"""dim AS (SELECT DISTINCT ord, name, kind, alias, {_comparable_sql("alias")} AS key, alias = name AS own FROM (SELECT ord, name, kind, unnest([name] || aliases) AS alias
    FROM (VALUES {", ".join(f"({n}, '{name}', '{kind}', [{', '.join(repr(x) for x in aliases)}]::VARCHAR[])" for n, (name, kind, aliases) in enumerate(institutions.INSTITUTIONS))}) v(ord, name, kind, aliases)))"""
_LINE_SQL = f"""coalesce(list_filter(list_transform(string_split(replace({{0}}, '\\n', chr(10)), chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '{institutions._LINE}'))[1], trim({{0}}))"""


_NAMES = [
    "中国工商银行", "招商银行股份有限公司上海分行", "北京银很股份有限公司", "■京银行股份有限公司", "信用卡中心", "未收录财务公司", "交通银行\\n2024.01.01", "南京银行信用卡中心", "兴业消费全融股份公司", "股份有限公司", "上海农村商亚银行股份有限公司", "",
    "工行", "ICBC", "马上金融", "浦发银行信用卡中心", "ＣＭＢ", "重庆京东小贷", "美团小贷", "深圳市财付通网网络小额贷款有限公司", "中融信融资担保（大连）股份有限公司", "海尔消费金融有限公司北京分中心", "天津滨海农村商业银行", "浙江网商银行股份有限公", "狮桥租赁", "梅赛德斯奔驰汽车金融"]


def _named(spark, sf_dir) -> DataFrame:
    """Names of the list above, some with a branch of the supplier's number behind them."""
    key = F.col("s_suppkey")
    return t.read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(_pick(_NAMES, key), F.when(key % 4 == 0, F.concat(F.lit("第"), (key % 13).cast("string"), F.lit("支行"))).otherwise("")).alias("org"))


_NAMED = f"named AS (SELECT s_suppkey, {_pick_sql(_NAMES, 's_suppkey')} || CASE WHEN s_suppkey % 4 = 0 THEN '第' || (s_suppkey % 13) || '支行' ELSE '' END AS org FROM supplier)"


@query(f"""WITH {_DIM}, {_NAMED}, k AS (SELECT {_comparable_sql('line')} AS key, count(*) AS suppliers FROM (SELECT {_LINE_SQL.format('org')} AS line FROM named) GROUP BY 1)
    SELECT name, kind, alias, key, coalesce(suppliers, 0) AS suppliers FROM dim LEFT JOIN k USING (key)""")
def q_inst_dim_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each name and alias, with how many suppliers of the view go by it."""
    held = _named(spark, sf_dir).groupBy(institutions.comparable(institutions.institution_line(F.col("org"))).alias("key")).agg(F.count("*").alias("suppliers"))
    dim = institutions.dimension(spark).select("name", "kind", "alias", institutions.comparable(F.col("alias")).alias("key"))
    return dim.join(held, "key", "left").select("name", "kind", "alias", "key", F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query(f"WITH {_NAMED} SELECT s_suppkey, {_comparable_sql('line')} AS key FROM (SELECT s_suppkey, {_LINE_SQL.format('org')} AS line FROM named)")
def q_inst_comparable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("s_suppkey", institutions.comparable(institutions.institution_line(F.col("org"))).alias("key"))


_TOP = "list_filter(list_transform({0}, lambda x: x.name), lambda n, i: list_position(list_transform({0}, lambda x: x.name), n) = i)[:5]"


@query(f"""WITH {_DIM}, {_NAMED}, o AS (SELECT original, cleaned, {_comparable_sql('cleaned')} AS c, regexp_matches(cleaned, '[■□�]') AS unsure FROM (SELECT DISTINCT trim(org) AS original, {_LINE_SQL.format('trim(org)')} AS cleaned FROM named)),
    p AS (SELECT o.*, ord, name, key, own, array_to_string(list_distinct(string_split(c || key, '')), '') AS used FROM o, dim),
    q AS (SELECT *, levenshtein(translate(c, used, left('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789', len(used))), translate(key, used, left('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789', len(used)))) AS edits,
        CASE WHEN len(c) <= 1 THEN [c] ELSE list_transform(range(1, len(c)), lambda i: c[i:i + 1]) END AS gx, CASE WHEN len(key) <= 1 THEN [key] ELSE list_transform(range(1, len(key)), lambda i: key[i:i + 1]) END AS gy FROM p),
    s AS (SELECT *, len(key)::DOUBLE AS m, least(len(c), len(key))::DOUBLE / greatest(len(c), len(key)) AS part, CASE WHEN c = '' THEN 0 WHEN c = key THEN 1 ELSE greatest(0, (1 - edits::DOUBLE / greatest(len(c), len(key))) * 0.55::DOUBLE
        + 2.0::DOUBLE * list_sum(list_transform(list_distinct(gx), lambda g: least(len(list_filter(gx, lambda h: h = g)), len(list_filter(gy, lambda h: h = g))))) / (len(gx) + len(gy)) * 0.45::DOUBLE) END AS alike FROM q),
    a AS (SELECT original, cleaned, c, unsure, arg_min(struct_pack(name := name, own := own), struct_pack(a := ord, b := NOT own)) FILTER (key = c) AS exact, coalesce(list(struct_pack(s := m, name := name) ORDER BY m DESC, ord) FILTER (m >= 4 AND contains(c, key)), []) AS inside,
        coalesce(list(struct_pack(s := part, name := name) ORDER BY part DESC, ord) FILTER (contains(c, key) OR contains(key, c)), []) AS partly, coalesce(list(struct_pack(s := alike, name := name) ORDER BY alike DESC, ord) FILTER (alike >= 0.72), []) AS near FROM s GROUP BY 1, 2, 3, 4),
    r AS (SELECT *, {_TOP.format("inside")} AS ti, {_TOP.format("partly")} AS tp, {_TOP.format("near")} AS tn, len(list_distinct(list_transform(list_filter(partly, lambda x: x.s >= partly[1].s - 0.05), lambda x: x.name))) AS close, floor((0.88 + partly[1].s * 0.08) * 100 + 0.5) / 100 AS held, floor(near[1].s * 100 + 0.5) / 100 AS fuzzy, list_filter(near, lambda x: x.name <> near[1].name)[1].s AS other,
        cleaned <> '' AND (regexp_matches(cleaned, '^[\\d,，.。:\\-—年月日\\s]+$') OR regexp_matches(cleaned, '^(信用卡中心|牡丹卡中心|销售中心|客服中心|分中心|网上银行|商业银行)$') OR regexp_matches(cleaned, '^[一-龥]{{0,6}}(?:信用卡中心|牡丹卡中心|销售中心|分中心)$') OR regexp_matches(cleaned, '^(?:股份|股|份|有限|公司|行股份|银行股份|小额贷款|消费金融)(?:有限)?(?:公司)?$')) AS fragment FROM a),
    d AS (SELECT *, CASE WHEN fragment THEN 'fragment' WHEN c = '' THEN 'nothing' WHEN exact IS NOT NULL THEN 'exact' WHEN len(inside) > 0 AND (unsure OR len(ti) > 1) THEN 'inside?' WHEN len(inside) > 0 THEN 'inside' WHEN partly[1].s >= 0.72 AND (unsure OR close > 1) THEN 'partly?' WHEN partly[1].s >= 0.72 THEN 'partly'
        WHEN len(near) > 0 AND NOT unsure AND near[1].s >= 0.82 AND (other IS NULL OR near[1].s - other >= 0.05) THEN 'near' WHEN len(near) > 0 THEN 'near?' ELSE 'nothing' END AS way FROM r),
    e AS (SELECT original, CASE way WHEN 'exact' THEN exact.name WHEN 'inside?' THEN inside[1].name WHEN 'inside' THEN inside[1].name WHEN 'partly?' THEN partly[1].name WHEN 'partly' THEN partly[1].name WHEN 'near' THEN near[1].name WHEN 'near?' THEN near[1].name ELSE cleaned END AS normalized,
        (CASE way WHEN 'exact' THEN CASE WHEN exact.own THEN 1 ELSE 0.98 END WHEN 'inside?' THEN 0.92 WHEN 'inside' THEN 0.94 WHEN 'partly?' THEN held WHEN 'partly' THEN held WHEN 'near' THEN fuzzy WHEN 'near?' THEN fuzzy ELSE 0 END)::DOUBLE AS confidence,
        CASE WHEN way = 'nothing' THEN 'unlisted' WHEN way IN ('exact', 'inside', 'partly', 'near') THEN 'matched' ELSE 'review' END AS status, CASE way WHEN 'exact' THEN CASE WHEN exact.own THEN 'exact' ELSE 'alias' END WHEN 'inside' THEN 'contains' WHEN 'partly' THEN 'contains' WHEN 'near' THEN 'fuzzy' ELSE 'none' END AS match,
        CASE WHEN way = 'exact' THEN exact.name WHEN way IN ('inside', 'inside?') THEN array_to_string(ti, ',') WHEN way IN ('partly', 'partly?') THEN array_to_string(tp, ',') WHEN way IN ('near', 'near?') THEN array_to_string(tn, ',') ELSE '' END AS candidates FROM d)
    SELECT s_suppkey, org, normalized, confidence, status, match, candidates FROM named JOIN e ON e.original = trim(org) WHERE original <> '' AND (status IN ('unlisted', 'review') OR original <> trim(normalized))""")
def q_inst_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _named(spark, sf_dir)
    matched = institutions.normalize_names(rows.select(F.col("org").alias("name")), institutions.dimension(spark))
    return institutions.corrections(rows, matched).select("s_suppkey", "org", "normalized", "confidence", "status", "match", "candidates")


_EVENT_TEXTS = [
    "（一）非循环贷账户", "账户1", "管理机构 借款金额", "余额 100", "(四)贷记卡账户", "账户二", "说明", "四查询记录", "（二 循环贷账户一", "账户", "循环贷账户 二", "账户状态 正常", "账户十 明细", "账户数", "发卡机构 额度", "相关还款责任信息", "信贷 账户", "(六) 授信协议信息", "账户信息汇总", "报告说明", "非循环贷账户", "账户标识账户"]
_EVENTS = f"""ev AS (SELECT DISTINCT l_orderkey AS doc_id, {_ORD} AS ord, {_pick_sql(_EVENT_TEXTS, '(l_partkey + l_linenumber)')} || CASE WHEN l_partkey % 3 = 0 THEN ' ' || (l_suppkey % 30) ELSE '' END AS text, (l_partkey + l_linenumber) % 8 IN (2, 3, 6) AS is_table FROM lineitem),
    mk AS (SELECT *, starts_with(plain, '四查询记录') OR plain IN ('查询记录', '报告说明', '编制说明') AS stop, CASE {" ".join(f"WHEN regexp_matches(plain, '[（(]{number}[）)]?{title}') OR plain = '{title}' THEN '{kind}'" for number, title, kind in segments.CATEGORY_TITLES)} END AS title,
        CASE WHEN NOT regexp_matches(plain, '账户状态|账户标识|账户授信额度|账户币种|账户关闭|账户数|账户信息汇总|循环贷账户|贷记卡账户') THEN nullif(regexp_extract(plain, '账户[0-9一二三四五六七八九十]+'), '') END AS mark FROM (SELECT *, regexp_replace(text, '\\s+', '', 'g') AS plain FROM ev))"""


def _events(spark, sf_dir) -> DataFrame:
    """Titles, stops, account marks, labels that look like them, and tables, some with a number behind them."""
    key = F.col("l_partkey") + F.col("l_linenumber")
    rows = t.read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), _ord().alias("ord"), (key % len(_EVENT_TEXTS)).alias("word"), F.when(F.col("l_partkey") % 3 == 0, F.col("l_suppkey") % 30).alias("number"), (key % 8).isin(2, 3, 6).alias("is_table"))
    text = F.concat(_pick(_EVENT_TEXTS, F.col("word")), F.coalesce(F.concat(F.lit(" "), F.col("number").cast("string")), F.lit("")))
    return t.distinct_by(rows, "doc_id").select("doc_id", "ord", text.alias("text"), "is_table")  # a word's place and a number tell texts apart


@query(f"WITH {_EVENTS} SELECT text, title AS category, stop, mark AS anchor, count(*) AS n FROM mk GROUP BY 1, 2, 3, 4")
def q_anchor_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("text")
    return _events(spark, sf_dir).groupBy("text").agg(F.count("*").alias("n")).select("text", segments.category_title(x).alias("category"), segments.is_stop_title(x).alias("stop"), segments.account_anchor(x).alias("anchor"), "n")


@query(f"""WITH {_EVENTS}, l AS (SELECT *, max(CASE WHEN NOT is_table AND (stop OR title IS NOT NULL) THEN ord END) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS at FROM mk)
    SELECT l.doc_id, l.ord, CASE WHEN NOT e.stop THEN e.title END AS category FROM l LEFT JOIN mk e ON e.doc_id = l.doc_id AND e.ord = l.at WHERE l.is_table""")
def q_stream_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.running_category(_events(spark, sf_dir))


@query(f"""WITH {_EVENTS}, l AS (SELECT *, max(CASE WHEN NOT is_table AND mark IS NOT NULL THEN ord END) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS at FROM mk)
    SELECT l.doc_id, l.ord, e.mark AS anchor FROM l LEFT JOIN mk e ON e.doc_id = l.doc_id AND e.ord = l.at WHERE l.is_table""")
def q_anchor_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.last_anchor(_events(spark, sf_dir))


@query(f"""WITH {_EVENTS}, m AS (SELECT doc_id, ord, text, is_table, NOT is_table AND stop AS stop, CASE WHEN NOT is_table AND NOT stop THEN title END AS title, CASE WHEN NOT is_table AND NOT stop AND title IS NULL THEN mark END AS mark FROM mk),
    l AS (SELECT *, max(CASE WHEN stop OR title IS NOT NULL THEN ord END) OVER w AS title_at, max(CASE WHEN stop OR title IS NOT NULL OR mark IS NOT NULL THEN ord END) OVER w AS reset_at FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    c AS (SELECT l.doc_id, l.ord, l.text, l.reset_at, e.title AS category, a.mark AS anchor FROM l JOIN m e ON e.doc_id = l.doc_id AND e.ord = l.title_at LEFT JOIN m a ON a.doc_id = l.doc_id AND a.ord = l.reset_at WHERE l.is_table AND e.title IS NOT NULL),
    d AS (SELECT *, coalesce(lag(reset_at) OVER (PARTITION BY doc_id ORDER BY ord) <> reset_at, true) OR regexp_matches(text, '管理机构|发卡机构|账户授信额度|借款金额') AS starts FROM c),
    s AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS segment FROM d)
    SELECT doc_id, segment, arg_min(category, ord) AS category, first(anchor ORDER BY ord) AS anchor, count(*) AS tables FROM s GROUP BY 1, 2""")
def q_account_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.account_segments(_events(spark, sf_dir))


@query(f"""WITH RECURSIVE p AS (SELECT l_orderkey AS doc_id, (l_linenumber // 2)::INT AS page, (l_partkey % 3 * 20)::DOUBLE AS y, l_suppkey::DOUBLE AS x, {_ORD} AS ord, CASE WHEN l_partkey % 5 = 0 THEN '账户3' ELSE '' END AS before, l_partkey % 4 = 0 AS hint,
        [CASE WHEN l_partkey % 3 = 0 THEN ['管理机构', '借款金额'] ELSE ['余额', l_partkey::VARCHAR] END, ['a', 'b']] AS cells FROM lineitem),
    t AS (SELECT *, array_to_string(cells[1], '|') AS head, row_number() OVER (PARTITION BY doc_id ORDER BY page, y, x, ord, before, hint) AS k FROM p),
    f AS (SELECT doc_id, k, 0 AS part, page, y, x, before, hint, cells, 1 AS n FROM t WHERE k = 1 UNION ALL
        SELECT doc_id, k, CASE WHEN joins THEN part ELSE part + 1 END, page, CASE WHEN beside AND joins THEN old.y ELSE y END, CASE WHEN joins THEN old.x ELSE x END, CASE WHEN joins THEN old.before ELSE before END, hint OR (joins AND old.hint),
            CASE WHEN NOT joins THEN cells WHEN beside THEN list_transform(list_zip(old.cells, cells), lambda z: list_concat(z[1], z[2])) ELSE list_concat(old.cells, CASE WHEN same THEN cells[2:] ELSE cells END) END, CASE WHEN joins THEN old.n + 1 ELSE 1 END
        FROM (SELECT *, page - old.page BETWEEN 0 AND 1 AND NOT (page = old.page AND y + 24 < old.y) AND (before = '' OR before = old.before) AND (beside OR (NOT level AND CASE WHEN same THEN NOT owns AND (hint OR old.hint OR before = '') ELSE NOT owns AND (len(old.cells) < 3 OR hint OR old.hint) END)) AS joins
            FROM (SELECT *, level AND x > old.x AND NOT same AND len(cells) = len(old.cells) AND len(cells) >= 2 AS beside
                FROM (SELECT t.*, f AS old, f.part, t.page = f.page AND abs(t.y - f.y) <= 24 AS level, head = array_to_string(f.cells[1], '|') AS same, regexp_matches(head, '管理机构|发卡机构|账户授信额度|借款金额') AS owns FROM (SELECT doc_id, k, part, page, y, x, before, hint, cells, n FROM f) f JOIN t ON t.doc_id = f.doc_id AND t.k = f.k + 1))))
    SELECT doc_id, part, n AS fragments, to_json(cells)::VARCHAR AS "table" FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, part ORDER BY k DESC) = 1""")
def q_fragment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces with and without primary headers at invented places, folded into tables."""
    k = F.col("l_partkey")
    head = F.when(k % 3 == 0, F.array(F.lit("管理机构"), F.lit("借款金额"))).otherwise(F.array(F.lit("余额"), k.cast("string")))
    rows = t.read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") / 2).cast("int").alias("page"), (k % 3 * 20).cast("double").alias("y"), F.col("l_suppkey").cast("double").alias("x"), _ord().alias("ord"), F.when(k % 5 == 0, "账户3").otherwise("").alias("preceding"), (k % 4 == 0).alias("hint"),
        F.array(head, F.array(F.lit("a"), F.lit("b"))).alias("rows"))
    return segments.merge_fragments(rows).select("doc_id", "part", "fragments", F.to_json("rows").alias("table"))


_MISREAD = ["贷己卡帐户", "巳用颁度", "佘额", "到期曰期", "五级分炎", "逾其", "查洵机枃", "己用额度", "自己用的", "锁户", "担保万式", "信贷交昜", "违纟", "窑福里", "还款其数", "循坏贷", "业务种炎"]


def _fix_sql(text: str) -> str:
    for wrong, right in segments.TEXT_FIXES:
        text = f"replace({text}, '{wrong}', '{right}')"
    return text


@query(f"SELECT p_partkey, {_fix_sql('raw')} AS text FROM (SELECT p_partkey, {_pick_sql(_MISREAD, 'p_partkey')} || p_name || {_pick_sql(_MISREAD, '(p_partkey // 17 + p_size)')} || {_pick_sql(_MISREAD, 'p_size')} AS raw FROM part)")
def q_ocr_context_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    raw = F.concat(_pick(_MISREAD, k), "p_name", _pick(_MISREAD, F.floor(k / 17) + size), _pick(_MISREAD, size))
    return t.read(spark, sf_dir, "part").select("p_partkey", segments.fix_context(raw).alias("text"))


@query("""WITH r AS (SELECT o_orderkey AS doc_id, 2020 + o_orderkey % 4 AS year, o_orderkey % 9 AS n FROM orders) SELECT doc_id, year::INT AS year, array_to_string(list_transform(range(1, 13), lambda i: CASE WHEN i <= n + 2 THEN ['N', '1', '*'][i % 3 + 1] ELSE '-' END), '') AS months FROM r WHERE n + 2 >= 6""")
def q_repay_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("o_orderkey") % 9 + 2).cast("int")
    codes = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit(" "), F.element_at(F.array(F.lit("N"), F.lit("1"), F.lit("*")), i % 3 + 1)))
    cells = F.concat(F.array(F.lit("年份"), (2020 + F.col("o_orderkey") % 4).cast("string")), codes, F.array(F.lit("x"), F.lit("")))
    rows = t.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("ord"), cells.alias("cells"))
    return segments.repayment_records(rows).select("doc_id", "year", F.array_join("months", "", "-").alias("months"))


_REASONS = ["货后管理。", " 贷款审批、", "本人查询（临柜）", "其他  原因；", "信用卡审批\u200b，。", "\u3000担保资格 审查", "异议核查.:", "", "公积金提取审查 。", "资信审查 贷款审批", "保前  审查"]
_PARTED = ["{0} {1}:{2}", "查询于{0}.{1}.{2}", "{0}:{1}.{2} 10:30", "{0}年{1}月", " {0} {1} {2}、"]


@query(f"""WITH c AS (SELECT event_id AS ord, list_concat(CASE WHEN event_id % 3 = 0 THEN ['序号1', '附注'] ELSE ['序号1'] END, [[{", ".join("'" + p.format("' || strftime(ts, '%Y') || '", "' || strftime(ts, '%m') || '", "' || strftime(ts, '%d') || '") + "'" for p in _PARTED)}][event_id % {len(_PARTED)} + 1]],
        CASE WHEN event_id % 19 = 0 THEN [] WHEN event_id % 7 = 0 THEN [' 本人 '] ELSE [' 机构' || event_id % 7] END, CASE WHEN event_id % 23 = 0 THEN [] ELSE [{_pick_sql(_REASONS, 'event_id')}] END) AS cells FROM events),
    f AS (SELECT *, list_position(list_transform(cells, lambda x: regexp_matches(x, '20\\d{{2}}[\\s.:]\\d{{2}}[\\s.:]\\d{{2}}')), true) AS place FROM c), r AS (SELECT ord, regexp_extract(cells[place], '20\\d{{2}}[\\s.:]\\d{{2}}[\\s.:]\\d{{2}}') AS found, trim(coalesce(cells[place + 1], '')) AS org,
        replace(trim(regexp_replace(trim(regexp_replace(regexp_replace(coalesce(cells[place + 2], ''), '[\\x{{200B}}-\\x{{200F}}\\x{{2028}}-\\x{{202F}}\\x{{FEFF}}\\x{{00A0}}\\x{{3000}}]', '', 'g'), '\\s+', ' ', 'g')), '[、，,.:;；。\\s]+$', '', 'g')), '货', '贷') AS plain FROM f WHERE place > 0)
    SELECT ord, CASE WHEN contains(org, '本人') THEN 'self' ELSE 'org' END AS kind, regexp_replace(regexp_replace(found, '[\\s:]', '.', 'g'), '\\.+', '.', 'g') AS date, org, CASE {" ".join(f"WHEN contains(plain, '{known}') THEN '{known}'" for known in KNOWN_REASONS)} ELSE plain END AS reason FROM r""")
def q_query_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a cell of a date in several spellings at several places, some without one or without what follows it."""
    k, day = F.col("event_id"), [F.date_format("ts", part) for part in ("yyyy", "MM", "dd")]
    dates = F.array(*[F.format_string(p.replace("{0}", "%1$s").replace("{1}", "%2$s").replace("{2}", "%3$s"), *day) for p in _PARTED])
    none = F.array().cast("array<string>")
    head = F.when(k % 3 == 0, F.array(F.lit("序号1"), F.lit("附注"))).otherwise(F.array(F.lit("序号1")))
    org = F.when(k % 19 == 0, none).when(k % 7 == 0, F.array(F.lit(" 本人 "))).otherwise(F.array(F.concat(F.lit(" 机构"), (k % 7).cast("string"))))
    cells = F.concat(head, F.array(F.element_at(dates, (k % len(_PARTED) + 1).cast("int"))), org, F.when(k % 23 == 0, none).otherwise(F.array(_pick(_REASONS, k))))
    return segments.query_rows(t.read(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), k.alias("ord"), cells.alias("cells"))).drop("doc_id")


@query("""WITH r AS (SELECT c_custkey AS doc_id, c_name, c_mktsegment, c_nationkey FROM customer) SELECT doc_id, '姓名' AS label, c_name AS value FROM r UNION ALL SELECT doc_id, '行业', c_mktsegment FROM r UNION ALL SELECT doc_id, '国家', CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey::VARCHAR ELSE 'N' || c_nationkey END FROM r""")
def q_label_value_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.col("c_nationkey").cast("string")
    band = F.array(
        F.array(F.lit("姓名"), F.lit("国家")), F.array(F.col("c_name"), F.when(F.col("c_nationkey") % 2 == 0, nation).otherwise("")), F.array(F.lit("行业"), F.lit("国家")), F.array(F.col("c_mktsegment"), F.concat(F.lit("N"), nation)))
    rows = t.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.posexplode(band).alias("r", "cells"))
    return segments.label_values(rows)


@query(f"""WITH v AS (SELECT l_orderkey AS doc_id, {_ORD} AS ord, (l_suppkey * 13 % 700)::DOUBLE AS lft, l_partkey AS value FROM lineitem), l AS (SELECT * FROM (VALUES ('余额', 150.0::DOUBLE), ('月供', 300.0::DOUBLE), ('额度', 450.0::DOUBLE)) x(label, lx)),
    n AS (SELECT doc_id, ord, value, arg_min(label, struct_pack(d := abs(lx - lft), a := lx)) AS label FROM v, l WHERE lft BETWEEN 50 AND 550 GROUP BY 1, 2, 3) SELECT doc_id, label, arg_min(value, ord) AS value FROM n GROUP BY 1, 2""")
def q_nearest_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = t.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), _ord().alias("ord"), (F.col("l_suppkey") * 13 % 700).cast("double").alias("left"), F.col("l_partkey").alias("value"))
    places = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(x).alias("left")) for n, x in (("余额", 150.0), ("月供", 300.0), ("额度", 450.0))])
    labels = t.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(places).alias("p")).select("doc_id", "p.label", "p.left")
    return segments.nearest_labels(labels, values)


@query(_ISSUES + "SELECT field, CASE WHEN field LIKE 'header.%' THEN 'personal' WHEN regexp_matches(field, '^[A-Za-z0-9]+\\[[0-9]+\\]\\.[A-Za-z0-9]+$') THEN 'credit' WHEN field LIKE 'accountDerived.%' THEN 'credit' WHEN field LIKE 'queryRecord%' THEN 'query' ELSE 'quality' END AS tab, TRY_CAST(nullif(regexp_extract(field, '\\[([0-9]+)\\]', 1), '') AS INT) AS row_index, regexp_extract(field, '([^.]*)$', 1) AS name, 'review-field-' || regexp_replace(field, '[^A-Za-z0-9_-]+', '-', 'g') AS anchor, count(*) AS n FROM issue GROUP BY 1, 2, 3, 4, 5")
def q_review_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.navigation(_issues(spark, sf_dir).groupBy("field").agg(F.count("*").alias("n")))


@query(_ISSUES + "SELECT severity, count(*) AS issues, count(CASE WHEN number % 3 = 0 THEN 1 END) AS reviewed, count(DISTINCT report_id) AS reports FROM issue GROUP BY 1")
def q_review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _issues(spark, sf_dir)
    return reviews.counts(found, found.filter("number % 3 = 0").select("report_id", "issue_id"))


@query(_ISSUES + "SELECT report_id, issue_id, CASE severity WHEN 'critical' THEN '严重' ELSE '警告' END AS level, field, CASE WHEN number % 3 = 0 THEN '已复核' ELSE '待复核' END AS state FROM issue WHERE severity IN ('critical', 'warning')")
def q_review_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _issues(spark, sf_dir)
    return reviews.export_rows(found, found.filter("number % 3 = 0").select("report_id", "issue_id"))


_COMMENTS = [
    ("1", "''", "CASE c_custkey % 4 {names} END", "'按名称' || CAST(c_custkey AS STRING)"), ("2", "CASE c_custkey % 3 {keys} ELSE '' END", "''", "'按键' || CAST(c_custkey AS STRING)"),
    ("3", "CASE c_custkey % 2 {keys} ELSE '' END", "'无此方案'", "'其后'")]
_SAID = " UNION ALL ".join(
    f"SELECT c_custkey AS report_id, {n} AS ord, {k} AS plan_key, {w} AS plan_name, {c} AS comment FROM customer".format(
        keys=" ".join(f"WHEN {i} THEN '{p[0]}'" for i, p in enumerate(PLANS)), names=" ".join(f"WHEN {i} THEN '{p[1]}'" for i, p in enumerate(PLANS))) for n, k, w, c in _COMMENTS)


@query(f"""WITH pl AS ({_PLANS_SQL}), cm AS ({_SAID}), nm AS (SELECT pl.report_id, key, ord, comment FROM pl JOIN cm ON cm.report_id = pl.report_id AND ((plan_key <> '' AND plan_key = key) OR (plan_name <> '' AND plan_name = name)))
    SELECT report_id, key, place, coalesce((SELECT arg_min(comment, ord) FROM nm WHERE nm.report_id = pl.report_id AND nm.key = pl.key), '测算' || key) AS comment FROM pl""")
def q_plan_comment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments on reports name a plan by its key or its name; the first that does stands, plans without one get a made text."""
    customers = t.read(spark, sf_dir, "customer")
    parts = [customers.selectExpr(*part.removeprefix("SELECT ").removesuffix(" FROM customer").split(", ")) for part in _SAID.split(" UNION ALL ")]
    return reviews.plan_comments(_plan_rows(spark, sf_dir), parts[0].union(parts[1]).union(parts[2]))


@query("""SELECT conv_id, turn, trim(text) AS summary, 2 AS sources, (turn + 1)::BIGINT AS priority FROM conversations""")
def q_llm_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with fences and words around them, made of the turns."""
    body = F.to_json(F.struct(F.col("text").alias("executiveSummary"), F.array(F.lit(" a "), F.lit(""), F.lit("b")).alias("primaryPressureSources"), (F.col("turn") + 1).alias("priority")))
    rows = t.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("结果如下\n```json\n"), body, F.lit("\n```\n完")).alias("answer"))
    return reviews.parse_answers(rows)


@query("SELECT page_id, array_to_string(list_filter([CASE WHEN page_id % 2 = 0 THEN '图像偏暗' END, CASE WHEN page_id % 3 = 0 THEN '页脚缺失' END, CASE WHEN page_id % 5 = 0 THEN '表格为空' END], lambda x: x IS NOT NULL), ',') AS issues FROM pages")
def q_issue_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    image = F.array_compact(F.array(F.when(k % 2 == 0, "图像偏暗")))
    paper = F.array_compact(F.array(F.when(k % 3 == 0, "页脚缺失"), F.when(k % 5 == 0, "表格为空")))
    return t.read(spark, sf_dir, "pages").select("page_id", F.array_join(F.concat(image, paper), ",").alias("issues"))
