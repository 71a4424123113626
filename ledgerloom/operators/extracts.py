"""Extraction operators: tables with their context, split tables, text fields by pattern, modules, routing of text layers.

Rows are keyed by doc_id; what needs a document's order is a window over one partition
by document, everything else is a projection or an aggregation.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.texts import occurrences, trim_all
from ledgerloom.operators.documents import markdown_rows, preceding_text, reading_order

#: Words of a report's text layer, and of its details; how many make a report; least text of a text layer.
REPORT_SIGNALS = ["个人信用报告", "报告编号", "报告时间", "本人版", "个人基本信息", "信息概要", "信贷交易信息明细", "查询记录", "管理机构", "发卡机构", "账户"]
DETAIL_SIGNALS = ["信贷交易信息明细", "非循环贷账户", "循环贷账户", "贷记卡账户", "相关还款责任", "授信协议"]
LEAST_SIGNALS, LEAST_TEXT, GOOD_SCORE = 3, 50, 0.86
#: Modules with their anchors in the text and their words in tables.
MODULES = [
    ("reportHeader", ["报告编号", "报告时间", "本人版"], ["报告编号"]),
    ("identity", ["身份信息"], ["性别", "出生日期", "婚姻状况"]),
    ("spouse", ["配偶信息"], ["配偶姓名", "配偶证件号码"]),
    ("residence", ["居住信息"], ["居住地址", "居住状况"]),
    ("job", ["职业信息"], ["工作单位", "单位地址", "进入本单位年份"]),
    ("infoSummary", ["二 信息概要", "信贷交易信息提示", "查询记录概要"], ["账户数", "管理机构数"]),
    ("creditDetail", ["三 信贷交易信息明细"], ["账户状态", "还款记录"]),
    ("nonRevolvingLoan", ["非循环贷账户"], ["借款金额", "剩余还款期数"]),
    ("revolvingLoan1", ["循环贷账户一"], ["循环贷账户一"]),
    ("revolvingLoan2", ["循环贷账户二"], ["账户授信额度", "管理机构"]),
    ("creditCard", ["贷记卡账户"], ["发卡机构", "卡机构", "账单日", "已用额度"]),
    ("repayResponsibility", ["相关还款责任信息"], ["还款责任金额", "责任人类型", "主业务借款人"]),
    ("creditAgreement", ["授信协议信息"], ["授信协议标识", "授信额度用途"]),
    ("queryRecord", ["四 查询记录", "机构查询记录明细", "本人查询记录明细"], ["查询日期", "查询机构", "查询原因"]),
    ("reportNote", ["报告说明"], ["本报告由中国人民银行征信中心出具"]),
]
SURE, LIKELY = 0.95, 0.75
_MARKS = "[（）()、，,.:：;；]"


def comparable(text: Column) -> Column:
    """A text without white space and common marks."""
    return F.regexp_replace(F.regexp_replace(text, r"[\s\x{3000}]", ""), _MARKS, "")


def recognized_modules(docs: DataFrame) -> DataFrame:
    """doc_id, module, hits, source of each module that a document's text or table text holds (doc_id, text, table_text)."""
    plain = docs.select("doc_id", comparable(F.col("text")).alias("text"), comparable(F.col("table_text")).alias("tables"))

    def many(column: str, words: list[str]) -> Column:
        return sum((occurrences(F.col(column), re.sub(rf"\s|{_MARKS}", "", w)) for w in words), F.lit(0))

    each = F.array(*[F.struct(F.lit(name).alias("module"), many("text", anchors).alias("a"), many("tables", words).alias("b")) for name, anchors, words in MODULES])
    found = plain.select("doc_id", F.explode(each).alias("m")).filter("m.a + m.b > 0")
    source = F.when((F.col("m.a") > 0) & (F.col("m.b") > 0), "mixed").when(F.col("m.a") > 0, "anchor").otherwise("table")
    return found.select("doc_id", "m.module", (F.col("m.a") + F.col("m.b")).alias("hits"), source.alias("source"))


def table_summary(tables: DataFrame) -> DataFrame:
    """doc_id, tables, markdown_rows, empty: a document's tables, their rows with headers, and tables without text."""
    blank = trim_all(F.coalesce("markdown", F.lit(""))) == ""
    rows = F.when(blank, 0).otherwise(F.size(markdown_rows(F.col("markdown"))))
    return tables.groupBy("doc_id").agg(F.count("*").alias("tables"), F.sum(rows).alias("markdown_rows"), F.sum(blank.cast("long")).alias("empty"))


def signals(text: Column, words: list[str]) -> Column:
    """How many of the words a text holds."""
    return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)))


def text_route(rows: DataFrame) -> DataFrame:
    """Rows with route (scan, ocr, text): a text layer that is too short is a scan; one whose words or parsed figures fall short is read again.

    Reads text, details (parsed detail items), parsed, critical (issues) and review.
    """
    plain = rows.withColumn("plain", F.regexp_replace("text", r"[\s\x{3000}]", ""))
    plain = plain.withColumns({"found": signals(F.col("plain"), REPORT_SIGNALS), "detail_words": signals(F.col("plain"), DETAIL_SIGNALS)})
    c = F.col
    again = (c("found") == 0) | ((c("found") < LEAST_SIGNALS) & ~c("parsed")) | ((c("detail_words") > 0) & (c("details") == 0))
    again = again | ((c("critical") > 0) & (c("found") < LEAST_SIGNALS + 1)) | (c("review") & (c("details") == 0) & ~c("parsed"))
    return plain.withColumn("route", F.when(F.char_length(trim_all(c("text"))) < LEAST_TEXT, "scan").when(again, "ocr").otherwise("text")).drop("plain", "detail_words")


def try_enhanced(score: Column, image_score: Column, image_issues: Column) -> Column:
    """Whether further candidates are worth their cost: a low score, a poor image, or an image with issues."""
    return (score < GOOD_SCORE) | F.coalesce((image_score < GOOD_SCORE) | (image_issues > 0), F.lit(False))


def by_patterns(text: Column, patterns: list[str]) -> tuple[Column, Column]:
    """The first pattern's match that a text holds, and how sure it is: most for the first pattern, less for others, 0 for none."""
    hits = [F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in patterns]
    return F.coalesce(*hits), F.when(hits[0].isNotNull(), SURE).when(F.coalesce(*hits).isNotNull(), LIKELY).otherwise(0.0)


def after_label(lines: DataFrame, label: str, value: str, reach: int = 10) -> DataFrame:
    """doc_id, value: the first match of ``value`` within ``reach`` lines after a line with ``label``; of the first such line that has one (doc_id, line, text)."""
    w = Window.partitionBy("doc_id").orderBy("line", "text")
    own = F.nullif(F.regexp_extract(F.trim("text"), value, 0), F.lit(""))
    rows = lines.withColumn("own", own).withColumns({"next": F.first("own", ignorenulls=True).over(w.rowsBetween(1, reach)), "k": F.row_number().over(w)})
    return rows.groupBy("doc_id").agg(F.min_by("next", F.when(F.col("text").rlike(label) & F.col("next").isNotNull(), F.col("k"))).alias("value"))


def context_tables(layouts: DataFrame, tables: DataFrame) -> DataFrame:
    """doc_id, ord, place, preceding, headers, n_rows of each table with rows, in reading order.

    Layouts (doc_id, layout_id, type, logical_page, y, x, ord, text) meet tables
    (doc_id, layout_id, markdown) by their ids; the nearest text above comes from an as-of
    window, and the order from another over the same partitioning.
    """
    held = tables.withColumn("rows", markdown_rows(F.col("markdown"))).filter(F.size("rows") > 0).select("doc_id", "layout_id", "rows")
    found = layouts.filter("type = 'table'").join(held, ["doc_id", "layout_id"]).select("doc_id", "ord", "logical_page", "y", "x", "rows")
    above = preceding_text(layouts.filter("type <> 'table'").select("doc_id", "logical_page", "y", "x", "text"), found.select("doc_id", "logical_page", "y", "ord"))
    placed = reading_order(found).join(above, ["doc_id", "ord"])
    return placed.select("doc_id", "ord", "place", "preceding", F.array_join(F.col("rows")[0], ",").alias("headers"), (F.size("rows") - 1).alias("n_rows"))


def split_lookahead(tables: DataFrame, least: int) -> DataFrame:
    """Tables (doc_id, ord, is_header, headers, rows), where a header table with fewer than ``least`` rows takes the next one's headers and rows if that is none.

    A table that is taken is no header table and so takes none itself: neighbours suffice.
    """
    w = Window.partitionBy("doc_id").orderBy("ord")
    rows = tables.withColumn("takes", F.col("is_header") & (F.size("rows") < least) & F.coalesce(~F.lead("is_header").over(w), F.lit(False)))
    rows = rows.withColumns({"taken": F.coalesce(F.lag("takes").over(w), F.lit(False)), "more": F.concat(F.array(F.lead("headers").over(w)), F.lead("rows").over(w))})
    grown = F.when(F.col("takes"), F.concat("rows", "more")).otherwise(F.col("rows"))
    return rows.filter("NOT taken").select("doc_id", "ord", "headers", grown.alias("rows"), F.col("takes").alias("merged"))
