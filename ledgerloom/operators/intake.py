"""From a recognition service's JSON to documents: layouts and tables, logical pages, corrected terms, fused candidates, prompt texts.

Rows are keyed by doc_id. What belongs to one page or one document (its lines, its
tables) is taken together in one row, as it arrives in one JSON text; nothing else is.
Null and malformed JSON gives no rows; missing arrays count as empty.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.texts import let
from ledgerloom.operators.documents import bounding_box, gutter, html_to_markdown
from ledgerloom.operators.folds import fold_rows
from ledgerloom.operators.segments import fix_context

_CELL = "struct<row:int,col:int,row_span:int,col_span:int,content:array<struct<content:array<bigint>>>>"
_BLOCK = f"struct<type:string,sub_type:string,text:string,pos:array<double>,`continue`:boolean,cells:array<{_CELL}>>"
_LINE = "struct<type:string,id:bigint,text:string,pos:array<double>>"
RESPONSE = f"result struct<pages:array<struct<page_id:string,height:double,width:double,structured:array<{_BLOCK}>,content:array<{_LINE}>>>>"
#: A footer's page number and page count; a page's height, and its width over its height where they are not given; a page's width.
FOOTER = r"第(\d+)页[，,。./\s]*共(\d+)页"
HEIGHT, STRETCH, WIDTH = 1190.0, 1.414, 842.0
#: Terms of a report of three or more characters and without digits, which misread ones are put right to.
TERMS = [
    "个人信用报告", "报告编号", "查询时间", "报告时间", "被查询者姓名", "被查询者证件类型", "被查询者证件号码", "查询机构", "查询原因", "身份信息", "配偶信息", "居住信息", "职业信息", "手机号码", "信息概要", "信贷交易信息提示",
    "信贷交易违约信息概要", "非循环贷账户", "循环贷账户", "贷记卡账户", "准贷记卡账户", "相关还款责任", "授信协议信息", "管理机构", "发卡机构", "业务种类", "担保方式", "借款金额", "授信额度", "共享授信额度", "已用额度", "账户状态", "五级分类",
    "剩余还款期数", "本月应还款", "应还款日", "本月实还款", "最近一次还款日期", "当前逾期期数", "当前逾期总额", "特殊交易", "还款记录", "开立日期", "到期日期", "还款频率", "还款方式", "共同借款标志", "大额专项分期信息", "查询记录",
    "机构查询记录明细", "本人查询记录明细", "贷后管理", "贷款审批", "信用卡审批", "担保资格审查", "人民币", "住房公积金", "养老保险金"]
HAN = "[一-龥]"
#: Scores from which a candidate table replaces one, by how much it must be better, and from which it is added.
REPLACE, MARGIN, APPEND = 18, 4, 28


def ingest_documents(responses: DataFrame) -> DataFrame:
    """Layouts of all pages of each response (doc_id, json): doc_id, page_num, page_id, page_width, page_height, layout_id, type, sub_type, text, box, merge_table, markdown, cells.

    Headers are dropped; titles are tagged; footers found among the raw lines are added;
    tables carry their markdown and the texts of their cells, taken from the lines they name.
    A response is parsed once; a page's lines are put in a map that its cells look into.
    """
    pages = responses.select("doc_id", F.posexplode(F.from_json("json", RESPONSE)["result"]["pages"]).alias("page_num", "p"))
    some = lambda column, kind: F.coalesce(column, F.array().cast(kind))
    kind = lambda x: F.coalesce(x["type"], F.lit(""))
    height = F.coalesce("p.height", F.lit(HEIGHT))
    name = lambda mark, n: F.format_string(f"p%d_{mark}%d", "page_num", n)

    def item(layout_id, kind_, sub_type, text, pos, merge_table=F.lit(None), markdown=F.lit(None), cells=F.lit(None)) -> Column:
        parts = {"layout_id": layout_id, "type": kind_, "sub_type": sub_type, "text": text, "box": bounding_box(pos), "merge_table": merge_table.cast("string"), "markdown": markdown.cast("string"), "cells": cells.cast("array<string>")}
        return F.struct(*[v.alias(n) for n, v in parts.items()])

    def items(page: Column) -> Column:
        """All layouts of a page, of which ``page`` holds blocks, lines and the texts by line id."""
        ids = lambda c: F.flatten(F.transform(some(c["content"], "array<struct<content:array<bigint>>>"), lambda x: some(x["content"], "array<bigint>")))
        cell = lambda c: F.array_join(F.filter(F.transform(ids(c), lambda i: F.try_element_at(page["by_id"], i)), lambda x: x != ""), "\n")
        tables = F.transform(F.filter(page["blocks"], lambda b: kind(b) == "table"), lambda b, n: item(
            name("t", n), F.lit("table"), F.lit(""), F.lit(""), b["pos"], F.when(b["continue"], "begin").otherwise(""),
            html_to_markdown(F.coalesce(b["text"], F.lit(""))), F.transform(some(b["cells"], f"array<{_CELL}>"), cell)))
        texts = F.filter(page["blocks"], lambda b: ~kind(b).isin("table", "header"))
        plain = F.transform(texts, lambda b, n: item(
            name("l", n), F.when((b["type"] == "textblock") & (b["sub_type"] == "text_title"), "title").otherwise("para"), F.coalesce(b["sub_type"], F.lit("")), F.coalesce(b["text"], F.lit("")), b["pos"]))
        footers = F.filter(page["lines"], lambda x: F.coalesce(x["text"], F.lit("")).rlike(FOOTER))
        footers = F.transform(footers, lambda x, n: item(name("footer", F.size(texts) + n), F.lit("para"), F.lit("footer"), x["text"], x["pos"]))
        return F.concat(tables, plain, footers)

    def last_texts(lines: Column) -> Column:
        """Line id to text; of lines with one id the last."""
        sorted_ = F.array_sort(F.transform(F.filter(lines, lambda x: x["id"].isNotNull()), lambda x, n: F.struct(x["id"].alias("id"), n.alias("n"), x["text"].alias("text"))))
        kept = let(sorted_, lambda s: F.filter(s, lambda x, n: ~F.get(s, n + 1)["id"].eqNullSafe(x["id"])))
        return F.map_from_entries(F.transform(kept, lambda x: F.struct(x["id"], x["text"])))

    lines = F.filter(some(F.col("p.content"), f"array<{_LINE}>"), lambda x: x["type"] == "line")
    # bound once for a page: the map must not be made again for each cell that looks into it
    page = let(lines, lambda x: F.struct(some(F.col("p.structured"), f"array<{_BLOCK}>").alias("blocks"), x.alias("lines"), last_texts(x).alias("by_id")))
    return pages.select(
        "doc_id", "page_num", F.coalesce("p.page_id", F.col("page_num").cast("string")).alias("page_id"), F.coalesce("p.width", F.floor(height * STRETCH + 0.5).cast("double")).alias("page_width"),
        height.alias("page_height"), F.inline(let(page, items)))


def logical_pages(layouts: DataFrame) -> DataFrame:
    """page_id, ord, logical_page, source of each layout (page_id, page_num, page_width, ord, x, y, w, text, is_footer).

    Footers tell the numbers of a page's left and right columns; where one is missing it
    follows from the other, where both are from the page's own number. Layouts belong to
    the column on their side of the footers' middle, of the gutter, or of the page's.
    """
    width = F.coalesce("page_width", F.lit(WIDTH))
    rows = layouts.withColumn("page_width", width)
    numbers = F.regexp_extract_all("text", F.lit(FOOTER), F.lit(1))
    hits = rows.filter(F.col("text").rlike(FOOTER)).select("page_id", "page_width", "ord", "x", "y", "is_footer", F.posexplode(numbers).alias("nth", "number"))
    page = Window.partitionBy("page_id")
    by_x = page.orderBy("x", "ord", "nth")
    hits = hits.withColumn("apart", F.coalesce(F.col("x") - F.lag("x").over(by_x) > F.col("page_width") * 0.05, F.lit(True)))
    hits = hits.withColumns({"sets": F.count_if("apart").over(page), "low": F.min("x").over(page), "high": F.max(F.when(F.col("apart"), F.col("x"))).over(page)})
    middle = F.when(F.col("sets") >= 2, (F.col("low") + F.col("high")) / 2).otherwise(F.col("page_width") / 2)
    hits = hits.withColumn("side", F.when(F.col("x") > middle, "r").otherwise("l"))
    best = hits.groupBy("page_id").agg(*[F.max_by(F.when(F.col("side") == s, F.struct(F.col("number").cast("long").alias("number"), "x")), F.when(F.col("side") == s, F.struct("is_footer", "y", -F.col("ord"), -F.col("nth")))).alias(s) for s in "lr"])
    boxes = rows.filter("NOT is_footer").select(F.col("page_id").alias("doc_id"), "ord", "x", "w", "page_width")
    out = rows.join(best, "page_id", "left").join(gutter(boxes).withColumnRenamed("doc_id", "page_id"), "page_id", "left")
    left, right, own = F.col("l.number"), F.col("r.number"), F.col("page_num") * 2 + 1
    split = F.when(F.abs(F.col("r.x") - F.col("l.x")) > F.col("page_width") * 0.1, (F.col("l.x") + F.col("r.x")) / 2)
    is_right = F.col("x") > F.coalesce(split, "split_x", F.col("page_width") / 2)
    both = left.isNotNull() & right.isNotNull()
    left_page = F.when(both, F.when(right > left, right - 1).otherwise(left)).when(left.isNotNull(), left).when(right.isNotNull(), F.greatest(F.lit(1), right - 1)).otherwise(own)
    right_page = F.when(both, F.when(right > left, right).otherwise(left + 1)).when(left.isNotNull(), left + 1).when(right.isNotNull(), right).otherwise(own + 1)
    return out.select("page_id", "ord", F.when(is_right, right_page).otherwise(left_page).alias("logical_page"), F.when(left.isNotNull() | right.isNotNull(), "footer").otherwise("fallback").alias("source"))


def term_variants(term: str) -> tuple[str, list[str]]:
    """A pattern for a term with any one character misread, and the other terms that it would take for it."""
    close = [t for t in TERMS if len(t) == len(term) and sum(a != b for a, b in zip(t, term)) == 1]
    return "|".join(f"{re.escape(term[:i])}{HAN}{re.escape(term[i + 1 :])}" for i in range(len(term))), close


def correct_terms(text: Column) -> Column:
    """Terms in which one Chinese character is misread, put right, term by term; other terms stay what they are."""
    for term in TERMS:
        pattern, close = term_variants(term)
        for k, other in enumerate(close):
            text = F.replace(text, F.lit(other), F.lit(chr(0xE000 + k)))
        text = F.regexp_replace(text, pattern, term)
        for k, other in enumerate(close):
            text = F.replace(text, F.lit(chr(0xE000 + k)), F.lit(other))
    return text


def correct_texts(texts: Column) -> Column:
    """Both corrections on an array of a document's texts: of layouts, tables and cells."""
    return F.transform(texts, lambda v: correct_terms(fix_context(v)))


_TABLE = {"page": "long", "x": "double", "y": "double", "w": "double", "h": "double", "score": "int", "signature": "string", "markdown": "string"}


class PageTables:
    """A page's tables by their box: the distinct boxes as columns, and of each box a heap of its tables, the best (then first) on top.

    The table that a candidate may replace is the best one of its box, so nothing but tops is ever looked at.
    """

    def __init__(self):
        self.at: dict[tuple, int] = {}
        self.heaps: list[list[tuple[float, int]]] = []
        self.boxes = np.full((6, 16), np.inf)  # x, y, w, h, and of the table on top the score below zero and the place

    def _show(self, k: int) -> None:
        self.boxes[4:, k] = self.heaps[k][0] if self.heaps[k] else (np.inf, np.inf)

    def put(self, box: tuple, score: int | None, place: int) -> None:
        k = self.at.setdefault(box, len(self.heaps))
        if k == len(self.heaps):
            self.heaps.append([])
            if k == self.boxes.shape[1]:
                self.boxes = np.concatenate([self.boxes, np.full_like(self.boxes, np.inf)], axis=1)
            self.boxes[:4, k] = [np.nan if v is None else v for v in box]
        heapq.heappush(self.heaps[k], (np.inf if score is None else -score, place))
        self._show(k)

    def take(self, k: int) -> int:
        place = heapq.heappop(self.heaps[k])[1]
        self._show(k)
        return place

    def under(self, box: tuple) -> int | None:
        """The box of the table that a candidate lies on: of most overlap, then of the best score, then the first."""
        x, y, w, h, score, place = self.boxes[:, : len(self.heaps)]
        cx, cy, cw, ch = (np.nan if v is None else v for v in box)
        small = np.fmin(w * h, cw * ch)  # a missing number is left out, as Spark's least and greatest do
        shared = np.fmax(0, np.fmin(x + w, cx + cw) - np.fmax(x, cx)) * np.fmax(0, np.fmin(y + h, cy + ch) - np.fmax(y, cy))
        ratio = np.divide(shared, small, out=np.zeros(len(x)), where=small > 0)
        near = (np.abs(x + w / 2 - cx - cw / 2) <= np.fmax(w, cw) * 0.35) & (np.abs(y + h / 2 - cy - ch / 2) <= np.fmax(h, ch) * 0.35)
        hits = np.flatnonzero(((ratio >= 0.35) | near) & (place < np.inf))
        if not len(hits):
            return None
        hits = hits[ratio[hits] == ratio[hits].max()]
        hits = hits[score[hits] == score[hits].min()]
        return int(hits[place[hits].argmin()])


def fuse_candidates(held: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, page, place, markdown, score: a document's tables after its candidates' tables were taken over, in their order.

    Both have doc_id, page, ord, x, y, w, h, score, signature, markdown; ``new`` also cand. A
    candidate table that lies on one of the document's replaces it where it is better by
    ``MARGIN``; one that lies on none is added where its score is high and its signature new.
    As each step depends on those before, a document's tables and then its candidates are folded
    as a stream, which tells each the place that it takes; of those that took a place the last one stays.
    """
    def step(state, t):
        turn = state["turn"] = state["turn"] + 1
        box, pages = (t["x"], t["y"], t["w"], t["h"]), state["pages"]
        if not t["is_new"]:
            place = state["places"]
            pages.setdefault(t["page"], PageTables()).put(box, t["score"], place)
        elif t["page"] is None or t["page"] not in pages:
            return state, (None, turn)
        else:
            own = pages[t["page"]]
            k = own.under(box)
            if k is None:
                if t["score"] < APPEND or t["signature"] is None or t["signature"] in state["seen"]:
                    return state, (None, turn)
                place = state["places"]
            elif own.boxes[4, k] < np.inf and t["score"] >= MARGIN - own.boxes[4, k]:
                place = own.take(k)
            else:
                return state, (None, turn)
            own.put(box, t["score"], place)
        state["places"] = max(state["places"], place + 1)
        state["seen"].add(t["signature"])
        return state, (place, turn)

    fields = [F.col(c).cast(kind).alias(c) for c, kind in _TABLE.items()]
    rows = held.select("doc_id", F.lit(False).alias("is_new"), F.lit(None).cast("long").alias("cand"), F.col("ord").cast("long").alias("ord"), *fields)
    rows = rows.unionByName(new.filter(F.col("score") >= REPLACE).select("doc_id", F.lit(True).alias("is_new"), F.col("cand").cast("long").alias("cand"), F.col("ord").cast("long").alias("ord"), *fields))
    start = lambda: {"turn": 0, "places": 0, "seen": set(), "pages": {}}
    told = fold_rows(rows, "doc_id", ["is_new", "cand", "page", "ord", *[c for c in _TABLE if c != "page"]], "place int, turn long", start, step).filter("place IS NOT NULL")
    last = told.groupBy("doc_id", "place").agg(F.max_by(F.struct("page", "markdown", "score"), "turn").alias("t"))
    return last.select("doc_id", "t.page", "place", "t.markdown", "t.score")


def prompt_text(facts: DataFrame) -> DataFrame:
    """report_id, prompt: facts (report_id, section, ord, text) as one text, sections in order, a heading above the lines of each.

    ``section`` is a struct of a section's place and title. A report's facts are a short list.
    """
    lines = facts.groupBy("report_id", "section").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("v"))
    part = F.concat(F.lit("【"), F.col("section.title"), F.lit("】\n"), F.array_join(F.transform("v", lambda x: F.concat(F.lit("- "), x["text"])), "\n"))
    parts = lines.select("report_id", F.struct(F.col("section.place").alias("place"), part.alias("text")).alias("s"))
    return parts.groupBy("report_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["text"]), "\n\n").alias("prompt"))
