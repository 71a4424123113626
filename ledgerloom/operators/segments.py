"""Order-sensitive operators over a document's tables: anchors, running categories, fragment merging, record rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ledgerloom.functions.texts import clean_query_date, clean_reason, trim_all

#: Category titles with their number, stop titles, and contextual corrections of misread text.
CATEGORY_TITLES = [("一", "非循环贷账户", "nonRevolvingLoan"), ("二", "循环贷账户一", "revolvingLoan1"), ("三", "循环贷账户二", "revolvingLoan2"), ("四", "贷记卡账户", "creditCard"), ("五", "相关还款责任信息", "repayResponsibility"), ("六", "授信协议信息", "creditAgreement")]
STOPS = ["查询记录", "报告说明", "编制说明"]
TEXT_FIXES = [
    ("窑福", "幸福"), ("佘额", "余额"), ("巳用", "已用"), ("己用额", "已用额"), ("曰期", "日期"), ("贷己卡", "贷记卡"), ("帐户", "账户"), ("循坏", "循环"), ("颁度", "额度"), ("锁户", "销户"), ("担保万式", "担保方式"), ("业务种炎", "业务种类"),
    ("还款其数", "还款期数"), ("逾其", "逾期"), ("五级分炎", "五级分类"), ("查洵", "查询"), ("机枃", "机构"), ("信贷交昜", "信贷交易"), ("违纟", "违约")]
PRIMARY = "管理机构|发卡机构|账户授信额度|借款金额"
NEAR_Y = 24


def fix_context(text: Column) -> Column:
    """Misread words that their neighbours give away, put right in order."""
    for wrong, right in TEXT_FIXES:
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return text


def _plain(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def category_title(text: Column) -> Column:
    return _title(_plain(text))


def _title(plain: Column) -> Column:
    out = F
    for number, title, kind in CATEGORY_TITLES:
        out = out.when(F.contains(plain, F.lit(title)) & (plain.rlike(f"[（(]{number}[）)]?{title}") | (plain == title)), kind)
    return out.otherwise(None)


def is_stop_title(text: Column) -> Column:
    return _stop(_plain(text))


def _stop(plain: Column) -> Column:
    return plain.startswith("四查询记录") | plain.isin(STOPS)


def account_anchor(text: Column) -> Column:
    """The account mark (账户 and a number) of a text; null for field labels and category titles."""
    return _anchor(_plain(text))


def _anchor(plain: Column) -> Column:
    found = F.nullif(F.regexp_extract(plain, r"账户[0-9一二三四五六七八九十]+", 0), F.lit(""))
    return F.when(~plain.rlike("账户状态|账户标识|账户授信额度|账户币种|账户关闭|账户数|账户信息汇总") & ~plain.rlike("循环贷账户|贷记卡账户"), found)


def running_category(events: DataFrame) -> DataFrame:
    """Tables (doc_id, ord, text, is_table) with the category of the last title before them; none after a stop title.

    A stop carries a struct with a null inside, so that it ends the category and is not skipped.
    """
    mark = F.when(is_stop_title(F.col("text")), F.struct(F.lit(None).cast("string").alias("kind"))).when(category_title(F.col("text")).isNotNull(), F.struct(category_title(F.col("text")).alias("kind")))
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("last", F.last(F.when(~F.col("is_table"), mark), ignorenulls=True).over(w))
    return rows.filter("is_table").select("doc_id", "ord", F.col("last.kind").alias("category"))


def last_anchor(events: DataFrame) -> DataFrame:
    """Tables with the last account mark above them (doc_id, ord, text, is_table)."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("anchor", F.last(F.when(~F.col("is_table"), account_anchor(F.col("text"))), ignorenulls=True).over(w))
    return rows.filter("is_table").select("doc_id", "ord", "anchor")


def account_segments(events: DataFrame) -> DataFrame:
    """doc_id, segment, category, anchor, tables: runs of tables under one category and account mark.

    A table with a primary header starts a segment of its own where no mark stands before
    it. Category, mark and start are local to each row, so segments are a running sum.
    """
    order = Window.partitionBy("doc_id").orderBy("ord")
    w = order.rowsBetween(Window.unboundedPreceding, 0)
    # texts are read once, and only what they tell is sorted
    rows = events.select("doc_id", "ord", "is_table", F.when(F.col("is_table"), F.coalesce(F.col("text").rlike(PRIMARY), F.lit(False))).alias("primary"), F.when(~F.col("is_table"), _plain(F.col("text"))).alias("plain"))
    rows = rows.select("doc_id", "ord", "is_table", "primary", F.coalesce(_stop(F.col("plain")), F.lit(False)).alias("stop"), _title(F.col("plain")).alias("title"), _anchor(F.col("plain")).alias("name"))
    turn = F.col("stop") | F.col("title").isNotNull()
    mark = F.when(turn, F.struct(F.when(~F.col("stop"), F.col("title")).alias("kind")))
    label = F.when(turn | F.col("name").isNotNull(), F.struct(F.when(~turn, F.col("name")).alias("name")))
    rows = rows.withColumns({"c": F.last(mark, ignorenulls=True).over(w), "a": F.last(label, ignorenulls=True).over(w), "cut": F.sum(label.isNotNull().cast("int")).over(w)})
    rows = rows.filter("is_table AND c.kind IS NOT NULL")
    starts = (F.lag("cut").over(order).isNull()) | (F.lag("cut").over(order) != F.col("cut")) | F.col("primary")
    rows = rows.withColumn("segment", F.sum(starts.cast("int")).over(w))
    # category and mark are the same throughout a segment
    return rows.groupBy("doc_id", "segment", F.col("c.kind").alias("category"), F.col("a.name").alias("anchor")).agg(F.count("*").alias("tables"))


def merge_fragments(tables: DataFrame) -> DataFrame:
    """doc_id, part, rows, fragments: neighbouring pieces of one table put together, left to right.

    Each step looks at the merged table, so a document's tables in reading order are folded
    as a stream, which carries the open table's place, headers and number of rows.
    A piece joins where it has no text of its own before it (or the same), its page is the
    same or the next, and it is either beside the table (same height, other headers, as many
    rows) or below it (headers without a primary label, or the same headers and a hint).
    Pieces are dealt and sorted once: the task that folds them hands out tables as soon as
    others begin, and holds one batch and the pieces of the open table.
    """
    pieces = tables.filter(F.size("rows") > 0).select(
        "doc_id", "page", "y", "x", "ord", F.coalesce(F.regexp_replace("preceding", r"\s+", ""), F.lit("")).alias("before"), F.coalesce("hint", F.lit(False)).alias("hint"), "rows")
    pieces = pieces.repartition("doc_id").sortWithinPartitions("doc_id", *[F.col(c).asc_nulls_last() for c in ("page", "y", "x", "ord")], "before", "hint", "rows")
    # headers are read off the rows after these were dealt out, so that they need not travel
    head = F.array_join(F.transform(F.get("rows", F.lit(0)), lambda c: F.regexp_replace(c, r"\s+", "")), "|")
    pieces = pieces.select("doc_id", "page", "y", "x", "before", "hint", "rows", F.coalesce(head, F.lit("")).alias("head")).withColumn("primary", F.col("head").rlike(PRIMARY))
    made = StructType([pieces.schema["doc_id"], StructField("part", IntegerType()), pieces.schema["rows"], StructField("fragments", IntegerType())])
    return pieces.mapInArrow(_merged, made)


def _merged(batches):
    """Tables of sorted pieces. Each piece is told its part and the row there at which it begins; a null place is near nothing."""
    held, doc = [], object()
    for batch in batches:
        rows, seen = batch["rows"], [batch[c].to_numpy(zero_copy_only=False).tolist() for c in ("page", "y", "x", "before", "hint", "head", "primary")]
        begins, parts, firsts, skips = [], [], [], []
        for key, n, page, y, x, before, hint, head, primary in zip(batch["doc_id"].to_pylist(), rows.value_lengths().to_pylist(), *seen):
            same = beside = below = False
            known = key == doc
            if known and 0 <= page - last_page <= 1 and before in ("", own_before) and (page > last_page or y + NEAR_Y >= last_y):
                same = head == own_head
                if page == last_page and abs(y - last_y) <= NEAR_Y:
                    beside = x > own_x and not same and n == size and n >= 2
                elif not primary:
                    below = hint or hinted or (before == "" if same else size < 3)
            skip = int(below and same)
            if beside:
                first, hinted = 0, hinted or hint
                own_head += "|" + head  # by itself, so that Python appends in place
            elif below:
                first, hinted, last_y, size = size - skip, hinted or hint, y, size + n - skip
            else:
                doc, part, first = key, part + 1 if known else 0, 0
                hinted, last_y, own_x, own_before, own_head, size = hint, y, x, before, head, n
            last_page = page
            begins.append(not (beside or below))
            parts.append(part)
            firsts.append(first)
            skips.append(skip)
        told = [pa.array(begins, pa.bool_()), pa.array(parts, pa.int32()), pa.array(firsts, pa.int64()), pa.array(skips, pa.int64())]
        pieces = pa.RecordBatch.from_arrays([batch["doc_id"], rows, *told], names=["doc_id", "rows", "begins", "part", "first", "skip"])
        cuts = np.flatnonzero(begins)
        if len(cuts):
            yield from _stacked([*held, pieces.slice(0, cuts[-1])])
            held, pieces = [], pieces.slice(cuts[-1])
        held.append(pieces)
    yield from _stacked(held)


def _stacked(held: list):
    """Whole tables' pieces as one row a table: pieces of a row come side by side, rows one below the other, and repeated headers stand on none."""
    pieces = pa.concat_batches(held) if held else []
    if not len(pieces):
        return
    size, first, skip = pieces["rows"].value_lengths().to_numpy(), pieces["first"].to_numpy(), pieces["skip"].to_numpy()
    starts = np.flatnonzero(pieces["begins"].to_numpy(zero_copy_only=False))
    fragments = np.diff(np.append(starts, len(pieces)))
    piece = np.repeat(np.arange(len(pieces)), size)
    r = np.arange(len(piece)) - np.repeat(np.cumsum(size) - size, size)
    kept = np.flatnonzero(r >= skip[piece])
    table, line = np.repeat(np.arange(len(starts)), fragments)[piece[kept]], (first[piece] + r)[kept]
    order = np.lexsort((line, table))  # keeps pieces of a line in order
    table, line = table[order], line[order]
    cells = pieces["rows"].flatten().take(pa.array(kept[order]))
    width = cells.value_lengths().fill_null(0).to_numpy()
    at = np.flatnonzero(np.append(True, (table[1:] != table[:-1]) | (line[1:] != line[:-1])))
    void = np.logical_or.reduceat(cells.is_null().to_numpy(zero_copy_only=False), at)
    ends = np.append(0, np.cumsum(width))[np.append(at, len(width))]
    lines = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells.flatten(), type=cells.type, mask=pa.array(void) if void.any() else None)
    ends = np.append(np.flatnonzero(np.append(True, np.diff(table[at]) != 0)), len(at))
    rows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lines, type=pieces["rows"].type)
    yield pa.RecordBatch.from_arrays([pieces["doc_id"].take(pa.array(starts)), pieces["part"].take(pa.array(starts)), rows, pa.array(fragments, pa.int32())], names=["doc_id", "part", "rows", "fragments"])


def repayment_records(rows: DataFrame) -> DataFrame:
    """doc_id, ord, year, months: rows with a year and at least six status codes after it; twelve months, null where none is left."""
    cells = F.transform("cells", lambda c: F.regexp_replace(c, r"\s", ""))
    at = F.array_position(F.transform(cells, lambda c: c.rlike(r"^20\d{2}$")), F.lit(True)).cast("int")
    codes = F.slice(F.filter(F.slice(cells, at + 1, F.size(cells)), lambda c: c.rlike(r"^([1-7NCDGZ*/#])$")), 1, 12)
    found = rows.filter(at > 0).select("doc_id", "ord", F.try_element_at(cells, at).cast("int").alias("year"), codes.alias("codes")).filter("size(codes) >= 6")
    months = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.try_element_at("codes", i))
    return found.select("doc_id", "ord", "year", months.alias("months"))


def query_rows(rows: DataFrame) -> DataFrame:
    """doc_id, ord, kind, date, org, reason: the date cell of a row and the two cells after it; the person's own queries apart."""
    at = F.array_position(F.transform("cells", lambda c: c.rlike(r"20\d{2}[\s.:]\d{2}[\s.:]\d{2}")), F.lit(True)).cast("int")
    cell = lambda k: F.coalesce(F.try_element_at("cells", at + k), F.lit(""))
    found = rows.filter(at > 0).select("doc_id", "ord", clean_query_date(cell(0)).alias("date"), trim_all(cell(1)).alias("org"), clean_reason(cell(2)).alias("reason"))
    return found.withColumn("kind", F.when(F.contains("org", F.lit("本人")), "self").otherwise("org"))


def label_values(rows: DataFrame) -> DataFrame:
    """doc_id, label, value: rows of labels above rows of values, paired by place; of several the first non-empty value (doc_id, r, cells)."""
    below = F.lead("cells").over(Window.partitionBy("doc_id").orderBy("r"))
    pairs = rows.withColumn("below", below).filter("r % 2 = 0 AND below IS NOT NULL").select("doc_id", "r", F.posexplode(F.arrays_zip("cells", "below")).alias("c", "p"))
    pairs = pairs.select("doc_id", "r", "c", F.col("p.cells").alias("label"), F.col("p.below").alias("value"))
    return pairs.filter("coalesce(value, '') <> ''").groupBy("doc_id", "label").agg(F.min_by("value", F.struct("r", "c")).alias("value"))


def nearest_labels(labels: DataFrame, values: DataFrame, reach: float = 100.0) -> DataFrame:
    """doc_id, label, value: values within ``reach`` of the labels' span go to the nearest label; the first value of a label stays.

    Labels of a document travel as one small array with its values; no pairs are joined.
    """
    span = labels.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("left", "label"))).alias("at"))
    rows = values.join(span, "doc_id")
    first, last = F.element_at("at", 1)["left"], F.element_at("at", -1)["left"]
    rows = rows.filter(F.col("left").between(first - reach, last + reach))
    near = F.array_min(F.transform("at", lambda a: F.struct(F.abs(a["left"] - F.col("left")).alias("d"), a["left"].alias("l"), a.label.alias("label"))))
    return rows.withColumn("label", near.label).groupBy("doc_id", "label").agg(F.min_by("value", "ord").alias("value"))
