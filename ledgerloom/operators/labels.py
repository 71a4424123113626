"""Values by label: which cells are a label, where its value stands, and accounts read from tables of both.

A table is a grid of rows of cells, its headers first. Only labels that share enough
characters with a cell to be contained or similar are compared with it. Tasks go through
their tables once and remember what a text is, as labels and many values repeat; what
they find of a table meets in one shuffle by its id.
Null cells count as empty; a table without rows gives no value.
"""

from __future__ import annotations

import re
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ledgerloom.functions.amounts import parse_number
from ledgerloom.functions.texts import clean_org, clean_status, lcs_length, let

#: Labels that are not taken for each other, misread labels put right, and words that make a text a label.
CONFLICTS = [
    ("证件类型", "证件号码"), ("开立日期", "到期日期"), ("本月应还款", "本月实还款"), ("查询机构", "管理机构"),
    ("授信协议标识", "账户授信额度"), ("授信协议标识", "授信额度"), ("账户标识", "账户授信额度"), ("账户标识", "授信额度")]
MISREAD = [("僧款", "借款"), ("管利", "管理"), ("管机", "管理机"), ("到日期", "到期日期"), ("期日期", "到期日期")]
LABEL_WORDS = "机构|种类|方式|状态|额度|余额|日期|还款|期数|分类|币种|账户|金额|借款|利率|标识|合同|到期|开立|证件|编号|授信|账单"
DATE = r"\d{4}[.\-/年]\d{1,2}[.\-/月]\d{1,2}日?"
#: Least similarity of labels of up to 4, up to 6, and more characters.
SIMILAR = (0.74, 0.68, 0.62)
PAYMENT = ["本月应还款", "本月应还", "应还款额", "本期应还"]
#: Fields of a loan and of a card, their kinds and labels.
LOAN_FIELDS = [
    ("org", "text", ["管理机构"]), ("open_date", "date", ["开立日期"]), ("end_date", "date", ["到期日期"]), ("amount", "amount", ["借款金额", "账户授信额度", "授信额度"]), ("currency", "text", ["账户币种"]),
    ("business_type", "text", ["业务种类"]), ("guarantee_type", "text", ["担保方式"]), ("terms", "amount", ["还款期数"]), ("repay_method", "text", ["还款方式"]), ("status", "text", ["账户状态"]),
    ("five_category", "text", ["五级分类"]), ("balance", "amount", ["余额", "佘额"]), ("remain_terms", "amount", ["剩余还款期数", "剩余期数", "剩余还款"]), ("monthly_payment", "amount", PAYMENT),
    ("due_date", "date", ["应还款日"]), ("actual_payment", "amount", ["本月实还款"]), ("overdue_terms", "amount", ["当前逾期期数"]), ("overdue_amount", "amount", ["当前逾期总额"])]
CARD_FIELDS = [
    ("org", "text", ["发卡机构", "卡机构", "机构"]), ("account_id", "text", ["账户标识", "账户保识", "账户标R"]), ("open_date", "date", ["开立日期"]), ("credit_limit", "amount", ["账户授信额度"]),
    ("shared_limit", "amount", ["共享授信额度"]), ("currency", "text", ["币种"]), ("status", "text", ["账户状态", "户状态"]), ("used_amount", "amount", ["已用额度", "巳用额度"]), ("bill_date", "date", ["账单日"]),
    ("monthly_payment", "amount", PAYMENT), ("actual_payment", "amount", ["本月实还款"])]
#: Fields of an account's brief: labels of loans, and of cards where they differ.
BRIEF_FIELDS = [("org", "text", ["管理机构"]), ("open_date", "date", ["开立日期"]), ("status", "text", ["账户状态"]), ("credit_amount", "amount", ["借款金额"]), ("balance", "amount", ["余额"]), ("monthly_payment", "amount", PAYMENT)]
CARD_BRIEF = {"org": ["发卡机构"], "credit_amount": ["授信额度"], "balance": ["已用额度"]}
CATEGORY_LABELS = {"nonRevolvingLoan": "非循环贷账户", "revolvingLoan1": "循环贷账户一", "revolvingLoan2": "循环贷账户二", "creditCard": "贷记卡账户", "repayResponsibility": "相关还款责任信息", "creditAgreement": "授信协议信息"}
#: Misread words in what names a category, and how a limit's label may read.
MISREAD_EVIDENCE = [("管利", "管理"), ("管机", "管理机"), ("僧款", "借款")]
LIMIT_LABELS = "授信额度|投信额度|受信额度|授销额度"
NOT_AN_ORG = "账户|日期|额度|币种|业务|担保|状态|账单|还款|记录|授信"
ORG_WORDS = "银行|银|公司|股份|分行|支行|中心|金融|贷款|租赁"


def normal_label(text: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(text, r"\s+", ""), "[■□�：:()（）]", "")
    for wrong, right in MISREAD:
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return F.regexp_replace(text, r"[^\x{4e00}-\x{9fa5}A-Za-z0-9]", "")


def conflicting(value: Column, target: Column) -> Column:
    pairs = F.expr("array(" + ", ".join(f"struct('{p}' AS p, '{q}' AS q)" for a, b in CONFLICTS for p, q in ((a, b), (b, a))) + ")")
    return F.exists(pairs, lambda x: F.contains(target, x["q"]) & F.contains(value, x["p"]))


def label_matches(value: Column, target: Column) -> Column:
    """Whether a normalized text is the normalized label: contained, one character short, or similar enough."""
    n, m = F.char_length(value), F.char_length(target)
    near = F.contains(target, value) & (m - n <= 1) & (n >= F.least(F.lit(3), m))
    least = F.when(m <= 4, SIMILAR[0]).when(m <= 6, SIMILAR[1]).otherwise(SIMILAR[2])
    # lengths alone rule out most texts
    similar = (m > 2) & (n >= least * m) & (n * least <= m) & ~((target == "管理机构") & F.contains(value, F.lit("查询机构")))
    similar = F.when(similar, lcs_length(value, target) / F.greatest(n, m) >= least).otherwise(False)
    return F.when((value == "") | (target == "") | conflicting(value, target), False).when(F.contains(value, target) | near, True).otherwise(similar)


def group_value(row: Column, at: Column, size: int) -> Column:
    """The first non-empty value of the group of ``size`` cells that cell ``at`` (from 0 on) belongs to."""
    cells = F.transform(F.slice(row, (F.floor(at / size) * size).cast("int") + 1, size), lambda v: F.trim(v))
    return F.coalesce(F.get(F.filter(cells, lambda v: v != ""), F.lit(0)), F.lit(""))


def _plain_word(word: str) -> str:
    """A label's normal form, for building the index."""
    for wrong, right in MISREAD:
        word = word.replace(wrong, right)
    return re.sub(r"[^\u4e00-\u9fa5A-Za-z0-9]", "", word)


class LabelIndex:
    """Which labels a text may be: from a character to the labels that have it, and how many distinct ones each asks for.

    A label of m characters, d of them distinct, is contained (all d); or all but one of it is
    the text (d - 1, from four characters on); or it is similar, which leaves out floor(m (1 - least)) of
    its characters at most (from three on).
    """

    def __init__(self, words: list[str]):
        self.words = sorted({_plain_word(w) for w in words})
        self.place = {w: k for k, w in enumerate(self.words)}
        by_char: dict[str, list[int]] = {}
        for k, w in enumerate(self.words):
            for c in sorted(set(w)):
                by_char.setdefault(c, []).append(k)
        ints = lambda values: f"array({', '.join(map(str, values))})"
        # as statements, as these are hundreds of literals
        self.by_char = F.expr("map(" + ", ".join(f"'{c}', {ints(own)}" for c, own in sorted(by_char.items())) + ")")
        self.need = F.expr(ints(map(self._least_shared, self.words)))
        self.targets = F.expr("array(" + ", ".join(f"'{w}'" for w in self.words) + ")")

    @staticmethod
    def _least_shared(word: str) -> int:
        m, d = len(word), len(set(word))
        least = SIMILAR[0 if m <= 4 else 1 if m <= 6 else 2]
        apart = int(m * (1 - least) + 1e-9) if m > 2 else 0
        return max(1, d - max(apart, 1 if m >= 4 else 0))

    def place_of(self, word: str) -> int:
        return self.place[_plain_word(word)]

    def candidates(self, label: Column) -> Column:
        """Places of the labels that share enough distinct characters with a normalized text."""
        shared = F.flatten(F.transform(F.array_distinct(F.split(label, "")), lambda c: F.coalesce(F.try_element_at(self.by_char, c), F.array().cast("array<int>"))))
        return let(shared, lambda hits: F.filter(F.array_distinct(hits), lambda k: F.size(F.filter(hits, lambda h: h == k)) >= F.element_at(self.need, k + 1)))

    def matches(self, label: Column) -> Column:
        """Places of the labels that a normalized text is."""
        return F.filter(self.candidates(label), lambda k: label_matches(label, F.element_at(self.targets, k + 1)))


#: Java's end of a text, which may stand before a last line break; its classes are ASCII.
_END = r"(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)"
_find = lambda pattern: re.compile(pattern.replace("$", _END), re.ASCII).search
_figures, _words, _date, _year, _dashes = _find(r"^[-—－\d,.\s￥¥元]+$"), _find(LABEL_WORDS), _find(DATE), _find(r"\d{4}\s*年"), _find("^[-—－]+$")
_day, _number, _short, _not_amount = _find("^(?:[1-9]|[12][0-9]|3[01])$"), _find(r"-?\d[\d,.]*"), _find("^[0-9]{1,2}$"), _find("授信协议标识|账户标识|协议标识|^[A-Za-z]")
_chinese = _find("[\u4e00-\u9fa5]")
#: Points for a label that is the target, or not; that holds it; and for places: below, right and what follows in the cell, by steps to the right.
SAME, OTHER, HOLDS = 120, 80, 20
PLACES = [("inline", 0, 26), ("below", 0, 62), ("right", 1, -6), ("below", 1, 0), ("right", 2, -14), ("below", 2, -8)]
#: Texts that a task remembers at a time.
REMEMBERED = 100_000


def _id_like(text: str) -> bool:
    plain = re.sub("[^A-Za-z0-9]", "", text)
    return len(plain) >= 8 and not plain.isdigit() and not plain.isalpha()


def _is_label_like(text: str) -> bool:
    return bool(_words(text)) and not _figures(text)


def nature(text: str) -> str:
    """What a text is, the first that fits: label, none, date, dashes, id (eight or more letters and digits, both kinds), plain."""
    if _is_label_like(text):
        return "label"
    v = re.sub("[￥¥元]", "", text.strip(" "))
    if v == "":
        return "none"
    if _date(v) or _year(v):
        return "date"
    return "dashes" if _dashes(v) else "id" if _id_like(v) else "plain"


def date_in(text: str) -> str:
    """The first date of a text with points, or a day of the month that is all of it."""
    text = text.strip(" ")
    if found := _date(text):
        return re.sub("年|月", ".", found[0]).replace("日", "")
    return found[0] if (found := _day(text)) else ""


def _after_label(text: str, labels: list[str]) -> str:
    """What follows the first label that a text holds with something after it."""
    for w in labels:
        if w in text:
            rest = re.sub(r"^[：:\s\-]+", "", text[text.index(w) + len(w) :], flags=re.ASCII).strip(" ")
            if rest:
                return rest
    return ""


def _plain_value(text: str, kind: str) -> str:
    """A text as a value of a kind: itself, its first number, or a date; empty where it is none."""
    if kind == "date":
        return date_in(text)
    if kind != "amount":
        return "" if _is_label_like(text) else text
    own = nature(text)
    if own != "plain":
        return "0" if own == "dashes" else ""
    found = _number(re.sub("[￥¥元]", "", text.strip(" ")))
    return found[0] if found and nature(found[0]) != "date" else ""


def find_value(raw: str, labels: list[str], kind: str) -> str:
    """The first line of a candidate that is a value of its kind."""
    for line in raw.split("\n"):
        text = _after_label(line, labels) or line.strip(" ")
        if text and not any(w in text for w in labels):
            if value := _plain_value(text, kind):
                return value
    return ""


def label_points(label: str, target: str, kind: str) -> int:
    """What speaks for a label's candidates, whatever they are."""
    total = (SAME if label == target else OTHER) + (HOLDS if target in label else 0)
    if kind == "amount":
        total += (40 if "授信额度" in label else 0) + (12 if any(w in label for w in ("金额", "额度", "余额", "还款")) else 0)
    return total


def raw_points(raw: str, value: str, kind: str) -> int | None:
    """What speaks for a candidate by itself; None for an amount that is an identifier."""
    if kind == "date":
        return 20 if nature(value) == "date" else 0
    if kind != "amount":
        return 0
    plain = re.sub(r"\s+", "", raw, flags=re.ASCII)
    if _not_amount(plain) or _id_like(plain):
        return None
    return (8 if "元" in raw or "￥" in raw or "¥" in raw or "," in raw else 0) - (20 if _short(value) else 0)


def is_label(value: str, target: str) -> bool:
    """:func:`label_matches` of two plain texts."""
    n, m = len(value), len(target)
    if not n or not m or any((p in value and q in target) or (q in value and p in target) for p, q in CONFLICTS):
        return False
    if target in value or (value in target and m - n <= 1 and n >= min(3, m)):
        return True
    least = SIMILAR[0 if m <= 4 else 1 if m <= 6 else 2]
    if m <= 2 or n < least * m or n * least > m or (target == "管理机构" and "查询机构" in value):
        return False
    row = [0] * (m + 1)
    for c in value:
        before = row
        row = [0]
        for j, d in enumerate(target):
            row.append(before[j] + 1 if c == d else max(before[j + 1], row[j]))
    return row[m] / max(n, m) >= least


class Finder:
    """A task's memory of what cells are: the fields of a label, and a candidate's value and points. Tables repeat their labels, so that most are looked up."""

    def __init__(self, fields: list[tuple[str, str, list[str]]]):
        self.fields = [(kind, labels, [_plain_word(w) for w in labels]) for _, kind, labels in fields]
        self.least = {w: (set(w), LabelIndex._least_shared(w)) for *_, words in self.fields for w in words}
        self.names, self.values, self.simple = {}, {}, {}

    def fields_of(self, cell: str) -> list[tuple[int, int, str]]:
        """The fields that a cell is a label of, each with the first of its labels that fits: place, points for that, what follows the label."""
        if not _chinese(cell):
            return []
        label = _plain_word(re.sub("[■□�：:()（）]", "", re.sub(r"\s+", "", cell, flags=re.ASCII)))
        chars = set(label)
        fits = {w for w, (own, least) in self.least.items() if len(own & chars) >= least and is_label(label, w)}
        return [(k, label_points(label, target, kind), _after_label(cell, labels)) for k, (kind, labels, words) in enumerate(self.fields) if (target := next((w for w in words if w in fits), None))]

    def _valued(self, raw: str, value: str, kind: str) -> tuple[str, int] | None:
        points = raw_points(raw, value, kind) if value else None
        return None if points is None else (value, points)

    def value_of(self, raw: str, k: int) -> tuple[str, int] | None:
        """A candidate's value for a field and what speaks for it; one without line breaks and the field's labels is the same for all fields of a kind."""
        kind, labels, _ = self.fields[k]
        if "\n" in raw or any(w in raw for w in labels):
            return self._valued(raw, find_value(raw, labels, kind), kind)
        if (raw, kind) not in self.simple:
            text = raw.strip(" ")
            self.simple[raw, kind] = self._valued(raw, _plain_value(text, kind) if text else "", kind)
        return self.simple[raw, kind]

    def best(self, grid: list) -> list[dict | None]:
        """For each field its best candidate's rank and value. Of equal points the upper, then the left label's leads, then the nearer place."""
        rank, found = [0] * len(self.fields), [None] * len(self.fields)
        for part in (self.names, self.values, self.simple):
            if len(part) > REMEMBERED:
                part.clear()
        for r, row in enumerate(grid):
            row = [*row, "", ""]
            below = [*(grid[r + 1] if r + 1 < len(grid) else ()), *[""] * len(row)]
            for c, cell in enumerate(row):
                if not cell:
                    continue
                own = self.names.get(cell)
                if own is None:
                    own = self.names[cell] = self.fields_of(cell)
                if not own:
                    continue
                near = (below[c], row[c + 1], below[c + 1], row[c + 2], below[c + 2])
                for k, base, after in own:
                    for at, raw in enumerate((after, *near)):
                        if not raw:
                            continue
                        key = (raw, k)
                        got = self.values.get(key, key)
                        if got is key:
                            got = self.values[key] = self.value_of(raw, k)
                        if got and (points := base + got[1] + PLACES[at][2]) > 0:
                            order = (points << 43) - (r << 23) - (c << 3) - at
                            if order > rank[k]:
                                rank[k], found[k] = order, {"rank": order, "value": got[0]}
        return found


def _grids(column: pa.ListArray) -> list[list[list[str]]]:
    """Grids as lists; null rows and grids as empty ones."""
    rows = column.flatten()
    deal = lambda items, sizes: [items[end - n : end] for n, end in zip(sizes, accumulate(sizes))]
    sizes = lambda lists: pc.fill_null(pc.list_value_length(lists), 0).to_pylist()
    return deal(deal(rows.flatten().to_numpy(zero_copy_only=False).tolist(), sizes(rows)), sizes(column))


def _best(tables: DataFrame, fields: list[tuple[str, str, list[str]]]) -> DataFrame:
    """``tables`` without the grid, one row for each table_id, and for each field a column with the rank and value of the best candidate, null for none.

    Candidates stand in the label's cell, up to two cells to its right, or below these. Each task finds those of its tables; rows of one table_id meet by it.
    """
    others = [c for c in tables.columns if c not in ("table_id", "grid")]
    names = [f"_{f[0]}" for f in fields]
    schema = StructType([f for f in tables.schema.fields if f.name != "grid"] + [StructField(n, StructType.fromDDL("rank long, value string")) for n in names])
    kinds = to_arrow_schema(schema)

    def run(batches):
        finder = Finder(fields)
        for batch in batches:
            found = zip(*map(finder.best, _grids(batch.column("grid")))) if batch.num_rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kinds if f.name not in names), *(pa.array(x, kinds.field(n).type) for n, x in zip(names, found))], schema=kinds)

    return tables.mapInArrow(run, schema).groupBy("table_id").agg(*[F.first(c).alias(c) for c in others], *[F.max(n).alias(n) for n in names])


def find_values(tables: DataFrame, fields: list[tuple[str, str, list[str]]]) -> DataFrame:
    """table_id, field, value, score: the best value of each field (name, kind, labels) that a table (table_id, grid) holds."""
    found = F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"_{n}.value").alias("value"), F.ceil(F.col(f"_{n}.rank") / (1 << 43)).cast("int").alias("score")) for n, *_ in fields])
    return _best(tables.select("table_id", "grid"), fields).select("table_id", F.inline(F.filter(found, lambda v: v["value"].isNotNull())))


def _wide(tables: DataFrame, fields: list[tuple[str, str, list[str]]]) -> DataFrame:
    """A row for each table_id with a column for each field, empty where nothing was found."""
    names = [f[0] for f in fields]
    return _best(tables, fields).select(*[c for c in tables.columns if c != "grid"], *[F.coalesce(F.col(f"_{n}.value"), F.lit("")).alias(n) for n in names])


def extract_loans(tables: DataFrame) -> DataFrame:
    """A row for each account table (table_id, grid) with an organisation or an amount; figures after the status are left out for closed accounts."""
    rows = _wide(tables, LOAN_FIELDS)
    status = F.when(clean_status(F.col("status")) == "", "结清").otherwise(clean_status(F.col("status")))
    rows = rows.withColumn("status", status).withColumn("amount", parse_number(F.col("amount")))
    open_ = ~F.col("status").rlike("结清|销户")
    for n in ("balance", "monthly_payment", "actual_payment"):
        rows = rows.withColumn(n, F.when(open_, parse_number(F.col(n))))
    for n in ("remain_terms", "overdue_terms", "overdue_amount"):
        rows = rows.withColumn(n, F.when(open_, F.nullif(parse_number(F.col(n)), F.lit(0.0))))
    rows = rows.withColumns({"due_date": F.when(open_, F.nullif("due_date", F.lit(""))), "end_date": F.nullif("end_date", F.lit("")), "terms": F.nullif(parse_number(F.col("terms")), F.lit(0.0)), "five_category": F.nullif("five_category", F.lit(""))})
    return rows.filter((F.trim("org") != "") | (F.col("amount") > 0))


def likely_org(text: Column) -> Column:
    plain = F.regexp_replace(text, r"\s+", "")
    return (F.char_length(plain) >= 4) & ~plain.rlike(NOT_AN_ORG) & ~text.rlike(r"^[A-Za-z0-9\s.,\-]+$") & ~text.rlike(DATE) & plain.rlike(ORG_WORDS)


def likely_account_id(text: Column) -> Column:
    return ~text.rlike(DATE) & (F.char_length(F.regexp_replace(text, "[^A-Za-z0-9]", "")) >= 8)


def is_misplaced(grid: Column) -> Column:
    """A table of another kind among the cards: its headers name a borrower or a business loan."""
    return F.exists(F.get(grid, F.lit(0)), lambda h: F.contains(h, F.lit("主业务借款人")) | F.contains(h, F.lit("个人经营性贷款")))


def extract_cards(tables: DataFrame) -> DataFrame:
    """A row for each usable card table (table_id, grid); organisation, date, id and limit fall back on the first cells.

    A limit below 100 gives way to a larger figure of the first cells. Inactive cards have no used amount or payments.
    """
    own = tables.filter(~F.coalesce(is_misplaced(F.col("grid")), F.lit(False)))
    rows = _wide(own.withColumn("first_", F.filter(F.transform(F.flatten(F.slice("grid", 1, 3)), lambda v: F.trim(v)), lambda v: v != "")), CARD_FIELDS)
    first = F.col("first_")
    pick = lambda values: F.coalesce(F.get(F.filter(values, lambda v: v != ""), F.lit(0)), F.lit(""))
    org = pick(F.transform(first, lambda v: F.when(likely_org(clean_org(v)), clean_org(v)).otherwise("")))
    day = pick(F.transform(first, lambda v: F.replace(F.regexp_replace(F.regexp_extract(v, DATE, 0), "年|月", "."), F.lit("日"), F.lit(""))))
    ident = pick(F.transform(first, lambda v: F.trim(F.regexp_extract(v, r"(?i)[A-Z][A-Z0-9][A-Z0-9\s.\-]{8,}", 0))))
    figure = lambda v: F.when(v.rlike("[A-Za-z]") | v.rlike(DATE), 0.0).otherwise(parse_number(F.regexp_extract(F.regexp_replace(v, "[￥¥元]", ""), r"\d[\d,.]*", 0)))
    limit = F.coalesce(F.array_max(F.transform(first, figure)), F.lit(0.0))
    rows = rows.withColumns({"org_": clean_org(F.col("org")), "limit_": parse_number(F.col("credit_limit"))})
    # the first cells are looked through only where a card needs them
    rows = rows.withColumn("org", F.when(likely_org(F.col("org_")), F.col("org_")).otherwise(let(org, lambda v: F.when(v != "", v).when(likely_account_id(F.col("org_")), "").otherwise(F.col("org_")))))
    rows = rows.withColumn("open_date", F.when(F.col("open_date") != "", F.col("open_date")).otherwise(day)).withColumn("account_id", F.when(likely_account_id(F.col("account_id")), F.col("account_id")).otherwise(ident))
    larger = let(limit, lambda v: F.when((F.col("limit_") == 0) | (v > F.col("limit_")), v).otherwise(F.col("limit_")))
    rows = rows.withColumn("credit_limit", F.when(F.col("limit_") >= 100, F.col("limit_")).otherwise(larger)).withColumn("status", clean_status(F.col("status")))
    active = ~F.col("status").rlike("销户|未激活|结清|其他") & ~F.col("currency").rlike("美元|外币")
    rows = rows.withColumn("status", F.when(F.col("currency").rlike("美元|外币"), "其他").otherwise(F.col("status")))
    for n in ("used_amount", "monthly_payment", "actual_payment"):
        rows = rows.withColumn(n, F.when(active & (F.col(n) != ""), parse_number(F.col(n))))
    rows = rows.withColumn("bill_date", F.when(active, F.nullif("bill_date", F.lit("")))).withColumn("shared_limit", F.when(F.col("shared_limit") != "", parse_number(F.col("shared_limit"))))
    rows = rows.filter(((F.trim("org") != "") | likely_account_id(F.col("account_id"))) & ((F.col("credit_limit") > 0) | (F.coalesce("used_amount", F.lit(0.0)) > 0) | (F.trim("status") != "")))
    return rows.drop("first_", "org_", "limit_")


def account_briefs(tables: DataFrame) -> DataFrame:
    """A brief of each account table (table_id, category, is_summary, grid) but summaries; closed accounts pay nothing."""
    own = tables.filter("NOT is_summary").drop("is_summary")
    card_fields = [(n, k, CARD_BRIEF.get(n, w)) for n, k, w in BRIEF_FIELDS]
    rows = _wide(own.filter("category <> 'creditCard'"), BRIEF_FIELDS).unionByName(_wide(own.filter("category = 'creditCard'"), card_fields))
    names = F.create_map(*[F.lit(x) for pair in CATEGORY_LABELS.items() for x in pair])
    closed = F.col("status").rlike("结清|销户")
    return rows.withColumns({
        "category_label": F.try_element_at(names, F.col("category")), "credit_amount": parse_number(F.col("credit_amount")), "balance": parse_number(F.col("balance")),
        "is_closed": closed, "monthly_payment": F.when(closed, 0.0).otherwise(parse_number(F.col("monthly_payment")))})


def infer_category(text: Column) -> Column:
    """The account category that a table's texts name, in order of evidence; null for none."""
    rules = [
        ("相关还款责任信息|还款责任金额|责任人类型|主业务借款人", "repayResponsibility"), ("授信协议信息|授信协议标识|授信额度用途", "creditAgreement"), ("贷记卡账户|发卡机构|卡机构|账单日", "creditCard"),
        ("循环贷账户二", "revolvingLoan2"), ("循环贷账户一", "revolvingLoan1"), ("非循环贷账户", "nonRevolvingLoan"), ("管理机构(?s:.)*账户授信额度|账户授信额度(?s:.)*管理机构", "revolvingLoan2"), ("管理机构(?s:.)*借款金额|借款金额(?s:.)*管理机构", "nonRevolvingLoan")]
    out = F.when(text.rlike(rules[0][0]), rules[0][1])
    for pattern, category in rules[1:]:
        out = out.when(text.rlike(pattern), category)
    return out


def _cells_of(rows: Column, most: int) -> Column:
    return F.flatten(F.slice(rows, 1, most))


def category_text(preceding: Column, headers: Column, rows: Column) -> Column:
    """What :func:`infer_category` reads: the text before a table, its headers and its first six rows."""
    return F.array_join(F.concat(F.array(F.coalesce(preceding, F.lit(""))), headers, _cells_of(rows, 6)), " ")


def _evidence(cells: Column) -> Column:
    """Cells as one text without white space and doubtful marks, misread words put right."""
    text = F.regexp_replace(F.array_join(cells, " "), r"[\s■□�]+", "")
    for wrong, right in MISREAD_EVIDENCE:
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return text


def choose_category(preceding: Column, headers: Column, rows: Column, current: Column, by_place: Column) -> Column:
    """Named outright, or of a distinct kind with its main table: the category that the texts name; else by place, else the current one, else the one named.

    A name may stand before the table, in its headers or its first two rows; its main table's labels in the headers or
    those rows. Labels may be misread: some characters apart, or a limit written in one of several wrong ways.
    """
    def of(x: Column) -> Column:
        inferred, named_in, main_in = x["inferred"], x["named"], x["main"]
        has = lambda *words: F.lit(True) if not words else F.contains(main_in, F.lit(words[0])) & has(*words[1:])
        limit = main_in.rlike(LIMIT_LABELS) | has("账户", "额度")
        main = F.when(inferred == "revolvingLoan2", has("管", "机构") & limit).when(inferred == "creditCard", has("卡", "机构") & limit)
        main = main.when(inferred == "repayResponsibility", main_in.rlike("还款责任|责任人类型")).when(inferred == "creditAgreement", main_in.rlike("授信协议|授信额度用途")).otherwise(False)
        names = F.create_map(*[F.lit(v) for pair in CATEGORY_LABELS.items() for v in pair])
        named = F.coalesce(F.contains(named_in, F.try_element_at(names, inferred)), F.lit(False))
        new = inferred.isNotNull() & ~inferred.eqNullSafe(current)
        return F.when(new & (named | main), inferred).otherwise(F.coalesce(by_place, current, inferred))

    first = F.concat(headers, _cells_of(rows, 2))
    return let(F.struct(
        infer_category(category_text(preceding, headers, rows)).alias("inferred"), _evidence(F.concat(F.array(F.coalesce(preceding, F.lit(""))), first)).alias("named"), _evidence(first).alias("main")), of)


def merge_segment(tables: DataFrame) -> DataFrame:
    """segment_id, grid: an account's pieces (segment_id, ord, grid) as one, in order; side by side where they have as many rows and other headers, else below.

    An account has a few pieces; they are gathered in one row.
    """
    plain = lambda row: F.regexp_replace(F.array_join(row, ""), r"\s+", "")

    def put(grid: Column, piece: Column) -> Column:
        same = plain(F.element_at(grid, 1)) == plain(F.element_at(piece, 1))
        beside = (F.size(grid) >= 2) & (F.size(grid) == F.size(piece)) & ~same
        return F.when(beside, F.zip_with(grid, piece, lambda a, b: F.concat(a, b))).otherwise(F.concat(grid, F.when(same, F.slice(piece, 2, F.greatest(F.size(piece) - 1, F.lit(0)))).otherwise(piece)))

    pieces = tables.filter(F.size("grid") > 0).groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("ord", "grid"))).alias("p"))
    return pieces.select("segment_id", F.aggregate(F.slice("p", 2, F.size("p")), F.element_at("p", 1).grid, lambda s, x: put(s, x.grid)).alias("grid"))


def provenance(tables: DataFrame) -> DataFrame:
    """field, label, source, page, logical_page, y, preceding, confidence: where a report's modules and accounts come from.

    ``tables`` has report_id, ord, module, field, label, derived (field name or null), headers, page, logical_page, y, preceding. The
    first table of a module stands for it; each table whose headers name a source of an account gives its organisation.
    """
    order = Window.partitionBy("report_id", "module").orderBy("ord")
    place = ["report_id", "page", "logical_page", "y", "preceding"]
    rows = tables.withColumn("k", F.row_number().over(order))
    first = rows.filter("k = 1")
    whole = first.select(*place, "field", "label", F.lit("doc-table").alias("source"), F.lit(0.85).alias("confidence"))
    derived = first.filter("derived IS NOT NULL").select(*place, F.col("derived").alias("field"), F.concat("label", F.lit("汇总反算")).alias("label"), F.lit("derived").alias("source"), F.lit(0.8).alias("confidence"))
    sources = tables.filter(F.col("headers").rlike("管理机构|发卡机构|还款责任金额|授信协议标识")).withColumn("k", F.row_number().over(order))
    each = sources.select(*place, F.format_string("%s[%d].org", "field", F.col("k") - 1).alias("field"), F.format_string("%s第%d笔机构", "label", "k").alias("label"), F.lit("doc-table").alias("source"), F.lit(0.85).alias("confidence"))
    return whole.unionByName(derived).unionByName(each)
