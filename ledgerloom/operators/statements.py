"""Agreements, repayment responsibilities and employers from tables; payments from numbered lines; rules from a log of changes.

Tables are rows of doc_id, ord, headers and rows of cells, in reading order by ord. Null
headers and rows count as empty ones, null cells as empty texts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ledgerloom.functions.amounts import parse_number
from ledgerloom.functions.texts import clean_org, let
from ledgerloom.operators.labels import REMEMBERED, Finder, _find, _grids

#: Kinds of a responsible person, and what makes a text an organisation.
RESPONSIBLE = "保证人|共同借款人|担保人|抵押人"
ORGANISATION = "银行|公司|金融"
DUTY_LABELS = ["管理机构", "业务种类", "开立日期", "到期日期", "责任人类型", "还款责任金额", "币种", "保证合同编号", "主业务借款人", "主业务借款人证件类型", "主业务借款人证件号码", "余额", "五级分类", "还款状态"]
_header, _responsible, _organisation, _amount = map(_find, ("管理机构|责任人|还款责任", RESPONSIBLE, ORGANISATION, r"^[0-9,]+(?:\.\d+)?$"))


def _plain(tables: DataFrame) -> DataFrame:
    cells = lambda row: F.transform(row, lambda c: F.coalesce(c, F.lit("")))
    rows = F.transform(F.coalesce("rows", F.array().cast("array<array<string>>")), cells)
    return tables.select("doc_id", "ord", cells(F.coalesce("headers", F.array().cast("array<string>"))).alias("headers"), rows.alias("rows"))


def _cell(row: Column, at: int) -> Column:
    return F.coalesce(F.get(row, F.lit(at)), F.lit(""))


def _row(rows: Column, at: int) -> Column:
    return F.coalesce(F.get(rows, F.lit(at)), F.array().cast("array<string>"))


def _under(labels: Column, values: Column, holds) -> Column:
    """The value under the first label that ``holds``; empty without one."""
    at = F.array_position(F.transform(labels, lambda c: F.coalesce(holds(c), F.lit(False))), F.lit(True))
    return F.when(at > 0, F.coalesce(F.get(values, (at - 1).cast("int")), F.lit(""))).otherwise("")


def credit_agreements(tables: DataFrame) -> DataFrame:
    """doc_id, ord, org, purpose, credit_limit, used_amount of each agreement.

    A table whose headers name the organisation and the purpose holds the values below its
    headers; with fewer than two rows the next table holds them, its headers being the first
    values, unless that is such a table itself.
    """
    head = let(F.array_join("headers", ""), lambda h: F.contains(h, F.lit("管理机构")) & F.contains(h, F.lit("授信额度用途")))
    rows = _plain(tables).withColumns({"head": head, "whole": F.size("rows") >= 2})
    own = F.col("head") & F.col("whole")
    rows = rows.select(
        "doc_id", "ord", "head", "whole", F.when(own, _row(F.col("rows"), 0)).otherwise(F.col("headers")).alias("first"), F.when(own, _row(F.col("rows"), 1)).otherwise(_row(F.col("rows"), 0)).alias("labels"),
        F.when(own, _row(F.col("rows"), 2)).otherwise(_row(F.col("rows"), 1)).alias("values"))
    limit = _under(F.col("labels"), F.col("values"), lambda c: F.contains(c, F.lit("授信额度")) & ~c.rlike("用途|限额"))
    used = _under(F.col("labels"), F.col("values"), lambda c: F.contains(c, F.lit("已用额度")))
    # each table tells what it holds, for itself or for the one before it; so no grids are sorted
    told = F.struct(clean_org(_cell(F.col("first"), 0)).alias("org"), _cell(F.col("first"), 4).alias("purpose"), parse_number(limit).alias("credit_limit"), parse_number(used).alias("used_amount"))
    rows = rows.select("doc_id", "ord", "head", "whole", F.when(own | ~F.col("head"), told).alias("told"))
    rows = rows.withColumn("next", F.lead(F.when(~F.col("head"), F.col("told"))).over(Window.partitionBy("doc_id").orderBy("ord")))
    return rows.filter("head").withColumn("told", F.when(F.col("whole"), F.col("told")).otherwise(F.col("next"))).filter("told IS NOT NULL").select("doc_id", "ord", "told.*")


def openers(tables: DataFrame) -> DataFrame:
    """Tables (with ``header`` and ``bare``, a header without rows) with ``alone`` (a header with rows of its own) and ``opens`` (one without, which takes the next table), each table used once.

    In a run of headers without rows every second one is taken by the one before it, so the
    parity of a table's place in its run decides; so does the parity of a run for the table behind it.
    """
    order = Window.partitionBy("doc_id").orderBy("ord")
    rows = tables.withColumn("at", F.row_number().over(order))
    rows = rows.withColumn("solid", F.max(F.when(~F.col("bare"), F.col("at"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("opens", F.col("bare") & ((F.col("at") - F.coalesce("solid", F.lit(0))) % 2 == 1))
    taken = F.coalesce(F.lag("opens").over(order), F.lit(False))
    return rows.withColumn("alone", F.col("header") & ~F.col("bare") & ~taken).drop("at", "solid")


class DutyReader:
    """What responsibility tables hold, with a memory of which labels a text is."""

    def __init__(self):
        self.finder, self.names = Finder([(w, "text", [w]) for w in DUTY_LABELS]), {}

    def places(self, texts: list[str]) -> list[int]:
        """For each of the labels the first place where a text is it; -1 for none."""
        found = [-1] * len(DUTY_LABELS)
        for n, text in enumerate(texts):
            own = self.names.get(text)
            if own is None:
                if len(self.names) > REMEMBERED:
                    self.names.clear()
                own = self.names[text] = [k for k, *_ in self.finder.fields_of(text)]
            for k in own:
                if found[k] < 0:
                    found[k] = n
        return found

    def _pair(self, details: list[list[str]], keyword: str, wanted: list[str]) -> list[str | None] | None:
        """Values under labels, of the first row but the last that has a keyword and the row below it; None without such a row."""
        for labels, values in zip(details, details[1:]):
            if any(keyword in c for c in labels):
                places = self.places(labels)
                at = [places[DUTY_LABELS.index(w)] for w in wanted]
                return [(values[n].strip(" ") or None) if 0 <= n < len(values) else None for n in at]
        return None

    def told(self, values: list[str], details: list[list[str]]) -> dict:
        """A responsibility's values, and what its details and the look of its values tell: a kind, of the others the longest organisation (the first on ties) and the first number."""
        values = [v.strip(" ") for v in values]
        kind = next((n for n, v in enumerate(values) if _responsible(v)), None)
        others = [v for n, v in enumerate(values) if n != kind]
        who = self._pair(details, "主业务借款人", DUTY_LABELS[8:11])
        state = self._pair(details, "余额", DUTY_LABELS[11:]) or self._pair(details, "五级分类", DUTY_LABELS[11:])
        looks = ["" if kind is None else values[kind], max(filter(_organisation, others), key=len, default=""), next(filter(_amount, others), "")]
        return {"values": values, "told": [*(who or [None] * 3), *(state or [None] * 3), *looks]}


def _read_duties(tables: DataFrame) -> DataFrame:
    """doc_id, ord, header, bare, places of the labels in a header, and what a table holds below its headers (``own``) and for the header before it (``next``).

    Grids end here: what is sorted and carried from row to row after it are the few values.
    """
    told = "struct<values array<string>, told array<string>>"
    schema = StructType([tables.schema["doc_id"], tables.schema["ord"], *StructType.fromDDL(f"header boolean, bare boolean, places array<int>, own {told}, next {told}").fields])
    kinds = to_arrow_schema(schema)

    def run(batches):
        reader = DutyReader()
        for batch in batches:
            out = []
            for headers, rows in zip(batch.column("headers").to_pylist(), _grids(batch.column("rows"))):
                headers, rows = [c or "" for c in headers or ()], [[c or "" for c in row] for row in rows]
                header = any(map(_header, headers))
                out.append((header, header and not rows, reader.places(headers) if header else None, reader.told(rows[0], rows[1:]) if header and rows else None, reader.told(headers, rows)))
            columns = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ord"), *(pa.array(c, kinds.field(n + 2).type) for n, c in enumerate(columns))], schema=kinds)

    return tables.select("doc_id", "ord", "headers", "rows").mapInArrow(run, schema)


def repay_responsibilities(tables: DataFrame) -> DataFrame:
    """A row for each responsibility: doc_id, ord, org, business_type, open_date, end_date, kind, amount, currency, contract_no, borrower, cert_type, cert_no, balance, five_category, repay_status.

    A header table without rows takes the next table, whose headers are its first values.
    Organisation, kind and amount fall back on the values that look like one.
    """
    rows = openers(_read_duties(tables)).withColumn("next", F.lead("next").over(Window.partitionBy("doc_id").orderBy("ord")))
    rows = rows.filter("alone OR (opens AND next IS NOT NULL)").select("doc_id", "ord", "places", F.when(F.col("alone"), F.col("own")).otherwise(F.col("next")).alias("t"))

    def own(keyword: str) -> Column:
        at = F.get("places", F.lit(DUTY_LABELS.index(keyword)))
        return F.when(at >= 0, F.coalesce(F.get("t.values", at), F.lit(""))).otherwise("")

    of = lambda k: F.get("t.told", F.lit(k))
    or_ = lambda text, other: let(text, lambda v: F.when(v != "", v).otherwise(other))
    return rows.select(
        "doc_id", "ord", clean_org(or_(own("管理机构"), of(7))).alias("org"), own("业务种类").alias("business_type"), own("开立日期").alias("open_date"), F.nullif(own("到期日期"), F.lit("")).alias("end_date"),
        or_(own("责任人类型"), of(6)).alias("kind"), parse_number(or_(own("还款责任金额"), of(8))).alias("amount"), own("币种").alias("currency"), F.nullif(own("保证合同编号"), F.lit("")).alias("contract_no"),
        of(0).alias("borrower"), of(1).alias("cert_type"), of(2).alias("cert_no"), of(4).alias("five_category"), of(5).alias("repay_status"), F.when(of(3).isNotNull(), parse_number(of(3))).alias("balance"))


def latest_employers(tables: DataFrame) -> DataFrame:
    """doc_id, company: the employer in the first row of a document's first table, where that has one of two characters or more."""
    first = _plain(tables).groupBy("doc_id").agg(F.min_by(F.struct("headers", "rows"), "ord").alias("t"))
    company = F.trim(_under(F.col("t.headers"), _row(F.col("t.rows"), 0), lambda c: F.contains(c, F.lit("工作单位"))))
    return first.select("doc_id", company.alias("company")).filter("char_length(company) >= 2")


def line_payments(lines: DataFrame) -> DataFrame:
    """account_id, payment: this month's payment from an account's numbered lines (account_id, is_card, line, text), where no table gave it.

    The first line that is the label starts a group of labels, which ends with its last
    label within a few lines; a loan's payment is the fifth number after it, a card's the second. 0 where there is none.
    """
    account = Window.partitionBy("account_id")
    text = F.trim(F.coalesce("text", F.lit("")))
    rows = lines.select("account_id", "is_card", "line", text.alias("text")).withColumn("at", F.min(F.when(F.col("text") == "本月应还款", F.col("line"))).over(account))
    last = F.when(F.col("is_card"), F.col("text").rlike("当前[途逾]期总额") & (F.col("line") < F.col("at") + 8)).otherwise((F.col("text") == "本月实还款") & (F.col("line") < F.col("at") + 5))
    rows = rows.withColumn("end", F.coalesce(F.min(F.when(last & (F.col("line") >= F.col("at")), F.col("line"))).over(account), "at"))
    number = F.regexp_extract(F.replace("text", F.lit(","), F.lit("")), r"^\d+(?:\.\d+)?$", 0)
    rows = rows.withColumn("number", F.when((F.col("line") > F.col("end")) & (number != ""), number.cast("double")))
    rows = rows.withColumn("nth", F.count("number").over(account.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    wanted = F.col("number").isNotNull() & (F.col("nth") == F.when(F.col("is_card"), 2).otherwise(5))
    return rows.groupBy("account_id").agg(F.coalesce(F.max(F.when(wanted, F.col("number"))), F.lit(0.0)).alias("payment"))


def fold_changes(changes: DataFrame, fields: list[str]) -> DataFrame:
    """id, the fields and updated_at (a seq): records as a log of changes (id, seq, op, fields) leaves them.

    ``op`` is add, update or delete. After an id's last delete an add brings it back; updates before
    that are lost. Of each field the last value that is not null stands. One shuffle by id.
    """
    own = Window.partitionBy("id")
    rows = changes.withColumn("gone", F.max(F.when(F.col("op") == "delete", F.col("seq"))).over(own))
    rows = rows.filter("gone IS NULL OR seq > gone").withColumn("born", F.min(F.when(F.col("op") == "add", F.col("seq"))).over(own)).filter("seq >= born")
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in fields]
    return rows.groupBy("id").agg(*last, F.max("seq").alias("updated_at"))
