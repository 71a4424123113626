"""Text functions for report fields: cleaning, similarity, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes, keywords and reasons in the order they are tried.
ORG_SUFFIXES = ["公司", "银行", "中心", "合作社"]
STATUS_KEYWORDS = ["正常", "结清", "销户", "呆账", "呆帐", "逾期", "冻结", "止付"]
KNOWN_REASONS = ["贷后管理", "贷款审批", "信用卡审批", "担保资格审查", "资信审查", "本人查询", "公积金提取审查"]
COMMON_SUFFIX = r"股份有限公司|有限责任公司|有限公司|股份公司"
FULL_WIDTH = "".join(chr(c + 0xFEE0) for r in ((48, 58), (65, 91), (97, 123)) for c in range(*r))
HALF_WIDTH = "".join(chr(c) for r in ((48, 58), (65, 91), (97, 123)) for c in range(*r))


def trim_all(text: Column) -> Column:
    """Trim every kind of white space, ideographic and zero-width ones included."""
    return F.regexp_replace(text, r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")


def clean_status(text: Column) -> Column:
    """The keyword that stands first in a text; '' for none."""
    places = F.array(*[F.struct(F.instr(text, k).alias("at"), F.lit(n).alias("n"), F.lit(k).alias("word")) for n, k in enumerate(STATUS_KEYWORDS)])
    found = F.array_sort(F.filter(places, lambda p: p.at > 0))
    return F.when(F.size(found) > 0, found[0].word).otherwise("")


def clean_org(text: Column) -> Column:
    """Up to the last organisation suffix, without long codes and punctuation; of several lines the first with a suffix."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("|".join(ORG_SUFFIXES)))
    line = F.when(F.instr(text, "\n") > 0, F.coalesce(F.try_element_at(lines, F.lit(1)), text)).otherwise(text)
    out = F
    for suffix in ORG_SUFFIXES:
        part = F.regexp_extract(line, f"(?s)^(.*{suffix})", 1)
        out = out.when(F.instr(line, suffix) > 0, F.regexp_replace(F.regexp_replace(part, "[A-Za-z0-9]{6,}", ""), "[；;，,。.]", ""))
    return out.otherwise(line)


def clean_reason(text: Column) -> Column:
    """A query reason without stray marks, as the known reason it holds."""
    plain = F.regexp_replace(text, r"[\x{200B}-\x{200F}\x{2028}-\x{202F}\x{FEFF}\x{00A0}\x{3000}]", "")
    plain = F.trim(F.regexp_replace(F.trim(F.regexp_replace(plain, r"\s+", " ")), r"[、，,.:;；。\s]+$", ""))
    plain = F.replace(plain, F.lit("货"), F.lit("贷"))
    out = F
    for reason in KNOWN_REASONS:
        out = out.when(F.contains(plain, F.lit(reason)), reason)
    return out.otherwise(plain)


def clean_query_date(text: Column) -> Column:
    """The first date of a query row with dots between its parts."""
    found = F.regexp_extract(text, r"20\d{2}[\s.:]\d{2}[\s.:]\d{2}", 0)
    return F.when(found == "", trim_all(text)).otherwise(F.regexp_replace(F.regexp_replace(found, r"[\s:]", "."), r"\.+", "."))


def bigrams(text: Column) -> Column:
    n = F.char_length(text)
    return F.when(n <= 1, F.array(text)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2))))


def dice(a: Column, b: Column) -> Column:
    """Twice the shared bigrams, counted as often as both have them, over all."""
    x, y = bigrams(a), bigrams(b)
    many = lambda grams, g: F.size(F.filter(grams, lambda h: h == g))
    shared = F.aggregate(F.array_distinct(x), F.lit(0), lambda s, g: s + F.least(many(x, g), many(y, g)))
    return F.when((a == "") | (b == ""), 0.0).otherwise(2.0 * shared / (F.size(x) + F.size(y)))


def similarity(a: Column, b: Column) -> Column:
    """0.55 parts edit similarity and 0.45 parts bigram similarity."""
    edit = 1 - F.levenshtein(a, b) / F.greatest(F.char_length(a), F.char_length(b), F.lit(1))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), edit * 0.55 + dice(a, b) * 0.45))


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two texts of any length; 0 where one is empty, null where one is null.

    A row of the table is kept as bits, a zero where it steps up, in words of 62 characters
    of ``b``; each character of ``a`` costs one addition a word, with the carry to the next.
    """
    bits, full = 62, (1 << 62) - 1
    chars = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    right = chars(b)
    blocks = F.transform(F.sequence(F.lit(1), F.ceil(F.size(right) / bits).cast("int")), lambda k: F.reverse(F.slice(right, (k - 1) * bits + 1, bits)))
    start = F.struct(F.lit(0).cast("long").alias("carry"), F.expr("CAST(array() AS array<bigint>)").alias("words"))

    def row(words: Column, char: Column) -> Column:
        def word(state: Column, p: Column) -> Column:
            here = F.aggregate(p["block"], F.lit(0).cast("long"), lambda m, c: m * 2 + (c == char).cast("long"))
            steps = p["word"].bitwiseAND(here)
            total = p["word"] + steps + state["carry"]
            new = total.bitwiseAND(F.lit(full)).bitwiseOR(p["word"] - steps)
            return F.struct(F.shiftright(total, bits).alias("carry"), F.concat(state["words"], F.array(new)).alias("words"))

        pairs = F.zip_with(words, blocks, lambda w, x: F.struct(w.alias("word"), x.alias("block")))
        return F.aggregate(pairs, start, word, lambda state: state["words"])

    words = F.aggregate(chars(a), F.transform(blocks, lambda x: F.lit(full)), row)
    length = F.aggregate(words, F.lit(0), lambda n, w: n + bits - F.bit_count(w))
    return F.when((a == "") | (b == ""), 0).otherwise(length)


def org_differs(a: Column, b: Column) -> Column:
    """Two organisations whose names share too little, common suffixes aside."""
    def plain(x: Column) -> Column:
        x = F.lower(F.regexp_replace(F.translate(F.regexp_replace(x, r"\s+", ""), FULL_WIDTH, HALF_WIDTH), "[^一-龥A-Za-z0-9]", ""))
        return F.regexp_replace(F.regexp_replace(x, COMMON_SUFFIX, ""), "银行|消费金融|小额贷款|融资租赁|融资担保", "")

    x, y = plain(a), plain(b)
    inside = (F.contains(x, y) | F.contains(y, x)) & (F.least(F.char_length(x), F.char_length(y)) >= 3)
    return ~((x == "") | (y == "") | (x == y) | inside) & (lcs_length(x, y) / F.greatest(F.char_length(x), F.char_length(y)) < 0.58)


def url_part(text: Column) -> Column:
    """Percent-encoding that leaves ``A-Za-z0-9 - _ . ! ~ * ' ( )`` as they are."""
    out = F.url_encode(text)
    for code, char in (("\\+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.regexp_replace(out, code, char)
    return out


def occurrences(text: Column, needle: str) -> Column:
    """How often a literal occurs."""
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("int")
