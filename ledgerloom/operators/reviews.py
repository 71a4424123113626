"""Review rows: navigation targets, counts, exports, plan comments, and answers of a language model as records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def navigation(fields: DataFrame) -> DataFrame:
    """Rows with the tab, row, name and page anchor that a field's path leads to."""
    path = F.regexp_replace(F.trim("field"), r"^creditDetail\.", "")
    account = r"^[A-Za-z0-9]+\[(\d+)\]\.[A-Za-z0-9]+$"
    tab = F.when(path.rlike(r"^(header|personalInfo)\."), "personal").when(path.rlike(account) | path.rlike(r"^accountDerived\.[A-Za-z0-9]+\.[A-Za-z0-9]+$"), "credit").when(path.rlike(r"^queryRecord(\.selfQueries|\.orgQueries|$)"), "query").otherwise("quality")
    return fields.select("*", tab.alias("tab"), F.nullif(F.regexp_extract(path, r"\[(\d+)\]", 1), F.lit("")).cast("int").alias("row_index"), F.regexp_extract(path, r"([^.]*)$", 1).alias("name"), F.concat(F.lit("review-field-"), F.regexp_replace(path, "[^A-Za-z0-9_-]+", "-")).alias("anchor"))


def counts(issues: DataFrame, reviewed: DataFrame) -> DataFrame:
    """severity, issues, reviewed, reports."""
    seen = reviewed.withColumn("seen", F.lit(True))
    rows = issues.join(seen, ["report_id", "issue_id"], "left")
    return rows.groupBy("severity").agg(F.count("*").alias("issues"), F.count("seen").alias("reviewed"), F.count_distinct("report_id").alias("reports"))


def export_rows(issues: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Critical issues and warnings with their state in words."""
    rows = issues.filter(F.col("severity").isin("critical", "warning")).join(reviewed.withColumn("seen", F.lit(True)), ["report_id", "issue_id"], "left")
    return rows.select("report_id", "issue_id", F.when(F.col("severity") == "critical", "严重").otherwise("警告").alias("level"), "field", F.when(F.col("seen"), "已复核").otherwise("待复核").alias("state"))


def plan_comments(plans: DataFrame, comments: DataFrame) -> DataFrame:
    """report_id, key, place, comment: the first comment on a report that names a plan by key or by name, else a made text.

    ``plans`` has report_id, key, place, name; ``comments`` report_id, ord, plan_key, plan_name, comment. The two
    ways to name a plan are two equi joins; an empty key or name names none.
    """
    said = lambda mine, theirs: plans.join(comments.filter(F.col(theirs) != ""), (plans.report_id == comments.report_id) & (F.col(mine) == F.col(theirs))).select(plans.report_id, "key", "ord", "comment")
    first = said("key", "plan_key").union(said("name", "plan_name")).groupBy("report_id", "key").agg(F.min_by("comment", "ord").alias("comment"))
    return plans.join(first, ["report_id", "key"], "left").select("report_id", "key", "place", F.coalesce("comment", F.concat(F.lit("测算"), "key")).alias("comment"))


def parse_answers(rows: DataFrame, most: int = 5) -> DataFrame:
    """Fields of the JSON object in each answer: fences and what stands around it are cut off, strings trimmed, lists capped at ``most``."""
    plain = F.trim(F.regexp_replace(F.regexp_replace("answer", r"```(json?)?\s*", ""), r"```\s*", ""))
    body = F.regexp_extract(plain, r"(?s)(\{.*\})", 1)
    parsed = F.from_json(F.when(body == "", plain).otherwise(body), "executiveSummary string, primaryPressureSources array<string>, priority bigint")
    opened = rows.withColumn("p", parsed)
    sources = F.filter(F.transform(F.slice(F.coalesce("p.primaryPressureSources", F.array().cast("array<string>")), 1, most), lambda x: F.trim(x)), lambda x: x != "")
    return opened.select("conv_id", "turn", F.coalesce(F.trim("p.executiveSummary"), F.lit("")).alias("summary"), F.size(sources).alias("sources"), F.coalesce("p.priority", F.lit(1)).alias("priority"))
