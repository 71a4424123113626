"""Stores as tables: the parse cache with a time to live, the rule table, review state, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import half_up

#: Days that a cached result lives.
TTL_DAYS = 30


def cache_read(entries: DataFrame, now: Column, days: int = TTL_DAYS) -> DataFrame:
    """The latest entry of each key that is not older than ``days`` (key, created_at, payload)."""
    fresh = entries.filter(F.col("created_at") > now - F.make_dt_interval(F.lit(days)))
    return fresh.groupBy("key").agg(F.max_by(F.struct("created_at", "payload"), "created_at").alias("e")).select("key", "e.*")


def cache_stats(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.length("payload")), F.lit(0)).alias("bytes"))


def import_rules(held: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Held rules and those new ones whose id is not held."""
    return held.unionByName(new.join(held.select(key), key, "left_anti").select(held.columns))


def last_wins(events: DataFrame, key: str, sequence: str, *values: str) -> DataFrame:
    """What the request with the highest sequence number of each key brought."""
    return events.groupBy(key).agg(F.max_by(F.struct(sequence, *values), sequence).alias("e")).select(key, "e.*")


def review_state(events: DataFrame) -> DataFrame:
    """key, reviewed: the items reviewed since each key's last edit (key, seq, kind edit or review, item)."""
    last = events.groupBy("key").agg(F.max(F.when(F.col("kind") == "edit", F.col("seq"))).alias("edited"))
    since = events.filter("kind = 'review'").join(last, "key").filter("edited IS NULL OR seq > edited")
    seen = since.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("item")), ",").alias("reviewed"))
    return last.select("key").join(seen, "key", "left").fillna("", ["reviewed"])


def evaluate_fields(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Share of expected (id, value) that the actual values equal, at four decimals; 1 for none."""
    rows = expected.join(actual.withColumnRenamed("value", "got"), "id", "left")
    passed = F.coalesce(F.trim("value") == F.trim("got"), F.lit(False))
    return rows.agg(F.count("*").alias("fields"), F.count_if(passed).alias("passed"), F.coalesce(half_up(F.avg(passed.cast("double")), 4), F.lit(1.0)).alias("accuracy"))


def prefix_lookup(fields: DataFrame, sources: DataFrame) -> DataFrame:
    """field, label: the source of a path, else of its list, the list's parent, or its root; the longest that is known.

    Distinct paths are expanded to their at most four keys and meet the sources in one join.
    """
    whole = F.col("field")
    lists = F.regexp_replace(whole, r"\[\d+\]\.[^.]+$", "")
    keys = F.array(whole, lists, F.regexp_replace(lists, r"\.[^.]+$", ""), F.element_at(F.split(whole, r"\["), 1))
    opened = fields.select("field").distinct().select("field", F.posexplode(keys).alias("level", "key"))
    found = opened.join(sources.select(F.col("field").alias("key"), "label", F.lit(True).alias("known")), "key", "left")
    return found.groupBy("field").agg(F.min_by("label", F.when(F.col("known"), F.col("level"))).alias("label"))


def paginate(rows: DataFrame, key: str, order: list[Column], page: int, size: int = 20) -> DataFrame:
    """One page of each key's rows, with their place."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("place", place).filter(F.col("place").between(page * size + 1, page * size + size))
