"""Quality scores from metric columns, pixel statistics over histogram rows, candidate ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import half_up

#: Fixed values of capture checks: metric, reject bound, warn bound, points off for each.
CAPTURE = [("short_side", "<", 1200, 1600, 32, 14), ("megapixels", "<", 1.5, 2.4, 24, 10), ("sharpness", "<", 55, 95, 34, 14), ("over", ">", 0.45, 0.3, 24, 10), ("under", ">", 0.18, 0.12, 18, 8)]
BRIGHTNESS = (55, 248, 70, 235, 24, 10)


def image_score(short_side: Column, megapixels: Column, sharpness: Column) -> Column:
    """1, less 0.22 for a short side, 0.18 for few pixels, 0.25 or 0.1 for low sharpness."""
    return 1 - F.when(short_side < 1200, 0.22).otherwise(0.0) - F.when(megapixels < 1.5, 0.18).otherwise(0.0) - F.when(sharpness < 55, 0.25).when(sharpness < 95, 0.1).otherwise(0.0)


def capture_quality(rows: DataFrame) -> DataFrame:
    """Rows with score and level, from short_side, megapixels, sharpness, brightness, over, under."""
    score, hard, soft = F.lit(100), F.lit(False), F.lit(False)
    for name, side, reject, warn, most, some in CAPTURE:
        c = F.col(name)
        bad, poor = (c < reject, c < warn) if side == "<" else (c > reject, c > warn)
        score, hard, soft = score - F.when(bad, most).when(poor, some).otherwise(0), hard | bad, soft | poor
    low, high, low2, high2, most, some = BRIGHTNESS
    b = F.col("brightness")
    bad, poor = (b < low) | (b > high), (b < low2) | (b > high2)
    score = F.greatest(F.lit(0), score - F.when(bad, most).when(poor, some).otherwise(0))
    return rows.withColumn("score", score).withColumn("level", F.when((F.col("score") < 70) | hard | bad, "reject").when((F.col("score") < 85) | soft | poor, "warn").otherwise("pass"))


def scan_score(coverage: Column, a4_offset: Column, skew: Column, cropped: Column) -> Column:
    """100 less the points for coverage, paper shape, skew and cropping, from 0 to 100."""
    off = F.when(coverage < 0.26, 36).when(coverage < 0.38, 10).otherwise(0)
    return half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - off - F.least(F.lit(20.0), a4_offset * 55) - F.least(F.lit(14.0), skew * 25) - F.when(cropped, 6).otherwise(0))))


def rank_candidates(rows: DataFrame) -> DataFrame:
    """doc_id, candidate, rank: the best candidate; the earlier one on ties (score, tables, anchors, modules, issues)."""
    rank = F.col("score") * 100 + F.col("tables") * 1.2 + F.col("anchors") * 0.7 + F.col("modules") * 1.5 - F.col("issues") * 1.8
    return rows.withColumn("rank", rank).groupBy("doc_id").agg(F.max_by("candidate", F.struct("rank", -F.col("candidate"))).alias("candidate"), F.max("rank").alias("rank"))


def quality_score(rows: DataFrame) -> DataFrame:
    """doc_id, score of a document by scope: complete, fragment or unknown."""
    c = F.col
    payment, gaps = F.when(c("payment_missing"), 0.05).otherwise(0.0), F.when(c("query_gaps"), 0.05).otherwise(0.0)
    fragment = 0.82 + F.when(c("tables") > 0, 0.06).otherwise(0.0) + F.when(c("modules") > 0, 0.08).otherwise(0.0) - F.least(F.lit(0.12), c("empty_tables") * 0.03) - payment - gaps
    unknown = F.when(c("tables") > 0, 0.45).otherwise(0.2) - F.least(F.lit(0.15), c("empty_tables") * 0.03)
    complete = 1 - F.least(F.lit(0.35), c("missing_anchors") * 0.025) - F.when(c("tables") == 0, 0.25).otherwise(0.0) - F.least(F.lit(0.15), c("empty_tables") * 0.02) - F.when(c("footers") < c("pages"), 0.1).otherwise(0.0) - F.when(c("missing_pages") > 0, 0.08).otherwise(0.0) - payment - gaps
    score = F.when(c("scope") == "fragment", F.least(F.lit(0.95), half_up(fragment, 2))).when(c("scope") == "unknown", half_up(unknown, 2)).otherwise(half_up(complete, 2))
    return rows.select("doc_id", F.greatest(F.lit(0.0), score).alias("score"))


def otsu(histogram: DataFrame, default: int = 150) -> DataFrame:
    """image_id, threshold: the bin that parts a histogram (image_id, bin, n) best; ``default`` where none does."""
    w = Window.partitionBy("image_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("image_id")
    mass = F.col("bin") * F.col("n")
    rows = histogram.withColumns({"wb": F.sum("n").over(w), "sb": F.sum(mass).over(w), "total": F.sum("n").over(whole), "mean": F.sum(mass).over(whole)})
    back, front = F.col("wb").cast("double"), (F.col("total") - F.col("wb")).cast("double")
    part = F.when((back > 0) & (front > 0), back * front * F.pow(F.col("sb") / back - (F.col("mean") - F.col("sb")) / front, 2))
    best = rows.withColumn("v", part).groupBy("image_id").agg(F.max_by("bin", F.when(F.col("v") > 0, F.struct("v", -F.col("bin")))).alias("bin"))
    return best.select("image_id", F.coalesce("bin", F.lit(default)).alias("threshold"))


def percentile_bin(histogram: DataFrame, share: float) -> DataFrame:
    """image_id, bin: the first bin at which the running count reaches a share of all."""
    w = Window.partitionBy("image_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    rows = histogram.withColumns({"seen": F.sum("n").over(w), "total": F.sum("n").over(Window.partitionBy("image_id"))})
    return rows.filter(F.col("seen") >= F.col("total") * share).groupBy("image_id").agg(F.min("bin").alias("bin"))


def moving_mean(rows: DataFrame, radius: int) -> DataFrame:
    """Rows (line_id, x, v) with the mean of 2 * radius + 1 neighbours; the edges' values stand in beyond them."""
    w, whole = Window.partitionBy("line_id").orderBy("x"), Window.partitionBy("line_id")
    near = w.rowsBetween(-radius, radius)
    edge = rows.withColumns({
        "k": F.row_number().over(w) - 1, "n": F.count("*").over(whole), "first": F.min_by("v", "x").over(whole), "last": F.max_by("v", "x").over(whole), "near": F.sum("v").over(near)})
    left, right = F.greatest(F.lit(0), radius - F.col("k")), F.greatest(F.lit(0), radius - (F.col("n") - 1 - F.col("k")))
    return edge.select("line_id", "x", ((F.col("near") + left * F.col("first") + right * F.col("last")) / (2 * radius + 1)).alias("mean"))


def robust_line(points: DataFrame, share: float = 0.68, least: float = 3.0) -> DataFrame:
    """line_id, a, b: least squares, again without points whose residual exceeds the ``share`` quantile (``least`` at least)."""
    def fit(rows: DataFrame) -> DataFrame:
        n, x, y = F.count("*").cast("double"), F.sum("x"), F.sum("y")
        xx, xy = F.sum(F.col("x") * F.col("x")), F.sum(F.col("x") * F.col("y"))
        rows = rows.groupBy("line_id").agg(n.alias("n"), x.alias("sx"), y.alias("sy"), xx.alias("sxx"), xy.alias("sxy"))
        below = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
        rows = rows.filter((F.col("n") >= 2) & (F.abs(below) >= 1e-6)).withColumn("a", (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / below)
        return rows.select("line_id", "a", ((F.col("sy") - F.col("a") * F.col("sx")) / F.col("n")).alias("b"))

    w = Window.partitionBy("line_id").orderBy("r")
    rows = points.join(fit(points), "line_id").withColumn("r", F.abs(F.col("y") - (F.col("a") * F.col("x") + F.col("b"))))
    rows = rows.withColumns({"k": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy("line_id"))})
    cut = F.max(F.when(F.col("k") == F.floor(F.col("n") * share), F.col("r"))).over(Window.partitionBy("line_id"))
    rows = rows.withColumn("cut", F.greatest(F.lit(least), F.coalesce(cut, F.lit(least))))
    rows = rows.withColumn("near", (F.col("r") <= F.col("cut")).cast("int")).withColumn("many", F.sum("near").over(Window.partitionBy("line_id")))
    return fit(rows.filter("near = 1 OR many < 2").select("line_id", "x", "y"))


def extreme_points(points: DataFrame) -> DataFrame:
    """shape_id and the points with the least and most x + y and x - y; the first on ties (shape_id, ord, x, y)."""
    total, less = F.col("x") + F.col("y"), F.col("x") - F.col("y")
    low = lambda v: F.min_by("ord", F.struct(v, F.col("ord")))
    high = lambda v: F.max_by("ord", F.struct(v, -F.col("ord")))
    return points.groupBy("shape_id").agg(low(total).alias("top_left"), high(total).alias("bottom_right"), high(less).alias("top_right"), low(less).alias("bottom_left"))
