"""Connected regions of images that are tables of pixel runs (image_id, y, x0, x1, both ends inclusive), and the one that looks like a document.

Runs are dealt by image, sorted by line and walked through as a stream: a run joins the
regions of the runs above it that it overlaps and of one that it touches on its own line.
Regions are kept in a forest of labels with their figures, and handed out as soon as a line has
none of their runs. So a task holds two lines of runs and the regions they belong to, however
large an image is, and time is linear in the runs.

Runs of a line must not overlap; rows with a null or with x1 below x0 are left out.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REGIONS = "image_id long, first_y int, first_x int, area long, min_x int, min_y int, max_x int, max_y int"
#: Least part of an image that a region covers, and weights of its distance from the middle and of how full its box is.
LEAST_COVERAGE, OFF_CENTER, SOLID, MOST_SOLID = 0.16, 0.32, 0.75, 1.25


class Regions:
    """The open regions of one image."""

    def __init__(self):
        self.parent: list[int] = []
        self.figures: dict[int, list[int]] = {}
        self.above: list[tuple[int, int, int]] = []
        self.line: list[tuple[int, int, int]] = []
        self.y: int | None = None
        self.done: list[list[int]] = []

    def _root(self, label: int) -> int:
        while self.parent[label] != label:
            self.parent[label] = self.parent[self.parent[label]]
            label = self.parent[label]
        return label

    def _join(self, a: int, b: int) -> int:
        a, b = self._root(a), self._root(b)
        if a == b:
            return a
        a, b = min(a, b), max(a, b)  # the older label is the region that began first
        self.parent[b] = a
        one, two = self.figures[a], self.figures.pop(b)
        one[:] = [*min(one[:2], two[:2]), one[2] + two[2], min(one[3], two[3]), min(one[4], two[4]), max(one[5], two[5]), max(one[6], two[6])]
        return a

    def next_line(self, y: int | None) -> None:
        """Hand out regions that the line before the last has and the last has not; all, if the next is not its neighbour."""
        live = {self._root(label) for *_, label in self.line}
        apart = y is None or self.y is None or y != self.y + 1
        ended = [k for k in self.figures if apart or k not in live]
        self.done += [self.figures.pop(k) for k in ended]
        if not self.figures:
            self.parent, self.above = [], []
        else:
            # labels start over, so that they don't grow with the image
            order = {k: n for n, k in enumerate(sorted(self.figures))}
            self.above = [(a, b, order[self._root(label)]) for a, b, label in self.line]
            self.figures = {order[k]: v for k, v in self.figures.items()}
            self.parent = list(range(len(order)))
        self.line, self.y, self.at = [], y, 0

    def add(self, y: int, x0: int, x1: int) -> None:
        if y != self.y:
            self.next_line(y)
        label = len(self.parent)
        self.parent.append(label)
        self.figures[label] = [y, x0, x1 - x0 + 1, x0, y, x1, y]
        if self.line and self.line[-1][1] + 1 == x0:
            label = self._join(label, self.line[-1][2])
        while self.at < len(self.above) and self.above[self.at][1] < x0:
            self.at += 1
        k = self.at
        while k < len(self.above) and self.above[k][0] <= x1:
            label = self._join(label, self.above[k][2])
            k += 1
        self.line.append((x0, x1, label))


def regions(runs: DataFrame) -> DataFrame:
    """A row for each region of pixels that hang together by their sides: image_id, its first pixel, area and box."""
    names = [c.split()[0] for c in REGIONS.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), *[pa.int32()] * 4]

    def run(batches):
        image, open_ = None, Regions()
        for batch in batches:
            out = []
            for i, y, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if i != image:
                    open_.next_line(None)
                    out += [(image, *r) for r in open_.done]
                    image, open_ = i, Regions()
                open_.add(y, a, b)
            out += [(image, *r) for r in open_.done]
            open_.done = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
        open_.next_line(None)
        if open_.done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*((image, *r) for r in open_.done)), kinds)], names)

    rows = runs.select(F.col("image_id").cast("long").alias("image_id"), *[F.col(c).cast("int").alias(c) for c in ("y", "x0", "x1")]).filter("image_id IS NOT NULL AND y IS NOT NULL AND x0 <= x1")
    return rows.repartition("image_id").sortWithinPartitions("image_id", "y", "x0").mapInArrow(run, REGIONS)


def document_region(runs: DataFrame, width: int, height: int) -> DataFrame:
    """image_id, area, min_x, min_y, max_x, max_y, score: of each image's large enough regions the best: large, near the middle, its box full.

    Of equal scores the region that begins first, line by line, stays.
    """
    half_w, half_h = width / 2, height / 2
    off = F.sqrt(F.pow((F.col("min_x") + F.col("max_x")) / 2 - half_w, F.lit(2)) + F.pow((F.col("min_y") + F.col("max_y")) / 2 - half_h, F.lit(2))) / (half_w**2 + half_h**2) ** 0.5
    solid = F.col("area") / ((F.col("max_x") - F.col("min_x") + 1) * (F.col("max_y") - F.col("min_y") + 1))
    rows = regions(runs).filter(F.col("area") / (width * height) >= LEAST_COVERAGE)
    rows = rows.withColumn("score", F.col("area") * (1 - off * OFF_CENTER) * F.least(F.lit(MOST_SOLID), SOLID + solid))
    best = F.max_by(F.struct("area", "min_x", "min_y", "max_x", "max_y", "score"), F.struct("score", -F.col("first_y"), -F.col("first_x")))
    return rows.groupBy("image_id").agg(best.alias("b")).select("image_id", "b.*")
