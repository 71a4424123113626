"""Selection of training text by importance resampling.

Two generative models over hashed word unigrams and bigrams, one of target texts and
one of all raw texts, give each text a log importance weight: the sum over its n-grams
of the log-ratio of their probabilities. Gumbel noise is added to each weight, and the
k largest sums are kept, which draws k texts without replacement in proportion to
their weights. The noise is a function of the id, so that runs agree.

The raw model counts all texts; the target model a sample of at most ``TARGETS`` rows
labelled good. Both are ``BUCKETS`` counts. The k-th largest key is found exactly by
counting keys in ever finer ranges, so no task or driver holds all keys, and equal
keys at the border go to the smallest ids, then rows.

Defined results: null and empty texts have weight 0; null ids order last; repeated
rows are drawn each for themselves; without good labels all weights are 0; an empty
table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import stage
from ledgerloom.llm.textscan import FOLDED, chunks, window_hashes, window_starts, words

BUCKETS = 1 << 15
TARGETS = 40_000
#: Ranges that a step of the search for the k-th key tells apart, as bits.
STEP = 12


def _ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all texts' n-grams, and the text of each."""
    w = words(texts, FOLDED)
    doc, two = w.doc, window_starts(w.first, 2)
    hashes = np.concatenate([w.hash, window_hashes(w.hash, 2)[two]]) if len(two) else w.hash
    return (hashes >> np.uint64(17)).astype(np.int64) % BUCKETS, np.concatenate([doc, doc[two]])


def _count(docs: DataFrame) -> np.ndarray:
    """N-grams of all texts in each bucket: summed in tasks, then over them."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in chunks(batch):
                total += np.bincount(_ngrams(part["text"])[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log-ratio of the two models' smoothed probabilities, for each bucket."""
    if not target.sum():
        return np.zeros(len(target))
    share = (raw + 1) / (raw.sum() + len(raw))
    # the target model falls back on the raw one where it has seen little
    return np.log((target + 200 * share) / (target.sum() + 200)) - np.log(share)


def _weigh(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                bucket, doc = _ngrams(part["text"])
                weight = np.bincount(doc, shared.value[bucket], len(part))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(weight)], ["doc_id", "log_weight"])

    return docs.mapInArrow(run, "doc_id long, log_weight double")


def _kth_bits(keys: DataFrame, k: int) -> tuple[int, int]:
    """The k-th largest of column bits (from 0 on), and how many of its equals belong to the k."""
    low, left, width = 0, k, None
    for shift in [*range(63 - STEP, 0, -STEP), 0]:
        part = keys if width is None else keys.filter((F.col("bits") >= low) & (F.col("bits") < low + width))
        counts = part.groupBy(F.shiftright(F.col("bits") - F.lit(low), shift).alias("at")).count().collect()  # at most 2 ** STEP rows
        for r in sorted(counts, key=lambda r: -r["at"]):
            if left <= r["count"]:
                low += r["at"] << shift
                break
            left -= r["count"]
        width = 1 << shift
    return low, left


def select_texts(docs: DataFrame, labels: DataFrame, keep: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, log_weight, sample_key, kept.

    ``keep`` rows are drawn; by default the share that is good among labelled rows.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("good")).dropna().groupBy("doc_id").agg(F.min("good").alias("good"))
    n, share = known.agg(F.sum("good"), F.avg("good")).head()
    good = known.filter("good = 1").select("doc_id")
    if n and n > TARGETS:
        # a share that gives at most TARGETS rows, but for less than one case in a million
        good = good.filter(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1_000_000)) < int(1_000_000 * (TARGETS - 5 * TARGETS**0.5) / n))
    ratio = log_ratio(_count(rows.join(F.broadcast(good), "doc_id", "left_semi")), _count(rows))
    weighed = stage(_weigh(rows, ratio).withColumn("row", F.monotonically_increasing_id()), "weights")
    even = (F.pmod(F.xxhash64(F.coalesce("doc_id", -1 - F.col("row")), F.lit(61)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    weighed = weighed.withColumn("sample_key", F.col("log_weight") - F.log(-F.log(even)))
    total = weighed.count()
    k = round(total * (1.0 if share is None else share)) if keep is None else min(keep, total)
    if not k:
        return weighed.select("doc_id", "log_weight", "sample_key", F.lit(False).alias("kept"))
    # the keys' order as whole numbers from 0 on
    scaled = F.expr("CAST(floor((greatest(least(sample_key, 4e6D), -4e6D) + 4e6D) * 1e12D) AS BIGINT)")
    keyed = weighed.withColumn("bits", scaled)
    border, equals = _kth_bits(keyed, k)
    last = keyed.filter(F.col("bits") == border).orderBy(F.desc("sample_key"), F.col("doc_id").asc_nulls_last(), "row").limit(equals)
    at = last.select(F.col("row").alias("own"))
    kept = keyed.filter(F.col("bits") == border).join(at, F.col("row") == F.col("own"), "left").select("doc_id", "log_weight", "sample_key", F.col("own").isNotNull().alias("kept"))
    return keyed.filter(F.col("bits") != border).select("doc_id", "log_weight", "sample_key", (F.col("bits") > border).alias("kept")).union(kept)
