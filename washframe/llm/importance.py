"""Quality selection by importance resampling over hashed n-grams.

Two bag-of-n-grams models over ``BUCKETS`` hash buckets (words and word pairs,
lower-cased A-Z) are estimated by counting: one over the target texts, one over
all raw texts. A document's log weight is the log ratio of the two models over
its n-grams, and the documents with the greatest log weight plus Gumbel noise
are a sample without replacement in proportion to the weights (Gumbel top-k).

Counts cover all texts; a task emits its ``BUCKETS`` sums, and the models (two
arrays of fixed size) are the only thing that reaches the driver. The k-th key
comes from range partitions and their counts, not from a single-task sort.

Defined results: a null or wordless text has log weight 0; equal rows draw equal
noise and ties of the key go to the smaller doc_id; with no target text all
weights are 0 and the sample is uniform; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washframe.llm.common import arrow_map, forget, numbered, only_ids, store
from washframe.llm.words import gram_hashes, word_hashes

BUCKETS = 10_000
_U = np.uint64


def _row_buckets(column):
    """(row, bucket of every word and word pair) of an Arrow text column."""
    for row, offs, h in word_hashes(column, lower=True):
        ones, twos = gram_hashes(h, 1) % _U(BUCKETS), gram_hashes(h, 2) % _U(BUCKETS)
        for d in range(len(offs) - 1):
            a, b = offs[d], offs[d + 1]
            yield row + d, np.concatenate([ones[a:b], twos[a:max(a, b - 1)]]).astype(np.int64)


def _count_rows(batches):
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for _, offs, h in word_hashes(batch.column(0), lower=True):
            counts += np.bincount((gram_hashes(h, 1) % _U(BUCKETS)).astype(np.int64), minlength=BUCKETS)
            twos = (gram_hashes(h, 2) % _U(BUCKETS)).astype(np.int64)
            inside = np.ones(len(twos), dtype=bool)   # pairs over the border of two texts go
            edges = offs[1:-1] - 1
            inside[edges[(edges >= 0) & (edges < len(twos))]] = False
            counts += np.bincount(twos[inside], minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(counts)], names=["bucket", "n"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Words and word pairs of all texts per hash bucket; each task emits its sums."""
    rows = arrow_map(texts.select(F.col("text").cast("string")), _count_rows, "bucket long, n long")
    out = np.zeros(BUCKETS)
    for x in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[x["bucket"]] = x["n"]
    return out


def log_ratio(target: DataFrame, raw: DataFrame, smoothing: float = 1.0) -> np.ndarray:
    """Per bucket the log ratio of the models of the target and of the raw texts."""
    t, r = bucket_counts(target), bucket_counts(raw)
    if not t.sum():
        return np.zeros(BUCKETS)
    t, r = t + smoothing, r + smoothing
    return np.log(t / t.sum()) - np.log(r / r.sum())


def _weight_rows(ratio: np.ndarray):
    def run(batches):
        for batch in batches:
            w = np.zeros(len(batch))
            for row, b in _row_buckets(batch.column(1)):
                w[row] = ratio[b].sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w)], names=["doc_id", "log_weight"])
    return run


def resample(docs: DataFrame, target_ids: DataFrame, fraction: float, seed: int = 11, temperature: float = 1.0,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: doc_id, log_weight, gumbel_key, rank (from 1), kept.

    ``target_ids`` (doc_id) names the target documents; the
    ``fraction`` of all rows with the greatest keys is kept."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # the raw pass joins nothing; the target pass filters in place while the list is short
    ids = store(target_ids.select("doc_id").distinct(), "resample-target")
    ratio = log_ratio(only_ids(texts, ids, ["doc_id"]), texts)
    weights = store(arrow_map(texts, _weight_rows(ratio), "doc_id long, log_weight double"), "resample-weights")
    # uniform in (0, 1) from a seeded hash; -log(-log(u)) is Gumbel noise
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + 0.5) / float(1 << 53)
    keyed = weights.withColumn("gumbel_key", F.col("log_weight") / temperature - F.log(-F.log(u)))
    ranked = numbered(keyed, [F.col("gumbel_key").desc(), F.col("doc_id")], "position", "resample")
    forget(ids, weights)
    keep = round(fraction * ranked.count())
    return ranked.select("doc_id", "log_weight", "gumbel_key", (F.col("position") + 1).alias("rank"),
                         (F.col("position") < keep).alias("kept"))


