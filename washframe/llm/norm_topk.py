"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are sorted by length and cut into buckets; every bucket knows its
greatest length. A query's running k-th best score theta turns into a local
cosine threshold theta / (|q| * longest of the bucket): above 1 the bucket is
skipped; from ``COORD_FROM`` on, candidates must lie in the feasible interval
of the query's ``FOCUS`` largest coordinates (coordinate pruning); below, only
the bucket's rows that are long enough are looked at (length pruning). What is
left is verified by exact integer products.

Queries travel in blocks. A first pass over the bucket of the longest vectors
gives every query a starting threshold; then each block visits every group of
buckets that its threshold allows, and the groups' best rows are merged.

Defined results: ids and vectors that are null, empty vectors and vectors with
null or non-finite components take no part; vectors of different dimensions
never meet; a query's own id is no candidate of it; ties go to the smaller id;
repeated candidate rows count as often as they occur. Scores that do not fit a
long raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from washframe.llm.common import arrow_map, forget, store

BUCKET_ROWS = 1024
QUERY_ROWS = 256
VISITS = 64           # query blocks that meet a group in one place
GROUP_VALUES = 1 << 22    # components of the candidates of one group at most, about
COORD_FROM = 0.5
FOCUS = 4


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of a with the rows of b."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), dtype=np.int64)
    bound = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if bound < 2 ** 53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2 ** 63:
        return a @ b.T
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)  # OverflowError if too large


class Bucket:
    """Candidate vectors of similar length, longest first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        real = vectors.astype(np.float64)
        self.lengths = np.sqrt((real * real).sum(axis=1))
        self.unit = real / np.where(self.lengths > 0, self.lengths, 1.0)[:, None]


class QueryBlock:
    """Queries with their running best rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, theta: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        real = vectors.astype(np.float64)
        self.lengths = np.sqrt((real * real).sum(axis=1))
        self.unit = real / np.where(self.lengths > 0, self.lengths, 1.0)[:, None]
        self.theta = theta.astype(np.float64).copy()
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]
        self.focus = np.argsort(-np.abs(self.unit), axis=1, kind="stable")[:, :FOCUS]

    def _offer(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ok = (scores >= self.theta[i]) & (ids != self.ids[i])
        if not ok.any():
            return
        s = np.concatenate([self.best[i][0], scores[ok]])
        d = np.concatenate([self.best[i][1], ids[ok]])
        top = np.lexsort((d, -s))[:self.k]
        self.best[i] = s[top], d[top]
        if len(top) == self.k:
            self.theta[i] = max(self.theta[i], float(s[top[-1]]))

    def visit(self, bucket: Bucket) -> None:
        reach = self.lengths * bucket.lengths[0] * (1 + 1e-9)
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(self.theta > 0, self.theta / reach, -1.0)
        local = np.where(np.isnan(local), -1.0, local)
        by_coord = np.flatnonzero((local >= COORD_FROM) & (local <= 1))
        by_length = np.flatnonzero(local < COORD_FROM)
        if len(by_length):
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(self.theta[by_length] > 0, self.theta[by_length] / self.lengths[by_length], -1.0)
            rows = np.searchsorted(-bucket.lengths, -(least.min() * (1 - 1e-9)), side="right")
            scores = products(self.vectors[by_length], bucket.vectors[:rows])
            for i, s in zip(by_length, scores):
                self._offer(i, bucket.ids[:rows], s)
        for i in by_coord:
            angle = np.arccos(local[i]) + 1e-7
            near = np.ones(len(bucket.ids), dtype=bool)
            for f in self.focus[i]:
                at = np.arccos(np.clip(self.unit[i, f], -1, 1))
                low, high = np.cos(min(np.pi, at + angle)) - 1e-9, np.cos(max(0.0, at - angle)) + 1e-9
                near &= (bucket.unit[:, f] >= low) & (bucket.unit[:, f] <= high)
            pick = np.flatnonzero(near)
            if len(pick):
                self._offer(i, bucket.ids[pick], products(self.vectors[i:i + 1], bucket.vectors[pick])[0])


PACKED = "dim int, part int, b int, n int, longest double, ids array<long>, v array<long>"


def _pack_rows(rows: int):
    """Sorted rows (dim, id, v) to packed buckets of one dimension each."""
    def run(batches):
        from pyspark import TaskContext
        part, b, dim, ids, vecs = TaskContext.get().partitionId(), 0, None, [], []

        def packed():
            v = np.concatenate(vecs)
            first = v[:dim].astype(np.float64)
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in (
                    (dim, pa.int32()), (part, pa.int32()), (b, pa.int32()), (len(ids), pa.int32()),
                    (float(np.sqrt((first * first).sum())), pa.float64()),
                    (ids, pa.list_(pa.int64())), (v, pa.list_(pa.int64())))],
                names=["dim", "part", "b", "n", "longest", "ids", "v"])

        for batch in batches:
            dims, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            values, offs = batch.column(2).values.to_numpy(), batch.column(2).offsets.to_numpy()
            for i in range(len(dims)):
                if ids and (dims[i] != dim or len(ids) == rows):
                    yield packed()
                    b, ids, vecs = b + 1, [], []
                dim = int(dims[i])
                ids.append(int(keys[i]))
                vecs.append(values[offs[i]:offs[i + 1]])
        if ids:
            yield packed()
    return run


FOUND = "query_id long, vec_id long, score long"


def _search_rows(k: int):
    """Sorted rows of a deal: its buckets (kind 0, longest first), then query blocks."""
    def run(batches):
        deal, buckets = None, []
        for batch in batches:
            g, kind, dim = (batch.column(i).to_numpy() for i in range(3))
            cols = [(batch.column(i).values, batch.column(i).offsets.to_numpy()) for i in (3, 4, 5)]
            for i in range(len(g)):
                if g[i] != deal:
                    deal, buckets = g[i], []
                ids, v, theta = (c.to_numpy()[o[i]:o[i + 1]] for c, o in cols)
                v = v.reshape(-1, dim[i])
                if kind[i] == 0:
                    buckets.append((dim[i], Bucket(ids.copy(), v.copy())))
                    continue
                block = QueryBlock(ids, v, theta, k)
                for d, bucket in buckets:
                    if d == dim[i]:
                        block.visit(bucket)
                n = [len(s) for s, _ in block.best]
                if sum(n):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(ids, n)), pa.array(np.concatenate([d for _, d in block.best])),
                         pa.array(np.concatenate([s for s, _ in block.best]))], names=["query_id", "vec_id", "score"])
    return run


def usable(vector: str) -> F.Column:
    """Non-empty vectors without null or non-finite components."""
    return F.expr(f"{vector} IS NOT NULL AND size({vector}) > 0 AND forall({vector}, x -> x IS NOT NULL "
                  f"AND NOT isnan(x) AND abs(x) <> double('infinity'))")


def to_integers(vector: str, scale: int = 256) -> F.Column:
    """floor(scale * x) of every component, x as double."""
    return F.expr(f"transform({vector}, x -> cast(floor({scale}D * cast(x AS double)) AS bigint))")


def _sorted_buckets(rows: DataFrame, parts: int, per: int, label: str) -> DataFrame:
    """rows (id, v) packed longest first; ties of length by id."""
    size = F.expr("sqrt(aggregate(v, 0D, (a, x) -> a + cast(x AS double) * x))")
    order = [F.col("dim"), F.col("len").desc(), F.col("id")]
    rows = rows.select(F.size("v").alias("dim"), "id", "v", size.alias("len"))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return store(arrow_map(rows.select("dim", "id", "v"), _pack_rows(per), PACKED), label)


def _search(buckets: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """buckets and blocks (deal, dim, ids, v, theta): rows found, up to k a deal and query."""
    empty = F.array().cast("array<double>")
    rows = buckets.select("deal", F.lit(0).alias("kind"), "dim", "ids", "v", empty.alias("theta"), F.col("b")).union(
        blocks.select("deal", F.lit(1), "dim", "ids", "v", "theta", F.col("b")))
    rows = rows.repartition("deal").sortWithinPartitions("deal", "kind", "dim", "b")
    return arrow_map(rows.select("deal", "kind", "dim", "ids", "v", "theta"), _search_rows(k), FOUND)


def top_k(items: DataFrame, queries: DataFrame, k: int = 5, group_values: int = GROUP_VALUES) -> DataFrame:
    """The k best items per query: query_id, rank, vec_id, score.

    ``items`` and ``queries`` have ``id long, v array<long>``. Rows that repeat a query's id
    are one query (with the least vector, should they differ); every row of ``items`` is a
    candidate, repeated ones too."""
    spark = items.sparkSession
    items, queries = (x.where("id IS NOT NULL AND size(v) > 0") for x in (items, queries))
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    total = items.agg(F.sum(F.size("v"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // group_values))
    buckets = _sorted_buckets(items, parts, BUCKET_ROWS, "topk-buckets")
    blocks = _sorted_buckets(queries, parts, QUERY_ROWS, "topk-queries").withColumn(
        "block", F.shiftleft(F.col("part").cast("long"), 32) + F.col("b"))
    # start: every block meets the bucket of the longest vectors of its dimension
    first = buckets.groupBy("dim").agg(F.min(F.struct("part", "b")).alias("f")).select("dim", "f.part", "f.b")
    longest = buckets.join(first, ["dim", "part", "b"]).select("dim", "ids", "v", "b")
    none = F.array_repeat(F.lit(float("-inf")), F.size("ids")).alias("theta")
    own = blocks.select(F.col("block").alias("deal"), "dim", "ids", "v", none, "b")
    seen = _search(longest.join(own.select("deal", "dim"), "dim"), own, k)
    start = seen.groupBy("query_id").agg(F.count("*").alias("c"), F.min("score").alias("s")).where(f"c >= {k}")
    start = store(start.select("query_id", F.col("s").cast("double").alias("s")), "topk-start")
    flat = blocks.select("block", F.posexplode("ids").alias("i", "query_id")).join(start, "query_id", "left")
    thetas = flat.groupBy("block").agg(F.sort_array(F.collect_list(F.struct(
        "i", F.coalesce("s", F.lit(float("-inf"))).alias("s")))).alias("t")).select("block", F.col("t.s").alias("theta"))
    ready = store(blocks.join(thetas, "block"), "topk-ready")
    # a group is a range partition; a block visits those its thresholds allow
    groups = buckets.groupBy(F.col("part").cast("long").alias("deal"), "dim").agg(F.max("longest").alias("reach"))
    allowed = ready.join(groups, "dim").where(F.col("reach") * F.col("longest") * (1 + 1e-9) >= F.array_min("theta"))
    # a group that many blocks visit is met in several places, each by a share of the blocks
    shares = store(allowed.groupBy("deal").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("shares")), "topk-shares")
    place = F.col("deal") * F.lit(1 << 20) + F.pmod(F.xxhash64("block"), F.col("shares"))
    asked = allowed.join(shares, "deal").select(place.alias("deal"), "dim", "ids", "v", "theta", F.col("block").alias("b"))
    held = (buckets.withColumn("deal", F.col("part").cast("long")).join(shares, "deal")
            .withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
            .withColumn("deal", F.col("deal") * F.lit(1 << 20) + F.col("share")))
    found = _search(held, asked, k)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    out = store(found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")
                .select("query_id", "rank", "vec_id", "score"), "topk")
    forget(buckets, start, ready, shares)
    return out
