"""Embedding near-dedup by collision counting over one-dimensional projections.

Unit vectors are projected on ``M`` random lines. For a pair at the cosine
threshold the difference of two projections is normal with deviation
sqrt(2 - 2 * cosine), so a window of ``WIDTH`` deviations around a vector's
projection holds the other one with known probability. A pair collides on a
line if it lies in that window; the least count of collisions that still has
the wanted recall at the threshold (a binomial quantile) makes a candidate, and
candidates are verified by their cosine in double precision.

Vectors of a group (label and dimension) are sorted by their first projection
and cut into blocks. Two blocks meet only if the ranges of enough projections
come within a window of each other. Between two blocks every line's sorted
projections give each vector's window by binary search; windows are bit sets
(differences of prefix sets), and counts are added bit by bit for all pairs of
the blocks. Only link counts per vector and a spanning set of edges leave a
task, never the pairs of a dense group.

Equal vectors are one class with a multiplicity. Defined results: vectors that
are null, zero, empty or hold null or non-finite components, and rows with a
null label or id link with nothing (n_links 0, their own component); vectors of
different dimensions never link; every input row is returned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washframe.llm.common import arrow_map, forget, store
from washframe.llm.components import connected_components
from washframe.llm.norm_topk import usable

M = 32
WIDTH = 1.5
MISS = 1e-4            # chance to miss a pair exactly at the threshold
BLOCK_ROWS = 1024
GROUP_BLOCKS = 8       # blocks that a task holds while others stream past


def window(cosine: float) -> float:
    return WIDTH * math.sqrt(2 - 2 * cosine)


def least_collisions(m: int = M, width: float = WIDTH, miss: float = MISS) -> int:
    """Largest count that a pair at the threshold misses with chance ``miss`` at most."""
    p, below = math.erf(width / math.sqrt(2)), 0.0
    for count in range(m + 1):
        below += math.comb(m, count) * p ** count * (1 - p) ** (m - count)
        if below > miss:
            return count
    return m


def directions(dim: int, m: int = M, seed: int = 5) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, m))


class Block:
    """Vectors with their sorted projections as prefix bit sets."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, unit: np.ndarray):
        self.ids, self.weights, self.unit = ids, weights, unit
        self.lines = unit @ directions(unit.shape[1])
        self._sets = None

    def sets(self):
        if self._sets is None:
            n, self._sets = len(self.ids), []
            words = -(-n // 64)
            for line in self.lines.T:
                order = np.argsort(line, kind="stable")
                marks = np.zeros((n + 1, words), dtype=np.uint64)
                marks[np.arange(1, n + 1), order // 64] = np.left_shift(np.uint64(1), (order % 64).astype(np.uint64))
                np.bitwise_or.accumulate(marks, axis=0, out=marks)
                self._sets.append((line[order], marks))
        return self._sets

    def may_meet(self, other: "Block", w: float, least: int) -> bool:
        near = (self.lines.min(0) - w <= other.lines.max(0)) & (other.lines.min(0) - w <= self.lines.max(0))
        return int(near.sum()) >= least


def collisions(a: Block, b: Block, w: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) that share ``least`` windows or more."""
    planes: list[np.ndarray] = []
    for line, (values, marks) in zip(a.lines.T, b.sets()):
        carry = marks[np.searchsorted(values, line + w, side="right")] ^ marks[np.searchsorted(values, line - w)]
        for p in planes:
            both = p & carry
            p ^= carry
            carry = both
        if (len(planes) == 0 or carry.any()):
            planes.append(carry)
    if least >> len(planes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    more, same = np.zeros_like(planes[0]), ~np.zeros_like(planes[0])
    for bit in range(len(planes) - 1, -1, -1):
        if least >> bit & 1:
            same &= planes[bit]
        else:
            more |= same & planes[bit]
            same &= ~planes[bit]
    hits = np.unpackbits((more | same).view(np.uint8), axis=1, bitorder="little")[:, :len(b.ids)]
    return np.nonzero(hits)


def verified(a: Block, b: Block, i: np.ndarray, j: np.ndarray, cosine: float):
    keep = np.zeros(len(i), dtype=bool)
    for lo in range(0, len(i), 1 << 14):
        s = slice(lo, lo + (1 << 14))
        keep[s] = np.einsum("ij,ij->i", a.unit[i[s]], b.unit[j[s]]) >= cosine
    return i[keep], j[keep]


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least vertex that each of n vertices reaches by the edges (i, j)."""
    head = np.arange(n)
    while True:
        low = np.minimum(head[i], head[j])
        nxt = head.copy()
        np.minimum.at(nxt, i, low)
        np.minimum.at(nxt, j, low)
        nxt = nxt[nxt]
        if (nxt == head).all():
            return head
        head = nxt


BLOCKS = "label string, dim int, bid long, grp long, lo array<double>, hi array<double>, ids array<long>, " \
         "weights array<long>, unit array<double>"


def _block_rows(rows: int, group: int):
    """Sorted rows (label, dim, id, weight, unit) to blocks; groups of blocks share
    label and dimension."""
    def run(batches):
        from pyspark import TaskContext
        base = TaskContext.get().partitionId() << 32
        bid, grp, in_grp, key, ids, weights, units = base, base, 0, None, [], [], []

        def packed():
            lines = np.stack(units) @ directions(key[1])
            cols = ((key[0], pa.string()), (key[1], pa.int32()), (bid, pa.int64()), (grp, pa.int64()),
                    (lines.min(0), pa.list_(pa.float64())), (lines.max(0), pa.list_(pa.float64())),
                    (ids, pa.list_(pa.int64())), (weights, pa.list_(pa.int64())),
                    (np.concatenate(units), pa.list_(pa.float64())))
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in cols],
                names=["label", "dim", "bid", "grp", "lo", "hi", "ids", "weights", "unit"])

        for batch in batches:
            labels = batch.column(0).to_pylist()
            dims, keys, counts = (batch.column(i).to_numpy() for i in range(1, 4))
            values, offs = batch.column(4).values.to_numpy(), batch.column(4).offsets.to_numpy()
            for r in range(len(labels)):
                new = (labels[r], int(dims[r]))
                if ids and (new != key or len(ids) == rows):
                    yield packed()
                    bid, in_grp, ids, weights, units = bid + 1, in_grp + 1, [], [], []
                    if new != key or in_grp == group:
                        grp, in_grp = bid, 0
                key = new
                ids.append(int(keys[r]))
                weights.append(int(counts[r]))
                units.append(values[offs[r]:offs[r + 1]])
        if ids:
            yield packed()
    return run


def _unit_rows():
    """(label, id, weight, v) to (label, dim, id, weight, unit, first projection)."""
    def run(batches):
        for batch in batches:
            out = {c: [] for c in ("label", "dim", "id", "weight", "unit", "p0")}
            values, offs = batch.column(3).values.to_numpy().astype(np.float64), batch.column(3).offsets.to_numpy()
            for r, (label, key, weight) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                v = values[offs[r]:offs[r + 1]]
                big = np.abs(v).max()
                if big == 0:
                    continue
                v = v / big  # lengths of very large or small components neither overflow nor vanish
                unit = v / np.sqrt((v * v).sum())
                for c, x in (("label", label), ("dim", len(v)), ("id", key), ("weight", weight), ("unit", unit),
                             ("p0", float(unit @ directions(len(v))[:, 0]))):
                    out[c].append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["label"], pa.string()), pa.array(out["dim"], pa.int32()), pa.array(out["id"], pa.int64()),
                 pa.array(out["weight"], pa.int64()), pa.array(out["unit"], pa.list_(pa.float64())),
                 pa.array(out["p0"], pa.float64())], names=list(out))
    return run


def _count_rows(cosine: float, least: int):
    """Sorted rows of a deal: its own blocks (kind 0), then blocks that stream past.
    Gives (id, links, head): links with the blocks met, and one edge to a head."""
    w = window(cosine)

    def run(batches):
        deal, own = None, []
        for batch in batches:
            g, kind, bids, dims = (batch.column(c).to_numpy() for c in range(4))
            cols = [(batch.column(c).values.to_numpy(), batch.column(c).offsets.to_numpy()) for c in (4, 5, 6)]
            for r in range(len(g)):
                if g[r] != deal:
                    deal, own = g[r], []
                ids, weights, unit = (v[o[r]:o[r + 1]] for v, o in cols)
                block = Block(ids.copy(), weights.copy(), unit.reshape(-1, dims[r]).copy())
                if kind[r] == 0:
                    own.append((bids[r], block))
                    continue
                for bid, mine in own:
                    if bid > bids[r] or not mine.may_meet(block, w, least):
                        continue
                    i, j = collisions(mine, block, w, least)
                    if bid == bids[r]:
                        i, j = i[i < j], j[i < j]
                    i, j = verified(mine, block, i, j, cosine)
                    if not len(i):
                        continue
                    n, same = len(mine.ids), bid == bids[r]
                    every = mine.ids if same else np.concatenate([mine.ids, block.ids])
                    far = j if same else j + n
                    load = mine.weights if same else np.concatenate([mine.weights, block.weights])
                    links = np.zeros(len(every), dtype=np.int64)
                    np.add.at(links, i, load[far])
                    np.add.at(links, far, load[i])
                    head = spanning(len(every), i, far)
                    at = np.flatnonzero(links)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(every[at]), pa.array(links[at]), pa.array(every[head[at]])],
                        names=["id", "links", "head"])
    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", label_col: str = "label",
                    vector_col: str = "embedding") -> DataFrame:
    """Per input row: vec_id, n_links, component_id, kept. Labels of any type are compared
    as text."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                          F.col(vector_col).alias("v"))
    live = rows.where(usable("v") & F.expr("vec_id IS NOT NULL AND label IS NOT NULL AND exists(v, x -> x <> 0)"))
    classes = live.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"))
    classes = classes.select("label", "id", "weight", F.col("v").cast("array<double>").alias("v"))
    units = store(arrow_map(classes, _unit_rows(),
                            "label string, dim int, id long, weight long, unit array<double>, p0 double"), "near-units")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-units.count() // (BLOCK_ROWS * GROUP_BLOCKS)))
    order = ["label", "dim", "p0", "id"]
    ordered = units.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    blocks = store(arrow_map(ordered.select("label", "dim", "id", "weight", "unit"),
                             _block_rows(BLOCK_ROWS, GROUP_BLOCKS), BLOCKS), "near-blocks")
    least, w = least_collisions(), window(cosine)
    groups = blocks.groupBy("label", "dim", F.col("grp").alias("deal")).agg(
        F.min("bid").alias("first"), *[F.min(F.col("lo")[i]).alias(f"l{i}") for i in range(M)],
        *[F.max(F.col("hi")[i]).alias(f"h{i}") for i in range(M)])
    groups = groups.select("label", "dim", "deal", "first", F.array(*[f"l{i}" for i in range(M)]).alias("glo"),
                           F.array(*[f"h{i}" for i in range(M)]).alias("ghi"))
    near = F.size(F.filter(F.sequence(F.lit(0), F.lit(M - 1)), lambda i: (
        F.get("glo", i) - w <= F.get("hi", i)) & (F.get("lo", i) - w <= F.get("ghi", i))))
    past = blocks.join(groups, ["label", "dim"]).where((F.col("bid") >= F.col("first")) & (near >= least))
    cols = ["bid", "dim", "ids", "weights", "unit"]
    dealt = (blocks.select(F.col("grp").alias("deal"), F.lit(0).alias("kind"), *cols)
             .union(past.select("deal", F.lit(1).alias("kind"), *cols))
             .repartition("deal").sortWithinPartitions("deal", "kind", "bid"))
    met = store(arrow_map(dealt, _count_rows(cosine, least), "id long, links long, head long"), "near-met")
    comps = connected_components(met.select(F.col("id").alias("u"), F.col("head").alias("v")))
    links = met.groupBy("id").agg(F.sum("links").alias("links"))
    per = classes.select("label", "id", "weight").join(links, "id", "left").join(
        comps, F.col("id") == F.col("vertex"), "left").select(
        "id", "label", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"))
    member = live.groupBy("label", "v").agg(F.min("vec_id").alias("id"))
    tagged = live.join(member, ["label", "v"]).select("vec_id", "label", "id").join(per, ["id", "label"])
    done = tagged.select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(usable("v") & F.expr(
        "vec_id IS NOT NULL AND label IS NOT NULL AND exists(v, x -> x <> 0)"), F.lit(False)))
    out = done.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                        F.col("vec_id").alias("component_id")))
    out = store(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), "near-out")
    forget(units, blocks, met)
    return out
