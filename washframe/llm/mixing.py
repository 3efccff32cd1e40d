"""Mixing sources to target weights by capped water-filling.

Every source has a weight and a size (words). A total is shared by weight; a
share above ``max_epochs`` times its source's size is clamped there, and the
excess goes to the other sources by weight, until none is above: every target
is min(cap, weight x level), and the level is found by rounds of one
aggregation over the source table (two numbers reach the driver).

A source's target is met by whole repetitions of all its documents plus, for
the rest, a seeded choice: documents in order of a hash of seed, doc_id and
text are taken once more while the words last. Prefix sums over hash ranges of
about ``RANGE_ROWS`` rows find where that is, so a hot source is never ordered
in one task; only the range at the end is gone through document by document,
filling up with the longest that still fit. What room is left goes to documents of
the following ranges, again by prefix sums: those longer than the room are set
aside, and so on until no document fits. A last one is taken if that comes nearer.

Defined results: a null or wordless text has size 0; a null source is a source,
last in order; rows equal in doc_id and text share one decision; an empty table
gives no rows; ties of the hash go to the smaller doc_id. Extra columns are
kept by ``mixed``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washframe.llm.common import ID_BROADCAST_ROWS, forget, numbered, store

WORD_GAP = r"[\x20\x09-\x0D]+"
RANGE_ROWS = 256
SPAN_RANGES = 1024   # ranges whose prefix sums are ordered at a time


def word_count(col) -> F.Column:
    """Words between white space (null: 0)."""
    parts = F.split(F.coalesce(col, F.lit("")), WORD_GAP, -1)
    edges = (F.element_at(parts, 1) == "").cast("int") + (
        (F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    return (F.size(parts) - edges).cast("long")


def _checked(df: DataFrame) -> DataFrame:
    """A broadcast hint for a counted, small side."""
    return F.broadcast(df) if df.count() <= ID_BROADCAST_ROWS else df


def water_level(sources: DataFrame, max_epochs: float) -> float:
    """The level of min(max_epochs * source_size, weight * level), shared over all
    sizes; ``sources`` has weight and source_size."""
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return 0.0
    level, clamped = total / weights, -1
    while True:
        over = F.col("weight") * level > F.col("source_size") * float(max_epochs)
        n, held, free = sources.agg(
            F.count_if(over), F.sum(F.when(over, F.col("source_size") * float(max_epochs))),
            F.sum(F.when(~over, F.col("weight")))).first()
        if n == clamped or not free:
            return level
        clamped, level = n, (total - (held or 0.0)) / free


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """Choose rows of one range: in turn up to the first that is too long, then the
    longest that still fit."""
    pdf = pdf.sort_values(["u", "doc_id"], kind="stable")
    left, words = float(pdf["room"].iloc[0]), pdf["words"].to_numpy()
    take = np.cumsum(words) <= left
    left -= float(words[take].sum())
    for i in np.argsort(-words, kind="stable"):
        if not take[i] and words[i] <= left:
            take[i], left = True, left - float(words[i])
    return pdf.loc[take, ["skey", "u", "doc_id", "words"]]


_TAKEN = "skey string, u long, doc_id long, words long"


class Mixture:
    """Targets per source and repetitions per document."""

    def __init__(self, docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: float = 3,
                 seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
        self.docs, self.seed, self.max_epochs = docs, seed, max_epochs
        self.cols = (id_col, text_col, source_col)
        self.sized = store(self._keyed(docs).select("skey", "u", "doc_id", "size"), "mix-sized")
        per = self.sized.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
        ranked = numbered(per, [F.col("skey")], "rank", "mix-sources")
        picks = F.array(*[F.lit(float(w)) for w in weights])
        ranked = ranked.withColumn("weight", F.element_at(picks, (F.col("rank") % len(weights) + 1).cast("int")))
        level = water_level(ranked, max_epochs)
        target = F.least(F.col("source_size") * float(max_epochs), F.col("weight") * level)
        self.sources = store(
            ranked.withColumn("target", target)
            .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                        .otherwise(0).cast("long"))
            .withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
            .withColumn("ranges", F.ceil(F.col("rows") / RANGE_ROWS))
            .select("skey", "source_size", "weight", "target", "whole", "rest", "ranges"), "mix-targets")
        self._choose()

    def _keyed(self, df: DataFrame) -> DataFrame:
        id_col, text_col, source_col = self.cols
        text = F.col(f"`{text_col}`").cast("string")
        return df.select(
            # a leading mark keeps the null source last and apart from any text
            F.coalesce(F.concat(F.lit("0"), F.col(f"`{source_col}`").cast("string")), F.lit("1")).alias("skey"),
            F.xxhash64(F.lit(self.seed), F.col(f"`{id_col}`"), text).alias("u"),
            F.col(f"`{id_col}`").cast("long").alias("doc_id"), word_count(text).alias("size"), F.struct("*").alias("row"))

    @staticmethod
    def _range() -> F.Column:
        """Hash range of a row within its source; grows with u as an unsigned half."""
        return F.floor(F.shiftrightunsigned("u", 1) / F.lit(float(1 << 63)) * F.col("ranges"))

    @staticmethod
    def _edges(rows: DataFrame, room: str, words: str) -> DataFrame:
        """Per source the range in which its words pass its room, and the room there.

        Prefix sums of two levels: over spans of ``SPAN_RANGES`` ranges first, then over
        the ranges of the one span where the words pass, so no task orders all ranges of
        a hot source."""
        sums = rows.groupBy("skey", F.col(room).alias("room"), "range").agg(F.sum(words).alias("words"))
        sums = store(sums.withColumn("span", F.floor(F.col("range") / SPAN_RANGES)), "mix-ranges")
        spans = sums.groupBy("skey", "room", "span").agg(F.sum("words").alias("words")).selectExpr(
            "skey", "room", "span", "words", "sum(words) OVER (PARTITION BY skey ORDER BY span) AS upto")
        span = spans.where("upto > room").groupBy("skey").agg(
            F.min(F.struct("span", (F.col("upto") - F.col("words")).alias("before"))).alias("e"))
        span = store(span.select("skey", "e.span", "e.before"), "mix-spans")   # a row a source
        run = sums.join(_checked(span), ["skey", "span"]).selectExpr(
            "skey", "room", "range", "words", "before + sum(words) OVER (PARTITION BY skey ORDER BY range) AS upto")
        edges = store(run.where("upto > room").groupBy("skey").agg(
            F.min(F.struct("range", (F.col("room") - F.col("upto") + F.col("words")).alias("room"))).alias("e"))
            .select("skey", F.col("e.range").alias("edge"), "e.room"), "mix-edges")
        forget(sums, span)
        return edges

    @staticmethod
    def _room_left(rooms: DataFrame, got: DataFrame) -> DataFrame:
        """rooms (skey, left) less the words of got."""
        used = got.groupBy("skey").agg(F.sum("words").alias("used"))
        return store(rooms.join(used, "skey", "left").select(
            "skey", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left")), "mix-rooms")

    def _choose(self) -> None:
        """Per source the range where the words end, and the rows taken from there on."""
        rows = self.sized.join(_checked(self.sources.select("skey", "rest", "ranges")), "skey") \
            .withColumn("range", self._range())
        self.edges = self._edges(rows, "rest", "size")
        behind = rows.join(_checked(self.edges), "skey").where("range >= edge")
        at_edge = behind.where("range = edge").groupBy("skey", "u", "doc_id", "room").agg(F.sum("size").alias("words"))
        taken = store(at_edge.groupBy("skey").applyInPandas(_fit, _TAKEN), "mix-taken")
        rooms = self._room_left(self.edges.select("skey", F.col("room").alias("left")), taken)
        # rows equal in doc_id and text are equal in size, so a long row rules its document out
        later = behind.where("range > edge AND size > 0").join(_checked(rooms), "skey").where("size <= left")
        later = later.groupBy("skey", "u", "doc_id", "range", "left").agg(F.sum("size").alias("words"))
        later = store(later.where("words <= left"), "mix-later")
        # Each round ends behind its edge, with less room or longer documents set aside.
        while not later.isEmpty():
            edge = self._edges(later, "left", "words")
            placed = later.join(_checked(edge), "skey", "left")
            whole = placed.where("edge IS NULL OR range < edge").select("skey", "u", "doc_id", "words")
            ends = placed.where("range = edge").groupBy("skey").applyInPandas(_fit, _TAKEN)
            got = store(whole.union(ends), "mix-got")
            old = (later, taken, rooms)
            rooms = self._room_left(rooms, got)
            later = store(placed.where("range > edge").drop("left", "edge", "room").join(_checked(rooms), "skey")
                          .where("words <= left"), "mix-later")
            taken = store(taken.union(got), "mix-taken")
            forget(edge, got, *old)
        # all that is not taken is longer than the room: the shortest may come nearer
        near = behind.where("size > 0").join(_checked(rooms), "skey").where("size < 2 * left")
        near = near.groupBy("skey", "u", "doc_id", "left").agg(F.sum("size").alias("words")).where("words < 2 * left")
        on = (F.col("n.skey") == F.col("t.skey")) & (F.col("n.u") == F.col("t.u")) & F.col("n.doc_id").eqNullSafe(
            F.col("t.doc_id"))
        near = near.alias("n").join(_checked(taken).alias("t"), on, "left_anti")
        last = near.groupBy("skey").agg(F.min(F.struct("words", "u", "doc_id")).alias("m"))
        self.taken = store(taken.union(last.select("skey", "m.u", "m.doc_id", "m.words")).drop("words"), "mix-taken")
        forget(later, taken, rooms)

    def _decided(self, rows: DataFrame) -> DataFrame:
        """rows (skey, u, doc_id, size, ...) with target columns and copies."""
        plan = self.sources.join(self.edges.select("skey", "edge"), "skey", "left")
        taken = self.taken.withColumn("extra", F.lit(1)).withColumnRenamed("doc_id", "tid")
        on = (F.col("r.skey") == F.col("t.skey")) & (F.col("r.u") == F.col("t.u")) & F.col("r.doc_id").eqNullSafe(
            F.col("t.tid"))
        out = rows.join(_checked(plan), "skey").withColumn("range", self._range())
        out = out.alias("r").join(_checked(taken).alias("t"), on, "left").select("r.*", "t.extra")
        # no edge: the rest covers the whole source, or there is none
        extra = F.when(F.col("rest") <= 0, F.lit(0)).when(F.col("edge").isNull() | (F.col("range") < F.col("edge")), F.lit(1)) \
            .otherwise(F.coalesce("extra", F.lit(0)))
        return out.withColumn("copies", (F.col("whole") + extra).cast("long"))

    def plan(self) -> DataFrame:
        """Per input row: doc_id, size, source_size, target, taken, copies."""
        return self._decided(self.sized).select(
            "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")

    def mixed(self) -> DataFrame:
        """The documents themselves, each as often as the mix takes it."""
        out = self._decided(self._keyed(self.docs)).where("copies > 0")
        return out.withColumn("copy", F.explode(F.expr("sequence(1, copies)"))).select("row.*")


def targets_by_hand(sizes: list[int], weights: list[float], max_epochs: float) -> list[float]:
    """Water-filling of a short list, source by source (for tests and reports)."""
    total, open_, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    left = total
    while open_:
        w = math.fsum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * left / w > max_epochs * sizes[i]]
        if not over:
            for i in open_:
                out[i] = weights[i] * left / w
            break
        for i in over:
            out[i] = float(max_epochs * sizes[i])
            open_.remove(i)
        left = total - math.fsum(out)
    return out

