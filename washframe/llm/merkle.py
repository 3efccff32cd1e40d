"""Merkle manifest of a table, with a witness for every row, by streamed appends.

Rows are leaves. The leaves of a language, by doc_id, form a binary tree; the roots of
the languages (null first, then by their UTF-8 bytes) form another one, whose root
stands for the table.

The trees grow by aligned appends. The leaves of a block (``BLOCK`` consecutive places,
a power of two) reach one task in order. An appended leaf opens a subtree of height 0;
two open subtrees of one height complete each other: every row below gets the other
side's root as the next entry of its partial witness, and the two become one subtree.
At the end of a block the last open subtrees are raised alone. A block's root is a
leaf of the next round, which appends the roots of all blocks in the same way, and so
on until a language has one node. The witness of a leaf is its own, then that of its
block, that of the block's block and so on, and last that of its language.

A witness is an array of strings, one for each level: ``L`` or ``R`` and the sibling's
digest on the left or right, ``-`` where a node is raised alone. ``fold`` recomputes the
root from a leaf and its witness.

Order: null doc_ids first; rows of one doc_id by leaf digest, so equal rows may change
places, which changes no result. Any column may be null (``-``). An empty table has no
rows and no root. Extra columns are ignored, and all names inside are own ones.

Places come from range partitions and their row counts, by (partition, language), so a
language that holds most rows is spread like the others. No task holds more than one
block of leaves at a time; the rounds are log(rows) / log(BLOCK).
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from washframe.llm.common import ID_BROADCAST_ROWS, arrow_map, forget, store

BLOCK = 256                      # leaves of a block, a power of two
BLOCK_BROADCAST_ROWS = 20_000    # witnesses of blocks (about 1 KB each) broadcast up to this counted number
_ROWS = 4096                     # rows of an output batch


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class OpenTree:
    """A tree under construction: open subtrees of falling height."""

    def __init__(self):
        self.open: list[tuple[int, str, list[int]]] = []   # (height, root, leaves below)
        self.witness: list[list[str]] = []

    def append(self, leaf: str) -> None:
        self.witness.append([])
        self.open.append((0, leaf, [len(self.witness) - 1]))
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            self._complete()

    def _complete(self) -> None:
        """The last two open subtrees, of one height, become one."""
        height, right, below_right = self.open.pop()
        _, left, below_left = self.open.pop()
        for i in below_left:
            self.witness[i].append("R" + right)
        for i in below_right:
            self.witness[i].append("L" + left)
        self.open.append((height + 1, digest(left + right), below_left + below_right))

    def close(self, height: int) -> str:
        """Root when all that is open is raised to one subtree of a height."""
        while len(self.open) > 1 or self.open[0][0] < height:
            at, root, below = self.open[-1]
            if len(self.open) > 1 and self.open[-2][0] == at:
                self._complete()
            else:
                for i in below:
                    self.witness[i].append("-")
                self.open[-1] = (at + 1, digest(root), below)
        return self.open[0][1]


def height_of(nodes: int, block: int) -> int:
    """Levels that a block of a language with so many nodes adds."""
    return (min(nodes, block) - 1).bit_length()


def _append_rows(block: int, names: list[str], kinds: list):
    """Streams rows that begin with (lane, place, node, total), blocks in order, and adds
    the witness, and the block's root on its first row."""
    names, kinds = [*names, "witness", "root"], [*kinds, pa.list_(pa.string()), pa.string()]

    def run(batches):
        held, tree, key, total = [], OpenTree(), None, 0

        def closed():
            root = tree.close(height_of(total, block))
            return [(*row, w, root if k == 0 else None) for k, (row, w) in enumerate(zip(held, tree.witness))]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        out = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                now = (row[0], row[1] // block)
                if now != key:
                    if held:
                        out += closed()
                    held, tree, key = [], OpenTree(), now
                    if len(out) >= _ROWS:
                        yield batch_of(out)
                        out = []
                held.append(row)
                total = row[3]
                tree.append(row[2])
        if held:
            out += closed()
        if out:
            yield batch_of(out)
    return run


_NODE = ["lane", "place", "node", "total"]


def append_blocks(nodes: DataFrame, block: int = BLOCK, carried: tuple[str, ...] = ()) -> DataFrame:
    """One round of appends over nodes (lane, place, node, total and carried columns)."""
    dealt = (nodes.select(*_NODE, *carried, F.floor(F.col("place") / block).alias("block"))
             .repartition("lane", "block").sortWithinPartitions("lane", "block", "place").drop("block"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema)
    kinds = list(to_arrow_schema(dealt.schema).types)
    return arrow_map(dealt, _append_rows(block, dealt.columns, kinds), f"{schema}, witness array<string>, root string")


def placed(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """``rows`` with place (from 0, in the given order within a lane) and total, the
    lane's rows. The counts that are summed are by (range partition, lane)."""
    parts = rows.repartitionByRange("lane", *order).sortWithinPartitions("lane", *order)
    parts = parts.withColumn("_m", F.monotonically_increasing_id()).select(
        "*", F.shiftright("_m", 33).alias("_p"), F.expr("_m & 8589934591").alias("_i")).drop("_m")
    parts = store(parts, label)
    runs = parts.groupBy("_p", "lane").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    runs = runs.selectExpr("_p", "lane", "_first", "sum(_n) OVER (PARTITION BY lane) AS total",
                           "sum(_n) OVER (PARTITION BY lane ORDER BY _p) - _n AS _before")
    runs = store(runs, label)   # at most partitions + lanes rows
    few = runs.count() <= ID_BROADCAST_ROWS
    out = parts.join(F.broadcast(runs) if few else runs, ["_p", "lane"]).withColumn("place", F.col("_before") + F.col("_i") - F.col("_first"))
    out = store(out.drop("_p", "_i", "_before", "_first"), label)
    forget(parts, runs)
    return out


def grow(nodes: DataFrame, block: int = BLOCK, carried: tuple[str, ...] = ()) -> tuple[list[DataFrame], DataFrame]:
    """All rounds over nodes (lane, place, node, total): the stored rounds, and one row
    per lane (lane, node) with its root."""
    rounds = [store(append_blocks(nodes, block, carried), "merkle-round")]
    while True:
        last = rounds[-1]
        roots = last.where("root IS NOT NULL")
        if (last.agg(F.max("total")).first()[0] or 0) <= block:
            break
        up = roots.select("lane", F.floor(F.col("place") / block).alias("place"), F.col("root").alias("node"),
                          F.ceil(F.col("total") / block).alias("total"))
        rounds.append(store(append_blocks(up, block), "merkle-round"))
    return rounds, roots.select("lane", F.col("root").alias("node"))


def _above(rounds: list[DataFrame], top: DataFrame, block: int) -> DataFrame:
    """Rows of the first round with ``above``, their whole witness; ``top`` has (lane, above,
    and what else the rows shall get) of the lanes."""
    more = [c for c in top.columns if c not in ("lane", "above")]
    above = top.withColumn("block", F.lit(0).cast("long"))
    for rows in reversed(rounds):
        mine = rows.drop("root").withColumn("block", F.floor(F.col("place") / block))
        few = above.count() <= BLOCK_BROADCAST_ROWS
        joined = mine.join(F.broadcast(above) if few else above.hint("merge"), ["lane", "block"])
        joined = joined.withColumn("above", F.concat("witness", "above")).drop("witness", "block")
        if rows is rounds[0]:
            return joined
        above = store(joined.select("lane", F.col("place").alias("block"), "above", *more), "merkle-above")


def fold(leaf: Column, witness: Column) -> Column:
    """Root that a leaf and its witness give."""
    def step(at, entry):
        side, other = F.substring(entry, 1, 1), F.substring(entry, 2, 64)
        return F.sha2(F.when(side == "L", F.concat(other, at)).when(side == "R", F.concat(at, other)).otherwise(at), 256)
    return F.aggregate(witness, leaf, step)


def proof_digest(witness: Column) -> Column:
    """SHA-256 of the siblings of a witness, from the leaf up."""
    return F.sha2(F.array_join(F.transform(F.filter(witness, lambda e: e != "-"), lambda e: F.substring(e, 2, 64)), ""), 256)


def _field(column) -> Column:
    text = F.col(column).cast("string") if isinstance(column, str) else column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(n_chars=None) -> Column:
    """SHA-256 of doc_id, source, lang, n_chars and text: ``-`` if null, else the length
    in bytes, ``:`` and the value."""
    fields = ("doc_id", "source", "lang", "n_chars" if n_chars is None else n_chars, "text")
    return F.sha2(F.concat(*[_field(f) for f in fields]), 256)


class MerkleManifest:
    """Trees, roots and witnesses of a table with the columns of ``documents``.

    ``tampered`` (a boolean column over them) marks rows for which ``verified`` recomputes
    the root from the row with one more character; nulls stay."""

    def __init__(self, docs: DataFrame, tampered: Column | None = None, block: int = BLOCK):
        if block < 2 or block & (block - 1):
            raise ValueError("block must be a power of two above 1")
        self.block = block
        lane = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))
        changed = leaf_digest(F.col("n_chars").cast("decimal(20,0)") + 1)
        hit = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
        leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lane.alias("lane"),
                             leaf_digest().alias("node"), F.when(hit, changed).alias("changed"))
        digests = store(leaves, "merkle-leaves")
        leaves = placed(digests, ["doc_id", "node"], "merkle-placed")
        forget(digests)
        self.rounds, subroots = grow(leaves, block, ("doc_id", "changed"))
        lanes = placed(subroots.select(F.lit("").alias("lane"), F.col("lane").alias("name"), "node"), ["name"],
                       "merkle-lanes")
        tops, root = grow(lanes, block, ("name",))
        self.root = next((r["node"] for r in root.collect()), None)   # the one root
        root = root.select("lane", F.expr("cast(array() AS array<string>)").alias("above"))
        self.lanes = store(_above(tops, root, block).select(F.col("name").alias("lane"), F.col("node").alias("subroot"),
                                                            "above"), "merkle-subroots")
        forget(leaves, lanes, *tops)

    def witnesses(self) -> DataFrame:
        """Per row doc_id, leaf, changed (leaf of the tampered row or null), subroot, root
        and its whole witness."""
        rows = _above(self.rounds, self.lanes, self.block)
        return rows.select("doc_id", F.col("node").alias("leaf"), "changed", "subroot", F.lit(self.root).alias("root"),
                           F.col("above").alias("witness"))

    def verified(self) -> DataFrame:
        """Per row doc_id, leaf, subroot, root, proof_sha256, folded_root (from the
        tampered row where it is marked) and whether that is the root."""
        rows = self.witnesses()
        folded = fold(F.coalesce("changed", "leaf"), F.col("witness"))
        return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("witness")).alias("proof_sha256"),
                           folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
