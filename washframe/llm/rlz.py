"""Substring dedup by relative Lempel-Ziv parsing against reference blocks.

A window is ``window`` consecutive words of one document. Every window has an
anchor: its k-gram of least hash, so documents that share a window share its
anchor. An anchor that occurs in two documents has a reference document, the
least doc_id that holds it. The reference documents' anchored regions form the
reference; it is cut into blocks, each indexed by its windows. Every other
document's regions with such anchors are parsed greedily against each block
that holds one of their anchors: a factor starts at an indexed window (at its
earliest place, hence the least doc_id) and runs as long as the reference
continues it. Factors of ``window`` words or more are duplicate spans; the
windows across factor boundaries are looked up too.

A window that its block does not hold can still repeat in a later document
than the reference; such a window is left over in all documents that hold it,
so grouping the left-over windows by hash finds each one's least doc_id.

Equal texts are parsed once: all but the copies with the least doc_id are
removed whole (if they have a window at all). A hot block's regions are dealt
over several tasks, each with its own copy of the block (at most about
``BLOCK_WORDS`` words, or one longer document's).

Defined results: a null or wordless text has no words and keeps none; rows with
a null doc_id are kept whole and referred to by none; rows that share a doc_id
never remove words from one another; a text shorter than a window loses
nothing. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washframe.llm.common import arrow_map, forget, only_ids, store, without_ids
from washframe.llm.words import gram_hashes, sequence_hash, signed, unsigned, word_hashes

WINDOW = 13
ANCHOR_WORDS = 6
BLOCK_WORDS = 1 << 20      # reference words a block holds on average
TASK_WORDS = 1 << 22       # words that one task parses against its copy of a block
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def kept_digest(text: str | None, removed: np.ndarray | None = None) -> str:
    """sha256 of the kept words, joined by single spaces."""
    words = _WORD.findall((text or "").encode("utf-8"))
    if removed is not None:
        words = [w for w, gone in zip(words, removed.tolist()) if not gone]
    return hashlib.sha256(b" ".join(words)).hexdigest()


def window_anchors(words: np.ndarray, window: int, k: int) -> np.ndarray:
    """Hash of the anchor (least k-gram) of the window that starts at each word."""
    out, width, span = gram_hashes(words, k), 1, window - k + 1
    if len(words) < window:
        return out[:0]
    while 2 * width <= span:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    if width < span:
        out = np.minimum(out[:width - span], out[span - width:])
    return out


def _row_words(column):
    """(row, word hashes) of each row of an Arrow text column."""
    for row, offs, h in word_hashes(column):
        for d in range(len(offs) - 1):
            yield row + d, h[offs[d]:offs[d + 1]]


SCAN_SCHEMA = "doc_id long, n_words long, fa long, fb long, whole string, anchors array<long>"


def _scan_rows(window: int, k: int):
    def run(batches):
        for batch in batches:
            n, fa, fb, anchors = [], [], [], []
            for _, offs, h in word_hashes(batch.column(1)):
                keys = window_anchors(h, window, k)
                for d in range(len(offs) - 1):
                    words = h[offs[d]:offs[d + 1]]
                    a, b = sequence_hash(words)
                    n.append(len(words))
                    fa.append(a)
                    fb.append(b)
                    own = keys[offs[d]:max(offs[d], offs[d + 1] - window + 1)]
                    new = np.ones(len(own), dtype=bool)
                    np.not_equal(own[1:], own[:-1], out=new[1:])
                    anchors.append(signed(np.unique(own[new])))
            whole = [kept_digest(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(fa, pa.int64()),
                 pa.array(fb, pa.int64()), pa.array(whole), pa.array(anchors, pa.list_(pa.int64()))],
                names=["doc_id", "n_words", "fa", "fb", "whole", "anchors"])
    return run


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


REGION_SCHEMA = "block int, parse int, doc long, fa long, at long, words array<long>"


def _region_rows(window: int, k: int):
    """Cut a document into its regions: runs of windows whose anchors belong to one
    block; parse 0 where the document is itself the reference, else 1."""
    def run(batches):
        for batch in batches:
            out = {c: [] for c in ("block", "parse", "doc", "fa", "at", "words")}
            docs, fas = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            shared, heads = batch.column(3), batch.column(4)
            sv, so = unsigned(shared.values.to_numpy()), shared.offsets.to_numpy()
            hv, bv = heads.values.to_numpy(), batch.column(5).values.to_numpy()
            for row, words in _row_words(batch.column(2)):
                if fas[row] != sequence_hash(words)[0]:
                    continue  # another text under the same doc_id
                mine = window_anchors(words, window, k)
                keys = sv[so[row]:so[row + 1]]
                order = np.argsort(keys)
                keys = keys[order]
                place = np.searchsorted(keys, mine)
                place[place == len(keys)] = 0
                hit = keys[place] == mine
                block = np.where(hit, bv[so[row]:so[row + 1]][order][place], -1)
                own = hv[so[row]:so[row + 1]][order][place] == docs[row]
                for parse in (0, 1):
                    mask = hit & (own if parse == 0 else ~own)
                    label = np.where(mask, block, -1)
                    cuts = np.flatnonzero(np.diff(label)) + 1
                    for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(label)]])):
                        if b > a and label[a] >= 0:
                            for c, v in (("block", int(label[a])), ("parse", parse), ("doc", docs[row]),
                                         ("fa", fas[row]), ("at", int(a)),
                                         ("words", signed(words[a:b + window - 1]))):
                                out[c].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["block"], pa.int32()), pa.array(out["parse"], pa.int32()),
                 pa.array(out["doc"], pa.int64()), pa.array(out["fa"], pa.int64()), pa.array(out["at"], pa.int64()),
                 pa.array(out["words"], pa.list_(pa.int64()))], names=list(out))
    return run


class Block:
    """An indexed reference block: words of its regions in order of doc_id."""

    def __init__(self, regions: list[tuple[int, np.ndarray]], window: int):
        regions.sort(key=lambda r: r[0])
        self.window = window
        self.words = np.concatenate([w for _, w in regions])
        sizes = np.array([len(w) for _, w in regions])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        inside = np.concatenate([np.arange(a, a + n - window + 1) for a, n in zip(starts, sizes)])
        owner = np.repeat(np.array([d for d, _ in regions]), sizes - window + 1)
        self.keys, first = np.unique(gram_hashes(self.words, window)[inside], return_index=True)
        self.places, self.docs = inside[first], owner[first]   # earliest place: least doc_id

    def factors(self, words: np.ndarray, doc: int):
        """Greedy parse of a region: ``(factors, left)``. A factor is (start, length
        in words, reference doc); consecutive windows whose reference places are
        consecutive extend one factor, and windows across factor boundaries are
        factors of their own when indexed. ``left`` marks windows not found in a
        document with a smaller id."""
        mine = gram_hashes(words, self.window)
        at = np.searchsorted(self.keys, mine)
        at[at == len(self.keys)] = 0
        found = (self.keys[at] == mine) & (self.docs[at] < doc)
        place = self.places[at]
        joint = np.zeros(len(mine), dtype=bool)
        joint[1:] = found[1:] & found[:-1] & (place[1:] == place[:-1] + 1)
        starts = np.flatnonzero(found & ~joint)
        ends = np.flatnonzero(found & ~np.append(joint[1:], False))
        spans = [(int(a), int(b - a + self.window), int(self.docs[at[a]])) for a, b in zip(starts, ends)]
        return spans, mine, ~found


PARSED_SCHEMA = "doc long, fa long, at long, n long, ref long, h long"


def _parse_rows(window: int):
    """Sorted rows of (block, salt): its reference regions, then regions to parse."""
    def run(batches):
        key, block, regions = None, None, []
        for batch in batches:
            blocks, salts, parses = (batch.column(i).to_numpy() for i in range(3))
            docs, fas, ats = (batch.column(i).to_numpy() for i in range(3, 6))
            wv, wo = unsigned(batch.column(6).values.to_numpy()), batch.column(6).offsets.to_numpy()
            out = [[] for _ in range(6)]
            for i in range(len(blocks)):
                if (blocks[i], salts[i]) != key:
                    key, block, regions = (blocks[i], salts[i]), None, []
                words = wv[wo[i]:wo[i + 1]]
                if parses[i] == 0:
                    regions.append((int(docs[i]), words.copy()))
                    continue
                if block is None:
                    block, regions = Block(regions, window) if regions else False, []
                if block:
                    spans, mine, left = block.factors(words, docs[i])
                else:
                    spans, mine = [], gram_hashes(words, window)
                    left = np.ones(len(mine), dtype=bool)
                rest = np.flatnonzero(left)
                m = len(spans)
                out[0].append(np.full(m + len(rest), docs[i]))
                out[1].append(np.full(m + len(rest), fas[i]))
                out[2].append(np.concatenate([np.array([s[0] for s in spans], np.int64), rest]) + ats[i])
                out[3].append(np.concatenate([np.array([s[1] for s in spans], np.int64), np.zeros(len(rest), np.int64)]))
                out[4].append(np.concatenate([np.array([s[2] for s in spans], np.int64), np.zeros(len(rest), np.int64)]))
                out[5].append(np.concatenate([np.zeros(m, np.int64), signed(mine[rest])]))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out],
                                                 names=["doc", "fa", "at", "n", "ref", "h"])
    return run


def _cut_rows():
    """Apply spans to a text: words left, number removed, digest, kept text."""
    def run(batches):
        for batch in batches:
            out = {"doc_id": [], "fa": [], "n_removed": [], "kept_sha256": [], "kept_text": []}
            spans, lens = batch.column(3), batch.column(4)
            sv, so = spans.values.to_numpy(), spans.offsets.to_numpy()
            lv = lens.values.to_numpy()
            hashes = {row: sequence_hash(words)[0] for row, words in _row_words(batch.column(2))}
            for i, (doc, fa, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                if hashes[i] != fa:
                    continue  # another text under the same doc_id
                words = _WORD.findall((text or "").encode("utf-8"))
                depth = np.zeros(len(words) + 1, dtype=np.int64)
                a, b = sv[so[i]:so[i + 1]], sv[so[i]:so[i + 1]] + lv[so[i]:so[i + 1]]
                np.add.at(depth, a, 1)
                np.add.at(depth, b, -1)
                gone = np.cumsum(depth)[:-1] > 0
                kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                for c, v in (("doc_id", doc), ("fa", fa), ("n_removed", int(gone.sum())),
                             ("kept_sha256", hashlib.sha256(kept).hexdigest()), ("kept_text", kept.decode("utf-8"))):
                    out[c].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["doc_id"], pa.int64()), pa.array(out["fa"], pa.int64()),
                 pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_sha256"], pa.string()),
                 pa.array(out["kept_text"], pa.string())], names=list(out))
    return run


class SubstringDedup:
    """Duplicate spans of documents and the words left without them."""

    def __init__(self, docs: DataFrame, window: int = WINDOW, anchor_words: int = ANCHOR_WORDS,
                 block_words: int = BLOCK_WORDS, task_words: int = TASK_WORDS,
                 id_col: str = "doc_id", text_col: str = "text"):
        self.window, self.k = window, min(anchor_words, window)
        self.block_words, self.task_words = block_words, task_words
        self.texts = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                                 F.col(text_col).cast("string").alias("text"))
        rows = arrow_map(self.texts, _scan_rows(window, self.k), SCAN_SCHEMA)
        self.scan = store(rows.withColumn("rid", F.monotonically_increasing_id()), "rlz-scan")
        usable = self.scan.where(f"doc_id IS NOT NULL AND n_words >= {window}")
        usable = usable.select("n_words", "fa", "fb", "doc_id", "rid")
        self.least = store(usable.groupBy("n_words", "fa", "fb").agg(F.min(F.struct("doc_id", "rid")).alias("r"))
                           .select("n_words", "fa", "fb", F.col("r.doc_id").alias("rep"), F.col("r.rid").alias("one")),
                           "rlz-least")
        self.copies = store(usable.join(self.least, ["n_words", "fa", "fb"]).where("rid <> one").select("rid"),
                            "rlz-copies")

    def _shared(self) -> DataFrame:
        """(doc, fa, [anchor], [reference doc]) of the texts that share anchors."""
        reps = without_ids(self.scan.where(f"doc_id IS NOT NULL AND n_words >= {self.window}"), self.copies, ["rid"])
        entries = reps.select(F.col("doc_id").alias("doc"), "fa", F.explode("anchors").alias("a"))
        shared = store(entries.groupBy("a").agg(F.min("doc").alias("head"), F.count("*").alias("g"))
                       .where("g > 1").select("a", "head"), "rlz-anchors")
        out = store(entries.join(shared, "a").groupBy("doc", "fa").agg(
            F.collect_list(F.struct("a", "head")).alias("m"))
            .select("doc", "fa", F.col("m.a").alias("a"), F.col("m.head").alias("head")), "rlz-routes")
        forget(shared)
        return out

    def spans(self) -> DataFrame:
        """(doc, fa, at, n, ref): spans of n words that repeat from document ref,
        for the texts that are not whole copies of another. Spans may overlap."""
        routes = self._shared()
        # words of reference regions: each anchor stands for about (window - k + 2) / 2 windows
        per_anchor = (self.window - self.k + 2) / 2
        pairs = routes.select("doc", F.explode("head").alias("head"))
        mine = pairs.agg(F.count_if(F.col("doc") == F.col("head"))).first()[0]
        blocks = max(1, round(mine * per_anchor / self.block_words))

        def block(col):
            return F.pmod(F.xxhash64(col), F.lit(blocks)).cast("int")

        loads = (pairs.where("doc <> head").groupBy("head").agg(F.count("*").alias("n"))
                 .select(block("head").alias("block"), "n")
                 .groupBy("block").agg(F.sum("n").alias("n"))
                 .select("block", F.greatest(F.lit(1), F.ceil(F.col("n") * per_anchor / self.task_words))
                         .cast("int").alias("salts")))
        loads = store(loads, "rlz-loads")
        ids = store(routes.select(F.col("doc").alias("doc_id")).distinct(), "rlz-ids")
        texts = only_ids(self.texts, ids, ["doc_id"]).join(
            routes.withColumnRenamed("doc", "doc_id"), "doc_id").select("doc_id", "fa", "text", "a", "head", F.transform("head", block).alias("block"))
        regions = arrow_map(texts, _region_rows(self.window, self.k), REGION_SCHEMA)
        dealt = regions.join(loads, "block").withColumn("salt", F.explode(F.expr(
            "CASE WHEN parse = 0 THEN sequence(0, salts - 1) "
            "ELSE array(cast(pmod(xxhash64(doc, fa, at), salts) AS int)) END")))
        dealt = (dealt.select("block", "salt", "parse", "doc", "fa", "at", "words")
                 .repartition("block", "salt").sortWithinPartitions("block", "salt", "parse", "doc", "at"))
        parsed = store(arrow_map(dealt, _parse_rows(self.window), PARSED_SCHEMA), "rlz-parsed")
        left = parsed.where("n = 0").select("doc", "fa", "at", "h")
        least = store(left.groupBy("h").agg(F.min("doc").alias("ref"), F.max("doc").alias("last"))
                      .where("ref < last").select("h", "ref"), "rlz-left")
        more = left.join(least, "h").where("ref < doc").select("doc", "fa", "at", F.lit(self.window).alias("n"), "ref")
        out = store(parsed.where("n > 0").select("doc", "fa", "at", "n", "ref").union(more), "rlz-spans")
        forget(routes, loads, ids, parsed, least)
        return out

    def cleaned(self) -> DataFrame:
        """Per input row: doc_id, n_words, n_removed, kept_sha256, kept_text (null
        when the whole text is kept as it is; empty when all of it goes)."""
        spans = self.spans()
        ids = store(spans.select(F.col("doc").alias("doc_id")).distinct(), "rlz-cut-ids")
        per_doc = spans.groupBy(F.col("doc").alias("doc_id"), "fa").agg(
            F.collect_set(F.struct("at", "n")).alias("s"))
        work = only_ids(self.texts, ids, ["doc_id"]).join(per_doc, "doc_id").select(
            "doc_id", "fa", "text", F.col("s.at").alias("at"), F.col("s.n").alias("n"))
        cut = arrow_map(work, _cut_rows(), "doc_id long, fa long, n_removed long, kept_sha256 string, kept_text string")
        cut = store(cut.dropDuplicates(["doc_id", "fa"]), "rlz-cut")
        forget(spans, ids)
        rows = self.scan.select("doc_id", "n_words", "fa", "fb", "whole").join(
            self.least, ["n_words", "fa", "fb"], "left").join(cut, ["doc_id", "fa"], "left")
        copy = F.coalesce(F.col("doc_id") > F.col("rep"), F.lit(False))
        return rows.select(
            "doc_id", "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(copy, F.lit(hashlib.sha256(b"").hexdigest()))
             .otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
            F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"))
