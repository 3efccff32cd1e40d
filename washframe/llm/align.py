"""Cross-tokenizer alignment by byte anchors.

Every text is encoded whole by two tokenizers: A, byte-level BPE, on a space and the
text; B, a sentencepiece model, on the text (it adds the space itself). The bytes of
both token sequences are joined and compared with the space and the text; a text that
fails has no tokens.

Anchors, the byte offsets at which both sides have an end, cut the tokens into groups; the
offsets at which either has one cut the text into pieces, and each piece is the overlap of
one token of A with one of B: a link. Links of equal ids are counted over the corpus (a
text's equal links first, then each task's, then all). The counts come back to the texts as sorted arrays, ``SLICE_PAIRS`` id pairs at a time: with more pairs
the texts are passed once for each slice.

Defined results: null or empty texts and those that fail the comparison have zeros and
''; every row counts, copies too; a null doc_id stays null; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washframe.llm.common import arrow_map, forget, store

MEMO_WINDOWS = 0   # alignments that a worker keeps: none, each text is aligned at once
SLICE_PAIRS = 2_000_000   # id pairs (17 bytes each) that are broadcast at a time
ROWS = 64
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_workers: dict[tuple[str, str], "Aligner"] = {}


def byte_level_alphabet() -> dict[str, int]:
    """Character that stands for each byte in byte-level vocabularies: printable ones
    for themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevelTokens:
    """Ids of texts, without special tokens, by a byte-level BPE in a ``tokenizers`` file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.lossless = False
        alphabet, special = byte_level_alphabet(), {t["content"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        names = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()}
        self.bytes = [names.get(i, b"") for i in range(max(names) + 1)]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [vocab[a + b] for a, b in merges]
        pre = spec["pre_tokenizer"]
        if made == sorted(made) and pre["type"] == "ByteLevel" and pre["use_regex"] and not spec["normalizer"]:
            # ids rise in the order of the merges: ranks, which tiktoken encodes faster
            import tiktoken
            ranks = {b: i for i, b in names.items()}
            encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            # every byte has an id and the pattern leaves no character out, so joined tokens are the text's bytes
            self.lossless = len({b for b in ranks if len(b) == 1}) == 256
            self.encode = partial(encoding.encode_to_numpy, disallowed_special=()) if self.lossless else encoding.encode_ordinary
        else:
            import os

            from tokenizers import Tokenizer
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            self.encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids


class PieceTokens:
    """Ids of texts by a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.encode = model.encode
        self.bytes, self.lossless = [], False
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else
                              piece.replace("▁", " ").encode())


class Aligner:
    """Alignments of texts under one pair of vocabularies."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevelTokens(path_a), PieceTokens(path_b)
        self.lengths = [np.array([len(t) for t in side.bytes]) for side in (self.a, self.b)]
        # decimal ids with what follows them: A's within and at the end of a group, B's likewise
        self.parts = [f"{i}{mark}" for side, marks in ((self.a, ",|"), (self.b, ",;"))
                      for mark in marks for i in range(len(side.bytes))]

    def text(self, text: str | None):
        """(n_a, n_b, n_groups, n_links, groups, id pairs, their numbers) or None."""
        if not text:
            return None
        raw, a, b = (" " + text).encode(), self.a.encode(" " + text), self.b.encode(text)
        for ids, side in ((a, self.a), (b, self.b)):
            if not side.lossless and b"".join(map(side.bytes.__getitem__, ids)) != raw:
                return None
        a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        ends = np.zeros((2, len(raw) + 1), dtype=bool)
        for mark, ids, sizes in zip(ends, (a, b), self.lengths):
            mark[np.cumsum(sizes[ids])] = True
        # pieces in order: whether a token of A, of B, and so a group, ends with them
        ends = ends[:, ends[0] | ends[1]]
        (of_a, of_b), both = ends, ends[0] & ends[1]
        upto_a, upto_b, upto = np.cumsum(of_a), np.cumsum(of_b), np.cumsum(both)
        links = a[upto_a - of_a] << 32 | b[upto_b - of_b]
        # ids and marks group by group, those of A first
        group = upto - both
        before_b = np.concatenate([[0], upto_b[both]])[group[of_a]]
        through_a = upto_a[both][group[of_b]]
        n_a, n_b = len(self.a.bytes), len(self.b.bytes)
        parts = np.empty(len(a) + len(b), dtype=np.int64)
        parts[np.arange(len(a)) + before_b] = a + n_a * both[of_a]
        parts[np.arange(len(b)) + through_a] = b + 2 * n_a + n_b * both[of_b]
        groups = "".join(map(self.parts.__getitem__, parts.tolist()))[:-1]
        pairs, times = np.unique(links, return_counts=True)
        return len(a), len(b), int(upto[-1]), len(links), groups, pairs, times


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_PAIRS = "pairs array<long>, times array<int>, n_best long, count_sum long"


def _aligned_rows(path_a: str, path_b: str, keep_groups: bool):
    none = (0, 0, 0, 0, None, np.zeros(0, np.int64), np.zeros(0, np.int64))

    def run(batches):
        aligner = _workers.get((path_a, path_b)) or _workers.setdefault((path_a, path_b), Aligner(path_a, path_b))
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                part = batch.slice(lo, ROWS)
                found = [aligner.text(t) or none for t in part.column(1).to_pylist()]
                cols = [part.column(0)] + [pa.array([f[k] for f in found], pa.int64()) for k in range(4)]
                cols.append(pa.array(["" if f[4] is None else hashlib.sha256(f[4].encode()).hexdigest() for f in found],
                                     pa.string()))
                if keep_groups:
                    cols.append(pa.array([f[4] or "" for f in found], pa.string()))
                zero = pa.array(np.zeros(len(found), np.int64))
                cols += [pa.array([f[5] for f in found], pa.list_(pa.int64())),
                         pa.array([f[6].astype(np.int32) for f in found], pa.list_(pa.int32())), zero, zero]
                names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *["groups"] * keep_groups,
                         "pairs", "times", "n_best", "count_sum"]
                yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def _weighed_rows(counts):
    """Adds to n_best and count_sum what the broadcast slice of pair counts knows."""
    def run(batches):
        pairs, n, best = counts.value
        for batch in batches:
            at = {name: batch.schema.get_field_index(name) for name in batch.schema.names}
            lists, times = batch.column(at["pairs"]), batch.column(at["times"])
            offs = lists.offsets.to_numpy()
            flat = lists.values.to_numpy()[offs[0]:offs[-1]]
            t_offs = times.offsets.to_numpy()
            t = times.values.to_numpy()[t_offs[0]:t_offs[-1]].astype(np.int64)
            cols = {name: batch.column(k) for name, k in at.items()}
            if len(pairs):
                where = np.minimum(np.searchsorted(pairs, flat), len(pairs) - 1)
                here = (pairs[where] == flat) * t
                for name, values in (("n_best", best[where] * here), ("count_sum", n[where] * here)):
                    total = np.concatenate([[0], np.cumsum(values)])
                    more = total[offs[1:] - offs[0]] - total[offs[:-1] - offs[0]]
                    cols[name] = pa.array(cols[name].to_numpy() + more)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
    return run


class Alignment:
    """Alignment of all texts of a table by two tokenizers.

    ``path_a`` is a byte-level BPE file of the tokenizers library, ``path_b`` a
    sentencepiece model; ``keep_groups`` adds the groups as text (``a1,a2|b1;a3|b2``)."""

    def __init__(self, docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = False,
                 slice_pairs: int = SLICE_PAIRS, id_col: str = "doc_id", text_col: str = "text"):
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        self.schema = f"{_ALIGNED}{', groups string' * keep_groups}, {_PAIRS}"
        self.slice_pairs = slice_pairs
        self.rows = store(arrow_map(rows, _aligned_rows(path_a, path_b, keep_groups), self.schema), "aligned")
        links = self.rows.select(F.inline(F.arrays_zip("pairs", "times")))
        counts = store(links.groupBy("pairs").agg(F.sum("times").alias("n")), "pair-counts")
        b_id = F.expr("pairs & 4294967295")
        most = counts.groupBy(b_id.alias("b_id")).agg(F.max("n").alias("most"))
        self.counts = store(counts.withColumn("b_id", b_id).join(most, "b_id").select(
            "pairs", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")
        forget(counts)

    def pairs(self) -> DataFrame:
        """(a_id, b_id, count, best) of all linked id pairs."""
        return self.counts.select(F.shiftright("pairs", 32).alias("a_id"), F.expr("pairs & 4294967295").alias("b_id"),
                                  F.col("n").alias("count"), "best")

    def documents(self) -> DataFrame:
        """Per row doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256
        (and groups, if asked for)."""
        rows, slices = self.rows, max(1, math.ceil(self.counts.count() / self.slice_pairs))
        sc = rows.sparkSession.sparkContext
        for s in range(slices):
            part = self.counts.where(F.pmod(F.xxhash64("pairs"), F.lit(slices)) == s).toArrow().sort_by("pairs")
            held = tuple(part.column(c).to_numpy() for c in ("pairs", "n", "best"))
            weighed = arrow_map(rows, _weighed_rows(sc.broadcast(held)), self.schema)
            if s < slices - 1:
                weighed = store(weighed, "aligned")   # one broadcast slice at a time
            rows = weighed
        return rows.drop("pairs", "times")
