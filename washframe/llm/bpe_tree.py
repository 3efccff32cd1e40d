"""Byte-level BPE by monoid tree reduction.

A text is halved until a part has at most ``LEAF`` characters; the leaves are encoded,
and two neighbours are joined by re-encoding a window around their border only. The
window grows until the tokens outside it are proven to stay:

* At a *cut* no match of the splitting pattern goes on, whatever surrounds it: a white
  space character behind another character, or a change between ASCII letters, digits
  and marks (save mark to letter, where a contraction may stand). There
  ``enc(x + y) = enc(x) + enc(y)``, so a window from a cut to a cut leaves all else as
  it is.
* Inside one long match (a run of one ASCII class without cuts) the window is a run of
  tokens. A token sequence is the encoding of its bytes if and only if every two
  neighbours are the encoding of theirs: merges go by (rank, place), so the first merge
  over a border of the sequence would be made in the pair alone as well. The window is
  re-encoded and grows until both pairs at its ends hold.
* A side that offers neither is taken whole.

Decoding concatenates the tokens' bytes up the same kind of tree.

Tokens are those of the tiktoken library with the ranks and the pattern, without
special tokens. The pattern's cuts are proven for ``public_tokenizers.PATTERN`` only;
another pattern is refused. Defined results: a null or empty text has no tokens; every
row is encoded, copies and rows with a null id too; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washframe.llm.common import arrow_map

LEAF = 512           # characters of a leaf
REACH = 64           # characters of the first window on either side of a border
LONG_MATCH = 1024    # characters without a cut from which windows of tokens are tried
ROWS = 64            # texts that are encoded between two yields
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_MARK = r"!-/:-@\[-`{-~"
_SPACE = "\t-\r" + "".join(map(chr, (0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F,
                                     0x3000)))   # Unicode's White_Space
_CUT = re.compile(rf"(?<=\S)(?=[{_SPACE}])|(?<=[0-9])(?=[A-Za-z{_MARK}])|(?<=[A-Za-z])(?=[0-9{_MARK}])"
                  rf"|(?<=[{_MARK}])(?=[0-9])")
_RUNS = [re.compile(c) for c in ("[A-Za-z]+", "[0-9]+", f"[{_MARK}]+", "[\t-\r ]+")]
_EDGE = 3            # characters at the ends of a run that may belong to another match
_codecs: dict[str, "TreeCodec"] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class TreeCodec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str = PATTERN, leaf: int = LEAF):
        import tiktoken
        if pattern != PATTERN:
            raise ValueError("cuts are proven for the pattern of this module only")
        ranks = read_ranks(path)
        self.leaf = leaf
        self.base = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token

    # ------------------------------------------------------------ encoding

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, a: int, b: int) -> list[int]:
        if b - a <= self.leaf:
            return self.base.encode_ordinary(text[a:b])
        m = (a + b) // 2
        return self._join(text, a, m, b, self._encode(text, a, m), self._encode(text, m, b))

    def _join(self, text: str, a: int, m: int, b: int, left: list[int], right: list[int]) -> list[int]:
        """Tokens of text[a:b] from those of text[a:m] and text[m:b]."""
        if _CUT.match(text, m):
            return left + right
        p, q, reach = None, None, REACH
        while p is None or q is None:
            if p is None:
                lo = max(a, m - reach)
                for at in _CUT.finditer(text, lo + 1, m):
                    p = at.start()
                if p is None and lo == a:
                    p = a
            if q is None:
                hi = min(b, m + reach)
                at = _CUT.search(text, m + 1, hi)
                q = at.start() if at and at.start() < hi else b if hi == b else None
            if (p is None or q is None) and reach >= LONG_MATCH:
                joined = self._join_tokens(text, m, reach, left, right)
                if joined is not None:
                    return joined
            reach *= 4
        enc = self.base.encode_ordinary
        keep = len(left) - len(enc(text[p:m]))
        return left[:keep] + enc(text[p:q]) + right[len(enc(text[m:q])):]

    def _join_tokens(self, text: str, m: int, reach: int, left: list[int], right: list[int]) -> list[int] | None:
        """The join by a window of tokens inside one long match, if the border lies in
        a run of one ASCII class that is long enough."""
        run = next((r for r in _RUNS if r.match(text, m)), None)
        if run is None:
            return None
        room_right = run.match(text, m, m + reach).end() - m - _EDGE
        lo = max(0, m - reach)
        room_left = reach if run.fullmatch(text, lo, m) else 0
        if not room_left:
            return None
        room_left = m - lo - _EDGE
        piece, names, n = self.base._encode_single_piece, self.bytes, 4
        while n < len(left) and n < len(right):
            before, after = left[-n - 1:], right[:n + 1]
            held = [b"".join([names[t] for t in side]) for side in (before, after)]
            if len(held[0]) > room_left or len(held[1]) > room_right:
                return None
            inner = held[0][len(names[before[0]]):] + held[1][:-len(names[after[-1]])]
            window = piece(inner)
            if (piece(names[before[0]] + names[window[0]]) == [before[0], window[0]]
                    and piece(names[window[-1]] + names[after[-1]]) == [window[-1], after[-1]]):
                return left[:-n] + window + right[n:]
            n *= 2
        return None

    # ------------------------------------------------------------ decoding

    def decode(self, ids: list[int]) -> bytes:
        return self._decode(ids, 0, len(ids))

    def _decode(self, ids: list[int], a: int, b: int) -> bytes:
        if b - a <= self.leaf:
            return b"".join([self.bytes[i] for i in ids[a:b]])
        m = (a + b) // 2
        return self._decode(ids, a, m) + self._decode(ids, m, b)


def _codec(path: str, leaf: int) -> TreeCodec:
    key = f"{leaf}:{path}"
    return _codecs.get(key) or _codecs.setdefault(key, TreeCodec(path, leaf=leaf))


def _encoded_rows(path: str, leaf: int):
    def run(batches):
        codec = _codec(path, leaf)
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                part = batch.slice(lo, ROWS)
                ids = [np.array(codec.encode(t or ""), dtype=np.int32) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))],
                                                 names=["doc_id", "ids"])
    return run


def _decoded_rows(path: str, leaf: int):
    def run(batches):
        codec = _codec(path, leaf)
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                part = batch.slice(lo, ROWS)
                found = [None if ids is None else codec.decode(ids) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())],
                                                 names=["doc_id", "decoded"])
    return run


def _digest_rows(path: str, leaf: int):
    def run(batches):
        codec = _codec(path, leaf)
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                part, n, first, second = batch.slice(lo, ROWS), [], [], []
                for t in part.column(1).to_pylist():
                    ids = codec.encode(t or "")
                    n.append(len(ids))
                    first.append(hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
                    second.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, path: str, leaf: int = LEAF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row."""
    return arrow_map(_texts(docs, id_col, text_col), _encoded_rows(path, leaf), "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """(doc_id, decoded) of rows (doc_id, ids); null ids stay null."""
    return arrow_map(rows.select("doc_id", "ids"), _decoded_rows(path, leaf), "doc_id long, decoded binary")


def digests(docs: DataFrame, path: str, leaf: int = LEAF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row doc_id, n_tokens and the SHA-256 of the ids (little-endian, 32 bits) and
    of the bytes that they decode to; nothing but the digests leaves a task."""
    return arrow_map(_texts(docs, id_col, text_col), _digest_rows(path, leaf),
                     "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
