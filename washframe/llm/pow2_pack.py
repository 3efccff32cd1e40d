"""Packing by power-of-two decomposition.

A document's token ids, with an end id, are cut into pieces whose lengths are
powers of two: as many of ``longest`` as fit, then one for each binary digit of
the rest, longest first. Pieces of equal length share a bucket, and every piece
is a sequence of its own, so no sequence crosses documents and none needs
padding. Within a bucket sequences are numbered without gaps (offsets of
storage partitions, no global sort), and consecutive numbers form batches of
``batch_tokens`` tokens.

Tokens: the vocabulary's pre-tokens never cross white space, so a text's ids are
its white-space-separated chunks' ids in order, and a chunk of letters with marks
behind it is the letters' ids and the marks'. Each worker keeps the ids of the
chunks that it has met, about ``CACHE_CHUNKS``. Texts that Python would split
(U+001C to U+001F) or lower-case (capital sigma, dotted capital I) in another
way than the vocabulary, that are not in normal form C, or that hold a special token's
string in any case, are encoded whole; so are all texts under a vocabulary of another kind.

Defined results: a null or empty text has the end id alone; every row is packed,
copies of a row like any other row; a null doc_id stays null. Extra columns are
ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washframe.llm.common import ID_BROADCAST_ROWS, arrow_map, store

LONGEST = 2048
END_ID = 1
CACHE_CHUNKS = 1_200_000     # chunks whose ids a worker keeps
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"   # fixed: the pattern of the vocabulary's file
_MARKS = ".,;:!?"
_MARK_RUN = re.compile(r"[.,](?<=[\W_][.,])(?<!\s[.,])\s")
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_workers: dict[str, "ChunkEncoder"] = {}


def piece_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Powers of two that sum to n, none above ``longest``, in falling order."""
    out = [longest] * (n // longest)
    rest = n % longest
    return out + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _apart(text: str) -> str:
    """The text with commas and full stops behind a letter or number set apart,
    which changes no pre-token; as it is if a mark may stand behind another mark."""
    if _MARK_RUN.search(text):
        return text
    return text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " .\n")


def splits_at_space(spec: dict) -> bool:
    """Whether a vocabulary lower-cases, drops white space and splits in the way that the
    chunk shortcuts rely on; texts of others are encoded whole."""
    steps = (spec.get("normalizer") or {}).get("normalizers") or [{}]
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = (parts[0].get("pattern") or {}).get("Regex")
    return ([n.get("type") for n in steps] == ["NFC", "Replace", "Lowercase"]
            and [p.get("type") for p in parts] == ["Split", "ByteLevel"]
            and (split, parts[0].get("behavior"), parts[0].get("invert")) == (WORDS, "Removed", True)
            and all(t["content"].startswith("<|") for t in spec["added_tokens"]))


class ChunkEncoder:
    """Token ids of texts as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        import json
        import os

        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        spec = json.loads(self.tokenizer.to_str())
        # Strings that the tokenizer takes out of a text before it lower-cases: a text
        # that holds one in any case is encoded whole and unchanged.
        added = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.added = re.compile("|".join(added), re.IGNORECASE) if added else None
        self.by_words = splits_at_space(spec)
        suffix = spec["model"].get("end_of_word_suffix")
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)   # ids that end a word
        if suffix:
            self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        # for plain words, lower-cased and normalised already: the model alone
        spec["normalizer"] = None
        spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [
            {"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True,
                                          "use_regex": False}]}
        self.model = Tokenizer.from_str(json.dumps(spec))
        self.known: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only, encoded together and cut at the ids that end
        a word."""
        out = []
        for lo in range(0, len(words), 2000):
            part = words[lo:lo + 2000]
            ids = self.model.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids
            ids = np.array(ids, dtype="<u4")
            ends = (np.flatnonzero(self.last[ids]) + 1) * 4
            if len(ends) != len(part):
                out += self._encode(part)
                continue
            raw, a = ids.tobytes(), 0
            for b in ends.tolist():
                out.append(raw[a:b])
                a = b
        return out

    def _learn(self, chunks: list[str]) -> None:
        """Ids of new chunks: a plain word, or one and marks behind it, by its parts."""
        known, parts, rest = self.known, {}, []
        for c in chunks:
            if not c.isalpha():
                core = c.rstrip(_MARKS)
                if core.isalpha():
                    parts[c] = core
                else:
                    rest.append(c)
        words = [c for c in chunks if c.isalpha()]
        words += [w for w in set(parts.values()).difference(words) if w not in known]
        known.update(zip(words, self._encode_words(words)))
        rest += [m for m in {c[len(w):] for c, w in parts.items()} if m not in known]
        known.update(zip(rest, self._encode(rest)))
        known.update((c, known[w] + known[c[len(w):]]) for c, w in parts.items())

    def ids(self, texts: list[str]) -> list[bytes]:
        out = [b""] * len(texts)
        whole = [i for i, t in enumerate(texts) if not self.by_words or not t.isascii() and (
            "\u0130" in t or "\u03a3" in t or not unicodedata.is_normalized("NFC", t)) or _ODD_SPACE.search(t)
            or "<|" in t and self.added and self.added.search(t)]
        for i, b in zip(whole, self._encode([texts[i] for i in whole])):
            out[i] = b
        odd = set(whole)
        split = {i: _apart(t.lower()).split() for i, t in enumerate(texts) if i not in odd}
        if len(self.known) > CACHE_CHUNKS:
            self.known.clear()
        known = self.known
        # one look-up a chunk: a set minus a dict's keys would walk all the keys
        self._learn([c for c in set().union(*split.values()) if c not in known])
        for i, chunks in split.items():
            out[i] = b"".join([known[c] for c in chunks])
        return out


def _piece_rows(path: str, longest: int, end_id: int, keep_ids: bool):
    tail = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext
        encoder = _workers.get(path) or _workers.setdefault(path, ChunkEncoder(path))
        part, counts = TaskContext.get().partitionId(), {}
        for batch in batches:
            docs = batch.column(0).cast(pa.int64())
            texts = batch.column(1)
            for lo in range(0, len(texts), 64):
                rows = [t or "" for t in texts.slice(lo, 64).to_pylist()]
                at, start, length, crc, total, index, ids = [], [], [], [], [], [], []
                for i, body in enumerate(encoder.ids(rows)):
                    body += tail
                    n, pos = len(body) // 4, 0
                    for m in piece_lengths(n, longest):
                        cut = body[4 * pos:4 * (pos + m)]
                        at.append(lo + i)
                        start.append(pos)
                        length.append(m)
                        crc.append(zlib.crc32(cut))
                        total.append(n)
                        index.append(counts.get(m, 0))
                        counts[m] = index[-1] + 1
                        if keep_ids:
                            ids.append(np.frombuffer(cut, dtype="<u4").astype(np.int32))
                        pos += m
                cols = [docs.take(pa.array(at, pa.int64()))]
                cols += [pa.array(c, pa.int64()) for c in (start, length, crc, total, index)]
                cols.append(pa.array(np.full(len(at), part, dtype=np.int32)))
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "i", "p"]
                if keep_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def pack(docs: DataFrame, tokenizer_path: str, longest: int = LONGEST, end_id: int = END_ID,
         batch_tokens: int = 1 << 16, keep_ids: bool = False,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, batch_id (and the ids, if asked for)."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, i long, p int"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = store(arrow_map(rows, _piece_rows(tokenizer_path, longest, end_id, keep_ids),
                             schema + ", ids array<int>" * keep_ids), "pieces")
    sizes = pieces.groupBy("length", "p").agg(F.count("*").alias("n"))
    before = sizes.selectExpr("length", "p", "sum(n) OVER (PARTITION BY length ORDER BY p) - n AS before")
    if sizes.count() <= ID_BROADCAST_ROWS:
        before = F.broadcast(before)
    bucket = F.log2("length").cast("int")
    place = F.col("before") + F.col("i")
    return pieces.join(before, ["length", "p"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.shiftleft(bucket.cast("long"), 52) + place).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        (F.shiftleft(bucket.cast("long"), 52)
         + F.floor(place / F.greatest(F.lit(1), F.lit(batch_tokens) / F.col("length")))).cast("long").alias("batch_id"),
        *(["ids"] if keep_ids else []))
