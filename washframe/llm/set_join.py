"""N-gram Jaccard join by universe partition and the pigeonhole principle.

A document's set holds its distinct k-word shingles (hashed to 64 bits). Sizes
are cut into bands such that two sets that reach the threshold lie in the same
or in neighbouring bands. For a band, ``H`` bounds the symmetric difference of
any linked pair whose larger set is in it; the hash universe is cut into
``H + 1`` segments and some to spare for empty ones, so a linked pair agrees on
one whole segment that is not empty (sets with too many empty segments index
those as well). Each
set is indexed by one key per segment under its own band's scheme and probes
the scheme of the next band.

Cost-based allocation: the join load of every segment (pairs that share its
key) is counted over the whole corpus. A segment whose load exceeds the price
of a one-deletion neighbourhood elsewhere is left out, and another segment of
its band is indexed with all its one-deletion variants instead: leaving out
counts 0, an exact segment 1 and a one-deletion segment 2 towards ``H + 1``, so
no linked pair is lost.

Candidates are verified with whole sets. For components, members of a key are
compared with one member, and in further rounds those of its smaller components
with another one; a key whose members are all in one component needs nothing
more. The members that are left are compared block by block by the parity bits of
their sets, so only pairs that may be linked become rows, and all of these are
verified. ``links`` gives all linked pairs instead.

Defined results: null or wordless texts have an empty set and no link; fewer
than k words make one shingle of the whole sequence; equal sets form a class
that is represented by its least doc_id; rows with a null doc_id are returned
with a null component and link with nothing; rows that repeat a doc_id count as
one document for links. Extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washframe.llm.common import arrow_map, byte_slices, forget, only_ids, store, without_ids
from washframe.llm.components import connected_components
from washframe.llm.words import gram_hashes, mix, signed, unsigned, word_hashes

_U = np.uint64
DELETION_PRICE = 4.0   # cost of one more index row, in candidate pairs
MAX_STAR_ROUNDS = 8    # rounds of stars; the pairs that are left then are verified all the same
STALLED = 0.7          # share of pairs left from one round to the next that ends the rounds
FAMILY_KEY = 32        # members of a key from which it can make a family
FAMILY_SHARE = 0.05    # pairs of its keys, of all its pairs, from which a family is dense
FAMILY_BLOCK = 256
KEY_BLOCK = 256        # members of a key that a task compares with as many others at a time
BLOCK_WORDS = 1 << 18  # words of parity bits that are compared at a time
KEY_BROADCAST_ROWS = 2_000_000   # shared keys up to this counted number are broadcast
KEY_ROWS = 1 << 18     # index rows that a task combines at a time
KEY_PART = 500_000     # keys of a shuffle partition
MAX_PARTS = 20_000
KEY_MASK = _U((1 << 48) - 1)   # shorter keys take less room; pairs are verified anyway


def linked(inter: int, a: int, b: int, num: int, den: int) -> bool:
    return den * inter >= num * (a + b - inter)


def most_apart(s: int, t: int, num: int, den: int) -> int:
    """Largest symmetric difference of linked sets of sizes s and t (negative: none)."""
    need = -(-num * (s + t) // (num + den))
    return s + t - 2 * need if need <= min(s, t) else -1


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


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all sets of b."""
    rows = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    names, col, seen = np.unique(np.concatenate([*a, *b]), return_inverse=True, return_counts=True)
    keep = seen[col] > 1
    order = np.argsort(col[keep], kind="stable")
    rows, col = rows[keep][order], col[keep][order]
    _, col = np.unique(col, return_inverse=True)
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
        x, y = np.searchsorted(col, [lo, lo + 4096])
        hits = np.zeros((len(a) + len(b), 4096), dtype=np.float32)
        hits[rows[x:y], col[x:y] - lo] = 1
        out += hits[:len(a)] @ hits[len(a):].T
    return out.astype(np.int64)


class Bands:
    """Size bands and the number of segments of each band's scheme."""

    def __init__(self, num: int, den: int, longest: int):
        self.starts = [1]
        while self.starts[-1] <= longest:
            self.starts.append(self.starts[-1] * den // num + 1)
        self.segments, self.slack = [], []
        for i in range(len(self.starts) - 1):
            lo, hi = self.starts[max(i - 1, 0)], self.starts[i + 1] - 1
            # the bound grows with both sizes up to rounding: look at the largest few
            far = 0
            for t in range(hi, max(self.starts[i], hi - 24) - 1, -1):
                for s in range(t, max(lo, t - 24) - 1, -1):
                    far = max(far, most_apart(s, t, num, den))
            # Segments that are empty in both sets tell nothing, and all sets share them.
            # With as many segments more as a set has empty ones, a linked pair agrees
            # on one that is not empty; sets with still more index their empty ones too.
            empty = (far + 1) * math.exp(-self.starts[i] / (far + 1))
            self.slack.append(math.ceil(empty + 2 * math.sqrt(empty)) if far > 0 and empty > 0.02 else 0)
            self.segments.append(far + 1 + self.slack[-1] if far > 0 else 0)  # 0: only equal sets link

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, sizes, side="right") - 1


@lru_cache(maxsize=8)
def all_bands(num: int, den: int) -> Bands:
    """Bands for sets of any size that fits in memory."""
    return Bands(num, den, 1 << 40)


def doc_sets(column, k: int):
    """Yield (row, sorted distinct shingle hashes) of an Arrow text column."""
    for row, offs, h in word_hashes(column, lower=True):
        grams = gram_hashes(h, k)
        for d in range(len(offs) - 1):
            a, b = offs[d], offs[d + 1]
            if b - a >= k:
                s = np.sort(grams[a:b - k + 1])
                keep = np.empty(len(s), dtype=bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                yield row + d, s[keep]
            elif b > a:
                yield row + d, mix(gram_hashes(h[a:b], b - a) + _U(b - a))
            else:
                yield row + d, h[:0]


def _scheme_sums(s: np.ndarray, scheme: int, m: int):
    """(segment of each element, content sum of each segment) under a scheme."""
    at = mix(s + _U((scheme + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    seg = (((at >> _U(32)) * _U(m)) >> _U(32)).astype(np.int64)
    sums = np.zeros(m, dtype=np.uint64)
    np.add.at(sums, seg, s)
    return seg, sums


def _keys(sums: np.ndarray, scheme: int, seg: np.ndarray) -> np.ndarray:
    place = (np.uint64(scheme + 1) << _U(32)) + seg.astype(np.uint64)
    return mix(sums ^ mix(place * _U(0xC2B2AE3D27D4EB4F))) & KEY_MASK


INDEX_SCHEMA = "doc_id long, n long, fa long, fb long, keys array<long>, codes array<long>, bits binary"


def parity_bits(s: np.ndarray) -> bytes:
    """Parities of a set's elements per hash bucket, about one bit an element. Each
    element of a symmetric difference flips one bit, so the bits of two sets differ
    in no more places than the sets do."""
    size = max(64, 1 << int(len(s) - 1).bit_length()) if len(s) else 64
    at = (mix(s ^ _U(0x369DEA0F31A53F85)) & _U(size - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def bits_apart(a: bytes, b: bytes) -> int:
    """Places in which two parity strings differ; the longer one is folded."""
    x, y = (np.frombuffer(v, dtype=np.uint64) for v in (a, b))
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, n), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _block(column, r: int):
    """Row r of an Arrow column of lists of members: their fields, and the rows and
    parity words of each width."""
    lo, hi = column.offsets[r].as_py(), column.offsets[r + 1].as_py()
    values = column.values
    fields = {c: values.field(c).slice(lo, hi - lo).to_numpy(zero_copy_only=False) for c in ("doc", "comp", "n", "low", "cut")}
    bits = values.field("bits").slice(lo, hi - lo).to_pylist()
    wide = np.array([len(x) for x in bits])
    return fields, [(rows, np.frombuffer(b"".join(bits[i] for i in rows), dtype=np.uint64).reshape(len(rows), -1))
                    for rows in (np.flatnonzero(wide == w) for w in np.unique(wide))]


def near_in_blocks(a, b, num: int, den: int):
    """(u, v) of the members of two blocks that may meet and whose parity bits let them
    reach the threshold."""
    (fa, wide_a), (fb, wide_b) = a, b
    us, vs = [], []
    for ra, xa in wide_a:
        for rb, xb in wide_b:
            words = min(xa.shape[1], xb.shape[1])
            x, y = (np.bitwise_xor.reduce(z.reshape(len(z), -1, words), axis=1) for z in (xa, xb))
            step = max(1, BLOCK_WORDS // y.size)
            for lo in range(0, len(x), step):
                at = ra[lo:lo + step]
                s, t = fa["n"][at][:, None], fb["n"][rb][None, :]
                need = -(-num * (s + t) // (num + den))
                apart = np.bitwise_count(x[lo:lo + step, None] ^ y[None]).sum(axis=2, dtype=np.int64)
                keep = (need <= np.minimum(s, t)) & (apart <= s + t - 2 * need)
                keep &= fa["comp"][at][:, None] != fb["comp"][rb][None, :]
                for c in ("low", "cut"):
                    keep &= ~(fa[c][at][:, None] & fb[c][rb][None, :])
                i, j = np.nonzero(keep)
                us.append(fa["doc"][at[i]])
                vs.append(fb["doc"][rb[j]])
    u, v = np.concatenate(us), np.concatenate(vs)
    return np.minimum(u, v), np.maximum(u, v)


def _block_rows(num: int, den: int):
    """Pairs (u, v) that may reach the threshold, of rows with one block (its members with
    each other) or two (those of one with those of the other)."""
    def run(batches):
        for batch in batches:
            found = []
            for r in range(len(batch)):
                one = _block(batch.column(0), r)
                found.append(near_in_blocks(one, one if batch.num_columns == 1 else _block(batch.column(1), r), num, den))
            if found:
                pairs = np.unique(np.concatenate([np.stack(x, axis=1) for x in found]), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], names=["u", "v"])
    return run


def _near_rows(num: int, den: int):
    """Pairs (u, v, sizes, parity bits) that may reach the threshold."""
    def run(batches):
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in (2, 3))
            ba, bb = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            keep = np.array([bits_apart(x, y) <= most_apart(int(s), int(t), num, den)
                             for x, y, s, t in zip(ba, bb, na, nb)], dtype=bool)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(c).to_numpy()[keep]) for c in (0, 1)],
                                             names=["u", "v"])
    return run


def _index_rows(num: int, den: int, k: int):
    def run(batches):
        bands = all_bands(num, den)
        segments = np.array(bands.segments + [0])
        for batch in (part for whole in batches for part in byte_slices(whole, 1)):
            ids, out = batch.column(0), {"n": [], "fa": [], "fb": [], "keys": [], "codes": [], "bits": []}
            for _, s in doc_sets(batch.column(1), k):
                out["n"].append(len(s))
                fa = mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                fb = np.bitwise_xor.reduce(mix(s + _U(0x14057B7EF767814F)), initial=_U(0))
                pair = signed(np.array([fa, fb], dtype=np.uint64))
                out["fa"].append(int(pair[0]))
                out["fb"].append(int(pair[1]))
                out["bits"].append(parity_bits(s))
                own, keys, codes = int(bands.of(np.array([max(len(s), 1)]))[0]), [], []
                for scheme in (own, own + 1):
                    m = int(segments[scheme]) if len(s) else 0
                    if m:
                        seg, sums = _scheme_sums(s, scheme, m)
                        at = np.flatnonzero(np.bincount(seg, minlength=m))
                        if m - len(at) > bands.slack[scheme]:
                            at = np.arange(m)
                        keys.append(_keys(sums[at], scheme, at))
                        codes.append((scheme << 40) + (at << 1) + (scheme != own))
                out["keys"].append(signed(np.concatenate(keys)) if keys else np.zeros(0, np.int64))
                out["codes"].append(np.concatenate(codes) if codes else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["fa"], pa.int64()),
                 pa.array(out["fb"], pa.int64()), pa.array(out["keys"], pa.list_(pa.int64())),
                 pa.array(out["codes"], pa.list_(pa.int64())), pa.array(out["bits"], pa.binary())],
                names=["doc_id", "n", "fa", "fb", "keys", "codes", "bits"])
    return run


def _variant_rows(num: int, den: int, k: int, raised: dict[int, list[int]]):
    """Keys of raised segments: the content itself and its one-deletion variants."""
    def run(batches):
        bands = all_bands(num, den)
        for batch in (part for whole in batches for part in byte_slices(whole, 1)):
            docs, keys, low, dele, place = [], [], [], [], []
            ids = batch.column(0).to_pylist()
            for row, s in doc_sets(batch.column(1), k):
                if not len(s):
                    continue
                own = int(bands.of(np.array([len(s)]))[0])
                for scheme in (own, own + 1):
                    segs = np.array(raised.get(scheme, ()), dtype=np.int64)
                    if not len(segs):
                        continue
                    seg, sums = _scheme_sums(s, scheme, bands.segments[scheme])
                    pick = np.isin(seg, segs)
                    cut = _keys(sums[seg[pick]] - s[pick], scheme, seg[pick])
                    whole = _keys(sums[segs], scheme, segs)
                    both = signed(mix(np.concatenate([whole, cut])) & KEY_MASK)
                    docs.append(np.full(len(both), ids[row], dtype=np.int64))
                    keys.append(both)
                    low.append(np.full(len(both), scheme != own))
                    dele.append(np.arange(len(both)) >= len(whole))
            if docs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (keys, docs, low, dele)],
                    names=["key", "doc", "low", "cut"])
    return run


def _key_rows(batches):
    """(key, g, own, head) of each run of about ``KEY_ROWS`` index rows (key, doc, low,
    whole): how many rows have the key, the least doc that is not low, and the least
    that is whole. A map-side combine of bounded size: nearly all keys are unique."""
    none = np.iinfo(np.int64).max

    def combined(parts):
        key, doc, low, whole = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(key)
        key, doc, low, whole = key[order], doc[order], low[order], whole[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        own, head = (np.minimum.reduceat(np.where(keep, doc, none), first) for keep in (~low, whole))
        return pa.RecordBatch.from_arrays(
            [pa.array(key[first]), pa.array(np.diff(np.append(first, len(key))))]
            + [pa.array(x, mask=x == none) for x in (own, head)], names=["key", "g", "own", "head"])

    held, n = [], 0
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        n += len(batch)
        if n >= KEY_ROWS:
            yield combined(held)
            held, n = [], 0
    if n:
        yield combined(held)


SETS_SCHEMA = "doc long, s array<long>"


def _set_rows(k: int):
    def run(batches):
        for batch in (part for whole in batches for part in byte_slices(whole, 1)):
            rows = [signed(s) for _, s in doc_sets(batch.column(1), k)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(rows, pa.list_(pa.int64()))], names=["doc", "s"])
    return run


def _verify_rows(num: int, den: int):
    def run(batches):
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            (va, oa), (vb, ob) = [(unsigned(x.values.to_numpy()), x.offsets.to_numpy()) for x in (a, b)]
            keep = []
            for i in range(len(a)):
                x, y = va[oa[i]:oa[i + 1]], vb[ob[i]:ob[i + 1]]
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                inter = int((y[at] == x).sum()) if len(y) else 0
                keep.append(linked(inter, len(x), len(y), num, den))
            keep = np.array(keep, dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch.column(c).to_numpy()[keep]) for c in (0, 1)], names=["u", "v"])
    return run


def _band_column(bands: Bands):
    """One more than the band of column n."""
    return F.size(F.filter(F.array(*[F.lit(x) for x in bands.starts]), lambda x: x <= F.col("n")))


def _blocks_of(column, r: int) -> list[np.ndarray]:
    """The sets of row r of an Arrow column of lists of lists."""
    inner, outer = column.values, column.offsets.to_numpy()
    values, offs = unsigned(inner.values.to_numpy()), inner.offsets.to_numpy()
    return [values[offs[i]:offs[i + 1]] for i in range(outer[r], outer[r + 1])]


def _family_rows(num: int, den: int):
    """Rows (docs, sets, other docs, other sets) of two blocks of a family: an edge
    to the least document of each group that their linked pairs connect."""
    def run(batches):
        for batch in batches:
            us, vs = [], []
            for r in range(len(batch)):
                ids = np.concatenate([np.array(batch.column(c)[r].as_py(), dtype=np.int64) for c in (0, 2)])
                a, b = _blocks_of(batch.column(1), r), _blocks_of(batch.column(3), r)
                both = common_counts(a, b)
                sizes = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :] - both
                i, j = np.nonzero(den * both >= num * sizes)
                order = np.argsort(ids, kind="stable")
                place = np.argsort(order, kind="stable")
                head = spanning(len(ids), place[i], place[j + len(a)])
                us.append(ids[order])
                vs.append(ids[order][head])
            if us:
                u, v = np.concatenate(us), np.concatenate(vs)
                yield pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], names=["u", "v"])
    return run


class JaccardJoin:
    """Classes, links and components of documents whose shingle sets are alike.

    ``num / den`` is the least Jaccard similarity (0.9: 90, 100); ``deletion_price``
    is the cost of an index row in candidate pairs.
    """

    def __init__(self, docs: DataFrame, num: int = 4, den: int = 5, k: int = 5,
                 id_col: str = "doc_id", text_col: str = "text", deletion_price: float = DELETION_PRICE):
        self.num, self.den, self.k, self.price = num, den, k, deletion_price
        self.texts = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                                 F.col(text_col).cast("string").alias("text"))
        rows = arrow_map(self.texts, _index_rows(num, den, k), INDEX_SCHEMA)
        self.index = store(rows.withColumn("rid", F.monotonically_increasing_id()), "jaccard-index")
        full = self.index.where("n > 0 AND doc_id IS NOT NULL").select("n", "fa", "fb", "doc_id", "rid")
        self.classes = store(full.groupBy("n", "fa", "fb").agg(F.min(F.struct("doc_id", "rid")).alias("r"))
                             .select("n", "fa", "fb", F.col("r.doc_id").alias("rep"), F.col("r.rid").alias("one")),
                             "jaccard-classes")
        copies = full.join(self.classes, ["n", "fa", "fb"]).where("rid <> one").select("rid")
        self.copies = store(copies, "jaccard-copies")
        self.marks: DataFrame | None = None
        self.swaps: dict[int, tuple[list[int], list[int]]] = {}

    # ------------------------------------------------------------ candidates

    def _entries(self) -> DataFrame:
        """(key, doc, code) of the classes' representatives; code holds the scheme, the
        segment and, in its last bit, whether the key probes the next band's scheme."""
        reps = without_ids(self.index.where("size(keys) > 0 AND doc_id IS NOT NULL").select(
            "rid", "doc_id", "keys", "codes"), self.copies, ["rid"])
        return reps.select(F.col("doc_id").alias("doc"), F.inline(F.arrays_zip("keys", "codes"))).select(
            F.col("keys").alias("key"), "doc", F.col("codes").alias("code"))

    @staticmethod
    def _decoded(rows: DataFrame) -> DataFrame:
        return rows.select("*", (F.expr("code & 1") == 1).alias("low"), F.shiftright("code", 40).cast("int").alias("scheme"),
                           F.expr("cast(shiftright(code, 1) & 549755813887 AS int)").alias("seg")).drop("code")

    @staticmethod
    def _shared(entries: DataFrame, whole, rows: int) -> DataFrame:
        """Keys that pair a member of the band itself with another: the least such member
        that may pair with all others. Tasks combine their keys in bounded runs; the keys
        of about so many rows are dealt to partitions of ``KEY_PART``."""
        runs = arrow_map(entries.select("key", "doc", "low", whole.alias("whole")), _key_rows,
                         "key long, g long, own long, head long")
        parts = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MAX_PARTS, rows // KEY_PART))
        return store(runs.repartition(parts, "key").groupBy("key").agg(
            F.sum("g").alias("g"), F.min("own").alias("own"), F.min("head").alias("head"))
            .where("g > 1 AND own IS NOT NULL").select("key", F.coalesce("head", "own").alias("head")), "jaccard-keys")

    def _allocate(self, members: DataFrame) -> dict[int, tuple[list[int], list[int]]]:
        """Per scheme the segments to leave out and those to raise instead. One row
        per (scheme, segment) with a heavy load comes to the driver, a number
        bounded by the sizes of sets, not by the number of documents."""
        keys = members.groupBy("scheme", "seg", "key").agg(F.count("*").alias("g"), F.count_if("low").alias("l"))
        pairs = F.sum(F.expr("cast(g as double) * (g - 1) / 2 - cast(l as double) * (l - 1) / 2"))
        heavy = (keys.groupBy("scheme", "seg").agg(pairs.alias("load"), F.sum("g").alias("rows"))
                 .where(f"load > {self.price} * rows").collect())
        if not heavy:
            return {}
        loads: dict[int, dict[int, float]] = {}
        for r in heavy:
            loads.setdefault(r["scheme"], {})[r["seg"]] = r["load"]
        bands = all_bands(self.num, self.den)
        sizes = {r["band"]: (r["docs"], r["n"]) for r in self.classes.select(
            (_band_column(bands) - 1).alias("band"), "n")
            .groupBy("band").agg(F.count("*").alias("docs"), F.avg("n").alias("n")).collect()}
        swaps = {}
        for scheme, load in loads.items():
            m = bands.segments[scheme]
            rows = sum(d * (n / m + 1) for b in (scheme, scheme - 1) for d, n in [sizes.get(b, (0, 0.0))])
            light = [s for s in range(m) if s not in load]
            drop = [s for s in sorted(load, key=lambda s: (-load[s], s)) if load[s] > self.price * rows][:len(light)]
            if drop:
                swaps[scheme] = (drop, light[:len(drop)])
        return swaps

    def _candidate_keys(self) -> DataFrame:
        """Members (key, head, doc, low, cut) of the keys that pair documents."""
        entries = self._entries()
        narrow = entries.select("key", "doc", (F.expr("code & 1") == 1).alias("low"))
        rows = self.index.agg(F.sum(F.size("keys"))).first()[0] or 0
        shared = self._shared(narrow, ~F.col("low"), rows)
        few = shared.count() <= KEY_BROADCAST_ROWS
        members = self._decoded(entries.join(F.broadcast(shared) if few else shared, "key"))
        members = store(members, "jaccard-members")
        forget(shared)
        self.swaps = self._allocate(members)
        out = members.select("key", "head", "doc", "low", F.lit(False).alias("cut"))
        if not self.swaps:
            return out
        gone = [(s, x) for s, (drop, up) in self.swaps.items() for x in drop + up]
        raised = {s: up for s, (_, up) in self.swaps.items()}
        gone = entries.sparkSession.createDataFrame(gone, "scheme int, seg int")
        kept = members.join(F.broadcast(gone), ["scheme", "seg"], "left_anti")
        bands = all_bands(self.num, self.den)
        spans = [(bands.starts[max(s - 1, 0)], bands.starts[s + 1]) for s in raised]
        near = self.classes.where(" OR ".join(f"n >= {a} AND n < {b}" for a, b in spans))
        ids = store(near.select(F.col("rep").alias("doc_id")).distinct(), "jaccard-near")
        more = arrow_map(only_ids(self.texts, ids, ["doc_id"]), _variant_rows(self.num, self.den, self.k, raised),
                         "key long, doc long, low boolean, cut boolean")
        more = store(more.distinct(), "jaccard-variants")
        extra = self._shared(more, ~F.col("low") & ~F.col("cut"), more.count())
        out = store(kept.select("key", "head", "doc", "low", F.lit(False).alias("cut")).unionByName(
            more.join(extra, "key").select("key", "head", "doc", "low", "cut")), "jaccard-swapped")
        forget(members, ids, more, extra)
        return out

    @staticmethod
    def _pairs(a: DataFrame, b: DataFrame, on) -> DataFrame:
        """Distinct pairs u < v of two sides of one key that may meet: not two
        probes (they met under their own scheme) and not two deletions."""
        return (a.join(b, on).where("a.doc <> b.doc AND NOT (a.low AND b.low) AND NOT (a.cut AND b.cut)")
                .select(F.least("a.doc", "b.doc").alias("u"), F.greatest("a.doc", "b.doc").alias("v")).distinct())

    def _marks(self) -> DataFrame:
        """(doc_id, n, bits) of the classes' representatives, stored when first asked for."""
        if self.marks is None:
            rows = self.index.where("n > 0 AND doc_id IS NOT NULL").select("rid", "doc_id", "n", "bits")
            self.marks = store(without_ids(rows, self.copies, ["rid"]).drop("rid"), "jaccard-marks")
        return self.marks

    def _near_in_keys(self, rest: DataFrame) -> DataFrame:
        """Distinct pairs u < v across components of the members (key, doc, low, cut, comp)
        of each key, without those that parity bits rule out. A key's pairs are not made
        as rows: blocks of about ``KEY_BLOCK`` of its members are compared in a task."""
        big = rest.groupBy("key").agg(F.count("*").alias("g")).where(f"g > {KEY_BLOCK}").select(
            "key", F.ceil(F.col("g") / KEY_BLOCK).cast("int").alias("parts"))
        marks = self._marks().select(F.col("doc_id").alias("doc"), "n", "bits")
        parts = F.coalesce("parts", F.lit(1))
        blocks = (rest.select("key", "doc", "low", "cut", "comp").join(big, "key", "left").join(marks, "doc")
                  .groupBy("key", parts.alias("parts"), F.pmod(F.xxhash64("doc"), parts).alias("b"))
                  .agg(F.collect_list(F.struct("doc", "comp", "n", "low", "cut", "bits")).alias("m")))
        blocks = store(blocks, "jaccard-key-blocks")
        many = blocks.where("parts > 1")
        met = many.alias("x").join(many.alias("y"), "key").where("x.b < y.b").select("x.m", F.col("y.m").alias("m2"))
        near = [arrow_map(rows, _block_rows(self.num, self.den), "u long, v long") for rows in (blocks.select("m"), met)]
        out = store(near[0].union(near[1]).distinct(), "jaccard-near-keys")
        forget(blocks)
        return out

    def _verify(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose whole sets reach the threshold. Parity bits, which never rule a
        linked pair out, drop pairs of unlike sets before any set is sent."""
        marks = self._marks()
        mark = [marks.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"b{x}"))
                for x in ("u", "v")]
        near = pairs.join(mark[0], "u").join(mark[1], "v").select("u", "v", "nu", "nv", "bu", "bv")
        pairs = store(arrow_map(near, _near_rows(self.num, self.den), "u long, v long").distinct(), "jaccard-near")
        ids = store(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), "jaccard-ids")
        sets = store(arrow_map(only_ids(self.texts, ids, ["doc_id"]), _set_rows(self.k), SETS_SCHEMA)
                     .dropDuplicates(["doc", "s"]), "jaccard-sets")
        with_u = pairs.join(sets.select(F.col("doc").alias("u"), F.col("s").alias("su")), "u")
        with_v = with_u.join(sets.select(F.col("doc").alias("v"), F.col("s").alias("sv")), "v")
        out = store(arrow_map(with_v.select("u", "v", "su", "sv"), _verify_rows(self.num, self.den), "u long, v long"),
                    "jaccard-links")
        forget(ids, sets, pairs)
        return out

    # --------------------------------------------------------------- results

    def links(self) -> DataFrame:
        """All linked pairs (u < v) of class representatives."""
        members = self._candidate_keys()
        pairs = store(self._pairs(members.alias("a"), members.alias("b"), "key"), "jaccard-pairs")
        out = self._verify(pairs).distinct()
        forget(members, pairs)
        return out

    def class_components(self) -> DataFrame:
        """(vertex, component) of the representatives that link with another.

        Rounds of stars: every key compares one member with those that are not yet
        in its component. A near-copy family grows together in a few rounds, so the
        pairs that are left between components, all of which are verified at the
        end, are few."""
        members = self._candidate_keys()
        star = (members.where("doc <> head")
                .select(F.least("doc", "head").alias("u"), F.greatest("doc", "head").alias("v")).distinct())
        tested = store(star, "jaccard-star")
        links = self._verify(tested)
        left = None
        for turn in range(MAX_STAR_ROUNDS + 1):   # the last turn makes no round: it leaves what is open then
            comps = store(connected_components(links), "jaccard-comps")
            placed = (members.join(comps, members["doc"] == comps["vertex"], "left")
                      .select("key", "doc", "low", "cut", F.coalesce("component", "doc").alias("comp")))
            sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("g"))
            sizes = sizes.groupBy("key").agg(F.sum("g").alias("g"), F.sum(F.col("g") * F.col("g")).alias("g2"),
                                             F.max(F.struct("g", "comp")).alias("most"))
            open_keys = sizes.where("g2 < g * g AND g > 2").select("key", F.col("most.comp").alias("most"),
                                                                  ((F.col("g") * F.col("g") - F.col("g2")) / 2).alias("cross"))
            rest = store(placed.join(open_keys, "key"), "jaccard-rest")
            before, left = left, rest.select("key", "cross").distinct().agg(F.sum("cross")).first()[0] or 0
            if turn == MAX_STAR_ROUNDS or left <= rest.count() or (before is not None and left > STALLED * before):
                break
            # the next centre of a key: a member of its largest component, another each round
            centre = rest.where("comp = most AND NOT low AND NOT cut").groupBy("key").agg(
                F.min(F.struct(F.xxhash64("doc", F.lit(turn)).alias("h"), "doc")).alias("c")).select(
                "key", F.col("c.doc").alias("centre"))
            star = (rest.where("comp <> most").join(centre, "key")
                    .select(F.least("doc", "centre").alias("u"), F.greatest("doc", "centre").alias("v")).distinct())
            star = store(star.join(tested, ["u", "v"], "left_anti"), "jaccard-star")
            more = self._verify(star)
            old = (links, tested)
            links = store(comps.select(F.col("vertex").alias("u"), F.col("component").alias("v")).union(more),
                          "jaccard-links")
            tested = store(tested.union(star), "jaccard-tested")
            forget(comps, rest, star, more, *old)
        dense, sparse = self._families(rest)
        near = self._near_in_keys(sparse)
        pairs = store(near.join(tested, ["u", "v"], "left_anti"), "jaccard-pairs")
        last = self._verify(pairs).union(self._verify_families(dense))
        out = connected_components(comps.select(F.col("vertex").alias("u"), F.col("component").alias("v")).union(last))
        forget(members, tested, links, comps, rest, near, pairs)
        return out

    @staticmethod
    def _families(rest: DataFrame):
        """Split open keys: ``(dense, sparse)``. Members of keys with ``FAMILY_KEY`` or
        more members form families; a family whose keys would make more pairs than
        a share of all its pairs is dense (family, doc, blocks): all its pairs are
        cheaper block by block. All other keys are sparse."""
        big = rest.groupBy("key").agg(F.count("*").alias("g"), F.min("doc").alias("first"),
                                      F.max("cross").alias("cross")).where(f"g >= {FAMILY_KEY}")
        big = store(big, "jaccard-big")
        of = rest.select("key", "doc").join(big, "key")
        family = store(connected_components(of.select(F.col("doc").alias("u"), F.col("first").alias("v")))
                       .withColumnRenamed("component", "family"), "jaccard-family")
        size = family.groupBy("family").agg(F.count("*").alias("n"))
        made = big.join(family, F.col("first") == F.col("vertex")).groupBy("family").agg(F.sum("cross").alias("pairs"))
        heavy = size.join(made, "family").where(f"pairs >= {FAMILY_SHARE} * n * n")
        heavy = store(heavy.select("family", F.ceil(F.col("n") / FAMILY_BLOCK).cast("int").alias("blocks")),
                      "jaccard-heavy")
        dense = store(family.join(heavy, "family").select("family", F.col("vertex").alias("doc_id"), "blocks"),
                      "jaccard-dense")
        done = big.join(dense, F.col("first") == F.col("doc_id")).select("key")
        sparse = store(rest.join(done, "key", "left_anti"), "jaccard-sparse")
        forget(big, family, heavy)
        return dense, sparse

    def _verify_families(self, dense: DataFrame) -> DataFrame:
        """Links of all pairs of every dense family, by pairs of blocks of about
        ``FAMILY_BLOCK`` sets; only connecting edges leave a task."""
        ids = store(dense.select("doc_id").distinct(), "jaccard-ids")
        sets = arrow_map(only_ids(self.texts, ids, ["doc_id"]), _set_rows(self.k), SETS_SCHEMA)
        block = F.pmod(F.xxhash64("doc"), "blocks").cast("int")
        blocks = (sets.join(dense, F.col("doc") == F.col("doc_id")).select("family", block.alias("b"), "doc", "s")
                  .groupBy("family", "b").agg(F.collect_list(F.struct("doc", "s")).alias("m"))
                  .select("family", "b", F.col("m.doc").alias("docs"), F.col("m.s").alias("sets")))
        blocks = store(blocks, "jaccard-blocks")
        met = (blocks.alias("x").join(blocks.alias("y"), "family").where("x.b <= y.b")
               .select("x.docs", "x.sets", F.col("y.docs").alias("docs2"), F.col("y.sets").alias("sets2")))
        return store(arrow_map(met, _family_rows(self.num, self.den), "u long, v long"), "jaccard-links")

    def components(self) -> DataFrame:
        """Per input row: doc_id, n_shingles, component_id (least linked doc_id)."""
        comps = self.class_components()
        heads = store(self.classes.join(comps, F.col("rep") == F.col("vertex"), "left")
                      .select("n", "fa", "fb", F.coalesce("component", "rep").alias("comp")), "jaccard-heads")
        rows = self.index.select("doc_id", "n", "fa", "fb")
        return (rows.join(heads, ["n", "fa", "fb"], "left")
                .select("doc_id", F.col("n").alias("n_shingles"),
                        F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id")))
