"""Words of texts as 64-bit hashes, for whole Arrow batches at a time.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D`` of the
UTF-8 text. Its hash is a polynomial over its bytes modulo 2**64, finished by
a mixer, so all words of a batch come from a few numpy passes over the text
buffer. Two different words (or word sequences) share a hash with a chance of
about 2**-64 a pair; the operators that call their comparison exact mean exact
up to that chance.
"""

from __future__ import annotations

import numpy as np

SLICE_BYTES = 1 << 20   # texts are hashed in slices of about this size, cut at word ends
_ROOT = 0x9E3779B97F4A7C15 | 5
_U = np.uint64
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shifts and multiplications)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the root and of its inverse modulo 2**64, grown on demand."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        inverse = pow(_ROOT, -1, 1 << 64)
        _powers[:] = []
        for base in (_ROOT, inverse):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers


def _hash_slice(data: np.ndarray, breaks: np.ndarray, lower: bool):
    """(hashes, start offsets) of the words of one slice; no word crosses a break."""
    white = _WHITE[data]
    first = np.empty(len(data), dtype=bool)
    first[:1] = True
    first[1:] = white[:-1]
    first[breaks[breaks < len(data)]] = True
    last = np.empty(len(data), dtype=bool)
    last[-1:] = True
    last[:-1] = white[1:]
    last[breaks[(breaks > 0) & (breaks <= len(data))] - 1] = True
    black = ~white
    starts = np.flatnonzero(first & black)
    ends = np.flatnonzero(last & black) + 1
    power, inverse = _power_tables(len(data) + 1)
    values = (_LOWER[data] if lower else data).astype(np.uint64)
    values += _U(1)
    values *= power[:len(data)]
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values, out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    h += (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93)
    return mix(h), starts


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null text is empty."""
    import pyarrow as pa
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def word_hashes(column, lower: bool = False):
    """Yield ``(first_row, row_offsets, hashes)`` for consecutive groups of rows.

    ``hashes[row_offsets[i]:row_offsets[i + 1]]`` are the words of row
    ``first_row + i``. Groups hold about ``SLICE_BYTES`` of text, or one longer
    text, which is hashed slice by slice.
    """
    raw, offsets = text_buffers(column)
    rows, i = len(offsets) - 1, 0
    while i < rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, side="right")) - 1)
        lo, hi = offsets[i], offsets[j]
        if hi - lo <= 2 * SLICE_BYTES:
            breaks = offsets[i:j + 1] - lo
            h, starts = _hash_slice(raw[lo:hi], breaks, lower) if hi > lo else (np.zeros(0, np.uint64), breaks[:0])
            yield i, np.searchsorted(starts, breaks), h
        else:
            parts, at = [], lo
            while at < hi:
                to = min(hi, at + SLICE_BYTES)
                if to < hi:  # move the cut behind the word that it would split
                    while to < hi:
                        gap = np.flatnonzero(_WHITE[raw[to:min(hi, to + 4096)]])
                        if len(gap):
                            to += int(gap[0])
                            break
                        to = min(hi, to + 4096)
                parts.append(_hash_slice(raw[at:to], np.zeros(0, np.int64), lower)[0])
                at = to
            h = np.concatenate(parts)
            yield i, np.array([0, len(h)]), h
        i = j


_FACTORS = mix(np.arange(1, 65, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k consecutive words that start at each position (order counts)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = words[:n] * _FACTORS[0]
    for t in range(1, k):
        out += words[t:t + n] * _FACTORS[t]
    return mix(out)


def sequence_hash(words: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a whole word sequence, as signed longs."""
    at = np.arange(1, len(words) + 1, dtype=np.uint64)
    a = mix(words + at * _U(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    b = mix((words ^ _U(0x8EBC6AF09C88C6E3)) * (at * _U(2) + _U(1))).sum(dtype=np.uint64)
    n = _U(len(words))
    pair = mix(np.array([a + n, b ^ n], dtype=np.uint64)).view(np.int64)
    return int(pair[0]), int(pair[1])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.int64).view(np.uint64)
