"""Vectorised text helpers for Arrow tasks: whole texts as byte or character
buffers, word and shingle hashes, per-document sets.

Everything works slice by slice (about ``SLICE`` bytes of text at a time), so
a task's memory does not depend on how many or how long its documents are,
apart from a single document's own length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
#: Word separators: space and the control characters 9 to 13.
SEPARATORS = b" \t\n\v\f\r"

U64 = np.uint64
_P = U64(0x9E3779B97F4A7C15)
_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_is_sep = np.zeros(256, dtype=bool)
_is_sep[list(SEPARATORS)] = True


def mix(x):
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_byte_value = mix(np.arange(1, 257, dtype=U64) * _P)
_byte_value[65:91] = _byte_value[97:123]  # A-Z as a-z


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self):
        self.up = np.ones(1, dtype=U64)
        self.down = np.ones(1, dtype=U64)

    def get(self, n: int):
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            up = np.full(size, _P, dtype=U64)
            up[0] = 1
            down = np.full(size, _INV, dtype=U64)
            down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def utf8_views(column) -> list:
    """Each text of an Arrow string column as a memory view of its UTF-8
    bytes (empty for null), without decoding."""
    if isinstance(column, pa.ChunkedArray):
        return [v for c in column.chunks for v in utf8_views(c)]
    wide = pa.types.is_large_string(column.type)
    bufs = column.buffers()
    n = len(column)
    if n == 0 or bufs[2] is None:
        return [memoryview(b"")] * n
    off = np.frombuffer(bufs[1], dtype=np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].tolist()
    data = memoryview(bufs[2])
    if column.null_count == 0:
        return [data[off[i]:off[i + 1]] for i in range(n)]
    valid = column.is_valid().to_pylist()
    return [data[off[i]:off[i + 1]] if valid[i] else memoryview(b"") for i in range(n)]


def slices(views, limit: int = SLICE):
    """Cut a list of byte views into (lo, hi) runs of about ``limit`` bytes."""
    lo, size = 0, 0
    for i, v in enumerate(views):
        if size and size + len(v) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(v) + 1
    if lo < len(views):
        yield lo, len(views)


def joined(views):
    """One byte buffer with a newline before each text and at the end, and
    the position after each of these newlines."""
    size = sum(map(len, views)) + len(views) + 1
    buf = np.full(size, 10, dtype=np.uint8)
    starts = np.empty(len(views) + 1, dtype=np.int64)
    at = 1
    for i, v in enumerate(views):
        starts[i] = at
        if len(v):
            buf[at:at + len(v)] = np.frombuffer(v, dtype=np.uint8)
        at += len(v) + 1
    starts[len(views)] = at
    return buf, starts


def words_of(buf, starts):
    """Hashes of the words (A-Z lower-cased) and, for each text, the position
    of its first word in them (one more entry than texts)."""
    sep = _is_sep[buf]
    begin = np.flatnonzero(sep[:-1] & ~sep[1:]) + 1
    end = np.flatnonzero(~sep[:-1] & sep[1:]) + 1
    up, down = _powers.get(len(buf) + 1)
    total = np.empty(len(buf) + 1, dtype=U64)
    total[0] = 0
    np.cumsum(_byte_value[buf] * up[:len(buf)], out=total[1:])
    h = mix((total[end] - total[begin]) * down[begin])
    return h, np.searchsorted(begin, starts), begin, end


def shingle_sets(views, n: int):
    """Distinct ``n``-word shingles of each text (with fewer words, the whole
    sequence as one) as sorted 64-bit hashes: (hashes, offsets)."""
    buf, starts = joined(views)
    h, first, _, _ = words_of(buf, starts)
    return shingle_sets_of_words(h, first, n)


def shingle_sets_of_words(h, first, n: int):
    docs = len(first) - 1
    counts = np.diff(first)
    if len(h) >= n:
        s = h[:len(h) - n + 1].copy()
        for j in range(1, n):
            s = mix(s * _P + h[j:len(h) - n + 1 + j])
    else:
        s = np.empty(0, dtype=U64)
    out, offsets = [], np.zeros(docs + 1, dtype=np.int64)
    for i in range(docs):
        k = int(counts[i])
        if k >= n:
            a = int(first[i])
            x = np.sort(s[a:a + k - n + 1])
            if len(x) > 1:
                keep = np.empty(len(x), dtype=bool)
                keep[0] = True
                np.not_equal(x[1:], x[:-1], out=keep[1:])
                x = x[keep]
        elif k:
            v = U64(k)
            with np.errstate(over="ignore"):
                for w in h[int(first[i]):int(first[i]) + k]:
                    v = mix(v * _P + w)
            x = np.array([v], dtype=U64)
        else:
            x = np.empty(0, dtype=U64)
        out.append(x)
        offsets[i + 1] = offsets[i] + len(x)
    return (np.concatenate(out) if out else np.empty(0, dtype=U64)), offsets
