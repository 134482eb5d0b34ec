"""Vectorised byte kernels that the operators share. Everything here works on numpy arrays of one task."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Texts are worked on in slices of about this many bytes, which keeps the 64-bit temporaries small.
SLICE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and int64 offsets (rows + 1); null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(raw[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE):
    """Ranges of rows [i, j) that hold at most `most` bytes, or one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def byte_values(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept and grown by doubling."""
    if not _powers or len(_powers["up"]) < n:
        m = 1 << max(12, int(n - 1).bit_length())
        inverse = pow(_BASE, -1, 2**64)
        for name, base in (("up", _BASE), ("down", inverse)):
            out = np.ones(1, U64)
            step = base
            while len(out) < m:
                out = np.concatenate([out, out * U64(step)])
                step = step * step % 2**64
            _powers[name] = out
    return _powers["up"], _powers["down"]


def words(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes with is_word[byte]; no run crosses a row bound."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = is_word[data]
    first = w.copy()
    first[1:] &= ~w[:-1]
    last = w.copy()
    last[:-1] &= ~w[1:]
    inner = bounds[(bounds > 0) & (bounds < n)]
    first[inner] = w[inner]
    last[inner - 1] = w[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span (ordered by start) from prefix sums of a polynomial modulo 2**64."""
    out = np.empty(len(starts), U64)
    i, n = 0, len(starts)
    while i < n:
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, low + SLICE, "right")))
        high = int(ends[i:j].max())
        up, down = powers(high - low)
        sums = np.zeros(high - low + 1, U64)
        np.cumsum(values[data[low:high]] * up[: high - low], out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(U64)
        i = j
    return mix(out)


#: Words longer than this are hashed one by one, by a cryptographic digest.
LONG_WORD = 128


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each span that has no algebraic collisions: its bytes go through the finaliser eight at a time.

    Spans of one length of at most 8 bytes never collide. span_hashes() is for spans of one fixed length of some tens of bytes; its polynomial
    maps some different texts of 1,024 bytes and more onto one value.
    """
    length = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = mix(length.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(seed))
    for k in range(0, LONG_WORD, 8):
        live = np.flatnonzero((length > k) & (length <= LONG_WORD)) if k else np.flatnonzero(length <= LONG_WORD)
        if not len(live):
            break
        spare = (8 - np.minimum(length[live] - k, 8)).astype(U64) * U64(8)
        some = spare < U64(64)
        chunk = np.where(some, eight[np.minimum(starts[live] + k, len(data))] << (spare % U64(64)), U64(0))
        out[live] = mix(out[live] ^ chunk)
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, at: np.ndarray, until: np.ndarray) -> np.ndarray:
    """Whether spans of equal word_hashes() are equal byte by byte. Of at most 8 bytes, they are if their lengths are."""
    size = until - at
    same = ends - starts == size
    long = np.flatnonzero(same & (size > 8))
    for i, j in slices(np.concatenate([[0], np.cumsum(size[long])])) if len(long) else ():
        some = long[i:j]
        differs = data[aranges(starts[some], size[some])] != other[aranges(at[some], size[some])]
        same[some] = np.add.reduceat(differs, np.cumsum(size[some]) - size[some], dtype=np.int64) == 0
    return same


def vocabulary(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(seed, sorted hashes of the distinct words, a span that has each, each span's word). The seed is raised until no two words share a hash."""
    while True:
        hashes, once, at = np.unique(word_hashes(data, starts, ends, seed), return_index=True, return_inverse=True)
        if same_spans(data, starts, ends, data, starts[once][at], ends[once][at]).all():
            return seed, hashes, once, at
        seed += 1_000


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII capitals to small letters, byte by byte."""
    return _LOWER[data]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def aranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + count)."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(total)


def pack(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
