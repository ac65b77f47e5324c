"""Vectorised word hashing over Arrow string columns (numpy only, used inside Arrow tasks).

Words are cut and hashed on the UTF-8 bytes of a whole batch at once: a byte table says which bytes
belong to words, a polynomial over random byte codes (prefix sums modulo 2**64) hashes every word,
and a finaliser mixes the result. No text is decoded and no Python loop runs over words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
SEGMENT = 1 << 20      # bytes hashed at once; a longer text goes through in several segments

_rng = np.random.default_rng(20240607)
_BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
MIX = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)   # odd multipliers by position


def _lower_codes() -> np.ndarray:
    codes = _BYTE_CODE.copy()
    codes[65:91] = codes[97:123]          # A-Z hash as a-z
    return codes


_CODES = _lower_codes()

# whitespace-delimited words: anything but space and 0x09-0x0D
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
# alphanumeric words: ASCII letters and digits and every byte of a non-ASCII character
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x41:0x5B] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = True


def finalise(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def string_buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def batches_by_bytes(offsets: np.ndarray, most: int = 2 * SEGMENT):
    """Row ranges of about ``most`` text bytes (one longer text alone)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SEGMENT)
        steps = np.full(size, _BASE, U64)
        steps[0] = 1
        inv = np.full(size, _BASE_INV, U64)
        inv[0] = 1
        _powers[:] = [np.cumprod(steps, dtype=U64), np.cumprod(inv, dtype=U64)]
    return _powers[0], _powers[1]


def _segment_words(raw: np.ndarray, inside: np.ndarray, breaks: np.ndarray):
    """Starts, ends and hashes of the words of one segment; ``breaks``: positions where a text begins."""
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[breaks] = inside[breaks]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    b = breaks[breaks > 0] - 1
    last[b] = inside[b]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    if not len(starts):
        return starts, ends, np.zeros(0, U64)
    up, down = _power_tables(len(raw))
    total = np.cumsum(_CODES[raw] * up[:len(raw)], dtype=U64)
    h = total[ends].copy()
    h[starts > 0] -= total[starts[starts > 0] - 1]
    h *= down[starts]
    return starts, ends + 1, finalise(h)


def hash_words(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """Hashes of all words of a batch and, per text, the index of its first word (one more at the end).

    A-Z count as a-z. A segment ends at a byte outside words or at a text's end, so no word is cut.
    """
    hashes, starts_all = [], []
    n, lo = len(raw), 0
    while lo < n:
        hi = min(n, lo + SEGMENT)
        inside = table[raw[lo:hi]]
        if hi < n:
            cut = np.flatnonzero(~inside)
            edge = int(np.searchsorted(offsets, hi, "right")) - 1
            at = max(lo + int(cut[-1]) + 1 if len(cut) else lo, int(offsets[edge]))
            while at <= lo:        # one word longer than a segment: widen until it ends
                hi = min(n, hi + SEGMENT)
                outside = np.flatnonzero(~table[raw[lo:hi]])
                nxt = offsets[np.searchsorted(offsets, lo, "right"):]
                ends = ([lo + int(outside[-1]) + 1] if len(outside) else []) + [int(x) for x in nxt[:1] if x <= hi]
                at = max(ends) if ends else (n if hi == n else lo)
            hi, inside = at, table[raw[lo:at]]
        a, b = np.searchsorted(offsets, [lo, hi], "left")
        s, _, h = _segment_words(raw[lo:hi], inside, np.unique(offsets[a:b] - lo))
        hashes.append(h)
        starts_all.append(s + lo)
        lo = hi
    h = np.concatenate(hashes) if hashes else np.zeros(0, U64)
    s = np.concatenate(starts_all) if starts_all else np.zeros(0, np.int64)
    return h, np.searchsorted(s, offsets, "left")


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words (across text ends as well: the caller masks those)."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, U64)
    total = np.full(count, n, U64)
    for j in range(n):
        total += words[j:j + count] * MIX[j % len(MIX)]
    return finalise(total)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct ``n``-word shingle hashes of one text; a shorter text is one shingle, none has none."""
    if len(words) == 0:
        return np.zeros(0, U64)
    return np.unique(gram_hashes(words, min(n, len(words))))


def lists(values: np.ndarray, lengths, kind) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
