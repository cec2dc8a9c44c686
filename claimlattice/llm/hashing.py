"""Vectorised word and shingle fingerprints of whole texts (numpy, on executors)."""

from __future__ import annotations

import numpy as np

M64 = (1 << 64) - 1
#: Texts are worked through in pieces of about this many bytes, cut at white space.
PIECE = 1 << 20
#: White space of words: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0xD6E8FEB86659FD93)
_POWER = 0x2545F4914F6CDD1D
_cache: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> np.uint64(32))
    x = x * _MUL
    x = x ^ (x >> np.uint64(29))
    x = x * _STEP
    return x ^ (x >> np.uint64(32))


#: Bytes that are mixed together before sums are taken of them.
WIDE = 8
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Keeps the first n bytes of a little-endian number.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(WIDE + 1)], np.uint64)


def octets(data: np.ndarray) -> np.ndarray:
    """At each place the number made of the bytes from there on (zeros behind the end)."""
    padded = np.concatenate((data, np.zeros(WIDE, np.uint8)))
    return np.ndarray(len(data), "<u8", padded, strides=(1,)).copy()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_cache.get("up", ())) < n:
        inverse = pow(_POWER, -1, 1 << 64)
        for name, base in (("up", _POWER), ("down", inverse)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _cache[name] = np.cumprod(p, dtype=np.uint64)
    return _cache["up"], _cache["down"]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Running sums s with hash(values[i:j]) = (s[j] - s[i]) * down[i].

    Sums modulo 2^64 are no fingerprint of bytes (some texts of two letters
    agree in all of them), so the values must be mixed: see ``octets``.
    """
    up, _ = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums


def word_hashes(data: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Start and fingerprint of every word of a buffer of bytes."""
    starts, hashes, lo, n = [], [], 0, len(data)
    while lo < n:
        hi = min(lo + PIECE, n)
        while hi < n:
            gap = SPACE[data[hi : hi + PIECE]]
            if gap.any():
                hi += int(gap.argmax())
                break
            hi = min(hi + PIECE, n)
        piece = data[lo:hi]
        inside = np.zeros(len(piece) + 2, np.int8)
        inside[1:-1] = ~SPACE[piece]
        turn = np.diff(inside)
        begin, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        # Of each place the bytes up to the word's end count.
        ends = np.zeros(len(piece) + 1, np.int64)
        ends[end] = end
        ends = np.minimum.accumulate(np.where(ends > 0, ends, len(piece))[::-1])[::-1][1:] if len(end) else ends[1:]
        reach = np.minimum(ends - np.arange(len(piece)), WIDE)
        values = mix((octets(LOWER[piece] if lower else piece) & FIRST[reach]) + reach.astype(np.uint64) * _STEP)
        sums = prefix_sums(values)
        hashes.append(mix((sums[end] - sums[begin]) * powers(len(piece) + 1)[1][begin]))
        starts.append(begin + lo)
        lo = hi
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def chain(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One step of a fingerprint over a sequence of words; order counts."""
    first = first * _STEP
    return (first ^ (first >> np.uint64(31))) + second


def text_words(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, fingerprints, bounds): the words of some texts; those of text i are ``bounds[i]`` to ``bounds[i + 1]``.

    Starts count from the begin of the first text, with one byte between texts.
    """
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    starts, h = word_hashes(np.frombuffer(b"\n".join(texts), np.uint8), lower)
    return starts, h, np.append(np.searchsorted(starts, np.cumsum(sizes) - sizes), len(h))


def shingles_of(h: np.ndarray, first: np.ndarray, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, bounds): shingles of k words of the runs ``h[first[i]:first[i] + words[i]]``, in order, with repeats.

    A run of 1 to k - 1 words has its whole sequence as its one shingle.
    """
    counts = np.where(words >= k, words - k + 1, (words > 0).astype(np.int64))
    bounds = np.concatenate(([0], np.cumsum(counts)))
    out = np.zeros(bounds[-1], np.uint64)
    m = len(h) - k + 1
    if m > 0:
        acc = h[:m]
        for j in range(1, k):
            acc = chain(acc, h[j : j + m])
        at = np.repeat(first - bounds[:-1], counts) + np.arange(bounds[-1])
        long = np.repeat(words >= k, counts)
        out[long] = acc[at[long]]
    short = np.flatnonzero((words > 0) & (words < k))
    if len(short):
        acc = h[first[short]]
        for j in range(1, k - 1):
            more = words[short] > j
            acc[more] = chain(acc[more], h[first[short][more] + j])
        out[bounds[short]] = acc ^ (np.uint64(0xA5A5A5A5) * words[short].astype(np.uint64))
    return mix(out), bounds


def shingles(texts: list[bytes], k: int, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprints, bounds, words): shingles of k words of each text, and how many words it has.

    Text i has ``fingerprints[bounds[i]:bounds[i + 1]]`` and ``words[i]`` words.
    """
    _, h, at = text_words(texts, lower)
    words = np.diff(at)
    return *shingles_of(h, at[:-1], words, k), words


def slabs(lengths, most: int = PIECE):
    """Slices of consecutive texts of about ``most`` bytes in all, one text at least."""
    begin, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield slice(begin, i)
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield slice(begin, len(lengths))


def texts_of(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null: empty."""
    return [b"" if t is None else t for t in column.cast("binary").to_pylist()]
