"""Word shingles as sorted arrays of 64-bit hashes, and b-bit MinHash signatures of them."""

from __future__ import annotations

import numpy as np
import xxhash

K = 5
MULT = np.uint64(0x9E3779B97F4A7C15)
#: Bands times rows of minima. A pair of similarity s shares no band with probability (1 - s^ROWS)^BANDS: 8e-7 at 0.85, 5e-5 at 0.8 with 24 bands.
BANDS, ROWS = 24, 5
PERMS = BANDS * ROWS
#: Low bits of each minimum that the packed signature keeps.
BITS = 4


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


#: Bytes that separate words.
SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
#: Bytes of text that are hashed together; a longer text is cut between words.
SEGMENT = 1 << 16
#: Longer words are hashed one by one.
LONG_WORD = 64
INVERSE = pow(int(MULT), -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


_held: dict[str, np.ndarray] = {"table": np.random.default_rng(20240102).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)}


def _hash_words(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the words of lower-case bytes that begin and end with a separator.

    The hash is a polynomial in the word's bytes, taken from running sums of the whole array.
    """
    if len(_held.get("up", ())) < len(x) + 1:
        n = max(SEGMENT + 2, len(x) + 1)
        _held["up"], _held["down"] = _powers(int(MULT), n), _powers(INVERSE, n)
    edge = np.flatnonzero(np.diff(SPACE[x])) + 1
    starts, ends = edge[0::2], edge[1::2]
    sums = _held["table"][x]
    sums *= _held["down"][: len(x)]
    np.cumsum(sums, out=sums)
    h = mix((sums[ends - 1] - sums[starts - 1]) * _held["up"][ends])
    for k in np.flatnonzero(ends - starts > LONG_WORD):
        h[k] = xxhash.xxh3_64_intdigest(x[starts[k] : ends[k]].tobytes())
    return h, starts, ends


def _segments(body: bytes):
    """A long text in pieces that end at a separator."""
    at = 0
    while len(body) - at > SEGMENT:
        piece = np.frombuffer(body, np.uint8, SEGMENT, at)
        gap = np.flatnonzero(SPACE[piece])
        end = at + int(gap[-1]) + 1 if len(gap) else at + SEGMENT
        while not len(gap) and end < len(body) and not SPACE[body[end]]:  # one word runs through the segment
            end += 1
        yield body[at:end]
        at = end
    yield body[at:]


def words_of(bodies: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the hashes of its words in order, and their last two bytes as a number (the second to last is the low one; a word of one byte stands alone).

    A-Z count as lower case; words are separated by \\x20 and \\x09-\\x0D. Short texts are hashed together.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = []
    held: list[bytes] = []
    size = 0
    for body in bodies:
        if held and size + len(body) > SEGMENT:
            out += _hashed(held)
            held, size = [], 0
        if len(body) > SEGMENT:
            parts = [_hashed([piece])[0] for piece in _segments(body)]
            out.append((np.concatenate([h for h, _ in parts]), np.concatenate([t for _, t in parts])))
        else:
            held.append(body)
            size += len(body) + 1
    return out + (_hashed(held) if held else [])


def _hashed(bodies: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    x = np.frombuffer((b" " + b" ".join(bodies) + b" ").lower(), np.uint8)
    h, starts, ends = _hash_words(x)
    last = x[ends - 1].astype(np.uint16)
    tail = np.where(ends - starts > 1, x[ends - 2] | last << np.uint16(8), last)
    at = np.searchsorted(starts, np.cumsum([1] + [len(b) + 1 for b in bodies]))
    return [(h[a:b], tail[a:b]) for a, b in zip(at[:-1], at[1:])]


def hashes_of(bodies: list[bytes]) -> list[np.ndarray]:
    """Hashes of the words of each text in order; see ``words_of``."""
    return [h for h, _ in words_of(bodies)]


def shingles(words: np.ndarray, k: int = K) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words count as one shingle, none as none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    width = min(k, n)
    h = np.full(max(1, n - k + 1), width, np.uint64)
    for j in range(width):
        h = h * MULT + words[j : j + len(h)]
        h ^= h >> np.uint64(31)
    return np.unique(mix(h))


def _multipliers() -> np.ndarray:
    return np.random.default_rng(20240101).integers(1, 2**63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


A = _multipliers()


def minima(sh: np.ndarray) -> np.ndarray:
    """PERMS minima (32 bits each) of a set of shingles that isn't empty."""
    out = np.full(PERMS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(sh), 1024):
        np.minimum(out, (A[:, None] * sh[None, at : at + 1024]).min(axis=1), out=out)
    return mix(out) >> np.uint64(32)


def band_keys(m: np.ndarray) -> np.ndarray:
    v = m.reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        h = mix(h * MULT + v[:, j])
    return h.astype(np.int64)


def pack(m: np.ndarray) -> bytes:
    """The low BITS of each minimum, two to a byte."""
    low = (m & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return (low[0::2] << 4 | low[1::2]).tobytes()


def matches(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """How many of the kept minima of packed signatures agree: both nibbles of the exclusive or that are zero."""
    x = one ^ many
    return ((x & 0xF0) == 0).sum(axis=-1) + ((x & 0x0F) == 0).sum(axis=-1)


def estimate(agree: np.ndarray) -> np.ndarray:
    """Similarity from agreeing minima, corrected for those that agree by chance in BITS bits."""
    chance = 1 / (1 << BITS)
    return (agree / PERMS - chance) / (1 - chance)


def slack(threshold: float) -> float:
    """Six standard deviations of the estimate at the threshold."""
    chance = 1 / (1 << BITS)
    p = threshold + (1 - threshold) * chance
    return 6 * (p * (1 - p) / PERMS) ** 0.5 / (1 - chance)
