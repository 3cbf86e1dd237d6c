"""Word shingles as 64-bit hashes, text by text inside the tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers, one per place of a shingle (the usual mixing constants of 64-bit hashes).
PLACES = np.array(
    [0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], dtype=np.uint64
)
SIZE = 5
#: Bytes that are hashed at once; longer texts are cut between words.
CHUNK = 1 << 19
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
GAPS = b" \t\n\r\x0b\x0c"
BASE, SEED = 0x5851F42D4C957F2D, 41


def mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Sorted distinct shingle hashes of a text.

    Words are runs of anything but space, tab and U+000A to U+000D, with A-Z
    in lower case; those are single bytes in UTF-8, so bytes are looked at.  A
    word's hash is a polynomial over random values of its bytes, taken from
    running sums.  A text of fewer than ``SIZE`` words is one shingle, a text
    without words none.
    """

    def __init__(self):
        self.values = np.random.default_rng(SEED).integers(0, 2**64, 256, dtype=np.uint64)
        self.gap = np.zeros(256, np.int8)
        self.gap[list(GAPS)] = 1
        self.up = self.down = np.ones(1, np.uint64)

    def runs(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the byte runs [start, end) of ``raw``."""
        if len(raw) > len(self.up):
            n = 1 << (len(raw) - 1).bit_length()
            self.up, self.down = _powers(BASE, n), _powers(pow(BASE, -1, 2**64), n)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.values[raw] * self.up[: len(raw)], out=sums[1:])
        return mixed((sums[end] - sums[start]) * self.down[start])

    def cuts(self, data: bytes):
        """[start, end) of pieces of about ``CHUNK`` bytes that end between words."""
        at = 0
        while at < len(data):
            cut = min(at + CHUNK, len(data))
            while cut < len(data) and data[cut] not in GAPS:
                cut += 1
            yield at, cut
            at = cut

    def _chunk(self, data: bytes) -> np.ndarray:
        raw = np.frombuffer(data, np.uint8)
        gap = np.ones(len(raw) + 2, np.int8)
        gap[1:-1] = self.gap[raw]
        turns = np.flatnonzero(gap[1:] != gap[:-1])
        return self.runs(raw, turns[::2], turns[1::2]) if len(turns) else np.empty(0, np.uint64)

    def words(self, data: bytes) -> np.ndarray:
        data = data.translate(LOWER)
        parts = [self._chunk(data[lo:hi]) for lo, hi in self.cuts(data)]
        return parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, np.uint64), *parts])

    def __call__(self, text: str | None) -> np.ndarray:
        w = self.words(text.encode("utf-8", "surrogatepass")) if text else np.empty(0, np.uint64)
        if not len(w):
            return w
        places = min(SIZE, len(w))
        n = len(w) - places + 1
        out = np.full(n, places, dtype=np.uint64)
        for k in range(places):
            out += w[k : k + n] * PLACES[k]
        out = mixed(out)
        out.sort()
        return out[np.concatenate(([True], out[1:] != out[:-1]))]


def digest(tokens: np.ndarray) -> bytes:
    """128 bits that name a set of shingles."""
    return xxhash.xxh3_128_digest(tokens.tobytes())
