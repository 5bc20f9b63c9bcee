"""Word shingles and their min-hash signatures, with numpy, for one batch of texts inside a Spark task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text handled at once; longer texts are cut at white space.
CHUNK = 1 << 18
_rng = np.random.default_rng(20240607)
LOWER = np.arange(256)
LOWER[65:91] += 32
LETTER = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)[LOWER] * np.uint64(2) + np.uint64(1)
BASE, STEP, M1, M2, OTHER = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xA0761D6478BD642F))
S33, S32 = np.uint64(33), np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> S33)) * M1
    x = (x ^ (x >> S33)) * M2
    return x ^ (x >> S33)


def _hashed(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each word (A-Z as a-z), and where it starts."""
    data = np.frombuffer(raw, np.uint8)
    solid = ~SPACES[data]
    starts = np.flatnonzero(solid & ~np.concatenate(([False], solid[:-1])))
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    ends = np.flatnonzero(solid & ~np.concatenate((solid[1:], [False]))) + 1
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    powers = np.cumprod(np.full(int(sizes.max()), BASE, np.uint64), dtype=np.uint64)
    place = np.arange(int(sizes.sum()), dtype=np.int64) - np.repeat(first, sizes)
    return mix(np.add.reduceat(LETTER[data[solid]] * powers[place], first) + sizes.astype(np.uint64)), starts


def word_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For each text, the hashes of its words in order."""
    i = 0
    while i < len(texts):
        if len(texts[i]) > CHUNK:
            parts, at, raw = [], 0, texts[i]
            while at < len(raw):
                end = at + CHUNK
                if end < len(raw):
                    end = max(cut for s in b" \t\n\x0b\x0c\r" if (cut := raw.rfind(bytes([s]), at, end) + 1) >= 0)
                    if end <= at:  # a word longer than the chunk: to its end
                        rest = np.flatnonzero(SPACES[np.frombuffer(raw, np.uint8, offset=at)])
                        end = at + int(rest[0]) + 1 if len(rest) else len(raw)
                parts.append(_hashed(raw[at:end])[0])
                at = end
            yield np.concatenate(parts)
            i += 1
            continue
        j, size = i, 0
        while j < len(texts) and size + len(texts[j]) <= CHUNK:
            size += len(texts[j]) + 1
            j += 1
        j = max(j, i + 1)
        hashes, starts = _hashed(b"\n".join(texts[i:j]))
        limits = np.cumsum([len(t) + 1 for t in texts[i:j]])
        yield from np.split(hashes, np.searchsorted(starts, limits[:-1]))
        i = j


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct hashes of runs of n words; of fewer words, their one sequence; of none, nothing."""
    if not len(words):
        return words
    size = min(n, len(words))
    out = np.full(len(words) - size + 1, np.uint64(size))
    for k in range(size):
        out = mix(out * STEP + words[k : len(words) - size + 1 + k])
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


class MinHash:
    """bands x rows minima under universal hash functions (a * x + b) >> 32 on 64 bits."""

    def __init__(self, bands: int, rows: int, seed: int = 971):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row for each set, none of them empty."""
        flat = np.concatenate(sets)
        starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
        out = np.empty((len(sets), len(self.a)), np.uint32)
        for i, (a, b) in enumerate(zip(self.a, self.b, strict=True)):
            out[:, i] = np.minimum.reduceat(((flat * a + b) >> S32).astype(np.uint32), starts)
        return out

    def band_keys(self, signatures: np.ndarray) -> np.ndarray:
        """A 64-bit key for each band, which holds the band's number too."""
        cells = signatures.reshape(len(signatures), self.bands, self.rows).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64), cells.shape[:2])
        for j in range(self.rows):
            key = mix(key * STEP + cells[:, :, j])
        return key.view(np.int64)
