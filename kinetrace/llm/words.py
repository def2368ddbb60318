"""Hashes of words and word sequences for whole batches of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Multipliers of the hashes: odd 64-bit constants without other meaning.
BASE, STEP, TAG = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
CHUNK = 1 << 20

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        steps = np.full(max(n, CHUNK + CHUNK // 4), base, np.uint64)
        steps[0] = 1
        held = _powers[base] = np.multiply.accumulate(steps)
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads each bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: list[str], size: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts as UTF-8 with A-Z lower-cased, about ``size`` bytes each; a longer text is a run of its own."""
    first, held, n = 0, [], 0
    for k, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass").translate(LOWER)
        if held and n + len(raw) > size:
            yield first, held
            first, held, n = k, [], 0
        held.append(raw)
        n += len(raw) + 1
    if held:
        yield first, held


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word ``[^\\x20\\x09-\\x0D]+`` of all texts in order, and the first word of each text and the end."""
    data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(gap, prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    if len(ends) < len(starts):
        ends = np.append(ends, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(BASE, len(data)), out=sums[1:])
    inverse = _power(pow(BASE, -1, 1 << 64), len(data))
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(TAG))
    offsets = np.cumsum([0] + [len(r) + 1 for r in raws])
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(raws: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct ``width``-word shingle hashes of each text; with fewer words the whole sequence, without words none."""
    hashes, bounds = word_hashes(raws)
    n = len(hashes)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        rolled = rolled * np.uint64(STEP) + hashes[k : k + len(rolled)]
    rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            whole = 0
            for h in hashes[a:b].tolist():
                whole = (whole * STEP + h) % (1 << 64)
            out.append(mix(np.array([(whole + (b - a) * TAG) % (1 << 64)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
