"""Word shingles as numbers, order min-hash sketches and banded alignment, over blocks of texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

from leafmill.llm.decontaminate import PLAIN

SHINGLE = 5
BLOCK_BYTES = 1 << 20
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_BASE = 0x2545F4914F6CDD1D
_BYTES = np.random.default_rng(3).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[32] = 0
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    return x * np.uint64(0xD6E8FEB86659FD93) ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def plain(text: str) -> bytes:
    """The text's words, lower-cased, between single blanks."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(PLAIN).split())


def digest(line: bytes) -> bytes:
    return hashlib.blake2b(line, digest_size=16).digest()


def _pieces(line: bytes) -> Iterator[bytes]:
    """A line cut at blanks into pieces of about the block size."""
    while len(line) > BLOCK_BYTES:
        cut = line.find(b" ", BLOCK_BYTES)
        if cut < 0:
            break
        yield line[:cut]
        line = line[cut + 1:]
    yield line


def word_numbers(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word of all lines, and where each line's words begin."""
    joined = np.frombuffer(b" ".join(lines) + b" ", np.uint8)
    up, down = _power(len(joined) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[joined] * up[:len(joined)], dtype=np.uint64)])
    blank = joined == 32
    ends = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    begins = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])])
    return mix((sums[ends] - sums[starts]) * down[starts]), np.searchsorted(starts, begins)


def shingle_numbers(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit numbers of the shingles of all lines in text order, and where each line's begin.  A line of fewer words,
    but at least one, has one shingle of all of them."""
    pieces = [(i, p) for i, line in enumerate(lines) for p in _pieces(line)]
    if len(pieces) == len(lines):
        words, bounds = word_numbers(lines)
    else:
        parts = [(i, *word_numbers([p])) for i, p in pieces]
        words = np.concatenate([w for _, w, _ in parts])
        sizes = np.bincount([i for i, _, _ in parts], [len(w) for _, w, _ in parts], len(lines)).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
    sizes = np.diff(bounds)
    padded = np.concatenate([words, np.zeros(SHINGLE - 1, np.uint64)])
    rolled = sum(padded[k:len(words) + k] * _K[k] for k in range(SHINGLE))
    whole = np.arange(len(words)) + SHINGLE <= np.repeat(bounds[1:], sizes)
    for line in np.flatnonzero((sizes > 0) & (sizes < SHINGLE)):
        own = slice(bounds[line], bounds[line + 1])
        rolled[bounds[line]] = (words[own] * np.array(_K[:sizes[line]])).sum(dtype=np.uint64) + np.uint64(sizes[line])
        whole[bounds[line]] = True
    numbers = (mix(rolled[whole]) >> np.uint64(32)).astype(np.uint32)
    return numbers, np.concatenate([[0], np.cumsum(whole)])[bounds]


def labelled(numbers: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit numbers of the shingles with their occurrence in the line: the second of equal ones differs from the first."""
    sizes = np.diff(bounds)
    key = np.repeat(np.arange(len(sizes), dtype=np.uint64) << np.uint64(32), sizes) | numbers
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(key) else np.zeros(0, bool)
    run = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
    nth = np.zeros(len(key), np.uint64)
    nth[order] = np.arange(len(key)) - run
    return mix(numbers.astype(np.uint64) * _K[1] + nth * _K[2] + _K[3])


def sketches(numbers: np.ndarray, bounds: np.ndarray, kept: int, count: int, seed: int) -> np.ndarray:
    """Order min-hash: for each line ``count`` keys, each of the ``kept`` labelled shingles that are least under its own
    hash function, in the order of the text.  Lines without shingles get zeros; fewer shingles than ``kept`` are all taken."""
    out = np.zeros((len(bounds) - 1, count), np.uint64)
    sizes = np.diff(bounds)
    lines = np.flatnonzero(sizes)
    if not len(lines):
        return out
    marks, starts, sizes = labelled(numbers, bounds), bounds[:-1][lines], sizes[lines]
    line_of = np.repeat(np.arange(len(lines)), sizes)
    most = np.iinfo(np.uint64).max
    seeds = np.random.default_rng(seed).integers(1, 1 << 63, count, np.uint64)
    far = len(marks)
    padded = np.concatenate([marks, np.zeros(1, np.uint64)])
    for j in range(count):
        hashed = mix(marks ^ seeds[j])
        places = np.full((kept, len(lines)), far)
        for r in range(kept):
            least = np.minimum.reduceat(hashed, starts)
            hit = np.flatnonzero((hashed == least[line_of]) & (hashed != most))
            places[r, line_of[hit]] = hit
            hashed[hit] = most
        key = np.full(len(lines), seeds[j])
        for place in np.sort(places, 0):
            key = mix(key * _K[0] + padded[place])
        out[lines, j] = key
    return out


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence of two sequences along paths that leave the diagonal by at most ``band``.

    Common ends are taken first; the rest runs row by row with a row of the band as the bits of one integer, whose
    zeros mark the columns where the subsequence grows."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(same.argmin())
    n -= head
    same = a[len(a) - n:][::-1] == b[len(b) - n:][::-1]
    tail = n if same.all() else int(same.argmin())
    a, b = a[head:len(a) - tail].tolist(), b[head:len(b) - tail].tolist()
    if not a or not b:
        return head + tail
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    width = 2 * band + 1
    full, row, passed = (1 << width) - 1, (1 << width) - 1, 0
    for i, x in enumerate(a):
        if i:
            passed += not row & 1
            row = row >> 1 | 1 << (width - 1)
        matches = 0
        for j in places.get(x, ()):
            if abs(j - i) <= band:
                matches |= 1 << (j - i + band)
        if matches:
            hit = row & matches
            row = (row + hit | row - hit) & full
    return head + tail + passed + width - row.bit_count()


def similar(a: np.ndarray, b: np.ndarray, tenths: int) -> bool:
    """Whether the aligned share of all shingles, common / (a + b - common), is at least ``tenths`` / 10."""
    total = len(a) + len(b)
    need = -(-tenths * total // (10 + tenths))
    if need > min(len(a), len(b)):
        return False
    return aligned(a, b, total - 2 * need) >= need
